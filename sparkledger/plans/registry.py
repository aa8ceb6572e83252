"""Registered queries over the event log, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkledger.functions import codec
from sparkledger.operators import filters, log, runs, workload
from sparkledger.streaming import ingest

EVERY, LIMIT, SNAPSHOT = 250, 800, 500
LOG_SQL = "log AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op, CAST(user_id AS VARCHAR) AS key, CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value FROM events)"
LATEST_SQL = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM log) WHERE n = 1)"
RUNS_SQL = f"runs AS (SELECT * FROM (SELECT *, seq // {EVERY} AS run, row_number() OVER (PARTITION BY seq // {EVERY}, key ORDER BY seq DESC) AS n FROM log) WHERE n = 1)"
LIVE_SQL = f"WITH {LOG_SQL}, {LATEST_SQL} SELECT key, value FROM latest WHERE op = 'PUT'"
MANIFEST = "r1#r2\n\nr3"
LISTING = ("r1", "r3", "r9", "wal", "header")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.flush(log.events_log(spark, d), EVERY)


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The event log's runs as blocks of 4,000 bytes: index and entries."""
    entries = runs.flush(log.events_log(spark, d), 2000).select("run", "key", (F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))).alias("n"))
    blocks = runs.pack_blocks(entries, 1000)
    return blocks.groupBy("run", "block").agg(F.min("key").alias("first_key"), F.min("offset").alias("offset")), entries


def sparse_index_search(spark: SparkSession, d: str) -> DataFrame:
    index, entries = _index(spark, d)
    return runs.search_index(index, entries.select("run", F.concat("key", F.lit("5")).alias("key")))


def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.read.parquet(f"{d}/pages.parquet").select(F.lit(0).cast("long").alias("run"), F.col("page_id").cast("string").alias("key"), (F.octet_length(F.col("page_id").cast("string")) + F.octet_length("html")).alias("n"))
    return runs.pack_blocks(pages)


def commands(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), F.concat_ws(" ", F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "get").when(F.col("event_type") == "click", "PUT").otherwise("put"), F.col("user_id").cast("string"), F.when(~F.col("event_type").isin("error", "view"), F.concat(F.lit("v"), F.col("event_id").cast("string")))).alias("line"))
    return codec.replies(lines)


COMMANDS_SQL = """
WITH c AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS k, event_type AS e,
  CASE WHEN event_type = 'error' THEN 'delete' WHEN event_type = 'view' THEN 'get' WHEN event_type = 'click' THEN 'bad' ELSE 'put' END AS v FROM events),
g AS (SELECT *, max(CASE WHEN v IN ('put', 'delete') THEN seq END) OVER (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_seq FROM c)
SELECT g.seq, CASE WHEN g.v = 'bad' THEN 'Invalid command' WHEN g.v <> 'get' THEN 'Success' WHEN m.v = 'put' THEN 'v' || CAST(m.seq AS VARCHAR) ELSE 'Key not found' END AS response
FROM g LEFT JOIN c m ON m.seq = g.last_seq
"""


def manifest_rows(spark: SparkSession, d: str) -> DataFrame:
    return codec.parse_manifest(spark.createDataFrame([(MANIFEST,)], "text string"))


def _names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in LISTING], "name string")


def orphan_runs(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark).filter(~F.col("name").isin("wal", "header")).join(manifest_rows(spark, d).select(F.col("run_id").alias("name")), "name", "left_anti")


def missing_runs(spark: SparkSession, d: str) -> DataFrame:
    return manifest_rows(spark, d).select(F.col("run_id").alias("name")).join(_names(spark), "name", "left_anti")


def amplification(spark: SparkSession, d: str) -> DataFrame:
    own = runs.assigned(_runs(spark, d), n_runs(spark, d))
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return own.groupBy("level").agg(F.count_distinct("run").alias("n_runs"), F.count("*").alias("n_entries"), F.count_distinct("key").alias("n_keys"), F.sum(size).cast("long").alias("n_bytes"))


def n_runs(spark: SparkSession, d: str) -> Column:
    """How many flushes the event log had, from its sequence numbers alone."""
    last = log.events_log(spark, d).agg(F.max("seq").alias("last"))
    return last.select((F.floor(F.col("last") / EVERY) + 1).cast("long")).scalar()


def wal_decode(spark: SparkSession, d: str) -> DataFrame:
    """The event log as binary files of 250 frames, each with a torn tail, and what is read back from them."""
    frames = log.events_log(spark, d).select(F.floor(F.col("seq") / EVERY).cast("long").alias("file"), F.struct("seq", codec.frame(F.col("op"), F.col("key"), F.col("value")).alias("hex")).alias("f"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["hex"]), "")  # a file holds 250 frames at most
    files = frames.groupBy("file").agg(F.unhex(F.concat(joined, F.lit("010300000000"))).alias("content")).select(F.col("file").cast("string").alias("path"), "content")
    return codec.decode_frames(files).select("path", "seq", "op", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def level_list(spark: SparkSession, d: str) -> DataFrame:
    """level, pos and run_id of the event log's runs, one row for each run."""
    levels = log.events_log(spark, d).select(F.floor(F.col("seq") / EVERY).cast("long").alias("run")).distinct()
    placed = levels.withColumn("level", runs.level_of(F.col("run"), n_runs(spark, d)))
    return placed.select("level", F.row_number().over(Window.partitionBy("level").orderBy("run")).alias("pos"), F.concat(F.lit("r"), F.col("run").cast("string")).alias("run_id"))


def recovery_check(spark: SparkSession, d: str) -> DataFrame:
    """What an open finds wrong in a listing: runs that the manifest doesn't name, and runs of it that aren't there. Every seventh run is gone, every fifth has a twin."""
    named = codec.parse_manifest(codec.manifest_text(level_list(spark, d))).select(F.col("run_id").alias("name"))
    number = F.substring("run_id", 2, 20).cast("long")
    there = level_list(spark, d).select("run_id", number.alias("n"))
    listing = there.filter("n % 7 <> 0").select(F.col("run_id").alias("name")).unionByName(there.filter("n % 5 = 0").select(F.concat(F.lit("x"), "run_id").alias("name")))
    orphans = listing.join(named, "name", "left_anti").select(F.lit("orphan").alias("kind"), "name")
    return orphans.unionByName(named.join(listing, "name", "left_anti").select(F.lit("missing").alias("kind"), "name"))


def filtered_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every run is asked for the keys of the run before it; its filter first."""
    own = _runs(spark, d)
    return filters.filtered_lookup(own, filters.build(own), own.select((F.col("run") + 1).alias("run"), "key"))


def run_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Filter, index and block: every run is asked for its keys and for keys that lie between them."""
    own = runs.flush(log.events_log(spark, d), 2000)
    entries = own.select("run", "key", runs.entry_size().alias("n"))
    blocks = runs.pack_blocks(entries, 1000)
    index = blocks.groupBy("run", "offset").agg(F.min("key").alias("first_key"))
    asked = entries.select("run", "key").unionByName(entries.select("run", F.concat("key", F.lit("5")).alias("key"))).distinct()
    return runs.lookup(blocks.join(own.select("run", "key", "value"), ["run", "key"]), index, asked)


def table_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the event log's runs and of what lives in them, as names and numbers."""
    own = _runs(spark, d)
    one = own.agg(F.count_distinct("run").alias("runs"), F.count("*").alias("entries"), F.sum(F.when(F.col("op") == "DELETE", 1).otherwise(0)).alias("tombstones"), F.sum(runs.entry_size()).alias("bytes"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    two = log.replay(log.events_log(spark, d)).agg(F.count("*").alias("live_keys"), F.sum(runs.entry_size()).alias("live_bytes"))
    both = one.join(F.broadcast(two))  # one row each
    both = both.withColumn("overhead_percent", F.floor(F.col("bytes") * 100 / F.col("live_bytes")))
    return both.select(F.explode(F.create_map(*[x for c in both.columns for x in (F.lit(c), F.col(c).cast("long"))])).alias("metric", "number"))


def mixes(spark: SparkSession, d: str) -> DataFrame:
    found = [workload.summary(workload.generated(spark, 20_000, 100, 5_100, 50, w[:3], w[3])).withColumn("mix", F.lit(m)) for m, w in workload.MIXES.items()]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "replay": lambda s, d: log.replay(log.events_log(s, d)),
    "replay_orders": lambda s, d: log.replay(log.orders_log(s, d)),
    "latest_with_tombstones": lambda s, d: log.latest(log.events_log(s, d)),
    "point_get": lambda s, d: log.replay(log.events_log(s, d).filter(F.col("key") == "7")),
    "multi_get": lambda s, d: log.multi_get(log.events_log(s, d), s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("key"))),
    "memtable_size": lambda s, d: log.memtable_sizes(log.events_log(s, d)),
    "run_assignment": lambda s, d: level_list(s, d).select(F.substring("run_id", 2, 20).cast("long").alias("run"), "level"),
    "compact_level": lambda s, d: runs.merge(_runs(s, d).withColumn("target", F.floor(F.col("run") / runs.FAN).cast("long")), "target").select("target", "key", "op", "value"),
    "leveled_read": lambda s, d: runs.leveled_read(runs.assigned(_runs(s, d), n_runs(s, d))),
    "full_compaction": lambda s, d: runs.merge(_runs(s, d)).filter("op = 'PUT'").select("key", "value").orderBy("key"),
    "run_stats": lambda s, d: runs.stats(_runs(s, d)),
    "sparse_index_search": sparse_index_search,
    "block_packing": page_blocks,
    "flush_boundaries": lambda s, d: runs.flush_boundaries(log.events_log(s, d), LIMIT),
    "wal_encode": lambda s, d: log.events_log(s, d).select("seq", codec.frame(F.col("op"), F.col("key"), F.col("value")).alias("frame")),
    "manifest_parse": manifest_rows,
    "orphan_runs": orphan_runs,
    "missing_runs": missing_runs,
    "command_responses": commands,
    "range_scan": lambda s, d: log.replay(log.events_log(s, d).filter("key >= '1' AND key < '3'")).orderBy("key"),
    "snapshot_scan": lambda s, d: log.replay(log.events_log(s, d).filter(F.col("seq") <= SNAPSHOT)),
    "key_versions": lambda s, d: log.events_log(s, d).select("key", "seq", "op", F.expr("lead(seq) OVER (PARTITION BY key ORDER BY seq)").alias("valid_until")),
    "merge_counter": lambda s, d: log.counters(log.events_log(s, d)),
    "rejected_mutations": lambda s, d: log.events_log(s, d).withColumn("value", F.when(F.col("seq") % 10 == 0, "").otherwise(F.col("value"))).filter(~log.valid(None)).select("seq", "op", "key"),
    "amplification": amplification,
    "streaming_ingest": ingest.ingested_state,
    "generated_workload": lambda s, d: workload.summary(workload.generated(s, 50_000, 0, 50_000, 100)),
    "generated_workload_1000": lambda s, d: workload.summary(workload.generated(s, 50_000, 0, 50_000, 1000)),
    "workload_mixes": mixes,
    "wal_decode": wal_decode,
    "manifest_write": lambda s, d: codec.manifest_text(level_list(s, d)),
    "manifest_round_trip": lambda s, d: codec.parse_manifest(codec.manifest_text(level_list(s, d))),
    "recovery_check": recovery_check,
    "filtered_lookup": filtered_lookup,
    "run_lookup": run_lookup,
    "table_metrics": table_metrics,
    "comparator_positions": lambda s, d: log.positions(log.replay(log.events_log(s, d)), F.col("key").cast("long")),
    "tuple_values": lambda s, d: log.tuples(log.replay(log.events_log(s, d)), "k int"),
    "anti_entropy": lambda s, d: log.differences(log.replay(log.events_log(s, d).filter(F.col("seq") <= SNAPSHOT)), log.replay(log.events_log(s, d))),
    "merge_operands": lambda s, d: log.merge_operands(log.events_log(s, d), first_value=F.min("value"), last_value=F.max("value"), newest=F.max("seq")),
}

_SIZE = "strlen(key) + coalesce(strlen(value), 0)"
_LEVEL = "CASE " + " ".join(f"WHEN (n // {3 ** (i + 1)}) * {3 ** (i + 1)} <= run AND run < (n // {3**i}) * {3**i} THEN {i}" for i in range(12)) + " END"
_ASSIGNED = f"WITH {LOG_SQL}, {RUNS_SQL}, a AS (SELECT run, op, key, value, CAST({_LEVEL} AS INTEGER) AS level FROM (SELECT run, op, key, value, (SELECT max(run) + 1 FROM runs) AS n FROM runs))"
_LE64 = "concat(" + ", ".join(f"substr(lpad(hex({{0}}), 16, '0'), {i}, 2)" for i in range(15, 0, -2)) + ")"

_LEVELS = f"{_ASSIGNED}, l AS (SELECT DISTINCT level, run FROM a), p AS (SELECT level, row_number() OVER (PARTITION BY level ORDER BY run) AS pos, 'r' || run AS run_id FROM l)"
_BLOCKS = f"""WITH RECURSIVE {LOG_SQL},
u AS (SELECT run, key, value, 16 + {_SIZE} AS n, row_number() OVER (PARTITION BY run ORDER BY key) AS rn FROM (SELECT *, seq // 2000 AS run, row_number() OVER (PARTITION BY seq // 2000, key ORDER BY seq DESC) AS newest FROM log) WHERE newest = 1),
b AS (SELECT run, rn, key, value, CAST(0 AS BIGINT) AS o, CAST(n AS BIGINT) AS used FROM u WHERE rn = 1
  UNION ALL SELECT u.run, u.rn, u.key, u.value, CASE WHEN b.used >= 1000 THEN b.o + b.used + 8 ELSE b.o END, CASE WHEN b.used >= 1000 THEN u.n ELSE b.used + u.n END FROM b JOIN u ON u.run = b.run AND u.rn = b.rn + 1),
i AS (SELECT run, o, min(key) AS first_key FROM b GROUP BY run, o)"""
_EPOCHS = f"""WITH RECURSIVE {LOG_SQL},
s AS (SELECT seq, key, {_SIZE} AS n FROM log),
e AS (SELECT CAST(0 AS BIGINT) AS epoch, (SELECT min(seq) FROM s) AS begin_seq, (SELECT min(seq) FROM (SELECT seq, sum(d) OVER (ORDER BY seq) AS size FROM (SELECT seq, n - coalesce(lag(n) OVER (PARTITION BY key ORDER BY seq), 0) AS d FROM s)) WHERE size > {LIMIT}) AS end_seq
  UNION ALL SELECT e.epoch + 1, e.end_seq + 1, (SELECT min(seq) FROM (SELECT seq, sum(d) OVER (ORDER BY seq) AS size FROM (SELECT seq, n - coalesce(lag(n) OVER (PARTITION BY key ORDER BY seq), 0) AS d FROM s WHERE s.seq > e.end_seq)) WHERE size > {LIMIT}) FROM e WHERE e.end_seq IS NOT NULL AND e.end_seq < (SELECT max(seq) FROM s))
SELECT seq, epoch, CAST(sum(d) OVER (PARTITION BY epoch ORDER BY seq) AS BIGINT) AS size_bytes FROM (SELECT s.seq, e.epoch, s.n - coalesce(lag(s.n) OVER (PARTITION BY e.epoch, s.key ORDER BY s.seq), 0) AS d FROM s ASOF JOIN e ON s.seq >= e.begin_seq)"""

ORACLES: dict[str, str] = {
    "generated_workload": workload.summary_sql(workload.generated_sql(50_000, 0, 50_000, 100)),
    "generated_workload_1000": workload.summary_sql(workload.generated_sql(50_000, 0, 50_000, 1000)),
    "workload_mixes": " UNION ALL ".join(f"SELECT *, '{m}' AS mix FROM ({workload.summary_sql(workload.generated_sql(20_000, 100, 5_100, 50, w[:3], w[3]))})" for m, w in workload.MIXES.items()),
    "wal_decode": f"WITH {LOG_SQL} SELECT CAST(seq // {EVERY} AS VARCHAR) AS path, row_number() OVER (PARTITION BY seq // {EVERY} ORDER BY seq) - 1 AS seq, op, key, value FROM log",
    "manifest_write": f"{_LEVELS}, t AS (SELECT level, string_agg(run_id, '#' ORDER BY pos) AS line FROM p GROUP BY level) SELECT string_agg(coalesce(t.line, ''), chr(10) ORDER BY g.level) AS text FROM range((SELECT max(level) + 1 FROM p)) g(level) LEFT JOIN t ON t.level = g.level",
    "manifest_round_trip": f"{_LEVELS} SELECT CAST(level AS INTEGER) AS level, CAST(pos - 1 AS INTEGER) AS pos, run_id FROM p",
    "recovery_check": f"{_LEVELS} SELECT 'missing' AS kind, run_id AS name FROM p WHERE CAST(substr(run_id, 2) AS BIGINT) % 7 = 0 UNION ALL SELECT 'orphan', 'x' || run_id FROM p WHERE CAST(substr(run_id, 2) AS BIGINT) % 5 = 0",
    "filtered_lookup": f"WITH {LOG_SQL}, {RUNS_SQL} SELECT a.run, a.key, a.op, a.value FROM runs a JOIN runs b ON b.run + 1 = a.run AND b.key = a.key",
    "run_lookup": f"{_BLOCKS}, k AS (SELECT run, key FROM u UNION SELECT run, key || '5' FROM u) SELECT k.run, k.key, i.o AS block_offset, b.key IS NOT NULL AS found, b.value FROM k ASOF LEFT JOIN i ON i.run = k.run AND k.key >= i.first_key LEFT JOIN b ON b.run = k.run AND b.key = k.key",
    "sparse_index_search": f"{_BLOCKS} SELECT k.run, k.key, i.o AS block_offset FROM (SELECT run, key || '5' AS key FROM u) k ASOF LEFT JOIN i ON i.run = k.run AND k.key >= i.first_key",
    "flush_boundaries": _EPOCHS,
    "table_metrics": f"WITH {LOG_SQL}, {LATEST_SQL}, {RUNS_SQL}, o AS (SELECT count(DISTINCT run) AS runs, count(*) AS entries, sum(CASE WHEN op = 'DELETE' THEN 1 ELSE 0 END) AS tombstones, sum({_SIZE}) AS bytes, min(seq) AS first_seq, max(seq) AS last_seq FROM runs), v AS (SELECT count(*) AS live_keys, sum({_SIZE}) AS live_bytes FROM latest WHERE op = 'PUT'), m AS (SELECT CAST(runs AS BIGINT) AS runs, CAST(entries AS BIGINT) AS entries, CAST(tombstones AS BIGINT) AS tombstones, CAST(bytes AS BIGINT) AS bytes, CAST(first_seq AS BIGINT) AS first_seq, CAST(last_seq AS BIGINT) AS last_seq, CAST(live_keys AS BIGINT) AS live_keys, CAST(live_bytes AS BIGINT) AS live_bytes, CAST(bytes * 100 // live_bytes AS BIGINT) AS overhead_percent FROM o, v) UNPIVOT m ON COLUMNS(*) INTO NAME metric VALUE number",
    "comparator_positions": f"WITH live AS ({LIVE_SQL}) SELECT key, row_number() OVER (ORDER BY CAST(key AS BIGINT)) AS position FROM live",
    "tuple_values": f"WITH live AS ({LIVE_SQL}) SELECT key, CAST(regexp_extract(value, ': *([0-9]+)', 1) AS INTEGER) AS k FROM live",
    "anti_entropy": f"WITH a AS ({LIVE_SQL.replace('FROM events', f'FROM events WHERE event_id <= {SNAPSHOT}')}), b AS ({LIVE_SQL}) SELECT coalesce(a.key, b.key) AS key, a.value AS one, b.value AS two FROM a FULL JOIN b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value",
    "merge_operands": f"WITH {LOG_SQL}, e AS (SELECT *, sum(CASE WHEN op = 'DELETE' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq DESC) AS ep FROM log) SELECT key, min(value) AS first_value, max(value) AS last_value, max(seq) AS newest FROM e WHERE ep = 0 GROUP BY key",
    "replay": LIVE_SQL,
    "replay_orders": LIVE_SQL.replace(LOG_SQL, "log AS (SELECT o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' THEN 'DELETE' ELSE 'PUT' END AS op, CAST(o_custkey AS VARCHAR) AS key, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS value FROM orders)"),
    "latest_with_tombstones": f"WITH {LOG_SQL}, {LATEST_SQL} SELECT seq, op, key, value FROM latest",
    "point_get": f"{LIVE_SQL} AND key = '7'",
    "multi_get": f"WITH live AS ({LIVE_SQL}) SELECT CAST(c_custkey AS VARCHAR) AS key, live.value FROM customer LEFT JOIN live ON live.key = CAST(c_custkey AS VARCHAR)",
    "memtable_size": f"WITH {LOG_SQL}, s AS (SELECT seq, {_SIZE} - coalesce(lag({_SIZE}) OVER (PARTITION BY key ORDER BY seq), 0) AS d FROM log) SELECT seq, CAST(sum(d) OVER (ORDER BY seq) AS BIGINT) AS size_bytes FROM s",
    "run_assignment": f"{_ASSIGNED} SELECT DISTINCT run, level FROM a",
    "compact_level": f"WITH {LOG_SQL}, {RUNS_SQL} SELECT target, key, op, value FROM (SELECT run // 3 AS target, key, op, value, row_number() OVER (PARTITION BY run // 3, key ORDER BY run DESC) AS m FROM runs) WHERE m = 1",
    "leveled_read": LIVE_SQL,
    "full_compaction": LIVE_SQL,
    "run_stats": f"WITH {LOG_SQL}, {RUNS_SQL} SELECT run, count(*) AS n_entries, count(DISTINCT key) AS n_keys, CAST(sum({_SIZE}) AS BIGINT) AS n_bytes, min(key) AS first_key, max(key) AS last_key FROM runs GROUP BY run",
    "block_packing": "WITH RECURSIVE p AS (SELECT CAST(page_id AS VARCHAR) AS key, 16 + strlen(CAST(page_id AS VARCHAR)) + strlen(html) AS n, row_number() OVER (ORDER BY CAST(page_id AS VARCHAR)) AS rn FROM pages), r AS (SELECT rn, key, CAST(0 AS BIGINT) AS block, CAST(0 AS BIGINT) AS o, CAST(n AS BIGINT) AS used FROM p WHERE rn = 1 UNION ALL SELECT p.rn, p.key, CASE WHEN r.used >= 4000 THEN r.block + 1 ELSE r.block END, CASE WHEN r.used >= 4000 THEN r.o + r.used + 8 ELSE r.o END, CASE WHEN r.used >= 4000 THEN p.n ELSE r.used + p.n END FROM r JOIN p ON p.rn = r.rn + 1) SELECT CAST(0 AS BIGINT) AS run, key, block, o AS \"offset\" FROM r",
    "wal_encode": f"WITH {LOG_SQL} SELECT seq, CASE op WHEN 'PUT' THEN '01' ELSE '02' END || {_LE64.format('CAST(strlen(key) AS BIGINT)')} || hex(key) || {_LE64.format('CAST(coalesce(strlen(value), 0) AS BIGINT)')} || hex(coalesce(value, '')) AS frame FROM log",
    "manifest_parse": "SELECT CAST(level AS INTEGER) AS level, CAST(pos AS INTEGER) AS pos, run_id FROM (VALUES (0, 0, 'r1'), (0, 1, 'r2'), (2, 0, 'r3')) t(level, pos, run_id)",
    "orphan_runs": "SELECT 'r9' AS name",
    "missing_runs": "SELECT 'r2' AS name",
    "command_responses": COMMANDS_SQL,
    "range_scan": f"{LIVE_SQL} AND key >= '1' AND key < '3'",
    "snapshot_scan": LIVE_SQL.replace("FROM events", f"FROM events WHERE event_id <= {SNAPSHOT}"),
    "key_versions": f"WITH {LOG_SQL} SELECT key, seq, op, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS valid_until FROM log",
    "merge_counter": f"WITH {LOG_SQL}, e AS (SELECT *, sum(CASE WHEN op = 'DELETE' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq DESC) AS ep FROM log) SELECT key, count(*) AS n_operands, CAST(sum(strlen(value)) AS BIGINT) AS operand_bytes FROM e WHERE ep = 0 GROUP BY key",
    "rejected_mutations": f"WITH {LOG_SQL} SELECT seq, op, key FROM log WHERE seq % 10 = 0 AND op = 'PUT'",
    "amplification": f"{_ASSIGNED} SELECT level, count(DISTINCT run) AS n_runs, count(*) AS n_entries, count(DISTINCT key) AS n_keys, CAST(sum({_SIZE}) AS BIGINT) AS n_bytes FROM a GROUP BY level",
    "streaming_ingest": LIVE_SQL,
}
