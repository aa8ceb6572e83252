"""The mutation log: adapters, validation and the latest-wins collapse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Operation codes.
GET, PUT, DELETE = 0, 1, 2


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, op, key, value of the events table: errors delete, all else puts."""
    deleted = F.col("event_type") == "error"
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), F.when(deleted, "DELETE").otherwise("PUT").alias("op"), F.col("user_id").cast("string").alias("key"), F.when(~deleted, F.col("props")).alias("value"))


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, op, key, value of the orders table: finished orders delete, all else puts."""
    deleted = F.col("o_orderstatus") == "F"
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("seq"), F.when(deleted, "DELETE").otherwise("PUT").alias("op"), F.col("o_custkey").cast("string").alias("key"), F.when(~deleted, F.col("o_orderpriority")).alias("value"))


def valid(log: DataFrame) -> Column:
    """Keys are never empty; a put has a value that isn't empty; only puts and deletes are logged."""
    return F.coalesce((F.octet_length("key") > 0) & F.col("op").isin("PUT", "DELETE") & ((F.col("op") == "DELETE") | (F.octet_length("value") > 0)), F.lit(False))


def latest(log: DataFrame) -> DataFrame:
    """The last mutation of each key, tombstones kept."""
    order = Window.partitionBy("key").orderBy(F.desc("seq"))
    return log.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def replay(log: DataFrame) -> DataFrame:
    """key and value of the live keys. The tombstone filter stands above the collapse."""
    return latest(log.filter(F.col("op").isin("PUT", "DELETE"))).filter("op = 'PUT'").select("key", "value")


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """key and value of each asked key, null where it isn't live.

    Asked keys and the log meet in one join by key, and the collapse keeps its partitioning; keys without
    mutations come through it with a null value.
    """
    own = log.filter(F.col("op").isin("PUT", "DELETE")).select("key", F.struct("seq", F.when(F.col("op") == "PUT", F.col("value")).alias("value")).alias("_last"))
    return keys.select("key").distinct().join(own, "key", "left").groupBy("key").agg(F.max("_last")["value"].alias("value"))


def memtable_sizes(log: DataFrame) -> DataFrame:
    """seq and the bytes that the sorted map holds after each mutation."""
    own = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    step = log.withColumn("n", own).withColumn("d", F.col("n") - F.coalesce(F.lag("n").over(Window.partitionBy("key").orderBy("seq")), F.lit(0)))
    return running(step, "d", "seq").select("seq", F.col("total").cast("long").alias("size_bytes"))


def running(rows: DataFrame, value: str, order: str, width: int = 1 << 16) -> DataFrame:
    """A running sum over all rows without gathering them: sums of ranges of the order column first, then inside each."""
    ranged = rows.withColumn("_range", F.floor(F.col(order) / width))
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_range", "_before")
    own = F.sum(value).over(Window.partitionBy("_range").orderBy(order))
    return ranged.withColumn("_own", own).join(before, "_range").withColumn("total", F.col("_own") + F.col("_before")).drop("_own", "_before", "_range")


def merge_operands(log: DataFrame, **aggregates: Column) -> DataFrame:
    """Custom merge operator: any Spark aggregates, grouped pandas functions too, over the puts of each key since its last delete.

    Built-in aggregates combine before the exchange, so a hot key's operands are never gathered.
    """
    deleted = log.filter("op = 'DELETE'").groupBy("key").agg(F.max("seq").alias("_deleted"))
    puts = log.filter("op = 'PUT'").join(deleted, "key", "left").filter("_deleted IS NULL OR seq > _deleted")
    return puts.groupBy("key").agg(*[c.alias(n) for n, c in aggregates.items()])


def counters(log: DataFrame) -> DataFrame:
    """The number and bytes of put operands of each key since its last delete."""
    return merge_operands(log, n_operands=F.count("*"), operand_bytes=F.sum(F.octet_length("value")).cast("long"))


def positions(state: DataFrame, comparator: Column, width: int = 1 << 16) -> DataFrame:
    """key and its place, from 1, in the order of a numeric comparator; keys must differ in it. Ranges are counted first, so no task orders all keys."""
    rows = state.select("key", comparator.cast("long").alias("_at"), F.lit(1).alias("_one"))
    return running(rows, "_one", "_at", width).select("key", F.col("total").cast("long").alias("position"))


def scan_by(state: DataFrame, comparator: Column) -> DataFrame:
    """A scan in the order of any comparator: numbers, reversed bytes, a collation."""
    return state.orderBy(comparator)


def tuples(state: DataFrame, schema: str) -> DataFrame:
    """A table with tuples for values: key and the fields of its value, written as JSON. Values that don't parse give null fields."""
    return state.select("key", F.from_json(F.col("value").cast("string"), schema).alias("_t")).select("key", "_t.*")


def bucket_sums(state: DataFrame, buckets: int) -> DataFrame:
    """Anti-entropy: number and checksum of each bucket of keys."""
    return state.groupBy(F.pmod(F.xxhash64(F.col("key").cast("binary")), F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key", "value")).alias("sum"))


def differences(one: DataFrame, two: DataFrame, buckets: int = 1024) -> DataFrame:
    """key and the values of both sides where two states differ; only buckets whose checksums differ are compared."""
    a, b = bucket_sums(one, buckets), bucket_sums(two, buckets)
    differ = a.join(b, "bucket", "full").filter(~a["n"].eqNullSafe(b["n"]) | ~a["sum"].eqNullSafe(b["sum"])).select("bucket")

    def side(state: DataFrame, name: str) -> DataFrame:
        held = state.select(F.pmod(F.xxhash64(F.col("key").cast("binary")), F.lit(buckets)).alias("bucket"), "key", F.col("value").alias(name))
        return held.join(F.broadcast(differ), "bucket").drop("bucket")  # a row for each bucket at most

    return side(one, "one").join(side(two, "two"), "key", "full").filter(~F.col("one").eqNullSafe(F.col("two")))
