"""Sorted runs: flushes, levels, merges, priority reads, statistics and sparse indexes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkledger.functions.shared import scratch

#: Runs of a level before it compacts, bytes of a block, of an entry's lengths and of a block's own length.
FAN, BLOCK, ENTRY, HEAD = 3, 4000, 16, 8
#: Digits that any long has in base FAN.
DIGITS = 41


def flush(log: DataFrame, every: int) -> DataFrame:
    """run, seq, op, key, value: a run for each stretch of so many sequence numbers, its last mutation of each key."""
    rows = log.withColumn("run", F.floor(F.col("seq") / every).cast("long"))
    order = Window.partitionBy("run", "key").orderBy(F.desc("seq"))
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def level_of(run: Column, n_runs: Column) -> Column:
    """The level in which a flush lies after n_runs flushes: the highest digit, in base FAN, in which its number and n_runs differ."""
    one, two = (F.lpad(F.conv(x.cast("string"), 10, FAN), DIGITS, "0") for x in (run, n_runs))
    return DIGITS - 1 - F.length(F.regexp_extract(F.concat(one, F.lit(":"), two), r"^(\d*)\d*:\1", 1))


def assigned(runs: DataFrame, n_runs: Column | None = None) -> DataFrame:
    """Runs with their level. n_runs: how many flushes there were, where that is known without reading the runs."""
    total = runs.agg((F.max("run") + 1).alias("n_runs")).scalar() if n_runs is None else n_runs
    return runs.withColumn("level", level_of(F.col("run"), total))


def merge(runs: DataFrame, *by: str) -> DataFrame:
    """k-way merge: the newest run wins, one row for each key, tombstones kept."""
    order = Window.partitionBy(*by, "key").orderBy(F.desc("run"))
    return runs.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def leveled_read(runs: DataFrame) -> DataFrame:
    """First hit by level, and in a level by newest run; a tombstone is a hit."""
    order = Window.partitionBy("key").orderBy("level", F.desc("run"))
    return runs.withColumn("_n", F.row_number().over(order)).filter("_n = 1 AND op = 'PUT'").select("key", "value")


def stats(runs: DataFrame) -> DataFrame:
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return runs.groupBy("run").agg(F.count("*").alias("n_entries"), F.count_distinct("key").alias("n_keys"), F.sum(size).cast("long").alias("n_bytes"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def entry_size() -> Column:
    return (F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))).cast("long")


def pack_blocks(entries: DataFrame, limit: int = BLOCK) -> DataFrame:
    """run, key, n -> run, key, block, offset: greedy blocks of each run in key order; a block closes once its length reaches the limit.

    Where a block begins depends on all entries before it, but only by the bytes that its first entries
    find in use. Entries are dealt to ranges of (run, key); each range tells, for every amount that may be
    in use at its start, how many blocks it closes and what stays in use: as many answers as entries fit
    in one block. Ranges are chained by these answers, and a second pass numbers the entries. Keys are text or bytes.
    """
    spark = entries.sparkSession
    path = scratch(spark, "blocks")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = entries.select("run", "key", F.col("n").cast("long").alias("n")).repartitionByRange(n, "run", "key").withColumn("part", F.spark_partition_id())
    kind = rows.schema["key"].dataType.simpleString()
    rows.write.partitionBy("part").parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path).select("part", "run", "key", "n")

    def ranges(pdf: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
        for run, own in pdf.groupby("run", sort=True):
            yield run, own.sort_values("key")

    def chain(size: np.ndarray, used: int) -> tuple[np.ndarray, np.ndarray]:
        """Where blocks close if so many bytes are in use: index of each closing entry, and the closed lengths."""
        total = np.r_[0, np.cumsum(size)]
        closes, lengths, start = [], [], -used
        while (at := int(np.searchsorted(total, start + limit))) < len(total):
            closes.append(at - 1)
            lengths.append(int(total[at] - start))
            start = int(total[at])
        return np.array(closes, dtype=np.int64), np.array(lengths, dtype=np.int64)

    def answers(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for run, own in ranges(pdf):
            total = np.r_[0, np.cumsum(own["n"].to_numpy() + ENTRY)]
            known: dict[int, tuple[int, int, int]] = {}  # blocks closed, their bytes and the rest, if a block begins at an entry

            def tail(start: int) -> tuple[int, int, int]:
                path = []
                while start not in known:
                    after = int(np.searchsorted(total, total[start] + limit))
                    if after >= len(total):
                        known[start] = 0, 0, int(total[-1] - total[start])
                    else:
                        path.append((start, after))
                        start = after
                for begin, after in reversed(path):
                    blocks, size, rest = known[after]
                    known[begin] = blocks + 1, size + HEAD + int(total[after] - total[begin]), rest
                return known[path[0][0] if path else start]

            # used bytes from low on make the same entry the first that closes
            least = limit
            for at in range(1, len(total)):
                low = max(0, limit - int(total[at]))
                if low < least:
                    blocks, size, rest = tail(at)
                    out.append((run, key[0], low, 1 + blocks, int(total[at]) + HEAD + size, rest, 1))
                    least = low
                if not low:
                    break
            if least:
                out.append((run, key[0], -1, 0, 0, int(total[-1]), 0))
        return pd.DataFrame(out, columns=["run", "part", "low", "blocks", "bytes", "rest", "closed"])

    def chained(pdf: pd.DataFrame) -> pd.DataFrame:
        out, used, block, offset, last = [], 0, 0, 0, None
        for (run, part), own in pdf.sort_values(["run", "part", "low"], ascending=[True, True, False]).groupby(["run", "part"], sort=True):
            if run != last:
                used, block, offset, last = 0, 0, 0, run
            out.append((run, part, used, block, offset))
            row = next(r for r in own.itertuples() if used >= r.low)
            # the first closed block began before this range; its used bytes count once
            block, offset = block + row.blocks, offset + (row.bytes + used if row.closed else 0)
            used = row.rest if row.closed else used + row.rest
        return pd.DataFrame(out, columns=["run", "part", "used", "block", "offset"])

    found = stored.groupBy("part").applyInPandas(answers, "run long, part int, low long, blocks long, bytes long, rest long, closed int")
    starts = found.groupBy("run").applyInPandas(chained, "run long, part int, used long, block long, offset long")

    def numbered(key: tuple, pdf: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"run": [], "key": [], "block": [], "offset": []})]
        begin = {r.run: r for r in at.itertuples()}
        for run, own in ranges(pdf):
            b = begin[run]
            closes, lengths = chain(own["n"].to_numpy() + ENTRY, int(b.used))
            nth = np.searchsorted(closes, np.arange(len(own)))
            before = np.r_[0, np.cumsum(lengths + HEAD)]
            out.append(own[["run", "key"]].assign(block=int(b.block) + nth, offset=int(b.offset) + before[nth]))
        return pd.concat(out[1:] or out)

    return stored.groupBy("part").cogroup(starts.groupBy("part")).applyInPandas(numbered, f"run long, key {kind}, block long, offset long")


def flush_boundaries(log: DataFrame, limit: int) -> DataFrame:
    """seq, epoch and size_bytes of a map that is flushed once it holds more than limit bytes.

    The one operator whose rule is serial: whether a mutation fills the map depends on all before it, and an
    epoch may be as long as the log. A single task folds the sorted log as a stream; it holds the map,
    which the limit bounds, and one batch.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        epoch, size, held = 0, 0, {}
        for b in batches:
            epochs, sizes = [], []
            for key, n in zip(b.column("key").to_pylist(), b.column("n").to_pylist(), strict=True):
                size += n - held.get(key, 0)
                held[key] = n
                epochs.append(epoch)
                sizes.append(size)
                if size > limit:
                    epoch, size, held = epoch + 1, 0, {}
            yield pa.RecordBatch.from_arrays([b.column("seq"), pa.array(epochs, pa.int64()), pa.array(sizes, pa.int64())], names=["seq", "epoch", "size_bytes"])

    return log.select("seq", "key", entry_size().alias("n")).repartition(1).sortWithinPartitions("seq").mapInArrow(fold, "seq long, epoch long, size_bytes long")


def search_index(index: DataFrame, keys: DataFrame) -> DataFrame:
    """As-of: for run and key the offset of the last index entry at or below the key, else null. index: run, first_key, offset.

    Keys and entries are dealt to ranges of (run, key); the last entry before a range comes from the
    ranges' own last entries, of which there is one for each range and run.
    """
    spark = index.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    both = index.select("run", F.col("first_key").alias("key"), F.lit(0).alias("tag"), "offset").unionByName(keys.select("run", "key").withColumns({"tag": F.lit(1), "offset": F.lit(None).cast("long")}))
    path = scratch(spark, "searched")
    ranged = both.repartitionByRange(n, "run", "key", "tag").withColumn("part", F.spark_partition_id())
    ranged.write.parquet(path)
    dealt = spark.read.schema(ranged.schema).parquet(path)
    ends = dealt.filter("tag = 0").groupBy("run", "part").agg(F.max(F.struct("key", "offset"))["offset"].alias("end"))
    present = dealt.select("run", "part").distinct().join(ends, ["run", "part"], "left")
    before = Window.partitionBy("run").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = present.withColumn("carried", F.last("end", ignorenulls=True).over(before)).select("run", "part", "carried")
    order = Window.partitionBy("run", "part").orderBy("key", "tag")
    own = dealt.withColumn("found", F.last("offset", ignorenulls=True).over(order)).filter("tag = 1")
    return own.join(carried, ["run", "part"]).select("run", "key", F.coalesce("found", "carried").alias("block_offset"))


def lookup(blocks: DataFrame, index: DataFrame, keys: DataFrame) -> DataFrame:
    """A run's whole lookup: the index names the block, and the key is looked for in that block alone.

    blocks: run, key, offset and value; a run and key of keys comes back with its block and what the run holds for it.
    """
    asked = search_index(index, keys).withColumnRenamed("block_offset", "offset")
    found = blocks.select("run", "key", "offset", "value", F.lit(True).alias("found"))
    return asked.join(found, ["run", "offset", "key"], "left").select("run", "key", F.col("offset").alias("block_offset"), F.coalesce("found", F.lit(False)).alias("found"), "value")
