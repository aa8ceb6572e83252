"""Membership filters of runs, and lookups that ask them first."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap bucket of Spark's bitmap functions.
BUCKET = 32_768
HASHES = 5


def places(key: Column, bits: Column) -> Column:
    """The bits of a key: two Murmur hashes and their combinations."""
    one, two = F.hash(key).cast("long"), F.hash(key, F.lit(1)).cast("long")
    return F.array(*[F.pmod(one + two * i, bits) for i in range(HASHES)])


def bits_for(n_keys: Column, rate: float) -> Column:
    """Bits that hold so many keys at a false-positive rate, a whole number of buckets."""
    each = -HASHES / math.log(1 - rate ** (1 / HASHES))
    return (F.ceil(n_keys * F.lit(each) / BUCKET) * BUCKET).cast("long")


def build(entries: DataFrame, rate: float = 0.03) -> DataFrame:
    """run, bits, bucket and bitmap from run and key. Buckets are rows of their own, so a large run's filter is spread; keys combine before the exchange."""
    sizes = entries.groupBy("run").agg(bits_for(F.count("*"), rate).alias("bits"))
    at = entries.join(sizes, "run").select("run", "bits", F.explode(places(F.col("key"), F.col("bits"))).alias("at"))
    place = F.col("at") + 1
    return at.groupBy("run", "bits", F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))


def probe(filters: DataFrame, keys: DataFrame) -> DataFrame:
    """The runs that may hold a key: run and key of keys for which every bit is set. No key that a run holds is lost."""
    runs = filters.groupBy("run").agg(F.first("bits").alias("bits"))
    asked = keys.select("run", "key").join(runs, "run").select("run", "key", F.explode(F.array_distinct(places(F.col("key"), F.col("bits")))).alias("at"))
    asked = asked.withColumn("bucket", F.bitmap_bucket_number(F.col("at") + 1)).withColumn("bit", F.bitmap_bit_position(F.col("at") + 1))
    met = asked.join(filters.select("run", "bucket", "bitmap"), ["run", "bucket"], "left")
    byte = F.conv(F.hex(F.substring("bitmap", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    isset = F.coalesce(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1, F.lit(False))
    return met.groupBy("run", "key").agg(F.min(isset).alias("all_set")).filter("all_set").select("run", "key")


def filtered_lookup(entries: DataFrame, filters: DataFrame, keys: DataFrame) -> DataFrame:
    """run, key, op and value of the asked keys that runs hold; runs whose filter rules a key out aren't asked for it."""
    return probe(filters, keys).join(entries.select("run", "key", "op", "value"), ["run", "key"])
