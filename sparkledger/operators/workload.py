"""Generated workloads: puts, gets and deletes by weight, with uniform or skewed keys, run against each other in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Weights of put, get, delete, and whether keys are skewed: the shapes of a known family of mixed workloads.
MIXES = {"a": (50, 50, 0, True), "b": (5, 95, 0, True), "c": (0, 100, 0, True), "f": (50, 50, 0, False), "churn": (40, 40, 20, False)}


def uniform(seed: int, salt: int) -> Column:
    """An integer from 0 to 2^28 - 1 for each id; the same for any partitioning, and in any SQL with MD5."""
    digest = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed)), F.lit(str(salt))))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("long")


def uniform_sql(seed: int, salt: int) -> str:
    return f"CAST('0x' || substr(md5(id || ':{seed}:{salt}'), 1, 7) AS BIGINT)"


def generated(spark: SparkSession, n: int, low: int, high: int, value_bytes: int, weights: tuple[int, int, int] = (50, 50, 0), skewed: bool = False, seed: int = 42) -> DataFrame:
    """seq, op, key, value of n operations on keys from low up to but without high.

    Skewed keys follow the harmonic law: a key's frequency falls with its rank, by the inverse of its distribution function.
    """
    total = sum(weights)
    kind, at = uniform(seed, 0) % total, uniform(seed, 1)
    span = high - low
    offset = F.least(F.lit(span - 1), F.floor(F.pow(F.lit(float(span)), at / (1 << 28))).cast("long") - 1) if skewed else at % span
    op = F.when(kind < weights[0], "PUT").when(kind < weights[0] + weights[1], "GET").otherwise("DELETE")
    return spark.range(n).select(F.col("id").alias("seq"), op.alias("op"), (offset + low).cast("string").alias("key")).withColumn("value", F.when(F.col("op") == "PUT", F.rpad(F.col("seq").cast("string"), value_bytes, "0")))


def generated_sql(n: int, low: int, high: int, value_bytes: int, weights: tuple[int, int, int] = (50, 50, 0), skewed: bool = False, seed: int = 42) -> str:
    total, span = sum(weights), high - low
    at = uniform_sql(seed, 1)
    offset = f"least({span - 1}, CAST(floor(pow({float(span)}, {at} / {float(1 << 28)})) AS BIGINT) - 1)" if skewed else f"{at} % {span}"
    kind = f"{uniform_sql(seed, 0)} % {total}"
    return f"SELECT id AS seq, op, CAST({low} + {offset} AS VARCHAR) AS key, CASE WHEN op = 'PUT' THEN rpad(CAST(id AS VARCHAR), {value_bytes}, '0') END AS value FROM (SELECT id, CASE WHEN {kind} < {weights[0]} THEN 'PUT' WHEN {kind} < {weights[0] + weights[1]} THEN 'GET' ELSE 'DELETE' END AS op FROM range({n}) r(id))"


def answered(log: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Every operation in order: a get sees the newest mutation of its key before it. state: key and value before the first."""
    rows = log.withColumn("made", F.when(F.col("op") != "GET", F.struct("value")))
    if state is not None:
        before = state.select(F.lit(-1).cast("long").alias("seq"), F.lit("PUT").alias("op"), "key", "value", F.struct("value").alias("made"))
        rows = rows.unionByName(before)
    order = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("answer", F.when(F.col("op") == "GET", F.last("made", ignorenulls=True).over(order)["value"])).filter("seq >= 0").drop("made")


def summary(log: DataFrame) -> DataFrame:
    """op, how many there were, how many gets found a value, and the bytes that were put or found."""
    moved = F.octet_length(F.coalesce("value", "answer"))
    return answered(log).groupBy("op").agg(F.count("*").alias("n_ops"), F.count("answer").alias("n_found"), F.coalesce(F.sum(moved), F.lit(0)).cast("long").alias("n_bytes"))


def summary_sql(log_sql: str) -> str:
    return f"""
WITH g AS ({log_sql}),
m AS (SELECT *, max(CASE WHEN op <> 'GET' THEN seq END) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS made FROM g),
a AS (SELECT m.op, m.value, CASE WHEN m.op = 'GET' THEN w.value END AS answer FROM m LEFT JOIN g w ON w.seq = m.made)
SELECT op, count(*) AS n_ops, count(answer) AS n_found, CAST(coalesce(sum(strlen(coalesce(value, answer))), 0) AS BIGINT) AS n_bytes FROM a GROUP BY op
"""
