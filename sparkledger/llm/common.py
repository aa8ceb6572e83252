"""Shared plumbing of the training-data operators: tables, shared folders, bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch. Texts may be long, so batches are kept far below Spark's default of 10,000 rows.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session_of(df: DataFrame) -> SparkSession:
    """The frame's session, with Arrow batches small enough for long texts; a smaller setting of the caller's stays."""
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only where the setting is unset and the master is local, as in tests."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sparkledger-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes the frame to the shared folder and reads it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(column: pa.Array) -> tuple[memoryview, list[int]]:
    """The UTF-8 bytes of a string column (null: empty) as one buffer, and where each row starts in it."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = column.fill_null(b"") if column.null_count else column
    import numpy as np

    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    whole = memoryview(data) if data is not None else memoryview(b"")
    return whole[int(offsets[0]) : int(offsets[-1])], offsets - offsets[0]


def documents(df: DataFrame, *columns: Column) -> DataFrame:
    """doc_id and text (null: empty) and what else is given; other columns, whatever their names, are left behind."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *columns)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


#: The column that carries a table's other columns through an operator, so that no name of theirs meets one of the operator's.
CARRIED = "carried_columns"


def carried(df: DataFrame, *without: str) -> Column:
    """All columns but some, as one struct of numbered fields."""
    names = [c for c in df.columns if c not in without]
    return F.struct(F.col("text").isNull().alias("no_text"), *[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(names)]).alias(CARRIED)


def text_as_it_was() -> Column:
    return F.when(~F.col(CARRIED)["no_text"], F.col("text"))


def uncarried(df: DataFrame, like: DataFrame, *without: str, **own: Column) -> DataFrame:
    """The columns of like, in its order: those that were carried, and own ones by name."""
    names = [c for c in like.columns if c not in without]
    at = {c: F.col(CARRIED)[f"c{i}"] for i, c in enumerate(names)} | own
    return df.select(*[at[c].alias(c) for c in like.columns])
