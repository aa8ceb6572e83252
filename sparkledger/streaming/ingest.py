"""Streaming ingest: micro-batches become runs, named by stream and batch, and a batch that runs again is taken in once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkledger.functions.shared import scratch
from sparkledger.operators import log
from sparkledger.sources.files import Files
from sparkledger.sources.table import KVTable

MUTATIONS = "seq long, op string, key string, value string"


def ingest(spark: SparkSession, source: str, schema: str, table: KVTable, checkpoint: str, files_per_batch: int = 1000) -> None:
    """Takes in all files of mutations that are new since the last call.

    Rows that aren't valid, reads among them, go to the table's ``rejected`` folder. files_per_batch limits
    the rate. The commit that adds a batch's run also says that it was added; the stream's own id is in the
    name, so other streams and other checkpoints never meet it.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    own = f"stream-{stream_id(spark, checkpoint)}"

    def take(df: DataFrame, batch: int) -> None:
        if not table.taken(own, batch):
            df.filter(~log.valid(df)).write.mode("overwrite").parquet(f"{table.path}/rejected/{own}-{batch:010d}")
            table.ingest(df.filter(log.valid(df)), own, batch)

    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """A name that stays with the checkpoint and that no other stream has."""
    files = Files(spark, checkpoint)
    if not files.exists("ledger-stream"):
        files.create("ledger-stream", uuid.uuid4().hex.encode())
    return files.read("ledger-stream").decode()


def ingested_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log cut into files, taken in by micro-batches, and the live keys of the runs they left."""
    root = scratch(spark, "ingest")
    events = log.events_log(spark, sf_dir)
    events.repartition(4, (F.col("seq") % 4)).write.parquet(f"{root}/source")
    table = KVTable(spark, f"{root}/table")
    ingest(spark, f"{root}/source", MUTATIONS, table, f"{root}/checkpoint", files_per_batch=2)
    return table.scan().select(F.col("key"), F.col("value"))
