"""Command lines as a stream, and a small server for single commands."""

from __future__ import annotations

import logging
import socketserver
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkledger.functions import codec
from sparkledger.sources.errors import StorageError
from sparkledger.sources.table import KVTable

from .ingest import stream_id

LOGGER = logging.getLogger("sparkledger.server")
REQUEST = 1024  # fixed value: bytes of a request


def respond(table: KVTable, commands: DataFrame) -> DataFrame:
    """seq and response of a batch of command lines on top of the table; the batch's mutations aren't written yet."""
    asked = codec.parsed(commands).filter("good").select(F.col("key").cast("binary").alias("key")).distinct()
    return codec.replies(commands, table.multi_get(asked).filter("value IS NOT NULL"))


def serve(spark: SparkSession, source: str, table: KVTable, sink: str, checkpoint: str) -> None:
    """Answers all new files of command lines (JSON with seq and line), in batches; responses are Parquet in sink."""
    own = f"commands-{stream_id(spark, checkpoint)}"
    lines = spark.readStream.schema("seq long, line string").json(source)

    def take(df: DataFrame, batch: int) -> None:
        if not table.taken(own, batch):
            respond(table, df).write.mode("overwrite").parquet(f"{sink}/batch={batch}")
            base = table.last_seq()
            table.ingest(codec.mutations_of(df).withColumn("seq", F.col("seq") + 1 + base), own, batch)

    lines.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def execute(table: KVTable, raw: bytes) -> bytes:
    """One command. Bytes that are no UTF-8 are replaced on the way in; a value that is none can't be sent."""
    tokens = raw.decode("utf-8", "replace").split()
    try:
        match tokens:
            case ["put", key, value]:
                table.put(key, value)
            case ["delete", key]:
                table.delete(key)
            case ["get", key]:
                found = table.get(key)
                return b"Key not found\n" if found is None else (found.encode() if isinstance(found, str) else found.decode().encode()) + b"\n"
            case _:
                return b"Invalid command\n"
    except (UnicodeDecodeError, StorageError) as e:
        LOGGER.warning("%s failed: %s", tokens[0], e)
        return b"Get failed." if tokens[0] == "get" else b"Write failed.\n"
    return b"Success\n"


def server(table: KVTable, host: str = "127.0.0.1", port: int = 8000) -> socketserver.TCPServer:
    """One client after another; a client that closes its side is done."""

    class Handler(socketserver.BaseRequestHandler):
        def handle(self) -> None:
            LOGGER.info("client %s", self.client_address)
            while raw := self.request.recv(REQUEST):
                self.request.sendall(execute(table, raw))

    return socketserver.TCPServer((host, port), Handler)


def repl(table: KVTable, lines=sys.stdin, out=sys.stdout) -> None:
    """A client without a socket: a command a line."""
    for line in lines:
        out.write(execute(table, line.encode()).decode())
        out.flush()
