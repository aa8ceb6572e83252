"""Log frames, manifests and command lines as column expressions."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkledger.sources.errors import CorruptLogEntry, CorruptManifest


def le64(n: Column) -> Column:
    """Eight bytes, the lowest first, as hex."""
    big = F.lpad(F.hex(n.cast("long")), 16, "0")
    return F.concat(*[F.substring(big, i, 2) for i in range(15, 0, -2)])


#: Operations by their codes.
OPERATIONS = ("GET", "PUT", "DELETE")


def code_of(op: Column, strict: bool = True) -> Column:
    """The code of an operation as hex. Unknown ones are an error, or null if not strict."""
    known = F.when(op == "GET", "00").when(op == "PUT", "01").when(op == "DELETE", "02")
    return known.otherwise(F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce(op, F.lit("null")))).cast("string")) if strict else known


def frame(op: Column, key: Column, value: Column, strict: bool = True) -> Column:
    """A log frame as hex: operation, length and bytes of the key, length and bytes of the value; keys and values are text or bytes."""
    k, v = key.cast("binary"), F.coalesce(value.cast("binary"), F.lit(b""))
    return F.concat(code_of(op, strict), le64(F.octet_length(k)), F.hex(k), le64(F.octet_length(v)), F.hex(v))


def decode_frames(files: DataFrame) -> DataFrame:
    """path, seq, op, key, value of binary log files; a torn tail ends a file quietly, an unknown operation is an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                rows, at, data = [], 0, bytes(data)
                while at + 9 <= len(data):
                    if data[at] > 2:
                        raise CorruptLogEntry(f"unknown operation {data[at]} at byte {at} of {path}")
                    (n,) = struct.unpack_from("<Q", data, at + 1)
                    if at + 17 + n > len(data):
                        break
                    (m,) = struct.unpack_from("<Q", data, at + 9 + n)
                    if at + 17 + n + m > len(data):
                        break
                    rows.append((path, len(rows), OPERATIONS[data[at]], data[at + 9 : at + 9 + n], data[at + 17 + n : at + 17 + n + m] or None))
                    at += 17 + n + m
                yield pd.DataFrame(rows, columns=["path", "seq", "op", "key", "value"])

    return files.select("path", "content").mapInPandas(run, "path string, seq long, op string, key binary, value binary")


RUN_ID = r"^[0-9A-Za-z][0-9A-Za-z_.-]*$"


def parse_manifest(texts: DataFrame, strict: bool = True) -> DataFrame:
    """level, pos, run_id from a column text: a line for each level, runs between # marks, an empty line an empty level.

    Lines that begin with ! hold facts, not runs. A name that can't be a run's is an error, or a row if not strict.
    """
    levels = texts.select(F.posexplode(F.split("text", "\n")).alias("level", "line")).filter("line <> '' AND NOT startswith(line, '!')")
    runs = levels.select("level", F.posexplode(F.split("line", "#")).alias("pos", "run_id"))
    named = F.when(F.col("run_id").rlike(RUN_ID), F.col("run_id")).otherwise(F.raise_error(F.concat(F.lit("corrupted manifest: "), "run_id")).cast("string"))
    return runs.withColumn("run_id", named) if strict else runs


def manifest_text(runs: DataFrame) -> DataFrame:
    """One row, text, from level, pos and run_id: what parse_manifest() reads. The input is a table's list of runs."""
    lines = runs.groupBy("level").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "run_id"))), lambda x: x["run_id"]), "#").alias("line"))
    held = lines.agg(F.map_from_entries(F.collect_list(F.struct("level", "line"))).alias("m"), F.max("level").alias("top"))
    every = F.sequence(F.lit(0), F.coalesce("top", F.lit(0)))
    return held.select(F.array_join(F.transform(every, lambda i: F.coalesce(F.element_at("m", i), F.lit(""))), "\n").alias("text"))


def read_manifest(text: str, most: int | None = None) -> tuple[list[list[str]], dict[str, int]]:
    """Levels and facts of a manifest that is already on the driver."""
    lines = text.split("\n")
    facts = {}
    for line in lines:
        if line.startswith("!"):
            name, _, number = line[1:].rpartition(" ")
            if not name or not number.lstrip("-").isdigit():
                raise CorruptManifest(f"no fact: {line[:80]}")
            facts[name] = int(number)
    levels = [x.split("#") if x else [] for x in lines if not x.startswith("!")]
    while levels and not levels[-1]:
        levels.pop()
    bad = [r for level in levels for r in level if not re.match(RUN_ID, r)]
    if bad:
        raise CorruptManifest(f"no run's name: {bad[0][:80]!r}")
    if most is not None and len(levels) > most:
        raise CorruptManifest(f"{len(levels)} levels, {most} at most")
    return levels, facts


def write_manifest(levels: list[list[str]], facts: dict[str, int]) -> str:
    return "\n".join([*("#".join(level) for level in levels), *(f"!{name} {number}" for name, number in sorted(facts.items()))])


def replies(commands: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """seq, line -> seq, response: a get sees the latest earlier mutation of its key, and before it the state.

    state: key and value of live keys. A value that is no UTF-8 can't be sent: its get fails, without a line end.
    """
    rows = parsed(commands)
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("seen", F.when(F.col("good"), F.last("mutation", ignorenulls=True).over(before)))
    if state is not None:
        held = state.select(F.col("key").cast("binary").alias("_key"), F.struct(F.col("value").cast("binary").alias("value")).alias("_held"))
        rows = rows.join(held, rows["key"].cast("binary") == held["_key"], "left").withColumn("seen", F.coalesce("seen", F.when(F.col("good"), F.col("_held"))))
    value = F.col("seen")["value"]
    sent = F.when(value.isNull(), "Key not found").when(F.is_valid_utf8(value.cast("string")), value.cast("string")).otherwise("Get failed.")
    return rows.select("seq", F.when(~F.col("good"), "Invalid command").when(F.col("verb") == "get", sent).otherwise("Success").alias("response"))


def parsed(commands: DataFrame) -> DataFrame:
    """seq, verb, key, whether the command is good, and the mutation it makes, if any."""
    token = F.filter(F.split("line", r"(?U)\s+"), lambda x: x != "")
    rows = commands.select("seq", token.alias("t")).withColumn("verb", F.element_at(F.when(F.size("t") > 0, F.col("t")).otherwise(F.array(F.lit(""))), 1))
    arity = F.size("t")
    good = F.coalesce(((F.col("verb") == "put") & (arity == 3)) | (F.col("verb").isin("get", "delete") & (arity == 2)), F.lit(False))
    mutation = F.struct(F.when(F.col("verb") == "put", F.get("t", F.lit(2)).cast("binary")).alias("value"))
    rows = rows.withColumn("good", good).withColumn("key", F.when(good, F.get("t", F.lit(1))))
    return rows.withColumn("mutation", F.when(good & (F.col("verb") != "get"), mutation)).drop("t")


def mutations_of(commands: DataFrame) -> DataFrame:
    """The log that the good puts and deletes of a batch of command lines make."""
    return parsed(commands).filter("mutation IS NOT NULL").select("seq", F.upper("verb").alias("op"), F.col("key").cast("binary").alias("key"), "mutation.value")
