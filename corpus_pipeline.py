"""The corpus pipeline: toxic documents go, near duplicates go, repeated passages go, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkledger.llm import common, near_dedup, packing, suffix_dedup, toxicity


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, keep_ids=False).drop("ids")


STAGES = [
    ("toxicity", toxicity.toxicity_stage),
    ("near duplicates", near_dedup.near_dedup_stage),
    ("repeated passages", suffix_dedup.suffix_stage),
    ("packing", pack_stage),
]

#: No SQL expresses a learned classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each writes Parquet that the next one reads."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
