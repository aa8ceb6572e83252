"""The registered queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, html_text, licenses, media, near_dedup, packing, suffix_dedup, tokens, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_html_extraction": html_text.op2_html_extraction,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_nearest_neighbours": ann.op6_nearest_neighbours,
    "op7_warc": warc.op7_warc,
    "op8_byte_bpe": tokens.op8_byte_bpe,
    "op9_media_columns": media.op9_media_columns,
    "op10_packing": packing.op10_packing,
}

ORACLES: dict[str, str] = {"op5_license_scan": licenses.OP5_SQL, "op6_nearest_neighbours": ann.OP6_SQL, "op7_warc": warc.OP7_SQL}
