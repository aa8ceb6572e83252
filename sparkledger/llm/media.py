"""Interleaved sequences of text and media: HTML gives ordered structs, digests lead to payloads.

``sequences`` parses a page into its items in order: text, or a reference to media with the caption
that belongs to it. ``resolve`` joins references to a media store by digest; the store is read once
and only what a caller computes from a payload travels in the join, so payloads are never shuffled
and a digest that a third of all pages cite costs narrow rows only.

Media are PNG images of 8-bit grey samples; a payload is stored row by row and comes back as it was.

Defined results: null or empty texts are one line of samples of 255. Null html has no items. Equal
texts give equal media; repeated rows are rows of their own, null ids stay null. Empty tables give no
rows; other columns are ignored. References that no stored media matches keep null payload columns.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LINE = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value of the format
ITEM = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, pixels string"

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|([^<]+|<)", re.S | re.I)
SOURCE = re.compile(r"\bsrc\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
INLINE = frozenset("a abbr b bdi bdo cite code em font i kbd mark q s samp small span strong sub sup time tt u var wbr".split())
MEDIA = frozenset("img audio video source embed".split())


# ---------------------------------------------------------------- PNG


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def png_bytes(samples: bytes, width: int = LINE, level: int = 1) -> bytes:
    """A grey image of whole lines; every line has filter 0."""
    lines = np.frombuffer(samples, dtype=np.uint8).reshape(-1, width)
    raw = np.zeros((len(lines), width + 1), dtype=np.uint8)
    raw[:, 1:] = lines
    head = struct.pack(">IIBBBBB", width, len(lines), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def png_samples(data: bytes) -> tuple[bytes, int, int]:
    """The samples, width and height of an image that png_bytes wrote; anything else raises."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    k, packed, size = 8, bytearray(), (0, 0)
    while k < len(data):
        (n,) = struct.unpack_from(">I", data, k)
        kind, body = data[k + 4 : k + 8], data[k + 8 : k + 8 + n]
        if struct.unpack_from(">I", data, k + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            *size, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, lace) != (8, 0, 0):
                raise ValueError("only 8-bit grey images without interlace are read")
        elif kind == b"IDAT":
            packed += body
        k += 12 + n
    raw = np.frombuffer(zlib.decompress(bytes(packed)), dtype=np.uint8).reshape(size[1], size[0] + 1)
    if raw[:, 0].any():
        raise ValueError("only lines with filter 0 are read")
    return raw[:, 1:].tobytes(), size[0], size[1]


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (max(1, -(-len(text) // LINE)) * LINE - len(text))


# ---------------------------------------------------------------- sequences


def items_of(page: str) -> list[dict]:
    """Text and media references in page order. The caption of a reference is the figcaption of its figure, and else its alt text."""
    found: list[dict] = []
    words: list[str] = []
    figure: int | None = None
    caption = False

    def close() -> None:
        text = " ".join(entities.unescape("".join(words)).split())
        words.clear()
        if text and caption and figure is not None:
            for item in found[figure:]:
                if item["kind"] == "media":
                    item["caption"] = text
        elif text:
            found.append({"kind": "text", "text": text, "digest": None, "caption": None})

    for m in TOKEN.finditer(page):
        if m[5] is not None:
            words.append(m[5])
            continue
        tag = (m[3] or "").lower()
        if not tag or tag in INLINE:
            continue
        if tag == "br":
            words.append(" ")
            continue
        close()
        if tag in MEDIA and not m[2]:
            if s := SOURCE.search(m[4]):
                alt = re.search(r"\balt\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", m[4], re.I)
                source = entities.unescape(s[1] or s[2] or s[3] or "")
                found.append({"kind": "media", "text": None, "digest": source.rpartition(":")[2], "caption": entities.unescape(alt[1] or alt[2] or "") if alt else None})
        elif tag == "figure":
            figure = None if m[2] else len(found)
        elif tag == "figcaption":
            caption = not m[2]
    close()
    return [{"position": i, **item} for i, item in enumerate(found)]


def sequences(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """id and items, ordered, of each page."""
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([items_of(p or "") for p in b.column(1).to_pylist()], kind)], names=["id", "items"])

    common.session_of(pages)
    return pages.select(F.col(id_column).cast("long").alias("id"), F.col(html_column).cast("string").alias("html")).mapInArrow(run, f"id long, items {ITEM}")


def stored_features(store: DataFrame) -> DataFrame:
    """For each digest of a store (digest, media) what is computed from the samples read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for digest, media in zip(b.column("digest").to_pylist(), b.column("media"), strict=True):
                media = media.as_py()
                samples, width, height = png_samples(media)
                values = np.frombuffer(samples, dtype=np.uint8)
                total, high = int(values.sum(dtype=np.int64)), int(np.count_nonzero(values >= 128))
                rows.append((digest, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"grey {width}x{height} sum {total} high {high} distinct {len(np.unique(values))}"))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in FEATURES.split(", ")])

    own = store.mapInArrow(run, FEATURES)
    return own.groupBy("digest").agg(*[F.first(c).alias(c) for c in own.columns if c != "digest"])


def resolve(items: DataFrame, store: DataFrame) -> DataFrame:
    """Each media reference of sequences() with its position, caption and what its payload gives."""
    refs = items.select("id", F.explode("items").alias("item")).filter("item.kind = 'media'").select("id", "item.position", "item.caption", "item.digest")
    return refs.join(stored_features(store), "digest", "left")


def compose(docs: DataFrame) -> DataFrame:
    """doc_id, an HTML page that refers to the document's payload by digest, and the media itself where the task hasn't met it before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[str] = set()
        for b in batches:
            whole, at = common.text_bytes(b.column("text"))
            pages, digests, media = [], [], []
            for i in range(len(b)):
                text = bytes(whole[at[i] : at[i + 1]])
                image = png_bytes(padded(text))
                digest = hashlib.sha256(image).hexdigest()
                pages.append(f'<article><p>text of {len(text)} bytes</p><figure><img src="sha256:{digest}"><figcaption>{len(text)}</figcaption></figure><p>end</p></article>')
                digests.append(digest)
                media.append(None if digest in met else image)
                met.add(digest) if len(met) < 1_000_000 else met.clear()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pages, pa.string()), pa.array(digests, pa.string()), pa.array(media, pa.binary())], names=["doc_id", "html", "digest", "media"])

    common.session_of(docs)
    return common.documents(docs).mapInArrow(run, "doc_id long, html string, digest string, media binary")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = common.saved(compose(common.table(spark, sf_dir, "documents")), "media")
    found = resolve(sequences(written, "doc_id"), written.filter("media IS NOT NULL").select("digest", "media"))
    return found.select(F.col("id").alias("doc_id"), F.col("caption").cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat_ws(" ", F.lit("item"), F.col("position"), F.lit("caption"), F.col("caption"), F.col("pixels")).alias("feature"))
