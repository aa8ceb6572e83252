"""ZIP-packaged web archives: WARC records in stored ZIP members, read back by byte range.

An archive is a ZIP file with three stored (uncompressed) members: ``archive/data.warc.gz``, whose
records are gzip members of their own; ``indexes/index.cdx``, a line for each record with its place
in that member; and ``datapackage.json``. A reader needs the tail of the file, the central directory
and the index; records are then read by range, and nothing is extracted.

Defined results: null html is an empty payload. A null url is written as ``urn:page``. A row with a
null page_id is archived without an id and comes back with null; it is a response only if all rows
with its payload lack an id. Repeated rows that carry the largest page_id of their payload are all
responses. An empty table gives no archive and no rows. Columns other than page_id, url and html are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DATA_MEMBER, INDEX_MEMBER, PACKAGE_MEMBER = "archive/data.warc.gz", "indexes/index.cdx", "datapackage.json"
# Fixed values of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64, EXTRA64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50, 0x0001
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF

#: Parts in which rows of one payload are dealt out.
SALTS = 16
MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


# ---------------------------------------------------------------- ZIP


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored: int
    header_at: int


def zip_bytes(members: list[tuple[str, bytes]], zip64: bool = True) -> bytes:
    """A ZIP file of stored members. zip64: with 64-bit sizes, places and end records throughout."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        raw, at, crc = name.encode(), len(out), zlib.crc32(data)
        wide = struct.pack("<HHQQ", EXTRA64, 16, len(data), len(data)) if zip64 else b""
        size = FULL32 if zip64 else len(data)
        out += struct.pack("<IHHHHHIIIHH", LOCAL, 45 if zip64 else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(wide)) + raw + wide
        out += data
        wide = struct.pack("<HHQQQ", EXTRA64, 24, len(data), len(data), at) if zip64 else b""
        central += struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45 if zip64 else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(wide), 0, 0, 0, 0, FULL32 if zip64 else at) + raw + wide
    start, n = len(out), len(members)
    out += central
    if zip64:
        end64 = len(out)
        out += struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, len(central), start)
        out += struct.pack("<IIQI", LOCATOR64, 0, end64, 1)
    short = (FULL16, FULL16, FULL32, FULL32) if zip64 else (n, n, len(central), start)
    return bytes(out + struct.pack("<IHHHHIIH", END, 0, 0, *short, 0))


class ZipRanges:
    """Range reads of a ZIP file's stored members. source: an open file with size(), seek() and read()."""

    def __init__(self, source) -> None:
        self.source, self.length = source, source.size()
        self.members = {m.name: m for m in self._directory()}

    def at(self, start: int, n: int) -> bytes:
        self.source.seek(start)
        data = self.source.read(n)
        if len(data) != n:
            raise ValueError(f"archive ends early: {len(data)} of {n} bytes at {start}")
        return data

    def _end(self) -> tuple[int, int, int]:
        """Entries, and size and place of the central directory."""
        n = min(self.length, 22 + FULL16)
        tail = self.at(self.length - n, n)
        k = tail.rfind(struct.pack("<I", END))
        while k >= 0 and (len(tail) - k < 22 or struct.unpack_from("<H", tail, k + 20)[0] != len(tail) - k - 22):
            k = tail.rfind(struct.pack("<I", END), 0, k)  # the signature may stand in a comment
        if k < 0:
            raise ValueError("no end of central directory: not a ZIP file")
        entries, size, start = struct.unpack_from("<HII", tail, k + 10)
        end_at = self.length - n + k
        if (entries == FULL16 or size == FULL32 or start == FULL32) and end_at >= 20:
            sign, _, where, _ = struct.unpack("<IIQI", self.at(end_at - 20, 20))
            if sign == LOCATOR64:
                head = struct.unpack("<IQHHIIQQQQ", self.at(where, 56))
                if head[0] != END64:
                    raise ValueError("damaged ZIP64 end record")
                entries, size, start = head[7:10]
        return entries, size, start

    def _directory(self) -> Iterator[Member]:
        entries, size, start = self._end()
        raw, k = self.at(start, size), 0
        for _ in range(entries):
            f = struct.unpack_from("<IHHHHHHIIIHHHHHII", raw, k)
            if f[0] != CENTRAL:
                raise ValueError("damaged central directory")
            name = raw[k + 46 : k + 46 + f[10]].decode()
            extra, stored, full, header_at = raw[k + 46 + f[10] : k + 46 + f[10] + f[11]], f[8], f[9], f[16]
            while len(extra) >= 4:
                tag, n = struct.unpack_from("<HH", extra)
                if tag == EXTRA64:  # holds only those that are full in the entry, in this order
                    wide = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                    full = next(wide) if full == FULL32 else full
                    stored = next(wide) if stored == FULL32 else stored
                    header_at = next(wide) if header_at == FULL32 else header_at
                extra = extra[4 + n :]
            yield Member(name, f[4], full, stored, header_at)
            k += 46 + f[10] + f[11] + f[12]

    def place(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin in the file, and how many they are."""
        m = self.members[name]
        if m.method:
            raise ValueError(f"{name} is compressed in the ZIP file; ranges need stored members")
        f = struct.unpack("<IHHHHHIIIHH", self.at(m.header_at, 30))
        if f[0] != LOCAL:
            raise ValueError(f"no local header for {name}")
        return m.header_at + 30 + f[9] + f[10], m.size


# ---------------------------------------------------------------- WARC records


def _clean(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:page"


def record_id(page_id: int | None, digest: str) -> str:
    """The same for a page and payload in every attempt, so that a revisit can name its response before that is written."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member with a WARC/1.1 record; a revisit keeps the HTTP head only, whose Content-Length is that of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Target-URI: {_clean(url)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse_record(packed: bytes, verify: bool = True) -> dict:
    raw = zlib.decompress(packed, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    f = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(f["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest, revisit = f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"] == "revisit"
    if verify and not revisit and (len(payload) != n or base32_sha1(payload) != digest):
        raise ValueError(f"payload of {f['WARC-Record-ID']} doesn't match its digest")
    return {"page_id": int(f["WARC-Page-ID"]) if "WARC-Page-ID" in f else None, "url": f["WARC-Target-URI"], "record_type": f["WARC-Type"], "refers_to": int(f["WARC-Refers-To-Page-ID"]) if "WARC-Refers-To-Page-ID" in f else None, "payload_bytes": n, "payload_digest": digest, "payload": None if revisit else payload}


# ---------------------------------------------------------------- Spark


def write_archives(pages: DataFrame, root: str, target_bytes: int = 32 << 20, zip64: bool = True) -> DataFrame:
    """Writes an archive or more for each partition below root, a URI that all executors reach; returns the manifest, itself kept in root.

    Of equal payloads the row with the largest page_id is the response and the others revisit it. The
    largest ids come from an aggregate with map-side combining; the join that brings them to the rows deals
    a payload's rows to SALTS tasks, and adaptive execution splits those of a hot one further. A task that runs again writes under new names, and the manifest
    lists those of the attempt that Spark committed.
    """
    spark = common.session_of(pages)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("sha", F.unhex(F.sha1("html")))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    top = rows.groupBy("sha").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).filter("n > 1").select("sha", "top", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.join(top, ["sha", "salt"], "left").select("page_id", "url", "html", "sha", "top")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(root)
        fs.create_dir(base, recursive=True)
        data, index, n = bytearray(), [], 0

        def flush() -> pa.RecordBatch:
            path = f"{base}/part-{uuid.uuid4().hex}.wacz"
            packed = zip_bytes([(DATA_MEMBER, bytes(data)), (INDEX_MEMBER, "".join(index).encode()), (PACKAGE_MEMBER, json.dumps({"profile": "data-package", "records": n}).encode())], zip64)
            with fs.open_output_stream(path) as out:
                out.write(packed)
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": [n], "n_bytes": [len(packed)]})

        for b in batches:
            whole, at = common.text_bytes(b.column("html"))
            for i, (page_id, url, sha, top) in enumerate(zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "sha", "top")), strict=True)):
                revisit = top is not None and page_id != top
                packed = record_bytes(page_id, url, bytes(whole[at[i] : at[i + 1]]), base64.b32encode(sha).decode(), top, revisit)
                index.append(f"{'-' if page_id is None else page_id} {len(data)} {len(packed)}\n")
                data += packed
                n += 1
                if len(data) >= target_bytes:
                    yield flush()
                    data, index, n = bytearray(), [], 0
        if n:
            yield flush()

    manifest = f"{root}/manifest"
    rows.mapInArrow(write, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def read_archives(manifest: DataFrame, root: str, payloads: bool = True, chunk_bytes: int = 4 << 20) -> DataFrame:
    """The records of the archives in a manifest. Only directories, indexes and the ranges of records are read, neighbours of up to chunk_bytes at once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(root)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for b in batches:
            for path in b.column("path").to_pylist():
                with fs.open_input_file(path) as f:
                    z = ZipRanges(f)
                    first, size = z.place(INDEX_MEMBER)
                    places = [tuple(map(int, line.split()[1:])) for line in z.at(first, size).decode().splitlines()]
                    first, _ = z.place(DATA_MEMBER)
                    k = 0
                    while k < len(places):
                        start, last = places[k][0], k
                        while last + 1 < len(places) and sum(places[last + 1]) - start <= chunk_bytes:
                            last += 1
                        chunk = z.at(first + start, sum(places[last]) - start)
                        found = [parse_record(chunk[o - start : o - start + n]) for o, n in places[k : last + 1]]
                        for r in found if not payloads else ():
                            r["payload"] = None
                        yield pa.RecordBatch.from_pylist(found, schema)
                        k = last + 1

    # one archive a task where there are enough cores: the manifest is a line for each archive
    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    return manifest.repartition(n).mapInArrow(lambda it: read(it), RECORDS)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = common.scratch(spark, "warc")
    manifest = write_archives(common.table(spark, sf_dir, "pages"), root)
    return read_archives(manifest, root, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = " || ".join(f"substr('{_LETTERS}', CAST((CAST('0x' || substr(h, {5 * i + 1}, 5) AS BIGINT) >> {shift}) & 31 AS BIGINT) + 1, 1)" for i in range(8) for shift in (15, 10, 5, 0))
OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN top IS NULL OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top IS NULL OR page_id = top THEN NULL ELSE top END AS refers_to FROM p
"""
