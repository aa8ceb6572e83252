"""Exact removal of repeated byte strings: anchored suffix contexts, merged by interleave refinement.

A byte goes if a string of ``length`` bytes that covers it also starts earlier, in a smaller doc_id or
further up in the same document. Merging Burrows-Wheeler transforms of all suffixes takes one pass over
the whole corpus for each byte of depth and one address space; here the suffix space is cut first, so
that parts merge alone. Anchors are the k-grams with the smallest hash of some window of ``length``
bytes (winnowing), so equal windows hold equal anchors at equal places. The bytes from ``length - k``
before an anchor to ``length`` behind its start are its context, and all windows that hold it lie
inside. Contexts that are equal to an earlier one need no bytes to tell: all their windows repeat.
Where an anchor has several contexts, these are merged: their order by what follows the anchor, with
common prefixes, is the start; each step prepends the byte before, as a transform's backward step does,
and refines the interleave; intervals that agree in ``length`` bytes at a step are repeats, and all
but their earliest member go.

Defined results: null or empty texts have no bytes and the digest of the empty string. Rows with a null
doc_id are left whole and match nothing. Rows that share a doc_id should be equal; they share their
removals and don't match each other at equal places. An empty table gives no rows; other columns are
ignored by ``spans`` and kept by ``clean``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import common

LENGTH, GRAM = 100, 24
FILL = 0xFF  # never a byte of UTF-8
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
ANCHORS = "anchor long, context long, doc_id long, pos int, lo int"
CHUNK = 1 << 21
CLEANED = [StructField(n, LongType()) for n in ("doc_id", "n_bytes", "n_removed", "n_spans")] + [StructField(n, StringType()) for n in ("kept_sha256", "text")]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _slide(x: np.ndarray, width: int, choose) -> np.ndarray:
    """The minimum or maximum of each run of width neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = choose(x[:-step], x[step:])
        done += step
    return x


class Hasher:
    """Hashes of substrings of one buffer from prefix sums of a polynomial over random byte values."""

    VALUES = _mix(np.arange(1, 257, dtype=np.uint64))
    INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        power = np.full(n + 1, BASE, dtype=np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.VALUES[data] * power[:n], out=self.sums[1:])
        back = np.full(n + 1, self.INVERSE, dtype=np.uint64)
        back[0] = 1
        self.back = np.cumprod(back)

    def __call__(self, start, end) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start])


def anchors_of(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the buffer, anchor hashes and context hashes; starts: where documents begin, and the end."""
    width = length - gram + 1
    n = len(data)
    none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    if n < length:
        return none
    hasher = Hasher(data)
    h = _mix((hasher.sums[gram:] - hasher.sums[: n - gram + 1]) * hasher.back[: n - gram + 1])
    h |= np.uint64(1)
    least = _slide(h, width, np.minimum)  # for each window of length bytes
    end_of = np.repeat(starts[1:], np.diff(starts))
    least[np.arange(len(least)) + length > end_of[: len(least)]] = 0  # windows that cross documents choose nothing
    pad = np.zeros(width - 1, dtype=np.uint64)
    chosen = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), width, np.maximum) == h)
    begin_of = np.repeat(starts[:-1], np.diff(starts))
    first = np.maximum(chosen - (width - 1), begin_of[chosen])
    last = np.minimum(chosen + length, end_of[chosen])
    sides = ((chosen - first) * (length + 1) + (last - chosen)).astype(np.uint64)
    return chosen, h[chosen], _mix(hasher(first, last) + sides)


def _chunks(b: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Ids, bytes and starts of runs of rows of about CHUNK bytes."""
    whole, at = common.text_bytes(b.column("text"))
    ids, data = b.column("doc_id").to_numpy(zero_copy_only=False), np.frombuffer(whole, dtype=np.uint8)
    i = 0
    while i < len(b):
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, side="right")) - 1)
        j = min(j, len(b))
        yield ids[i:j], data[at[i] : at[j]], np.asarray(at[i : j + 1]) - at[i]
        i = j


def told_apart(ids: np.ndarray, doc: np.ndarray, place: np.ndarray, anchor: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Whether a context equals one of a smaller place in the same chunk; equal places aren't smaller."""
    own = ids[doc]
    order = np.lexsort((place, own, context, anchor))
    a, b = order[:-1], order[1:]
    equal = (anchor[a] == anchor[b]) & (context[a] == context[b])
    moved = (own[a] != own[b]) | (place[a] != place[b])
    # rows of one place, as a repeated doc_id gives them, share the answer of the first
    group = np.cumsum(np.r_[True, ~equal])
    step = np.cumsum(np.r_[False, equal & moved])
    begin = np.maximum.accumulate(np.where(np.r_[True, ~equal], step, 0))
    out = np.zeros(len(order), dtype=bool)
    out[order] = (step > begin) & (group > 0)
    return out


def joined_runs(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs that touch, of each document, as one; they come by document and place."""
    new = np.r_[True, (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1] + 1)][: len(doc)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(doc) - 1][: len(first)]
    return doc[first], lo[first], hi[last]


def find_anchors(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Anchors with their contexts, and runs (lo is not null, pos is the last start) of windows that a smaller place of the same chunk repeats.

    So copies that a task reads together leave one anchor each, and their runs a row or two for a document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, data, starts in _chunks(b):
                place, anchor, context = anchors_of(data, starts, length, gram)
                doc = np.searchsorted(starts, place, side="right") - 1
                ids, pos = np.asarray(ids).astype(np.int64), place - starts[doc]
                known = told_apart(ids, doc, pos, anchor, context)
                run_doc, lo, hi = joined_runs(doc[known], np.maximum(0, pos[known] - (length - gram)), pos[known])
                dealt = _mix(ids[run_doc].view(np.uint64) * BASE + hi.astype(np.uint64)) & ~np.uint64(1)  # anchors are odd
                left = ~known
                out = [np.r_[anchor[left], dealt].view(np.int64), np.r_[context[left], _mix(dealt + lo.astype(np.uint64))].view(np.int64), ids[np.r_[doc[left], run_doc]], np.r_[pos[left], hi].astype(np.int32)]
                begin = pa.array(np.r_[np.zeros(int(left.sum()), dtype=np.int32), lo].astype(np.int32), mask=np.arange(len(out[0])) < left.sum())
                for k in range(0, max(1, len(out[0])), 200_000):
                    part = slice(k, k + 200_000)
                    yield pa.RecordBatch.from_arrays([*(pa.array(x[part]) for x in out), begin.slice(k, 200_000)], names=["anchor", "context", "doc_id", "pos", "lo"])

    return docs.mapInArrow(run, ANCHORS)


def repeats(contexts: np.ndarray, group: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For contexts in order of place, by group: a matrix of steps by contexts, true where the window that starts so many bytes before the anchor repeats one of an earlier context.

    Ranks by what follows the anchor come from one sort with common prefixes; the classes of what stands
    before are refined by one byte at each step, and both together name the intervals.
    """
    width, n = length - gram + 1, len(contexts)
    left, right = contexts[:, : width - 1], np.ascontiguousarray(contexts[:, width - 1 :])
    have_left = (left != FILL).sum(axis=1)
    have_right = (right != FILL).sum(axis=1)
    _, rank = np.unique(_keys(right), return_inverse=True)
    order = np.lexsort((rank, group))
    a, b = right[order[:-1]], right[order[1:]]
    differ = a != b
    common_prefix = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    common_prefix[group[order[:-1]] != group[order[1:]]] = -1
    found = np.zeros((width, n), dtype=bool)
    before = group.astype(np.int64)
    for j in range(width):
        if j:
            _, before = np.unique(before * 256 + left[:, width - 1 - j], return_inverse=True)
        after = np.zeros(n, dtype=np.int64)
        after[order[1:]] = np.cumsum(common_prefix < length - j)
        valid = np.flatnonzero((have_left >= j) & (have_right >= length - j))
        if not len(valid):
            continue
        _, first, own = np.unique(before[valid] * n + after[valid], return_index=True, return_inverse=True)
        found[j, valid] = valid != valid[first[own]]
    return found


def _keys(rows: np.ndarray) -> np.ndarray:
    """Fixed-width byte strings that compare as bytes; FILL keeps trailing zeros apart."""
    wide = np.full((len(rows), rows.shape[1] + 1), FILL, dtype=np.uint8)
    wide[:, :-1] = rows
    return wide.view(f"S{rows.shape[1] + 1}").ravel()


def _runs(found: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, and first and last start of each run of repeated windows."""
    steps = np.zeros((found.shape[0] + 2, found.shape[1]), dtype=np.int8)
    steps[1:-1] = found
    edge = np.diff(steps, axis=0)
    c1, j1 = np.nonzero((edge == 1).T)
    _, j2 = np.nonzero((edge == -1).T)
    return c1, pos[c1] - (j2 - 1), pos[c1] - j1


def merge_contexts(contexts: DataFrame, block: int = 20_000, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Runs of starts of repeated windows, from contexts that come by anchor, and in order of place for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            anchor, doc, pos, raw = (np.concatenate([p[i] for p in parts]) for i in range(4))
            once = np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])]  # rows that repeat a doc_id give each context again
            anchor, doc, pos, raw = anchor[once], doc[once], pos[once], raw[once]
            group = np.cumsum(np.r_[0, anchor[1:] != anchor[:-1]])
            c, lo, hi = _runs(repeats(raw, group, length, gram), pos.astype(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(doc[c]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["doc_id", "lo", "hi"])

        for b in batches:
            raw = np.frombuffer(common.text_bytes(b.column("bytes"))[0], dtype=np.uint8).reshape(len(b), -1)
            rows = [b.column(c).to_numpy() for c in ("anchor", "doc_id", "pos")] + [raw]
            if size >= block and len(b):
                # all anchors but the last are complete; that one waits for its other contexts
                anchor = np.concatenate([p[0] for p in held])
                cut = int(np.flatnonzero(anchor != anchor[-1])[-1]) + 1 if (anchor != anchor[-1]).any() else 0
                if cut:
                    joined = tuple(np.concatenate([p[i] for p in held]) for i in range(4))
                    yield flush([tuple(x[:cut] for x in joined)])
                    held, size = [tuple(x[cut:] for x in joined)], len(anchor) - cut
            held.append(tuple(rows))
            size += len(b)
        if size:
            yield flush(held)

    return contexts.mapInArrow(run, "doc_id long, lo int, hi int")


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id and the runs of starts, in bytes, of windows that also start earlier."""
    spark = common.session_of(docs)
    width = length - gram + 1
    rows = common.documents(docs).filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    place = F.struct("doc_id", "pos")
    by_anchor = Window.partitionBy("anchor")
    own = by_anchor.orderBy("context", "doc_id", "pos")
    marked = find_anchors(rows, length, gram)
    marked = marked.withColumn("same", F.lag("context").over(own) == F.col("context")).withColumn("back", F.lag(place).over(own))
    marked = marked.withColumn("several", F.min("context").over(by_anchor) != F.max("context").over(by_anchor))
    marked = marked.filter(~F.coalesce(F.col("same") & (F.col("back") == place), F.lit(False)))  # a repeated row's anchors count once
    marked = marked.withColumn("same", F.coalesce("same", F.lit(False)) | F.col("lo").isNotNull()).filter("same OR several").select("anchor", "doc_id", "pos", "same", "lo")
    marked = common.saved(marked, "marked")
    whole = marked.filter("same").select("doc_id", F.coalesce("lo", F.greatest(F.lit(0), F.col("pos") - (width - 1))).alias("lo"), F.col("pos").alias("hi"))
    wanted = marked.filter("NOT same").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "pos")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, at = common.text_bytes(b.column("text"))
            data = np.frombuffer(text, dtype=np.uint8)
            for i, doc_id in enumerate(b.column("doc_id").to_pylist()):
                want = b.column("wanted")[i].values
                anchor, pos = want.field("anchor").to_numpy(), want.field("pos").to_numpy()
                own = np.full(at[i + 1] - at[i] + 2 * length, FILL, dtype=np.uint8)
                own[length : len(own) - length] = data[at[i] : at[i + 1]]
                for k in range(0, len(pos), 20_000):
                    p = pos[k : k + 20_000]
                    raw = np.lib.stride_tricks.sliding_window_view(own, width - 1 + length)[p + length - (width - 1)]
                    out = pa.array([r.tobytes() for r in raw], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[k : k + 20_000]), pa.array(np.full(len(p), doc_id, dtype=np.int64)), pa.array(p), out], names=["anchor", "doc_id", "pos", "bytes"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    contexts = rows.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(cut, "anchor long, doc_id long, pos int, bytes binary")
    merged = merge_contexts(contexts.repartition(n, "anchor").sortWithinPartitions("anchor", "doc_id", "pos"), length=length, gram=gram)
    return common.saved(whole.unionByName(merged), "runs")


def cleaned(docs: DataFrame, carry: Column | None = None, length: int = LENGTH) -> DataFrame:
    """doc_id, the digest columns, the kept bytes as text (characters that a removal cuts go) and a struct that is carried along."""
    runs = spans(docs, length).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")).withColumnRenamed("doc_id", "run_id")
    rows = common.documents(docs, *([] if carry is None else [carry]))
    extra = [] if carry is None else [common.CARRIED]
    rows = rows.join(runs, F.col("doc_id") == F.col("run_id"), "left").drop("run_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, at = common.text_bytes(b.column("text"))
            data = np.frombuffer(whole, dtype=np.uint8)
            found = []
            for i in range(len(b)):
                own = data[at[i] : at[i + 1]]
                n, runs_of = len(own), b.column("runs")[i].values
                if runs_of is None or n < length:
                    kept, removed, n_spans = own.tobytes(), 0, 0
                else:
                    lo, hi = runs_of.field("lo").to_numpy().astype(np.int64), runs_of.field("hi").to_numpy().astype(np.int64)
                    lo, hi = np.clip(lo, 0, n), np.minimum(hi, n - length) + length
                    real = hi - lo >= length
                    steps = np.zeros(n + 1, dtype=np.int32)
                    np.add.at(steps, lo[real], 1)
                    np.add.at(steps, hi[real], -1)
                    gone = np.cumsum(steps[:n]) > 0
                    kept, removed = own[~gone].tobytes(), int(gone.sum())
                    n_spans = int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum())
                found.append((n, removed, n_spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)), *(b.column(c) for c in extra)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", *extra])

    return rows.mapInArrow(run, StructType([*CLEANED, *(rows.schema[c] for c in extra)]))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(common.table(spark, sf_dir, "documents")).drop("text")


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated bytes, with all other columns as they were; n_chars is that of the new text, and documents of which nothing is left stay, empty; null texts stay null."""
    out = cleaned(docs, common.carried(docs, "text", "n_chars"))
    own = {"text": common.text_as_it_was()}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length(common.text_as_it_was()).cast(docs.schema["n_chars"].dataType)
    return common.uncarried(out, docs, "text", "n_chars", **own)
