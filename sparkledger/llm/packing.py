"""Packing of tokenized documents by shortest-pack-first over the histogram of lengths.

Documents are cut into full sequences and a rest. The histogram of piece lengths, which has no more
rows than a sequence has tokens, goes to the driver; lengths are placed from the longest to the
shortest, each into the packs with the fewest tokens so far, for a whole group of like packs at a
time. What comes out is a table of slots: so many pieces of a length, from a rank on, go to sequences
from a number on, at an offset. Pieces find their slot by length and rank, and ranks come from counts
of each task and length, so no group of equal lengths meets in one task.

Defined results: null or empty texts are one piece with the end token alone. Null doc_ids stay null;
repeated rows are documents of their own. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

REMEMBERED = 400_000
#: Texts whose characters the normalizer only lower-cases, one by one.
PLAIN = re.compile("[\n\x20-\x7eÀ-ÖØ-öø-įı-ž]*")
#: Fixed value: the split pattern of the vocabulary file, as it reads on plain texts.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, pid int, local long"


class Matches(dict):
    """The ids of each match of the split pattern, as little-endian 32-bit numbers."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        from .tokens import byte_alphabet

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.chars = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})
        #: Strings that the library takes for one id of their own before it splits a text.
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}

    def __missing__(self, match: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        written = match if match.isascii() else match.encode().decode("latin-1").translate(self.chars)
        self[match] = ids = array("I", [t.id for t in self.model.tokenize(written)]).tobytes()
        return ids

    def library(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, word: str) -> bytes:
        if PLAIN.fullmatch(word):
            return b"".join(map(self.__getitem__, SPLIT.findall(word.lower())))
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            ids = self.words[word] = self.library(word)
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text, as the library gives them.

        Plain texts are split here; in others, words between spaces and line ends encode alone, since the
        vocabulary drops white space. A text that holds an added token goes to the library whole.
        """
        if any(t in text for t in self.added):
            return self.library(text)
        if PLAIN.fullmatch(text):
            return b"".join(map(self.__getitem__, SPLIT.findall(text.lower())))
        return b"".join(map(self.word, text.replace("\n", " ").split(" ")))


@functools.lru_cache(maxsize=2)
def matches(path: str) -> Matches:
    return Matches(path)


def cut(docs: DataFrame, path: str, limit: int, end_id: int, keep_ids: bool) -> DataFrame:
    """The pieces of each document, with the task that made them and their rank in it among pieces of their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, last = matches(path), int(end_id).to_bytes(4, "little")
        seen: dict[int, int] = defaultdict(int)
        pid = TaskContext.get().partitionId()
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = vocabulary.encode(text) + last
                total = len(ids) // 4
                for start in range(0, total, limit):
                    part = ids[4 * start : 4 * (start + limit)]
                    n = len(part) // 4
                    rows.append((doc_id, start, n, zlib.crc32(part), total, part if keep_ids else None, pid, seen[n]))
                    seen[n] += 1
            kinds = (pa.int64(),) * 5 + (pa.binary(), pa.int32(), pa.int64())
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "pid", "local"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return docs.mapInArrow(run, PIECES)


def slots(histogram: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, how many, first sequence, offset): shortest-pack-first, longest lengths first.

    Packs that hold the same lengths are one group with a count; a placement moves a group, or a part
    of it, to a smaller space. Work depends on limit and the number of lengths, not on the counts.
    """
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # space left: (first sequence, number of packs)
    spaces = np.zeros(limit + 1, dtype=bool)
    out, sequences = [], 0

    def keep(space: int, first: int, n: int) -> None:
        if space and n:
            groups[space].append((first, n))
            spaces[space] = True

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            open_ = np.flatnonzero(spaces)
            space = int(open_[-1]) if len(open_) else 0
            if space < length:
                most = limit // length
                for packs, each in ((left // most, most), (1, left % most)):
                    if packs and each:
                        for i in range(each):
                            out.append((length, rank, packs, sequences, i * length))
                            rank += packs
                        left -= packs * each
                        keep(limit - each * length, sequences, packs)
                        sequences += packs
                continue
            first, n = groups[space].pop()
            if not groups[space]:
                spaces[space] = False
            other = space if spaces[space] else int(open_[-2]) if len(open_) > 1 else 0
            each = max(1, min(left // n, space // length, -(-(space - other) // length)))
            packs = min(n, left)
            for i in range(each):
                out.append((length, rank, packs, first, limit - space + i * length))
                rank += packs
            left -= packs * each
            keep(space - each * length, first, packs)
            keep(space, first + packs, n - packs)
    return out


def pack(docs: DataFrame, path: str | None = None, name: str = "word_bpe_49k.json", limit: int = 2048, end_id: int = 1, keep_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of each piece, and its ids as 32-bit numbers where they are kept."""
    import public_tokenizers

    common.session_of(docs)
    pieces = common.saved(cut(common.documents(docs), path or public_tokenizers.path(name), limit, end_id, keep_ids), "pieces")
    counts = pieces.groupBy("pid", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # limit rows at most
    placed = np.array(slots(histogram, limit), dtype=np.int64).reshape(-1, 5)
    placed = placed[np.lexsort((placed[:, 1], placed[:, 0]))]
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("pid", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(counts, ["pid", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", (F.col("before") + F.col("local")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = int(placed[:, 1].max(initial=0)) + 1
        keys = placed[:, 0] * top + placed[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            row = placed[np.searchsorted(keys, length * top + np.minimum(rank, top - 1), side="right") - 1]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4]), b.column("ids")], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return ranked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")
