"""Byte-level BPE with the tokenizers library over Arrow batches; decoding reverses the byte table.

A rank file becomes a BPE model of the library: every token is written in the byte-to-character
alphabet, and every pair of lower-ranked tokens that makes a token is a merge, in rank order. Texts
are cut where a space follows a character that isn't white space. No match of the split pattern
crosses such a place, so pieces encode alone and each worker keeps the ids of the pieces it has seen.
Texts with white space before a space are encoded whole.

Defined results: null or empty texts have no tokens; ids_sha256 is then that of the empty string.
Strings of special tokens are ordinary text. Equal rows give equal rows; null ids stay null. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Pieces that a worker remembers; then it starts anew. Bounds memory and never changes ids.
REMEMBERED = 400_000
#: Characters for which all Unicode tables agree on what is a letter, a number or white space.
PLAIN = re.compile("[\n\x20-\x7eÀ-ÖØ-öø-ž]*")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
IDS_SCHEMA = "doc_id long, ids array<int>, starts array<int>, ends array<int>"


def byte_alphabet() -> dict[int, str]:
    """A printable character for each byte: itself where it is printable, else the next from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return {b: chr(b if b in printable else next(spare)) for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class ByteBPE:
    """Encodes by the library, piece by piece, and decodes by the reversed byte table."""

    def __init__(self, path: str, pattern: str) -> None:
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ranks, self.chars = read_ranks(path), byte_alphabet()
        name = {token: "".join(map(self.chars.__getitem__, token)) for token in ranks}
        merges = []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            for i in range(1, len(token)):
                left, right = token[:i], token[i:]
                if ranks.get(left, rank) < rank and ranks.get(right, rank) < rank:
                    merges.append((name[left], name[right]))
        self.whole = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges))
        self.whole.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), behavior="isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.model, self.split = self.whole.model, regex.compile(pattern)
        back = {c: b for b, c in self.chars.items()}
        #: The byte table reversed, by id.
        self.table: dict[int, bytes] = {r: bytes(map(back.__getitem__, name[t])) for t, r in ranks.items()}
        self.matches: dict[str, tuple[int, ...]] = {}

    def ids(self, text: str) -> list[int]:
        if not PLAIN.fullmatch(text):
            return self.whole.encode(text, add_special_tokens=False).ids
        found: list[int] = []
        for match in self.split.findall(text):
            ids = self.matches.get(match)
            if ids is None:
                if len(self.matches) >= REMEMBERED:
                    self.matches.clear()
                ids = self.matches[match] = tuple([t.id for t in self.model.tokenize("".join(map(self.chars.__getitem__, match.encode())))])
            found += ids
        return found

    def decode(self, ids) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def offsets(self, text: str, ids: list[int]) -> tuple[list[int], list[int]]:
        """The first and the end character of each token; tokens that hold parts of one character all span it."""
        data = text.encode()
        before = [0]  # characters that begin before each byte
        for b in data:
            before.append(before[-1] + (b & 0xC0 != 0x80))
        starts, ends, at = [], [], 0
        for i in ids:
            n = len(self.table[i])
            starts.append(before[at] if data[at] & 0xC0 != 0x80 else before[at] - 1)
            ends.append(before[at + n])
            at += n
        return starts, ends


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def vocabulary(path: str | None, name: str) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path(name), public_tokenizers.PATTERN


class Pieces(dict):
    """What is known of each piece: its ids in decimal, their number and the bytes they decode to; None for a piece after which no cut is safe."""

    def __init__(self, bpe: ByteBPE, lead: str) -> None:
        super().__init__()
        self.bpe, self.lead = bpe, lead

    def __missing__(self, part: str):
        if len(self) >= REMEMBERED:
            self.clear()
        if not part or part[-1].isspace():
            return self.setdefault(part, None)
        ids = self.bpe.ids(self.lead + part)
        self[part] = value = (",".join(map(str, ids)), len(ids), self.bpe.decode(ids))
        return value


def encode(docs: DataFrame, path: str | None = None, name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id, ids and the character offsets of each token, for callers that want the tokens themselves."""
    path, pattern = vocabulary(path, name)
    common.session_of(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = bpe.ids(text)
                starts, ends = bpe.offsets(text, ids)
                rows.append({"doc_id": doc_id, "ids": ids, "starts": starts, "ends": ends})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), *((c, pa.list_(pa.int32())) for c in ("ids", "starts", "ends"))]))

    return common.documents(docs).mapInArrow(run, IDS_SCHEMA)


def decode(tokens: DataFrame, path: str | None = None, name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id and the text of ids; bytes that are no UTF-8 become replacement characters."""
    path, pattern = vocabulary(path, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for b in batches:
            texts = [bpe.decode(ids or ()).decode("utf-8", "replace") for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None, name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of what they decode to."""
    path, pattern = vocabulary(path, name)
    common.session_of(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        first, rest = Pieces(bpe, ""), Pieces(bpe, " ")
        for b in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in b.column("text").to_pylist():
                head, *parts = text.split(" ")
                known = [first[head], *map(rest.__getitem__, parts)] if text else []
                if None in known:
                    ids = bpe.ids(text)
                    known = [(",".join(map(str, ids)), len(ids), bpe.decode(ids))]
                counts.append(sum([k[1] for k in known]))
                ids_sha.append(hashlib.sha256(",".join([k[0] for k in known]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(b"".join([k[2] for k in known])).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.documents(docs).mapInArrow(run, SCHEMA)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))
