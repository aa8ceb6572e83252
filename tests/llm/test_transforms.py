"""Merged transforms against sorted suffixes, and repeated bytes against brute force and op4."""

import hashlib
import os

import numpy as np
import pytest

from sparkledger.llm import common, suffix_dedup, transforms

SF = "/root/testdata/sf0.01"


def test_merged_order_and_common_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(40):
        depth, k = int(rng.integers(1, 12)), int(rng.integers(1, 5))
        strings = [bytes(rng.integers(97, 99 + rng.integers(3), rng.integers(0, 30)).astype(np.uint8)) for _ in range(rng.integers(1, 12))]
        shards = [s for s in (strings[i::k] for i in range(k)) if s]
        parts = [transforms.transform(np.frombuffer(b"".join(s), dtype=np.uint8), np.r_[0, np.cumsum([len(x) for x in s])], depth) for s in shards]
        suffixes = [[x[j : j + depth] for x in s for j in range(len(x) + 1)] for s in shards]
        shard, index, prefix = transforms.merge(parts, depth)
        got = [suffixes[a][parts[a].place[b]] for a, b in zip(shard, index, strict=True)]
        assert got == sorted(x for s in suffixes for x in s)
        for a, b, n in zip(got, got[1:], prefix[1:], strict=False):
            common_bytes = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert n == common_bytes or (a == b and len(a) < depth and n <= len(a))


def brute(texts, n):
    seen, out = set(), []
    for b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if b[k : k + n] in seen:
                gone[k : k + n] = b"\1" * n
            seen.add(b[k : k + n])
        out.append(gone)
    return out


def test_repeated_bytes_of_merged_transforms(spark):
    rng = np.random.default_rng(2)
    shared = [bytes(rng.integers(97, 123, 150).astype(np.uint8)) for _ in range(3)]
    texts = [b"".join([bytes(rng.integers(97, 123, rng.integers(0, 200)).astype(np.uint8)), shared[i % 3], b"xy" * (i % 5) * 40]) for i in range(20)] + [b"", b"a" * 400]
    want = brute(texts, 100)
    for shards in (1, 3, 7):
        assert [bytes(g.astype(np.uint8)) for g in transforms.repeated_bytes(texts, shards, 100)] == [bytes(g) for g in want]
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in suffix_dedup.cleaned(docs).collect()} == {i: sum(g) for i, g in enumerate(want)}
    assert transforms.repeated_bytes([], 3, 100) == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_op4_equals_brute_force_on_a_whole_table(spark):
    rows = sorted(common.table(spark, SF, "documents").select("doc_id", "text").collect())
    texts = [(r.text or "").encode() for r in rows]
    want = {}
    for r, b, g in zip(rows, texts, brute(texts, 100), strict=True):
        kept = bytes(x for x, y in zip(b, g, strict=True) if not y)
        want[r.doc_id] = len(b), sum(g), (b"\0" + bytes(g)).count(b"\0\1"), hashlib.sha256(kept).hexdigest()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op4_suffix_dedup(spark, SF).collect()} == want
