"""The pipeline's stages over all of sf0.001, held against brute force."""

import os
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from sparkledger.llm import common, near_dedup, toxicity

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages_against_brute_force(spark):
    docs = common.table(spark, SF, "documents")
    clean = common.saved(corpus_pipeline.STAGES[0][1](spark, docs, SF), "clean")
    kept = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == docs.columns
    scored = {r.doc_id: r.predicted for r in toxicity.op3_toxicity(spark, SF).collect()}
    assert set(kept) == {i for i, p in scored.items() if not p}

    single = common.saved(corpus_pipeline.STAGES[1][1](spark, clean, SF), "single")
    known = near_dedup.WordHashes()
    ids = sorted(kept)
    words = [near_dedup.words_of(kept[i] or "", known) for i in ids]
    grams = [np.sort(near_dedup.labelled(near_dedup.grams_of(w))) for w in words]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if len(words[i]) and len(words[j]) and near_dedup.resemblance(grams[i], grams[j]) >= 0.8 and near_dedup.aligned(words[i], words[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {r.doc_id for r in single.collect()} == {ids[i] for i in range(len(ids)) if find(i) == i}
    assert single.columns == docs.columns


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test data")
def test_toxicity_on_held_out_rows(spark):
    """Floors under what was measured (14 of 18 toxic found, no clean one of 95 rejected); sf0.001 has too few labels to learn from."""
    found = toxicity.op3_toxicity(spark, LARGER).filter("held_out").join(common.table(spark, LARGER, "labels").select("doc_id", "toxic"), "doc_id").collect()
    toxic, clean = ([r.predicted for r in found if r.toxic == x] for x in (1, 0))
    assert sum(toxic) >= 0.7 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_estimate_leaves_similar_pairs_open():
    rng = np.random.default_rng(3)
    for n in (8, 150, 5000):
        for _ in range(20):
            both = rng.integers(1, 1 << 62, n).astype(np.uint64)
            only = rng.integers(1, 1 << 62, 2 * (n // 8)).astype(np.uint64)
            x, y = np.r_[both, only[: n // 8]], np.r_[both, only[n // 8 :]]
            bins = [np.frombuffer(near_dedup.binned(v), dtype=np.uint8)[: near_dedup.BINS] for v in (x, y)]
            grams = np.int64(len(x) + len(y))
            assert near_dedup.may_reach(*bins, grams, 0.8, near_dedup.MARGIN)
        far = np.frombuffer(near_dedup.binned(rng.integers(1, 1 << 62, n).astype(np.uint64)), dtype=np.uint8)[: near_dedup.BINS]
        assert not near_dedup.may_reach(bins[0], far, np.int64(2 * n), 0.8, near_dedup.MARGIN)


CLASHING = ["score", "predicted", "held_out", "runs", "n_bytes", "n_removed", "a.b", "c`d", "class_id", "sketch", "digest", "id", "row", "carried_columns"]


def test_columns_of_any_name_pass_all_stages(spark, tmp_path):
    (tmp_path / "sf").mkdir()
    rng = random.Random(5)

    def words(n, *extra):
        return " ".join([*("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)), *extra])

    shared, copied = words(40), words(60)
    texts = [words(50, shared), words(50, shared), copied, copied, None, "", words(20)] + [words(30, "vile filth") if i % 3 == 0 else words(30) for i in range(60)]
    ids = [3, 1, 7, 5, 8, 9, None, *range(100, 160)]
    rows = [(i, t, "en", "s", None if t is None else len(t), *[f"{c} of {k}" for c in CLASHING]) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{common.quoted(c)} string" for c in CLASHING)
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(i, int((i - 100) % 3 == 0)) for i in range(100, 160)], "doc_id long, toxic int").write.parquet(str(tmp_path / "sf/labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.saved(stage(spark, docs, str(tmp_path / "sf")), "stage")
        assert docs.columns == [f.name for f in spark.createDataFrame([], schema).schema], name
    kept = {r["doc_id"]: r for r in docs.collect()}
    assert set(kept) >= {1, 3, 5, 8, 9, None} and 7 not in kept
    assert kept[8]["text"] is None and kept[8]["n_chars"] is None and kept[9]["text"] == ""
    assert not any("vile filth" in (r["text"] or "") for r in kept.values())
    assert kept[1]["text"].endswith(shared) and shared not in kept[3]["text"] and kept[3]["n_chars"] == len(kept[3]["text"])
    at = {i: k for k, i in enumerate(ids)}
    assert all(r[c] == f"{c} of {at[i]}" for i, r in kept.items() for c in CLASHING)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(kept)


def test_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_last_stages_against_brute_force(spark):
    """Repeated passages and packing over all of sf0.001, each on its own input."""
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = common.table(spark, SF, "documents")
    seen, want = set(), {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        b = (r.text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            own = b[k : k + 100]
            if own in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(own)
        want[r.doc_id] = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
    cut = common.saved(corpus_pipeline.STAGES[2][1](spark, docs, SF), "cut")
    assert {r.doc_id: r.text or "" for r in cut.collect()} == want
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*whole.encode(t, add_special_tokens=False).ids, 1], dtype="<u4") for i, t in want.items()}
    pieces, packs = {i: 0 for i in ids}, {}
    for r in corpus_pipeline.STAGES[3][1](spark, cut, SF).collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id] += r.length
        packs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(n == len(ids[i]) for i, n in pieces.items())
    for own in packs.values():
        ends = [0, *(a + n for a, n in sorted(own))]
        assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= 2048
    assert sum(map(len, ids.values())) >= 0.97 * 2048 * (len(packs) - 1)
