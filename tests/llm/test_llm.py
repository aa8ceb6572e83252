"""The training-data operators against brute force, round trips and small edge cases."""

import hashlib
import io
import random
import zipfile
import zlib

import numpy as np
import pytest

from sparkledger.llm import ann, html_text, licenses, media, near_dedup, packing, suffix_dedup, tokens, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, batch string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "x") for i, t in rows], DOCS)


def words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    base = words(1, 120)
    near = base[:50] + ["other"] + base[51:]
    shared = " ".join(words(2, 40))
    rows = [(5, " ".join(base)), (1, " ".join(near)), (9, " ".join(base)), (2, shared + " " + " ".join(words(3, 30))), (3, " ".join(words(4, 30)) + " " + shared), (4, None), (6, ""), (None, "no id here"), (7, "é" * 300), (8, "ab"), (8, "ab")]
    return rows


def test_near_duplicates(spark, corpus):
    got = {(r.doc_id, r.class_id) for r in near_dedup.near_duplicates(docs(spark, corpus)).collect()}
    assert {(1, 1), (5, 1), (9, 1), (2, 2), (3, 3), (4, 4), (6, 6), (8, 8), (None, None)} <= got
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_alignment_counts_matched_grams():
    a = np.arange(100, dtype=np.uint64)
    assert near_dedup.aligned(a, a) == 1.0
    b = a.copy()
    b[50] = 1000
    assert near_dedup.aligned(a, b) == pytest.approx(91 / 101)
    assert near_dedup.aligned(a, np.delete(a, 20)) == pytest.approx(91 / 100)
    assert near_dedup.aligned(a, a[::-1].copy()) == 0.0


def brute_spans(rows, n=100):
    seen, out = set(), {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b, gone = (t or "").encode(), set()
        for s in range(len(b) - n + 1):
            if b[s : s + n] in seen:
                gone.update(range(s, s + n))
            seen.add(b[s : s + n])
        kept = bytes(x for k, x in enumerate(b) if k not in gone)
        out[i] = (len(b), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_bytes(spark, corpus):
    got = suffix_dedup.cleaned(docs(spark, corpus)).collect()
    assert len(got) == len(corpus)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in got if r.doc_id is not None} == brute_spans(corpus)
    assert suffix_dedup.cleaned(docs(spark, [])).count() == 0


def test_byte_bpe_equals_tiktoken(spark):
    import public_tokenizers as p
    import tiktoken

    ranks = tokens.read_ranks(p.path("byte_bpe_multi_50k.tiktoken"))
    other = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "a  b   c\n\n d ", "été über 'll 123 !!", "日本語 \x1c x \U0001f600", " lead", "tab\t x\n y", "a  b", "aaaaaaaaaaaaa aaaa", "<|endoftext|>"]
    got = {r.doc_id: r for r in tokens.digests(docs(spark, enumerate(texts))).collect()}
    for i, t in enumerate(texts):
        ids = other.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()), t
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    row = tokens.encode(docs(spark, [(1, "é\U0001f600 x")])).first()
    assert row.starts[0] == 0 and row.ends[-1] == 4


def test_packing(spark):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    rows = [(i, " ".join(words(i, random.Random(i).randrange(1, 3000)))) for i in range(25)] + [(30, None), (31, "É İ x"), (32, "hello <|endoftext|> world"), (33, "a<|startoftext|>b<|endoftext|>"), (34, "<|endoftext"), (35, "a\tb\x1cc 'll _x_ 12"), (36, "日本語 ’s été"), (36, "日本語 ’s été")]
    got = packing.pack(docs(spark, rows)).collect()
    whole = Tokenizer.from_file(p.path("word_bpe_49k.json"))
    for i, t in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in own) == len(ids) * sum(j == i for j, _ in rows) and own[0].doc_tokens == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    packs = {}
    for r in got:
        packs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in packs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "x" * 50, 0), (2, "http://b/", "x" * 50, 0), (3, None, None, 0), (4, "http://c/\r\n", "é", 0)], "page_id long, url string, html string, n long")
    root = str(tmp_path / "w")
    got = {r.page_id: r for r in warc.read_archives(warc.write_archives(pages, root, target_bytes=200), root).collect()}
    assert (got[1].record_type, got[1].refers_to, got[1].payload_bytes) == ("revisit", 2, 50)
    assert got[2].record_type == "response" and bytes(got[4].payload) == "é".encode() and got[3].payload_bytes == 0


def test_zip_directories():
    members = [("a", b"123"), ("b/c", b"")]
    for zip64 in (False, True):
        raw = warc.zip_bytes(members, zip64)
        assert zipfile.ZipFile(io.BytesIO(raw)).read("a") == b"123"

        class Source(io.BytesIO):
            def size(self):
                return len(self.getvalue())

        z = warc.ZipRanges(Source(raw))
        at, n = z.place("a")
        assert z.at(at, n) == b"123"


def test_main_text():
    page = "<html><head><title>t</title></head><body><nav><a>menu</a></nav><div class='ad'>buy</div><article><h1>Head &amp; tail</h1><p>one\n two<br>three<p>four</article><footer>f</footer>"
    assert html_text.main_texts([page, ""], 4) == [("Head & tail\n\none two three\n\nfour", 0), ("", 0)]
    common = "<p>a b c d e f g h</p>"
    texts = [t for t, _ in html_text.main_texts([common + "<p>first page text</p>", "<p>second one</p>" + common], 5)]
    assert texts == ["first page text", "second one"]


def test_media(spark):
    item = media.items_of('<p>x</p><figure><img src="sha256:ab" alt="y"><figcaption>cap</figcaption></figure>z')
    assert [(i["position"], i["kind"], i["caption"]) for i in item] == [(0, "text", None), (1, "media", "cap"), (2, "text", None)]
    data = media.padded("é".encode() * 400)
    assert media.png_samples(media.png_bytes(data)) == (data, 576, 2)


def test_licenses(spark):
    rows = [(1, "Under the GNU General Public License v3, or CC BY 4.0. cc by"), (2, None), (3, "nothing")]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, rows)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 2, 12, "cc-by,gpl")
    assert "gpl-3.0" in got[1].labels and "cc-by-4.0" in got[1].labels and got[2].labels == "" and got[3].score == 0
    assert len(licenses.RULES) > 300


def test_neighbours_recall():
    rng = np.random.default_rng(1)
    v = rng.standard_normal((500, 32))
    codes, scalars = ann.one_bit_codes(v, v.mean(axis=0))
    ids = np.arange(500)
    found = list(ann.nearest(ids[:20], v[:20], ids, v, codes, scalars, v.mean(axis=0), 10, 4.0))
    hit = sum(len(set(near) & set(sorted((x for x in ids if x != q), key=lambda x: (np.linalg.norm(v[x] - v[q]), x))[:10])) for q, near, _ in found)
    assert hit >= 190
