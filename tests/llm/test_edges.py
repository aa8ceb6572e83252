"""All ten queries on a table of edge cases and on empty tables: nulls, empty and very long texts, ties, repeated rows, clashing names."""

import gzip
import hashlib
import random
import zipfile
import zlib

import pytest

from sparkledger.llm import ann, common, html_text, media, packing, queries, tokens, toxicity, warc

CLASHING = ["score", "predicted", "held_out", "runs", "n_bytes", "a.b", "class_id", "sketch", "digest", "id", "norm", "found", "copy", "html2", "sha", "top", "salt", "n", "rank", "dim", "cell", "ids", "length", "pid", "payload"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"
EMBEDDINGS = "vec_id long, embedding array<float>, label int"
LABELS = "doc_id long, quality int, toxic int"
NAMES = sorted(queries.QUERIES)


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(n))


LONG = words(9, 20_000)
TEXTS = [(1, None), (2, ""), (3, words(1, 40)), (4, words(1, 40)), (None, "no id"), (5, LONG), (6, "cc by " * 2000), (7, "é퟿\U0001f600 \x00 <|endoftext|>"), (8, " \n "), (3, words(1, 40))]
HTML = [(1, None, None), (2, "http://a/", ""), (3, "http://a/", "<p>x y</p>"), (4, "http://a/", "<p>x y</p>"), (None, "http://a/", "<p>z</p>"), (5, "", f"<p>{LONG}</p>"), (3, "http://a/", "<p>x y</p>"), (6, "http://b/", "<<a b='<p>&#x0;&bogus;")]
VECTORS = [(0, [1.0, 0.0], 1), (100, [0.0, 1.0], 1), (1, [1.0, 1.0], None), (2, [1.0, 1.0], 1), (3, None, 1), (4, [], 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [None, 1.0], 1), (None, [1.0, 2.0], 1), (200, [1.0, 2.0, 3.0], 1), (1, [1.0, 1.0], 2), (8, [float("inf"), 1.0], 1)]


def write(spark, root, docs, pages, vectors, labels):
    own = CLASHING
    for name, rows, schema in (("documents", docs, DOCS), ("pages", pages, PAGES), ("embeddings", vectors, EMBEDDINGS), ("labels", labels, LABELS)):
        names = [c for c in own if c not in schema.replace(",", " ").split()]
        extra = [tuple(f"{c}!" for c in names)] * len(rows)
        spark.createDataFrame([(*r, *x) for r, x in zip(rows, extra, strict=True)], schema + "".join(f", {common.quoted(c)} string" for c in names)).write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    docs = [(i, t, None, None, None) for i, t in TEXTS]
    return write(spark, tmp_path_factory.mktemp("edges"), docs, HTML, VECTORS, [(3, 1, 0), (7, 0, 1), (5, None, None), (None, 1, 1), (2, 1, 0)])


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_give_no_rows(spark, tmp_path, name):
    root = write(spark, tmp_path, [], [], [], [])
    assert queries.QUERIES[name](spark, root).count() == 0


@pytest.mark.parametrize("name", [n for n in NAMES if n not in ("op2_html_extraction", "op6_nearest_neighbours", "op7_warc")])
def test_every_row_has_a_result(spark, edges, name):
    rows = queries.QUERIES[name](spark, edges).collect()
    if name == "op10_packing":
        assert {r.doc_id for r in rows} == {i for i, _ in TEXTS}
        assert [r.doc_tokens for r in rows if r.doc_id in (1, 2, 8)] == [1, 1, 1]
        return
    assert sorted((r.doc_id for r in rows), key=str) == sorted((i for i, _ in TEXTS), key=str)
    by = {r.doc_id: r for r in rows}
    if name == "op1_near_dedup":
        assert (by[3].class_id, by[4].class_id, by[1].class_id, by[None].class_id) == (3, 3, 1, None)
    elif name == "op3_toxicity":
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
        assert len({r.score for r in rows if r.doc_id in (3, 4)}) == 1 and by[None].held_out is False
        assert {r.doc_id for r in rows if r.held_out} == {i for i, _ in TEXTS if i is not None and zlib.crc32(str(i).encode()) % 3 == 1}
    elif name == "op4_suffix_dedup":
        assert by[1].kept_sha256 == by[2].kept_sha256 == hashlib.sha256(b"").hexdigest() and by[4].n_removed == by[4].n_bytes
    elif name == "op5_license_scan":
        assert (by[6].n_base, by[6].first_word, by[6].last_word, by[6].base_labels, by[6].score) == (2000, 0, 3998, "cc-by", 1.0)
        assert (by[1].n_words, by[1].labels, by[1].score, by[1].first_word) == (0, "", 0.0, None)
    elif name == "op8_byte_bpe":
        text = dict(TEXTS)[7]
        assert by[7].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and by[1].n_tokens == 0


def test_op9_against_brute_force(spark, edges):
    rows = queries.QUERIES["op9_media_columns"](spark, edges).collect()
    for r in rows:
        text = (dict(TEXTS)[r.doc_id] or "").encode()
        payload = text + b"\xff" * (max(1, -(-len(text) // 576)) * 576 - len(text))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        image = media.png_bytes(payload)
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
        raw, at = b"", 8  # a reader of its own
        while at < len(image):
            n = int.from_bytes(image[at : at + 4], "big")
            assert zlib.crc32(image[at + 4 : at + 8 + n]) == int.from_bytes(image[at + 8 + n : at + 12 + n], "big")
            raw += image[at + 8 : at + 8 + n] if image[at + 4 : at + 8] == b"IDAT" else b""
            at += 12 + n
        raw = zlib.decompress(raw)
        assert b"".join(raw[k + 1 : k + 577] for k in range(0, len(raw), 577)) == payload
    assert len({r.feature for r in rows if r.doc_id in (3, 4)}) == 1


def test_pages_with_several_media(spark):
    images = [media.png_bytes(media.padded(x)) for x in (b"one", b"two", b"three" * 300)]
    digest = [hashlib.sha256(x).hexdigest() for x in images]
    page = f'<article>Intro &amp; more<figure><img alt="A" src="sha256:{digest[0]}"><img src=sha256:{digest[1]}><figcaption>both <b>of</b> them</figcaption></figure>middle<p><img alt="last" src="sha256:{digest[2]}">end<video src="sha256:gone"></video><!-- <img src="sha256:x"> --></article>'
    pages = spark.createDataFrame([(1, page, "x"), (2, None, "x"), (3, "text alone", "x"), (4, page, "x")], "page_id long, html string, digest string")
    items = media.sequences(pages)
    found = {r.id: [(i["position"], i["kind"], i["text"], i["caption"]) for i in r["items"]] for r in items.collect()}
    want = [(0, "text", "Intro & more", None), (1, "media", None, "both of them"), (2, "media", None, "both of them"), (3, "text", "middle", None), (4, "media", None, "last"), (5, "text", "end", None), (6, "media", None, None)]
    assert found == {1: want, 2: [], 3: [(0, "text", "text alone", None)], 4: want}
    store = spark.createDataFrame([(d, bytearray(x)) for d, x in zip(digest, images, strict=True)] + [(digest[0], bytearray(images[0]))], "digest string, media binary")
    got = sorted((r.id, r.position, r.caption, r.payload_bytes, r.media_sha256) for r in media.resolve(items, store).collect() if r.payload_bytes)
    assert got == sorted((i, p, c, n, d) for i in (1, 4) for p, c, n, d in ((1, "both of them", 576, digest[0]), (2, "both of them", 576, digest[1]), (4, "last", 1728, digest[2])))
    assert media.resolve(items, store).filter("payload_bytes IS NULL").count() == 2


def test_op2_rows_and_parts(spark, edges):
    rows = queries.QUERIES["op2_html_extraction"](spark, edges).collect()
    assert len(rows) == len(HTML)
    assert sorted((r.page_id, r.text) for r in rows if r.page_id in (1, 2, 3, 4)) == [(1, ""), (2, ""), (3, "x y"), (3, "x y"), (4, "x y")]
    assert next(r for r in rows if r.page_id == 5).text == LONG and all(r.n_chars == len(r.text) for r in rows)


def test_op2_class_names_count_whole():
    text = "<p>one two</p>"
    for page in (f'<main class="content has-sidebar">{text}</main>', f'<article class="post ad-free">{text}</article>', f'<div class="site header-fixed"><article>{text}</article></div>', f"<form><input><article>{text}</article><button>b</button></form>", f'<header><nav>n</nav><main>{text}</main></header>', f'<div class="sidebar"><article>{text}</article></div>'):
        assert [t for _, t in html_text.blocks_of(page)] == ["one two"], page
    for page in ('<ol class="comment-list"><li>c</li></ol>', '<div class="site-footer">f</div>', '<div id="cookie-notice">c</div>', '<div class="post"><div role="search">s</div></div>', "<div class=ad>x</div>", '<section class="comments"><article class="comment">c</article></section><article>a</article>'):
        assert [t for _, t in html_text.blocks_of(page)] in ([], ["a"]), page
    assert [t for _, t in html_text.blocks_of('a<a title="it>link after')] == ["alink after"]


def test_op2_suffix_array_finds_what_windows_find():
    rng = random.Random(4)
    for _ in range(30):
        streams = [[rng.choice("abc") for _ in range(rng.randrange(0, 25))] for _ in range(rng.randrange(0, 6))]
        n = rng.randrange(1, 6)
        got = html_text.repeated_tokens(streams, n)
        for i, s in enumerate(streams):
            want = [False] * len(s)
            for k in range(len(s) - n + 1):
                if any(s[k : k + n] == o[j : j + n] for m, o in enumerate(streams) if m != i for j in range(len(o) - n + 1)):
                    want[k : k + n] = [True] * n
            assert got[i].tolist() == want


def test_op2_shards_of_a_host_count_together(spark):
    boiler, pair = words(1, 25), words(2, 14)
    rows = [(i, "http://hot/", f"<p>{words(100 + i, 30)}</p><div>{words(900 + i, 3)} {boiler} {words(500 + i, 3)}</div>" + (f"<p>{i} {pair} {i}</p>" if i in (4, 55) else "")) for i in range(60)]
    rows += [(100 + i, f"http://small{i % 3}/", f"<p>{words(300 + i, 20)} {boiler}</p>") for i in range(6)]
    want = html_text.main_texts([r[2] for r in rows[:60]], 12)
    for tokens_of_shard in (1 << 20, 500):
        got = {r.page_id: (r.text, r.n_repeated) for r in html_text.extract(spark.createDataFrame(rows, PAGES), shard_tokens=tokens_of_shard).collect()}
        assert [got[i] for i in range(60)] == want and not any(boiler in got[i][0] for i in range(60))
        assert got[4][1] == 39 and pair in got[4][0] and all(boiler in got[100 + i][0] and got[100 + i][1] == 25 for i in range(6))


def test_op7_against_another_reader(spark, edges, tmp_path):
    rows = queries.QUERIES["op7_warc"](spark, edges).collect()
    want = {}
    for i, _, h in HTML:
        want.setdefault(h or "", []).append(i)
    tops = {h: max((i for i in ids if i is not None), default=None) for h, ids in want.items()}
    expected = sorted((str(i), len((h or "").encode()), warc.base32_sha1((h or "").encode()), *(("response", None) if i == tops[h or ""] else ("revisit", tops[h or ""]))) for i, _, h in HTML)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == expected

    manifest = warc.write_archives(common.table(spark, edges, "pages"), str(tmp_path / "w"), target_bytes=500)
    records = {}
    for path in (r.path for r in manifest.collect()):
        raw = gzip.decompress(zipfile.ZipFile(path).read(warc.DATA_MEMBER))
        while raw:
            head, _, rest = raw.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            n = int(fields["Content-Length"])
            assert rest[n : n + 4] == b"\r\n\r\n"
            records.setdefault(fields["WARC-Record-ID"], (fields, rest[:n].partition(b"\r\n\r\n")[2]))
            raw = rest[n + 4 :]
    for fields, payload in records.values():
        if fields["WARC-Type"] == "revisit":
            to, body = records[fields["WARC-Refers-To"]]
            assert to["WARC-Type"] == "response" and to["WARC-Payload-Digest"] == fields["WARC-Payload-Digest"] == f"sha1:{warc.base32_sha1(body)}" and not payload


def brute_neighbours(rows, asked, k):
    held = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and abs(x) < float("inf") for x in v) and any(v):
            held[i] = min(held.get(i, v), v)
    return {(q, n + 1): i for q in held if asked(q) for n, (_, i) in enumerate(sorted((sum((a - b) ** 2 for a, b in zip(held[q], v, strict=True)) ** 0.5, i) for i, v in held.items() if i != q and len(v) == len(held[q]))[:k])}


def test_op6_ties_and_unusable_vectors(spark, edges):
    got = {(r.query_id, r.rank): r.vec_id for r in queries.QUERIES["op6_nearest_neighbours"](spark, edges).collect()}
    assert got == brute_neighbours([(i, v) for i, v, _ in VECTORS], lambda q: q % 100 == 0, 10)


@pytest.mark.parametrize("spread", [0.2, 30.0])
def test_op6_cells_lose_nothing(spark, spread):
    rng = random.Random(6)
    centres = [[rng.gauss(0, 3) for _ in range(12)] for _ in range(7)]
    rows = [(i, [rng.gauss(c, spread) for c in centres[i % 7 if i % 3 else 0]]) for i in range(900)] + [(1000 + i, centres[0]) for i in range(30)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(vectors, vectors.filter("vec_id % 10 = 0"), k=5, block_rows=60, chunk=16, sample_bytes=8 * 12 * 200)
    assert {(r.query_id, r.rank): r.vec_id for r in found.collect()} == brute_neighbours(rows, lambda q: q % 10 == 0, 5)


def test_offsets_of_a_split_character(spark):
    docs = spark.createDataFrame([(1, "a\U0001f9ffक b")], "doc_id long, text string")
    row = tokens.encode(docs).first()
    assert row.starts[0] == 0 and row.ends[-1] == 5 and all(a < b for a, b in zip(row.starts, row.ends, strict=True))
    assert tokens.decode(tokens.encode(docs)).first().text == "a\U0001f9ffक b"


def test_packing_ranks_share_lengths_over_tasks(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(3000)], "doc_id long, text string").repartition(7)
    rows = packing.pack(docs, keep_ids=False).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 3000 and len({r.sequence_id for r in rows}) == -(-3000 // (2048 // rows[0].length))


def test_scores_rank_what_labels_mark():
    rng = random.Random(1)
    clean = [words(i, 30) for i in range(200)]
    toxic = [words(1000 + i, 28) + " you " + rng.choice(["vile scum", "filthy scum", "v1le filth"]) for i in range(60)]
    model = toxicity.fit(clean[:150] + toxic[:45], [0] * 150 + [1] * 45)
    import numpy as np

    features = toxicity.Features(model.lexicon)
    low, high = (model.scores(np.array([features(t) for t in x])) for x in (clean[150:], toxic[45:]))
    assert low.max() < 0.7 <= np.median(high) and list(model.values) == sorted(model.values)
