"""What the review of round 1 asked for, one finding after another."""

import hashlib
import itertools
import random
import re
from re import _parser

from sparkledger.llm import html_text, licenses, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, batch string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "x") for i, t in rows], DOCS)


def spellings(parsed):
    """Texts of every alternative of a parsed pattern, each optional part with and without."""
    parts = []
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(value)])
        elif name == "NOT_LITERAL":
            parts.append(["x"])
        elif name == "IN":
            parts.append([chr(v if str(k) == "LITERAL" else v[0]) for k, v in value])
        elif name == "BRANCH":
            parts.append([t for branch in value[1] for t in spellings(branch)])
        elif name == "SUBPATTERN":
            parts.append(spellings(value[3]))
        else:
            low, high, inner = value
            parts.append([t * n for n in range(low, min(high, low + 1) + 1) for t in spellings(inner)])
    return list(dict.fromkeys("".join(p) for p in itertools.product(*parts)))


def test_license_keywords_lose_nothing(spark):
    texts = {t: None for r in licenses.RULES for t in spellings(_parser.parse(r.pattern))}
    lost = [(r.pattern, t) for r in licenses.RULES for t in spellings(_parser.parse(r.pattern)) if f" {r.keyword} " not in f" {t} "]
    assert not lost
    gate = re.compile(f" {licenses.any_of(licenses.KEYWORDS)} ")
    assert all(gate.search(f" {k} ") for k in licenses.KEYWORDS)
    assert not any(gate.search(f" {k[:-1]} ") for k in licenses.KEYWORDS if k[:-1] not in licenses.KEYWORDS)
    texts = [*list(texts)[::7], "licensed under GPLv3", "LGPLv2.1 AGPLv3 MPL2 EPLv2", "Common Development and Distribution License 1.0", "Open Font License 1.1", "Beerware license", "as is, without warranties"]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, list(enumerate(texts)))).collect()}
    patterns = [re.compile(f"(?<= )(?:{r.pattern})(?= )") for r in licenses.RULES]
    for i, t in enumerate(texts):
        text = " " + re.sub("[^0-9a-z]+", " ", t.lower()).strip() + " "
        found = sorted((text[: m.start()].count(" ") - 1, -(text[: m.end()].count(" ")), k) for k, p in enumerate(patterns) for m in p.finditer(text))
        kept, reach = [], -1
        for _, end, k in found:
            if -end > reach:
                kept.append(licenses.RULES[k].label)
                reach = -end
        assert got[i].n_detections == len(kept), t
        base = set(filter(None, got[i].base_labels.split(",")))
        assert got[i].labels == ",".join(sorted(base | set(kept))), t
    assert got[len(texts) - 6].labels == "gpl-3.0"
    assert got[len(texts) - 5].labels == "agpl-3.0,epl-2.0,lgpl-2.1,mpl-2.0"
    assert [got[len(texts) - n].labels for n in (4, 3, 2, 1)] == ["cddl-1.0", "ofl-1.1", "beerware", "no-warranty"]


PAGES = "page_id long, url string, html string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(n))


def extracted(spark, rows):
    return {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}


def test_repeats_are_found_over_a_whole_host(spark):
    boiler, pair, run = prose(1, 20), prose(2, 20), prose(3, 15)
    rows = []
    for i in range(700):
        body = f"<p>{prose(100 + i, 30)}</p>"
        if i % 4 == 0:
            body += f"<p>{boiler}</p>"
        if i in (3, 690):
            body += f"<p>{pair}</p>"
        if i % 5 == 0:
            body += f"<p>{prose(5000 + i, 5)} {run}</p>"
        rows.append((i, "http://hot.example/x", body))
    got = extracted(spark, rows)
    local = html_text.main_texts([r[2] for r in rows], 12)
    assert [(got[i].text, got[i].n_repeated) for i in range(700)] == local
    assert not any(boiler in r.text or run in r.text for r in got.values())
    assert all(prose(100 + i, 30) in got[i].text for i in range(700))
    assert [i for i in range(700) if pair in got[i].text] == [3, 690] and (got[3].n_repeated, got[690].n_repeated) == (20, 35)


def test_copies_and_shared_passages_without_article_stay(spark):
    page, quote = f"<p>{prose(1, 40)}</p><p>{prose(2, 40)}</p>", prose(3, 15)
    rows = [(1, "http://a/1", page), (2, "http://a/2", page), (3, None, page), (4, None, page), (5, "http://b/", f"<p>{prose(4, 9)} {quote} {prose(5, 9)}</p>"), (6, "http://b/", f"<p>{prose(6, 9)} {quote}</p>"), (7, "http://b/", None), (8, "about:blank", page)]
    got = extracted(spark, rows)
    whole = prose(1, 40) + "\n\n" + prose(2, 40)
    assert all(got[i].text == whole for i in (1, 2, 3, 4, 8))
    assert (got[1].n_repeated, got[3].n_repeated, got[8].n_repeated) == (80, 0, 0)
    assert quote in got[5].text and quote in got[6].text and got[5].n_repeated == 15 and got[7].text == ""


def test_text_outside_a_teaser_article_stays(spark):
    notice, label = prose(1, 14), "read more here"
    rows = [(i, "http://a/", f"<div>{prose(10 + i, 50)}</div><div>{label}</div><article>teaser {i}<p>{notice}</p></article>") for i in range(12)]
    got = extracted(spark, rows)
    for i in range(12):
        assert got[i].text == f"{prose(10 + i, 50)}\n\nteaser {i}"


def test_repeated_ids_match_no_row_of_their_own(spark):
    shared = prose(1, 60)
    own = {1: prose(2, 60) + " " + shared, 2: shared + " " + prose(3, 60), 3: prose(4, 60) + " " + shared + " " + prose(5, 30), 4: prose(6, 80)}
    seen, want = set(), {}
    for i, text in own.items():
        b, gone = text.encode(), set()
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone.update(range(k, k + 100))
            seen.add(b[k : k + 100])
        want[i] = (len(gone), hashlib.sha256(bytes(x for k, x in enumerate(b) if k not in gone)).hexdigest())
    rows = [(i, own[i]) for i in (1, 2, 2, 3, 3, 3, 4, 4, 1)]
    got = suffix_dedup.cleaned(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in got) == sorted((i, *want[i]) for i, _ in rows)
