"""Main text of web pages: block structure, and repetition over all pages of a host.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments go by their
markup. Over all other blocks, in and out of ``article`` and ``main``, decides how many distinct page
texts of the host hold them; equal pages count once, so copies of a page stay whole. With D distinct
texts on the host, ``enough`` is a quarter of D, at least 2 and at most 100:

* outside an article a block of ``min_tokens`` or more goes if it stands whole on ``enough`` texts; on
  a page that has an article, shorter ones do too;
* outside, a run of ``min_tokens`` or more inside another block goes if it stands on ``enough`` texts
  and on 10 at least; a passage that fewer share stays;
* inside an article only a block of ``min_tokens`` or more goes, if it stands whole on half of the
  texts and on 10 at least;
* a page of which nothing would remain keeps its text.

``n_repeated`` counts the tokens outside articles in runs of ``min_tokens`` or more that another page of
the host holds, a copy too. What stands outside articles goes to suffix arrays: the token streams of
a host's distinct texts, one after another, in shards of at most about ``shard_tokens`` tokens. An
interval of suffixes with a common prefix of ``min_tokens`` tokens is a repeated string, and the texts in it
are counted. Where a host has several shards, each tells the others its strings by 64-bit hash with its
count of texts, added up before they are sent back to the shards that hold them; hosts of one shard
send nothing. Results are exact but for collisions of hashes.

Elements are left out by whole class names, ids and roles, never by parts of them: of names joined by
``-`` or ``_`` the last word tells (``site-footer``), or the first before a word for a container
(``comment-list``). ``main`` and ``article`` don't go by a class of their own, and where they stand in
an element that is left out, they are read unless it holds comments, asides or related pages. A page
with text in an article that all its wrappers would leave out is read by its elements alone.

Defined results: null or empty html, or html without text, gives an empty text. A page whose url is
null or names no host is a host of its own. Unclosed elements end with the page; a tag cut off at the
end of the page is markup, and so is one with a quote that is never closed. Repeated rows are pages of their own. An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Elements whose whole content is no text of the page's article.
SKIPPED = frozenset("nav header footer aside form button select option textarea label fieldset dialog menu template noscript svg math canvas iframe object audio video head".split())
#: Elements whose content isn't markup.
RAW = "script|style|title|noembed|noframes|xmp"
BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id or role that mark an element as no part of the article.
MARKS = frozenset("ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget complementary contentinfo search".split())
ARTICLE = frozenset(("article", "main"))

TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"']|[\"'])*)(?:>|\Z)|([^<]+|<)", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[^_-]+")
#: Words after a mark that name a container of such things.
CONTAINERS = frozenset("area bar block body box container content form inner item items link links list panel section text title widget wrap wrapper".split())
#: Marks of what may hold articles of its own that are no part of the page's.
ASIDE = frozenset("aside footer comment comments commentlist disqus related replies respond sidebar complementary contentinfo".split())
SCHEMA = "page_id long, url string, text string, n_chars long, n_repeated long"


def mark_of(attributes: str) -> str:
    """The mark that a class, id or role names, or nothing."""
    for m in ATTRIBUTE.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = PART.findall(name)
            if not parts or parts[0] in ("has", "no", "non", "not", "with", "without"):
                continue
            if parts[-1] in MARKS:
                return parts[-1]
            if parts[0] in MARKS and parts[-1] in CONTAINERS:
                return parts[0]
    return ""


def blocks_of(page: str, by_class: bool = True) -> list[tuple[bool, str]]:
    """The page's visible blocks in order, each with whether it stands in an article."""
    found: list[tuple[bool, str]] = []
    words: list[str] = []
    inside = 0
    skip, depth, mark = "", 0, ""  # the element that is left out, how many of its name are open, and why
    held: list[tuple[str, int, str, int]] = []  # left out again after the article that stands in them
    passed = False

    def close() -> None:
        if words:
            text = " ".join(entities.unescape("".join(words)).split())
            if text:
                found.append((inside > 0, text))
            words.clear()

    for m in TOKEN.finditer(page):
        text = m[5]
        if text is not None:
            if not skip:
                words.append(text)
            continue
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if m[2]:
            if skip:
                if tag == skip:
                    depth -= 1
                    if not depth:
                        skip = ""
                elif tag in ("body", "html"):
                    skip, depth = "", 0
                continue
            if tag in BLOCKS:
                close()
            if tag in ARTICLE:
                inside = max(0, inside - 1)
                if held and held[-1][3] == inside:
                    skip, depth, mark, _ = held.pop()
            elif held and tag in ("form", "body", "html"):
                held.clear()  # the article was never closed
            continue
        if skip:
            if tag == skip and not m[4].endswith("/"):
                depth += 1
            elif tag == "body":
                skip, depth = "", 0  # the element was never closed
            elif tag in ARTICLE and (tag == "main" or mark not in ASIDE):
                held.append((skip, depth, mark, inside))
                skip, depth = "", 0
            elif tag in ARTICLE:
                passed = True
            if skip:
                continue
        if tag in VOID:
            close() if tag == "hr" else words.append(" ")
            continue
        why = tag if tag in SKIPPED else mark_of(m[4]) if by_class and m[4] and tag not in ("html", "body", "main", "article") else ""
        if why:
            if not m[4].endswith("/"):
                close()
                skip, depth, mark = tag, 1, why
            continue
        if tag in BLOCKS:
            close()
        if tag in ARTICLE:
            inside += 1
    close()
    return blocks_of(page, False) if by_class and passed and not found else found


def suffix_intervals(streams: list[list[str]], min_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token of the concatenated streams the interval of its suffix, its stream, and whether min_tokens stand from it on.

    The suffix array, ordered by prefix doubling to the depth that decides: suffixes with equal ranks are
    an interval of common prefix min_tokens or longer.
    """
    lengths = np.array([len(s) for s in streams], dtype=np.int64)
    total = int(lengths.sum())
    ids: dict[str, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for s in streams for w in s), dtype=np.int64, count=total)
    ends = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(total)
    depth = 1
    while depth < min_tokens and total:
        step = min(depth, min_tokens - depth)
        after = at + step
        nxt = np.where(after < ends, rank[np.minimum(after, total - 1)] + 1, 0)  # beyond the stream stands a symbol below all others
        _, rank = np.unique(rank * (total + len(ids) + 2) + nxt, return_inverse=True)
        depth += step
    return rank, np.repeat(np.arange(len(streams)), lengths), at + min_tokens <= ends


def counted_streams(streams: list[list[str]], min_tokens: int) -> np.ndarray:
    """For each token of the concatenated streams how many streams hold the string of min_tokens from it on; 0 near a stream's end."""
    rank, stream, whole = suffix_intervals(streams, min_tokens)
    out = np.zeros(len(rank), dtype=np.int64)
    if not whole.any():
        return out
    _, interval = np.unique(rank[whole], return_inverse=True)
    pairs = np.unique(interval * len(streams) + stream[whole])
    out[whole] = np.bincount(pairs // len(streams))[interval]
    return out


def repeated_tokens(streams: list[list[str]], min_tokens: int) -> list[np.ndarray]:
    """For each stream which of its tokens lie in a run of min_tokens or more that also stands in another stream."""
    lengths = [len(s) for s in streams]
    steps = np.zeros(sum(lengths) + 1, dtype=np.int64)
    hits = np.flatnonzero(counted_streams(streams, min_tokens) > 1)
    np.add.at(steps, hits, 1)
    np.add.at(steps, hits + min_tokens, -1)
    return np.split(np.cumsum(steps[:-1]) > 0, np.cumsum(lengths)[:-1]) if streams else []


WINDOW, FACTOR = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_known: dict[str, int] = {}


def hash_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of tokens, the same in every worker."""
    if len(_known) > 1 << 19:
        _known.clear()
    for w in set(words).difference(_known):
        _known[w] = hash_of(w)
    return np.array([_known[w] for w in words], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(h: np.ndarray, n: int, seed: np.uint64) -> np.ndarray:
    """Hashes of all runs of n tokens."""
    out = np.zeros(max(0, len(h) - n + 1), dtype=np.uint64)
    for i in range(n if len(out) else 0):
        out = out * FACTOR + h[i : i + len(out)]
    return mixed(out ^ seed)


def key_of(blocks: list[tuple[bool, str]], host: str) -> int:
    """Equal for equal texts of a host."""
    return hash_of(host + "\n\n" + "\n\n".join(text for _, text in blocks))


class Page:
    """Blocks of a page with the hashes by which its host's pages are compared."""

    def __init__(self, blocks: list[tuple[bool, str]], host: str, min_tokens: int):
        self.blocks, self.name, self.min_tokens = blocks, host, min_tokens
        self.has_article = any(inside for inside, _ in blocks)

    @cached_property
    def key(self) -> int:
        return key_of(self.blocks, self.name)

    @cached_property
    def stream(self) -> list[str]:
        """The tokens outside articles."""
        return [w for inside, text in self.blocks if not inside for w in text.split(" ")]

    @cached_property
    def h(self) -> np.ndarray:
        return hashes(self.stream)

    def host(self) -> int:
        return hash_of("host\n" + self.name)

    def seed(self) -> np.uint64:
        return np.uint64(hash_of(self.name))

    def windows(self) -> np.ndarray:
        return grams(self.h, self.min_tokens, self.seed() ^ WINDOW)

    def whole(self, text: str) -> int:
        """The hash of a block on this host."""
        return hash_of(f"block\n{self.name}\n{text}")

    def judged(self, inside: bool, text: str) -> bool:
        """Whether a block may go as a whole."""
        return self.has_article and not inside or text.count(" ") + 1 >= self.min_tokens

    def units(self) -> np.ndarray:
        """Hashes of the host and of the blocks that may go as a whole."""
        return np.array(sorted({self.host(), *(self.whole(t) for inside, t in self.blocks if self.judged(inside, t))}) if self.blocks else [], dtype=np.uint64)

    def text(self, keys: np.ndarray, counts: np.ndarray, copies: int, at: np.ndarray, held: np.ndarray) -> tuple[str, int]:
        """Text and number of repeated tokens.

        keys are sorted hashes of units with how many distinct texts of the host hold each; at are places
        outside articles from which min_tokens tokens repeat, with how many texts hold them.
        """

        def count(h: np.ndarray) -> np.ndarray:
            if not len(keys):
                return np.ones(len(h), dtype=np.int64)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            return np.where(keys[at] == h, counts[at], 1)

        def one(h: int) -> int:
            return int(count(np.array([h], dtype=np.uint64))[0])

        def cover(start: np.ndarray) -> np.ndarray:
            steps = np.zeros(len(self.stream) + 1, dtype=np.int64)
            at = np.flatnonzero(start)
            steps[at] += 1
            steps[at + self.min_tokens] -= 1
            return np.cumsum(steps[:-1]) > 0

        if copies < 2 and not len(at) and (not len(keys) or len(keys) == 1 and keys[0] == self.host()):
            return "\n\n".join(text for _, text in self.blocks), 0  # the host alone is held twice
        pages = one(self.host())
        enough = max(2, min(-(-pages // 4), 100))
        windows = np.ones(max(0, len(self.stream) - self.min_tokens + 1), dtype=np.int64)
        windows[at] = held
        cut = cover(windows >= max(10, enough))
        kept, at = [], 0
        for inside, text in self.blocks:
            own = cut[:0]
            if not inside:
                n = text.count(" ") + 1
                own, at = cut[at : at + n], at + n
            if self.judged(inside, text) and one(self.whole(text)) >= (max(10, -(-pages // 2)) if inside else enough):
                continue
            if own.any():
                text = " ".join(w for w, c in zip(text.split(" "), own, strict=True) if not c)
            if text:
                kept.append(text)
        return "\n\n".join(kept or [text for _, text in self.blocks]), int(cover((windows >= 2) | (copies > 1)).sum())


def main_texts(pages: list[str], min_tokens: int) -> list[tuple[str, int]]:
    """Text and number of repeated tokens of each page of one host, in memory: windows are counted one by one, the tokens by a suffix array of all pages."""
    parsed = [Page(blocks_of(p), "", min_tokens) for p in pages]
    copies = Counter(p.key for p in parsed)
    distinct = {p.key: p for p in parsed}.values()
    held = Counter(int(h) for p in distinct for h in p.units())
    seen = Counter(w for p in distinct for w in {tuple(p.stream[k : k + min_tokens]) for k in range(len(p.stream) - min_tokens + 1)})
    keys = np.array(sorted(held), dtype=np.uint64)
    counts = np.array([held[int(k)] for k in keys], dtype=np.int64)
    covered = repeated_tokens([p.stream for p in parsed], min_tokens)
    out = []
    for p, c in zip(parsed, covered, strict=True):
        n = np.array([seen[tuple(p.stream[k : k + min_tokens])] for k in range(len(p.stream) - min_tokens + 1)], dtype=np.int64)
        out.append((p.text(keys, counts, copies[p.key], np.flatnonzero(n > 1), n[n > 1])[0], int(c.sum())))
    return out


def packed(blocks: list[tuple[bool, str]]) -> bytes:
    """Blocks as bytes; their texts hold no separators, which count as spaces."""
    return zlib.compress("\x1e".join(("\x1f" if inside else "") + text for inside, text in blocks).encode("utf-8", "surrogatepass"), 6)


def unpacked(data: bytes) -> list[tuple[bool, str]]:
    text = zlib.decompress(data).decode("utf-8", "surrogatepass")
    return [(t.startswith("\x1f"), t.removeprefix("\x1f")) for t in text.split("\x1e")] if text else []


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.astype(np.uint64).view(np.int64))


def long_of(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


SHARD = ("host", "shard")


def by_shard(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartition(n, *SHARD).sortWithinPartitions(*SHARD, "kind")


def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[dict]]]:
    """Host, shard and rows of each shard, from batches in this order."""
    at, held = None, []
    for b in batches:
        for row in b.to_pylist():
            here = row["host"], row["shard"]
            if held and here != at:
                yield *at, held
                held = []
            at = here
            held.append(row)
    if held:
        yield *at, held


def repeated_places(texts: DataFrame, min_tokens: int, shard_tokens: int) -> DataFrame:
    """text_key, places and counts of the strings of min_tokens that several of a host's texts hold. texts: text_key, host, outside, n_tokens."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = texts.groupBy("host").agg(F.ceil(F.sum("n_tokens") / F.lit(shard_tokens)).cast("int").alias("shards"))
    dealt = texts.join(sizes, "host").withColumn("shard", F.pmod(F.xxhash64("text_key"), F.col("shards")).cast("int"))
    no_hash, no_count = F.lit(None).cast("long").alias("h"), F.lit(None).cast("long").alias("n")
    dealt = dealt.select(*SHARD, "shards", F.lit(1).alias("kind"), "text_key", "outside", no_hash, no_count)

    def streams(host: str, rows: list[dict]) -> tuple[list[Page], np.ndarray, np.ndarray]:
        """Pages of a shard, how many of them hold the string from each token on, and the hashes of these strings."""
        found = [Page(unpacked(r["outside"]), host, min_tokens) for r in rows]
        counts = counted_streams([p.stream for p in found], min_tokens)
        hashed = np.zeros(len(counts), dtype=np.uint64)
        begin = 0
        for p in found:
            w = p.windows()
            hashed[begin : begin + len(w)] = w
            begin += len(p.stream)
        return found, counts, hashed

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for host, shard, rows in shards_of(batches):
            _, counts, hashed = streams(host, rows)
            h, first = np.unique(hashed[counts > 0], return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array([host] * len(h), pa.string()), pa.array(np.full(len(h), shard, dtype=np.int32)), signed(h), pa.array(counts[counts > 0][first])], names=["host", "shard", "h", "n"])

    told = by_shard(dealt.filter("shards > 1"), n).mapInArrow(tell, "host string, shard int, h long, n long")
    told = common.saved(told, "html-told")
    met = told.groupBy("h").agg(F.sum("n").alias("n"), F.count("*").alias("shards")).filter("shards > 1").select("h", "n")
    back = told.select(*SHARD, "h").join(met, "h")
    back = back.select(*SHARD, F.lit(2).alias("shards"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("text_key"), F.lit(None).cast("binary").alias("outside"), "h", "n")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for host, _, rows in shards_of(batches):
            others = sorted((r["h"] % (1 << 64), r["n"]) for r in rows if not r["kind"])
            own = [r for r in rows if r["kind"]]
            found, counts, hashed = streams(host, own)
            if others:
                keys, total = np.array([o[0] for o in others], dtype=np.uint64), np.array([o[1] for o in others], dtype=np.int64)
                at = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
                counts = np.where((keys[at] == hashed) & (counts > 0), total[at], counts)
            begin, keys, places, held = 0, [], [], []
            for r, p in zip(own, found, strict=True):
                mine = counts[begin : begin + len(p.stream)]
                begin += len(p.stream)
                if (mine > 1).any():
                    keys.append(r["text_key"])
                    places.append(np.flatnonzero(mine > 1).astype(np.int32))
                    held.append(mine[mine > 1])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(held, pa.list_(pa.int64()))], names=["text_key", "places", "counts"])

    return by_shard(dealt.unionByName(back), n).mapInArrow(place, "text_key long, places array<int>, counts array<long>")


def extract(pages: DataFrame, min_tokens: int = 12, shard_tokens: int = 1 << 20) -> DataFrame:
    """page_id, url, text, n_chars and n_repeated for each page.

    A first pass leaves a row for each distinct text of a host: the hashes of its host and blocks, and
    what stands outside its articles. What the host's texts share is counted and joined to the texts, and
    in a second pass to the pages.
    """
    common.session_of(pages)
    host = F.nullif(F.regexp_extract(F.lower(F.col("url").cast("string")), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [Page(blocks_of(html), name, min_tokens) for name, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            units = [p.units() for p in found]
            flat = signed(np.concatenate([np.zeros(0, dtype=np.uint64), *units]))
            outside = [packed([x for x in p.blocks if not x[0]]) if any(not inside for inside, _ in p.blocks) else None for p in found]
            yield pa.RecordBatch.from_arrays([pa.array([long_of(p.key) for p in found], pa.int64()), b.column(0), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, units)]), pa.int32()), flat), pa.array(outside, pa.binary()), pa.array([len(p.stream) for p in found], pa.int64())], names=["text_key", "host", "units", "outside", "n_tokens"])

    first = rows.filter("host IS NOT NULL AND html <> ''").select("host", "html").mapInArrow(read, "text_key long, host string, units array<long>, outside binary, n_tokens long")
    texts = common.saved(first.groupBy("text_key").agg(*[F.first(c).alias(c) for c in ("host", "units", "outside", "n_tokens")], F.count("*").alias("copies")), "html-texts")
    places = repeated_places(texts.filter("outside IS NOT NULL").select("text_key", "host", "outside", "n_tokens"), min_tokens, shard_tokens)
    pairs = texts.select(F.explode("units").alias("h"), "text_key")
    held = pairs.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    facts = pairs.join(held, "h").groupBy("text_key").agg(F.collect_list(F.struct("h", "n")).alias("held"))
    facts = texts.select("text_key", "copies").join(facts, "text_key", "left").join(places, "text_key", "left").filter("copies > 1 OR held IS NOT NULL OR places IS NOT NULL")
    facts = facts.select("text_key", "copies", F.col("held.h").alias("h"), F.col("held.n").alias("n"), "places", "counts")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, data = [], []
            for name, page in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                blocks = blocks_of(page or "")
                data.append(packed(blocks))
                keys.append(None if name is None else long_of(key_of(blocks, name)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(keys, pa.int64()), pa.array(data, pa.binary())], names=["page_id", "url", "host", "text_key", "data"])

    def result(b: pa.RecordBatch, texts: list[tuple[str, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t for t, _ in texts], pa.string()), pa.array([len(t) for t, _ in texts], pa.int64()), pa.array([n for _, n in texts], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_repeated"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for name, data, copies, h, n, at, held in zip(*(b.column(i).to_pylist() for i in range(2, 9)), strict=True):
                keys = np.array(h or [], dtype=np.int64).view(np.uint64)
                order = np.argsort(keys)
                texts.append(Page(unpacked(data), name, min_tokens).text(keys[order], np.array(n or [], dtype=np.int64)[order], copies or 1, np.array(at or [], dtype=np.int64), np.array(held or [], dtype=np.int64)))
            yield result(b, texts)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield result(b, [("\n\n".join(t for _, t in blocks_of(page or "")), 0) for page in b.column(3).to_pylist()])

    parsed = rows.filter("host IS NOT NULL").mapInArrow(parse, "page_id long, url string, host string, text_key long, data binary")
    hosted = parsed.join(facts, "text_key", "left").select("page_id", "url", "host", "data", "copies", "h", "n", "places", "counts").mapInArrow(finish, SCHEMA)
    return hosted.unionByName(rows.filter("host IS NULL").mapInArrow(alone, SCHEMA))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
