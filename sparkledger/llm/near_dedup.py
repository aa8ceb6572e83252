"""Near duplicates by Order MinHash over word five-grams, verified by banded alignment.

Each of ``sketches`` hash functions orders the occurrence-labelled five-grams of a document; the two
smallest, in the order in which they stand in the text, are a sketch. Documents that share a sketch
are candidates. Similarity is that of an alignment: five-grams inside matched runs over all five-grams
of either text, so it never exceeds the resemblance of the two sets and moved passages don't count.
Documents of fewer than five words have one gram, all their words.

Equal word sequences fall together before anything else. In each bucket the member with the largest
buckets is compared with all others (a star, not all pairs); pairs whose binned hashes rule the
similarity out are not aligned. Members of a bucket that verified links leave in
different classes are then compared with those that share one of the next ``NEXT`` sketches too, pairs of
one class left out. Texts of similarity 0.8 share about 0.64 of their sketches, so they miss this with
a probability of about 1e-5, and members that met by one common passage don't meet again. Classes are connected components of verified links, found by
alternating stars over tables in the shared folder.

Defined results: null and empty texts have no words and are each a class of their own. A null doc_id
has a null class. Repeated rows and equal texts share a class. Class ids are the smallest doc_id of the
class. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

GRAM, SIMILARITY = 5, 0.8
SKETCHES, BINS = 20, 1024
#: Hashes computed at once for a text.
BLOCK = 1 << 17
#: Pairs with an estimate so many standard errors under the similarity aren't aligned.
MARGIN = 3.4
#: Members of a bucket that one task compares with each other or with as many others.
MEMBERS = 1000
#: Sorted five-grams that a worker remembers while it verifies pairs.
REMEMBERED = 1 << 21
STEP = np.uint64(0x9E3779B97F4A7C15)
SKETCHED = "doc_id long, digest binary, n_words int, sketch array<long>, bins binary"


class WordHashes(dict):
    """Hashes of words; bounded, and the same in every worker."""

    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return h


def words_of(text: str, known: WordHashes) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams_of(words: np.ndarray) -> np.ndarray:
    """Hashes of all five-grams, or of all words if there are fewer."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    n = min(GRAM, len(words))
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = out * STEP + words[i : i + len(out)]
    return _mix(out + np.uint64(n))


def labelled(grams: np.ndarray) -> np.ndarray:
    """Grams told apart by which occurrence in the text they are."""
    order = np.argsort(grams, kind="stable")
    same = np.r_[False, grams[order[1:]] == grams[order[:-1]]]
    at = np.arange(len(grams))
    nth = np.empty(len(grams), dtype=np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(same, 0, at))
    return _mix(grams + nth * STEP)


def order_min_hash(items: np.ndarray, sketches: int = SKETCHES) -> np.ndarray:
    """A sketch for each hash function: its two smallest labelled grams in text order.

    items: labelled grams. All functions are computed together, in blocks of bounded size for long texts.
    """
    seeds = _mix((np.arange(sketches, dtype=np.uint64) + np.uint64(1)) * STEP)
    out = np.empty(sketches, dtype=np.uint64)
    block = max(1, BLOCK // len(items))
    for i in range(0, sketches, block):
        own = seeds[i : i + block, None]
        h = (items[None, :] ^ own) * (own | np.uint64(1))
        h ^= h >> np.uint64(32)
        h *= STEP
        if len(items) == 1:
            out[i : i + block] = _mix(h[:, 0])
            continue
        at = np.arange(len(h))
        first = h.argmin(axis=1)
        low = h[at, first]
        h[at, first] = np.uint64(0xFFFFFFFFFFFFFFFF)
        second = h.argmin(axis=1)
        high, ahead = h[at, second], first < second
        out[i : i + block] = _mix(np.where(ahead, low, high) * STEP + np.where(ahead, high, low))
    return out


def binned(items: np.ndarray) -> bytes:
    """The smallest hash of labelled grams in each of BINS ranges, in 8 bits; 0 where a range is empty.

    Equal bins estimate resemblance: chance makes one in 255 of unequal bins equal. The
    number of grams follows in four bytes.
    """
    h = np.sort(_mix(items ^ STEP))
    where = (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.r_[True, where[1:] != where[:-1]]
    out = np.zeros(BINS, dtype=np.uint8)
    out[where[first]] = _mix(h[first]) % np.uint64(255) + np.uint64(1)
    return out.tobytes() + np.uint32(len(items)).tobytes()


def bins_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bins of each row and its number of grams."""
    raw = np.frombuffer(common.text_bytes(column)[0], dtype=np.uint8).reshape(len(column), BINS + 4)
    return raw[:, :BINS], np.ascontiguousarray(raw[:, BINS:]).view(np.uint32)[:, 0].astype(np.int64)


def may_reach(x: np.ndarray, y: np.ndarray, grams: np.ndarray, least: float, margin: float) -> np.ndarray:
    """Whether bins x and y leave it open that their texts, of so many grams together, resemble each other by least.

    The bins that either fills are a sample, without replacement, of the union of both sets, so the equal ones
    follow a hypergeometric distribution; one gram is allowed for rounding.
    """
    size = np.maximum(((x > 0) | (y > 0)).sum(axis=-1), 1)
    union = grams / (1 + least)
    error = np.sqrt(least * (1 - least) / size * np.clip((union - size) / np.maximum(union - 1, 1), 0, 1))
    return ((x == y) & (x > 0)).sum(axis=-1) + 1 >= (least - margin * error) * size


# ---------------------------------------------------------------- alignment


def resemblance(x: np.ndarray, y: np.ndarray) -> float:
    """The resemblance of two sorted sets of labelled five-grams: an upper bound of aligned()."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """The share of five-grams that an alignment of the words matches; 0 if it takes more edits than least allows.

    Furthest-reaching paths on a band of diagonals, as wide as the edits that the similarity allows.
    """
    if np.array_equal(a, b):
        return 1.0
    if min(len(a), len(b)) < GRAM:
        return 0.0
    ga, gb = len(a) - GRAM + 1, len(b) - GRAM + 1
    need = int(np.ceil(least / (1 + least) * (ga + gb) - 1e-9))
    if need > min(ga, gb):
        return 0.0
    most = len(a) + len(b) - 2 * (need + GRAM - 1)
    breaks: dict[int, list[int]] = {}

    def slide(i: int, k: int) -> int:
        """The first place from i on where the diagonal b = a + k differs."""
        if k not in breaks:
            lo, hi = max(0, -k), min(len(a), len(b) - k)
            breaks[k] = [*(np.flatnonzero(a[lo:hi] != b[lo + k : hi + k]) + lo).tolist(), max(lo, hi)]
        own = breaks[k]
        j = bisect_left(own, i)
        return own[j] if j < len(own) else i

    reach: list[dict[int, int]] = [{0: slide(0, 0)}]
    goal = len(b) - len(a)
    while reach[-1].get(goal, -1) < len(a):
        d = len(reach)
        if d > most:
            return 0.0
        last, now = reach[-1], {}
        for k in range(-d, d + 1, 2):
            i = max(last.get(k + 1, -2) + 1, last.get(k - 1, -2))
            if i < 0 or i > len(a) or i + k > len(b) or i + k < 0 or abs(k - goal) > most - d:
                continue
            now[k] = slide(i, k) if i < len(a) and i + k < len(b) else i
        if not now:
            return 0.0
        reach.append(now)
    matched, k, end = 0, goal, len(a)
    for d in range(len(reach) - 1, -1, -1):
        if d:
            last = reach[d - 1]
            down, right = last.get(k + 1, -2) + 1, last.get(k - 1, -2)
            start = max(down, right)
            step = k + 1 if down >= right else k - 1
        else:
            start, step = 0, k
        matched += max(0, end - start - GRAM + 1)
        if d:
            end, k = reach[d - 1][step], step
    return matched / (ga + gb - matched)


# ---------------------------------------------------------------- candidates


def sketched(docs: DataFrame, sketches: int = SKETCHES) -> DataFrame:
    """doc_id, a digest of its words, their number and its sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            digest, n, sketch, bins = [], [], [], []
            for text in b.column("text").to_pylist():
                words = words_of(text, known)
                digest.append(hashlib.md5(words.tobytes(), usedforsecurity=False).digest() if len(words) else None)
                n.append(len(words))
                items = labelled(grams_of(words)) if len(words) else None
                sketch.append(order_min_hash(items, sketches).view(np.int64) if len(words) else None)
                bins.append(binned(items) if len(words) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(digest, pa.binary()), pa.array(n, pa.int32()), pa.array(sketch, pa.list_(pa.int64())), pa.array(bins, pa.binary())], names=["doc_id", "digest", "n_words", "sketch", "bins"])

    return docs.mapInArrow(run, SKETCHED)


def shared_buckets(heads: DataFrame) -> DataFrame:
    """band, key, id and size of the buckets with several members; only counts are dealt by bucket before."""
    buckets = heads.select("id", F.posexplode("sketch").alias("band", "key"))
    sizes = buckets.groupBy("band", "key").agg(F.count("*").alias("size")).filter("size > 1")
    return buckets.join(sizes.hint("merge"), ["band", "key"])


def stars(buckets: DataFrame) -> DataFrame:
    """Pairs of each bucket's central member, that with the largest buckets, with the others. buckets: band, key, id, size."""
    weight = buckets.groupBy("id").agg(F.sum("size").alias("weight"))
    weighed = buckets.select("band", "key", "id").join(weight.hint("merge"), "id")
    centres = weighed.groupBy("band", "key").agg(F.min(F.struct(-F.col("weight"), "id"))["id"].alias("centre"))
    paired = buckets.select("band", "key", "id").join(centres.hint("merge"), ["band", "key"]).filter("id <> centre")
    return paired.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()


def blocked(members: DataFrame, most: int = MEMBERS) -> DataFrame:
    """Members dealt to pairs of blocks, so that no task holds a whole hot bucket. members: id, size and others.

    Adds own, lo and hi: a member's block and the two blocks that meet; lo and hi are equal where one block meets itself.
    """
    n = F.ceil(F.col("size") / F.lit(most)).cast("int")
    dealt = members.withColumn("own", F.pmod(F.xxhash64("id"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return dealt.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other", "size")


#: How far the second sketch stands behind the first.
NEXT = 3
#: What the members that meet in the last pass have in common, and the blocks they are dealt to.
SHARED = ("band", "band2", "key")
MET = (*SHARED, "lo", "hi")


def twice_shared(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """Members of a bucket by a second, later sketch that they share: band, band2, key, id, class and size of groups that hold several classes.

    members: band, key, id, class. sketches: id, sketch. Groups are counted before the exchange.
    """
    own = members.join(sketches.hint("merge"), "id").select("band", "key", "id", "class", F.posexplode("sketch").alias("band2", "key2")).filter(F.col("band2").between(F.col("band") + 1, F.col("band") + NEXT))
    own = own.select("band", "band2", F.xxhash64("key", "key2").alias("key"), "id", "class")
    groups = own.groupBy(*SHARED).agg(F.count("*").alias("size"), F.min("class").alias("x"), F.max("class").alias("y")).filter("x <> y")
    return own.join(groups.select(*SHARED, "size"), list(SHARED))


def crossing(members: DataFrame, least: float = SIMILARITY, margin: float = MARGIN) -> DataFrame:
    """Pairs inside groups whose members lie in several classes, those of one class left out.

    A pair's bins must leave the similarity open, and it is made by the first two sketches by which it
    meets, so none comes twice. members: MET, own, id, class, sketch, bins, dealt and ordered by MET.
    """
    keys = MET

    def pairs(at: tuple, own: np.ndarray, ids: np.ndarray, classes: np.ndarray, sketch: np.ndarray, bins: np.ndarray, grams: np.ndarray) -> Iterator[pa.RecordBatch]:
        band, second, _, lo, hi = at
        one: list[np.ndarray] = []
        two: list[np.ndarray] = []
        for i in np.flatnonzero(own == lo):
            others = np.flatnonzero(own == hi) if lo < hi else np.arange(i + 1, len(ids))
            other = others[classes[others] != classes[i]]
            if not len(other):
                continue
            same = sketch[other] == sketch[i]
            met = np.zeros(len(other), dtype=bool)  # by two earlier sketches
            for k in range(band + 1):
                for j in range(k + 1, min(k + NEXT + 1, sketch.shape[1])):
                    if (k, j) < (band, second):
                        met |= same[:, k] & same[:, j]
            other = other[~met]
            other = ids[other[may_reach(bins[other], bins[i], grams[other] + grams[i], least, margin)]]
            one.append(np.full(len(other), ids[i]))
            two.append(other)
        if one:
            a, b = np.concatenate(one), np.concatenate(two)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None
        for b in batches:
            if not len(b):
                continue
            key = [b.column(c).to_numpy() for c in keys]
            rows = [b.column(c).to_numpy() for c in ("own", "id", "class")]
            rows.append(b.column("sketch").flatten().to_numpy().reshape(len(b), -1))
            rows.extend(bins_of(b.column("bins")))
            changes = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
            cuts = np.r_[0, np.flatnonzero(changes) + 1, len(b)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                here = tuple(int(k[i]) for k in key)
                if held and at != here:
                    yield from pairs(at, *(np.concatenate(x) for x in zip(*held, strict=True)))
                    held = []
                at = here
                held.append(tuple(r[i:j] for r in rows))
        if held:
            yield from pairs(at, *(np.concatenate(x) for x in zip(*held, strict=True)))

    return members.mapInArrow(run, "a long, b long")


def gathered(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """a, b, id and value, two rows for each pair that follow each other, a's first. values: id, value.

    The values are dealt once for both members. Joins are merge joins at every size: both sides grow with the corpus.
    """
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("id"))
    found = asked.join(values.hint("merge"), "id").select("a", "b", "id", "value")
    return found.repartition(n, "a", "b").sortWithinPartitions("a", "b", "id")


def in_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of gathered() that cut no pair, and where each pair's two rows are; of rows that share an id, the first counts."""

    def places(b: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        one, two, own = (b.column(c).to_numpy() for c in ("a", "b", "id"))
        new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
        return b, np.flatnonzero(new), np.flatnonzero(np.r_[False, (own[1:] == two[1:]) & ((own[:-1] != two[1:]) | new[1:])])

    held = None
    for b in batches:
        if not len(b):
            continue
        held = pa.concat_batches([held, b]) if held is not None else b
        one, two = held.column("a").to_numpy(), held.column("b").to_numpy()
        other = np.flatnonzero((one != one[-1]) | (two != two[-1]))
        if len(other):
            yield places(held.slice(0, int(other[-1]) + 1))
            held = held.slice(int(other[-1]) + 1)
    if held is not None:
        yield places(held)


def likely(pairs: DataFrame, bins: DataFrame, least: float = SIMILARITY, margin: float = MARGIN) -> DataFrame:
    """The pairs whose bins leave the similarity open. bins: id, value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, first, second in in_pairs(batches):
            own, grams = bins_of(b.column("value"))
            keep = may_reach(own[first], own[second], grams[first] + grams[second], least, margin)
            yield b.select(["a", "b"]).take(pa.array(first[keep]))

    return gathered(pairs, bins).mapInArrow(run, "a long, b long")


def word_table(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and value, the hashes of its words, of the documents in ids; texts are dealt here and nowhere else."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([words_of(t, known).astype(np.uint32).tobytes() for t in b.column("text").to_pylist()], pa.binary())], names=["id", "value"])

    wanted = ids.select(F.col("id").alias("doc_id")).distinct()
    return docs.join(wanted.hint("merge"), "doc_id", "left_semi").mapInArrow(hashes, "id long, value binary")


def verified(pairs: DataFrame, words: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """a, b and similarity of the pairs that the alignment confirms. words: id, value."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        size = 0

        def read(doc_id: int, raw: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
            """Words and sorted labelled grams of a document."""
            nonlocal size
            if doc_id not in known:
                if size > REMEMBERED:
                    known.clear()
                    size = 0
                own = np.frombuffer(raw.as_buffer(), dtype=np.uint32).astype(np.uint64)
                known[doc_id] = own, np.sort(labelled(grams_of(own)))
                size += len(own)
            return known[doc_id]

        for b, first, second in in_pairs(batches):
            found, ids, raw = [], b.column("id").to_pylist(), b.column("value")
            for i, j in zip(first.tolist(), second.tolist(), strict=True):
                (u, p), (v, q) = read(ids[i], raw[i]), read(ids[j], raw[j])
                if resemblance(p, q) >= least and (s := aligned(u, v, least)) >= least:
                    found.append((ids[i], ids[j], s))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], names=["a", "b", "similarity"])

    return gathered(pairs, words).mapInArrow(confirm, "a long, b long, similarity double")


def components(links: DataFrame) -> DataFrame:
    """id and class, the smallest id that links lead to, by alternating large and small stars until nothing changes."""
    edges = common.saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    previous = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges = common.saved(small, "edges")
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.max(F.struct(F.xxhash64("u", "v")))).first()
        if seen == previous:
            return edges.groupBy("u").agg(F.min("v").alias("class")).withColumnRenamed("u", "id")
        previous = seen


def near_duplicates(docs: DataFrame, sketches: int = SKETCHES, least: float = SIMILARITY, margin: float = MARGIN) -> DataFrame:
    """doc_id, class_id and n_links for each row; n_links counts the verified links found for its word sequence.

    Links are looked for by stars in each bucket and between the classes that these leave, so documents of
    one class may be similar without a link of their own: n_links is at most the number of similar ones.
    """
    spark = common.session_of(docs)
    rows = common.documents(docs)
    all_rows = common.saved(sketched(rows, sketches).withColumn("row", F.monotonically_increasing_id()), "sketches")
    # one row for each word sequence, found without its wide columns
    known = all_rows.filter("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("head"))
    heads = common.saved(known.select("digest", F.col("head.doc_id").alias("id"), F.col("head.row").alias("row")), "heads")
    by_row = heads.select("id", "row").hint("merge")
    buckets = common.saved(shared_buckets(all_rows.select("row", "sketch").join(by_row, "row")), "buckets")
    shared = buckets.select("id").distinct()
    words = common.saved(word_table(rows, shared), "words")
    wide = common.saved(all_rows.select("row", "sketch", "bins").join(by_row, "row").join(shared.hint("merge"), "id", "left_semi").drop("row"), "wide")
    bins = wide.select("id", F.col("bins").alias("value"))

    pairs = common.saved(likely(common.saved(stars(buckets), "pairs"), bins, least, margin), "likely")
    links = common.saved(verified(pairs, words, least), "links")
    members = buckets.join(components(links), "id", "left").withColumn("class", F.coalesce("class", "id"))
    several = members.groupBy("band", "key").agg(F.min("class").alias("x"), F.max("class").alias("y")).filter("x <> y")
    members = members.join(several.select("band", "key"), ["band", "key"]).select("band", "key", "id", "class")
    members = common.saved(twice_shared(members, wide.select("id", "sketch")), "members")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    members = blocked(members).join(wide.hint("merge"), "id")
    members = members.repartition(n, *MET).sortWithinPartitions(*MET).select(*MET, "own", "id", "class", "sketch", "bins")
    last = verified(common.saved(crossing(members, least, margin), "pairs"), words, least)
    links = common.saved(links.unionByName(last).select("a", "b").distinct(), "links")
    classes = components(links)
    degree = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).groupBy("id").count().withColumnRenamed("count", "n_links")
    known = heads.select("digest", "id").join(classes, "id", "left").join(degree, "id", "left").select("digest", F.coalesce("class", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = all_rows.select("doc_id", "digest").join(known.hint("merge"), "digest", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return out.select("doc_id", own.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, that with the smallest doc_id; rows without an id stay."""
    classes = near_duplicates(docs)
    gone = classes.filter("doc_id <> class_id").select(F.col("doc_id").alias("gone_id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("own_id"), common.carried(docs))
    return common.uncarried(rows.join(gone, rows["own_id"] == gone["gone_id"], "left_anti"), docs)
