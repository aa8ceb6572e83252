"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of words and word beginnings comes from labelled texts: those that stand in toxic texts far
more often than their share of all texts explains. Copies of a text count once for each word. Features
are densities of lexicon hits by strength, second-person words near hits, capitals, punctuation and
obfuscation rates. Features of the texts that the trees learn from use a lexicon that was learned
without their fold; predictions of trees that didn't see a fold calibrate the score.

Labels are learned from a sample bounded by ``max_rows``, a parameter; every text, learned from or
scored, is read whole. Neither labels nor lang, source or doc_id are inputs of a score.

Defined results: null or empty texts get the score of a text without any hits. Null ids are never held
out and never learned from. Rows with null labels aren't learned from. With no toxic or no clean label
the score is the same for all. Equal texts get equal scores. Empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from . import common

WORD = re.compile(r"[^\W_]+(?:[@$!*0-9_.'-]+[^\W_]+)*|[@$][^\W_]+")
INNER = re.compile(r"[^\W\d_][@$!*0-9_.]+[^\W\d_]")
RUN = re.compile(r"(\S)\1{2,}")
BEGINNINGS = (4, 5, 6)
#: Digits and signs that stand for letters; second-person words of the corpus's languages.
LEET = str.maketrans("013457@$!", "oieastasi", "*_.-'")
SECOND = frozenset("you your yours yourself youre u ur thou du dich dir dein deine deiner deinem deinen ihr euch euer eure tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros vuestro".split())
NAMES = ("strong", "weak", "strong_kinds", "weak_kinds", "weight", "top", "near_you", "you", "capitals", "shouted", "marks", "odd", "obfuscated", "stretched", "length", "longest_run")
FOLDS, THRESHOLD, SEED = 4, 0.7, 11
T_SCORE = [StructField(n, t()) for n, t in (("doc_id", LongType), ("held_out", BooleanType), ("score", DoubleType), ("predicted", IntegerType), ("text", StringType))]


# ---------------------------------------------------------------- lexicon


def keys_of(word: str) -> Iterator[str]:
    """What stands for a lower-case word in the lexicon: itself, also without disguise, and its beginnings."""
    yield word
    plain = word.translate(LEET)
    if plain != word and len(plain) > 2:
        yield plain
    for n in BEGINNINGS:
        if len(plain) > n:
            yield f"{plain[:n]}*"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def group_of(words: set[str]) -> int:
    """A minimum hash of the text's words: near copies nearly always agree in it."""
    return min((zlib.crc32(w.encode("utf-8", "replace"), SEED) for w in words), default=0)


@dataclass(frozen=True)
class Sample:
    """Labelled texts as numbers: the keys of all texts in a row, where each text's begin, labels and groups of near copies."""

    names: list[str]
    keys: np.ndarray
    starts: np.ndarray
    toxic: np.ndarray
    group: np.ndarray


def sample_of(texts: Sequence[str], toxic: Sequence[int]) -> Sample:
    ids: dict[str, int] = {}
    by_word: dict[str, tuple[int, ...]] = {}
    keys, groups = [], []
    for text in texts:
        words = set(words_of(text))
        own: set[int] = set()
        for w in words:
            if len(w) > 2:
                if w not in by_word:
                    by_word[w] = tuple(ids.setdefault(k, len(ids)) for k in keys_of(w))
                own.update(by_word[w])
        keys.append(np.fromiter(own, dtype=np.int64, count=len(own)))
        groups.append(group_of(words))
    starts = np.cumsum([0, *map(len, keys)])
    return Sample(list(ids), np.concatenate(keys) if keys else np.zeros(0, np.int64), starts, np.array(toxic, dtype=np.int64), np.array(groups, dtype=np.int64))


def learn_lexicon(sample: Sample, rows: np.ndarray, least: float = 10.0, most: int = 20_000) -> dict[str, tuple[float, float]]:
    """key: (log odds, strength), the strength being the gain in log likelihood over the base rate. A group of near copies counts once for each key and label."""
    of_row = np.repeat(np.arange(len(sample.toxic)), np.diff(sample.starts))
    used = np.isin(of_row, rows)
    _, group = np.unique(sample.group, return_inverse=True)
    kind = group * 2 + sample.toxic
    n_keys = len(sample.names)
    pairs = np.unique(kind[of_row[used]] * n_keys + sample.keys[used]) if n_keys else np.zeros(0, np.int64)
    toxic_pair = pairs // max(1, n_keys) % 2 == 1
    t, c = (np.bincount(pairs[m] % n_keys, minlength=n_keys).astype(float) if n_keys else np.zeros(0) for m in (toxic_pair, ~toxic_pair))
    totals = np.unique(kind[rows])
    toxic, clean = int((totals % 2 == 1).sum()), int((totals % 2 == 0).sum())
    if not clean or not toxic:
        return {}
    base = toxic / (clean + toxic)
    rate = t / np.maximum(1, t + c)
    gain = 2 * (t * np.log(np.maximum(rate, 1e-12) / base) + c * np.log(np.maximum(1 - rate, 1e-12) / (1 - base)))
    odds = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
    kept = np.flatnonzero((t >= 2) & (rate > base) & (gain >= least))
    found = sorted(((-gain[i], sample.names[i], odds[i]) for i in kept))[:most]
    return {key: (float(o), float(-g)) for g, key, o in found}


# ---------------------------------------------------------------- features


class Features:
    """Dense features of a text, summed over its distinct tokens between white space.

    A worker remembers what each token adds; tokens that add nothing, nearly all, are remembered as None.
    """

    def __init__(self, lexicon: dict[str, tuple[float, float]], remembered: int = 300_000) -> None:
        self.lexicon, self.remembered = lexicon, remembered
        strengths = sorted((s for _, s in lexicon.values()), reverse=True)
        #: A quarter of the strength of the eleventh entry: what divides strong from weak.
        self.strong = strengths[min(len(strengths) - 1, 10)] / 4 if strengths else 0.0
        self.starts = {k[:3] for k in lexicon}
        self.known: dict[str, tuple | None] = {}

    def hit(self, word: str) -> tuple[float, float] | None:
        if len(word) < 3 or word.isalpha() and word[:3] not in self.starts:
            return None
        own = [self.lexicon[k] for k in keys_of(word) if k in self.lexicon]
        return max(own, key=lambda x: x[1], default=None)

    def token(self, token: str) -> tuple | None:
        """Hits by word, second-person words, capitals, shouted, marks, odd signs, obfuscated, stretched, longest run of a sign."""
        if len(self.known) >= self.remembered:
            self.known.clear()
        core = token.rstrip(".,")
        if core.isalpha() and core.islower() and core[:3] not in self.starts and core not in SECOND and not RUN.search(token):
            self.known[token] = None
            return None
        words = words_of(token)
        hits = {w: h for w in words if (h := self.hit(w)) is not None}
        you = sum(w in SECOND for w in words)
        capitals = sum(map(str.isupper, token))
        run = max((len(m[0]) for m in RUN.finditer(token)), default=0)
        plain = not (hits or you or capitals or run) and token.isalpha()
        marks, odd = token.count("!") + token.count("?"), sum(map(token.count, "#$%&*@"))
        inner, stretched = len(INNER.findall(token)), sum(m[1].isalpha() for m in RUN.finditer(token))
        info = None if plain or not (hits or you or capitals or run or marks or odd or inner) else (hits, you, capitals, int(len(token) > 2 and token.isupper()), marks, odd, inner, stretched, run)
        self.known[token] = info
        return info

    def __call__(self, text: str) -> list[float]:
        tokens = text.split()
        n, known = max(1, len(tokens)), self.known
        found = [(count, info) for token, count in Counter(tokens).items() if (info := known[token] if token in known else self.token(token)) is not None]
        you, capitals, shouted, marks, odd, inner, stretched = (sum([c * info[i] for c, info in found]) for i in range(1, 8))
        hits: dict[str, tuple[float, float]] = {}
        n_strong = n_weak = 0
        for c, info in found:
            for w, h in info[0].items():
                hits[w] = h
                if h[1] >= self.strong:
                    n_strong += c
                else:
                    n_weak += c
        near = 0
        if hits and you:
            infos = [self.token(t) for t in tokens]
            second = [info is not None and info[1] > 0 for info in infos]
            near = sum(any(second[max(0, i - 5) : i + 6]) for i, info in enumerate(infos) if info is not None and info[0])
        kinds = sum(h[1] >= self.strong for h in hits.values())
        chars = max(1, len(text))
        return [
            1000 * n_strong / n, 1000 * n_weak / n, float(kinds), float(len(hits) - kinds),
            sum(sorted(h[0] for h in hits.values())), max((h[1] for h in hits.values()), default=0.0),
            1000 * near / n, 1000 * you / n, capitals / chars, shouted / n, marks / n, odd / n, inner / n, stretched / n,
            math.log1p(len(tokens)), float(max((info[8] for _, info in found), default=0)),
        ]


# ---------------------------------------------------------------- trees


@dataclass
class Trees:
    """Boosted regression trees of fixed depth on the logistic loss."""

    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(int(math.log2(len(leaf)))):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Histogram splits; each level of a tree is searched for all its nodes and features at once."""
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model = Trees(math.log(share / (1 - share)))
    if y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    # a feature that is mostly 0 has few quantiles: its other values get their own
    edges = [np.unique(np.r_[e, np.quantile(p, np.linspace(0, 1, bins // 2))]) if len(p := x[:, j][x[:, j] > 0]) else e for j, e in enumerate(edges)]
    width = max(map(len, edges)) + 1
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    raw = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first = 2**level - 1
            at = node - first
            size = 2**level
            gs, hs = np.zeros((x.shape[1], size, width)), np.zeros((x.shape[1], size, width))
            for j in range(x.shape[1]):
                where = at * width + binned[:, j]
                gs[j] = np.bincount(where, g, size * width).reshape(size, width)
                hs[j] = np.bincount(where, h, size * width).reshape(size, width)
            gl, hl = gs.cumsum(axis=2)[:, :, :-1], hs.cumsum(axis=2)[:, :, :-1]
            gt, ht = gs.sum(axis=2)[:, :, None], hs.sum(axis=2)[:, :, None]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least * 0.1) | (ht - hl < least * 0.1)] = 0
            for i in range(size):
                j, k = np.unravel_index(int(gain[:, i].argmax()), gain[:, i].shape)
                if gain[j, i, k] > 1e-9 and k < len(edges[j]):
                    feature[first + i], cut[first + i] = j, edges[j][k]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        own = node - len(feature)
        leaf = rate * np.bincount(own, g, 2**depth) / (np.bincount(own, h, 2**depth) + ridge)
        model.trees.append((feature, cut, leaf))
        raw += leaf[own]
    return model


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: the middle of each pool and its mean, for linear interpolation."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # sum of labels, number, sum of raw
    for r, label in zip(raw[order], y[order], strict=True):
        pools.append([float(label), 1.0, float(r)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


# ---------------------------------------------------------------- model


@dataclass
class Model:
    lexicon: dict[str, tuple[float, float]]
    trees: Trees
    knots: np.ndarray
    values: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        raw = self.trees.raw(features)
        calibrated = np.interp(raw, self.knots, self.values) if len(self.knots) else 1 / (1 + np.exp(-raw))
        return np.clip(0.998 * calibrated + 0.002 / (1 + np.exp(-raw)), 0, 1)  # the second part orders ties


def fit(texts: Sequence[str], toxic: Sequence[int]) -> Model:
    """Lexicon, trees and calibration from labelled texts; copies of a text stay in one fold."""
    if not len(texts) or min(toxic) == max(toxic):
        return Model({}, Trees(base=math.log((sum(toxic) + 0.5) / (len(toxic) - sum(toxic) + 0.5))), np.zeros(0), np.zeros(0))
    sample = sample_of(texts, toxic)
    fold = sample.group % 1_000_003 % FOLDS
    rows = np.arange(len(texts))
    x = np.zeros((len(texts), len(NAMES)))
    for k in range(FOLDS):
        features = Features(learn_lexicon(sample, rows[fold != k]))
        for i in rows[fold == k]:
            x[i] = features(texts[i])
    raw = np.zeros(len(texts))
    y = sample.toxic.astype(float)
    for k in range(FOLDS):
        if (fold == k).any() and (fold != k).any():
            raw[fold == k] = fit_trees(x[fold != k], y[fold != k]).raw(x[fold == k])
    knots, values = isotonic(raw, y)
    return Model(learn_lexicon(sample, rows), fit_trees(x, y), knots, values)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_documents(docs: DataFrame, labels: DataFrame, max_rows: int = 6000) -> Model:
    """A model from at most max_rows labelled ids that aren't held out, chosen by a hash of the id; their whole texts count.

    Rows that repeat an id, which have one label, count as the smallest of their texts.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("doc_id")))
    chosen = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = common.documents(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = sorted((r["doc_id"], r["text"], r["toxic"]) for r in rows.toLocalIterator())
    return fit([r[1] for r in found], [r[2] for r in found])


def score(docs: DataFrame, model: Model, carry: Column | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted and text for each row, and a struct that is carried along."""
    common.session_of(docs)
    rows = common.documents(docs, *([] if carry is None else [carry])).withColumn("held_out", held_out(F.col("doc_id")))
    packed = docs.sparkSession.sparkContext.broadcast(model)
    extra = [] if carry is None else [common.CARRIED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(packed.value.lexicon)
        for b in batches:
            x = np.array([features(t) for t in b.column("text").to_pylist()], dtype=float).reshape(-1, len(NAMES))
            s = packed.value.scores(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), *(b.column(c) for c in ("text", *extra))], names=["doc_id", "held_out", "score", "predicted", "text", *extra])

    schema = StructType([*T_SCORE, *(rows.schema[c] for c in extra)])
    return rows.mapInArrow(run, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, fit_documents(docs, common.table(spark, sf_dir, "labels"))).drop("text")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic, with all their columns as they were, whatever their names."""
    model = fit_documents(docs, common.table(spark, sf_dir, "labels"))
    kept = score(docs, model, common.carried(docs, "doc_id", "text")).filter("predicted = 0")
    return common.uncarried(kept, docs, "doc_id", "text", doc_id=F.col("doc_id").cast(docs.schema["doc_id"].dataType), text=common.text_as_it_was())
