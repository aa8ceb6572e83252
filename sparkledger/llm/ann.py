"""Nearest neighbours by randomly rotated one-bit codes with error bounds, in cells that a bound rules out.

Cells are the nearest of some centres, fitted on a sample bounded by ``sample_bytes`` (a parameter);
every vector is assigned and indexed, in blocks of its cell. A block keeps one sign bit for each rotated
dimension of a vector's residual from the centre, packed in words, the residual's length and the inner
product of its direction with its code. A query is turned likewise and written in eight bit planes;
counts of common bits of planes and codes estimate the inner product, with an error below
``epsilon * sqrt((1 - p^2) / p^2 / (dim - 1))`` with high probability, and that of the planes. Vectors
whose lower bound lies above the k-th upper bound of their block, or above what the query found before,
are left out; the others are ranked by exact distances in double precision.

A query visits its nearest cells first. Then it visits every other cell that the triangle inequality
leaves open: those whose centre is no further than the k-th distance found and the cell's radius
together. So cells lose nothing; on data without clusters they save nothing either. Cells of any
size are many blocks, and the queries of a cell come in chunks, so no task holds a whole cell.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows
with a null vec_id, take no part. Rows with one vec_id are one vector, the smallest of them in array
order, and never their own neighbour. Vectors of different length aren't compared. Equal distances
rank by vec_id. With fewer than k candidates all are returned; with none the query has no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BLOCK = "dim int, cell int, sub int, ids binary, vectors binary, codes binary, scalars binary"
PLANES = 8


@functools.lru_cache(maxsize=8)
def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def packed_words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    raw = np.packbits(bits, axis=1)
    wide = np.zeros((len(raw), -(-raw.shape[1] // 8) * 8), dtype=np.uint8)
    wide[:, : raw.shape[1]] = raw
    return wide.view(np.uint64)


def one_bit_codes(vectors: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated residuals; for each its norm and the inner product of its direction with its code."""
    rest = vectors - centre
    norm = np.sqrt((rest * rest).sum(axis=1))
    turned = (rest / np.where(norm > 0, norm, 1)[:, None]) @ rotation(vectors.shape[1])
    product = np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])
    return packed_words(turned >= 0), np.stack([norm, np.where(norm > 0, product, 1)], axis=1)


def bounds(queries: np.ndarray, codes: np.ndarray, scalars: np.ndarray, centre: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances, queries by vectors, from codes and scalars alone."""
    dim, root = queries.shape[1], np.sqrt(queries.shape[1])
    rest = queries - centre
    size = np.sqrt((rest * rest).sum(axis=1))
    turned = (rest / np.where(size > 0, size, 1)[:, None]) @ rotation(dim)
    norm, product = scalars[:, 0], scalars[:, 1]
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    estimate, slack = np.empty((len(queries), len(codes))), np.empty(len(queries))
    for i, q in enumerate(turned):
        low = q.min()
        step = max((q.max() - low) / (2**PLANES - 1), 1e-12)
        level = np.rint((q - low) / step).astype(np.uint8)
        common = np.zeros(len(codes), dtype=np.int64)
        for j in range(PLANES):
            plane = packed_words((level >> j & 1)[None, :])[0]
            common += np.bitwise_count(codes & plane).sum(axis=1, dtype=np.int64) << j
        estimate[i] = (2 * (low * ones + step * common) - (low * dim + step * int(level.sum()))) / root
        slack[i] = root * step / 2  # the planes' own error, at most
    error = (epsilon * np.sqrt(np.maximum(0, 1 - product**2)) / np.sqrt(max(1, dim - 1)) + slack[:, None]) / product + 1e-9
    both = 2 * size[:, None] * norm
    middle = size[:, None] ** 2 + norm**2 - both * (estimate / product)
    return middle - both * error, middle + both * error


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances; components are summed in their order."""
    d = vectors - query
    return np.sqrt(np.cumsum(d * d, axis=1)[:, -1])


def nearest(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, scalars: np.ndarray, centre: np.ndarray, k: int, epsilon: float, known: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The k nearest vectors of a block for each query; known: distances beyond which nothing counts."""
    low, high = bounds(queries, codes, scalars, centre, epsilon)
    own = query_ids[:, None] == ids
    high[own], low[own] = np.inf, np.inf
    limit = np.partition(high, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(queries), np.inf)
    if known is not None:
        limit = np.minimum(limit, known**2 * (1 + 1e-9))
    for i, query in enumerate(queries):
        near = np.flatnonzero((low[i] <= limit[i]) & ~own[i])
        distance = exact(vectors[near], query) if len(near) else np.zeros(0)
        best = np.lexsort((ids[near], distance))[:k]
        yield int(query_ids[i]), ids[near][best], distance[best]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding in double precision, one row for each id."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(F.size("embedding") > 0, F.lit(False)) & F.expr("forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))") & F.expr("exists(embedding, x -> x <> 0)"))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def fit_centres(sample: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """n centres of a sample, by Lloyd's rounds from spread rows."""
    centres = sample[np.random.default_rng(5).permutation(len(sample))[:n]].copy()
    for _ in range(rounds):
        own = ((centres**2).sum(axis=1) - 2 * sample @ centres.T).argmin(axis=1)
        size = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def centres_of(vectors: DataFrame, rows: int, sample_bytes: int) -> dict[int, np.ndarray]:
    """Centres for each length of vector: one for so many rows, and for 8 vectors of the sample at least."""
    sizes = {r["dim"]: r["n"] for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # lengths that occur
    if not sizes:
        return {}
    wanted = max(8, sample_bytes // (8 * max(sizes)))
    held: dict[int, list] = {}
    for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).select("dim", "embedding").toLocalIterator():
        held.setdefault(r["dim"], []).append(r["embedding"])
    found = {}
    for dim, n in sizes.items():
        sample = np.array(held.get(dim, [[0.0] * dim]), dtype=np.float64)
        found[dim] = fit_centres(sample, max(1, min(n // rows, len(sample) // 8)))
    return found


def distances(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (vectors**2).sum(axis=1)[:, None] - 2 * vectors @ centres.T + (centres**2).sum(axis=1)))


def assigned(vectors: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """vec_id, dim, cell, distance to the cell's centre, and the vector."""
    sent = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = b.filter(pa.array(dims == dim))
                v = own.column("embedding").flatten().to_numpy().reshape(-1, dim)
                cell = distances(v, sent.value[dim]).argmin(axis=1)
                away = np.sqrt(((v - sent.value[dim][cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("dim"), pa.array(cell.astype(np.int32)), pa.array(away), own.column("embedding")], names=["vec_id", "dim", "cell", "away", "embedding"])

    return vectors.select("vec_id", "dim", "embedding").mapInArrow(run, "vec_id long, dim int, cell int, away double, embedding array<double>")


def blocks(placed: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """A coded block for each dim, cell and sub of placed vectors that come in this order."""
    sent = placed.sparkSession.sparkContext.broadcast(centres)
    schema = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("sub", pa.int32()), *((c, pa.binary()) for c in ("ids", "vectors", "codes", "scalars"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, parts = None, [], []

        def flush() -> pa.RecordBatch:
            v, own = np.concatenate(parts), np.concatenate(ids)
            codes, scalars = one_bit_codes(v, sent.value[at[0]][at[1]])
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, (*at, own.tobytes(), v.tobytes(), codes.tobytes(), scalars.tobytes()), strict=True))], schema)

        for b in batches:
            if not len(b):
                continue
            key = [b.column(c).to_numpy() for c in ("dim", "cell", "sub")]
            cuts = np.r_[0, np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key])) + 1, len(b)]
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                here = tuple(int(k[i]) for k in key)
                if ids and here != at:
                    yield flush()
                    ids, parts = [], []
                at = here
                ids.append(b.column("vec_id").to_numpy()[i:j])
                parts.append(b.column("embedding").slice(i, j - i).flatten().to_numpy().reshape(j - i, -1))
        if ids:
            yield flush()

    return placed.mapInArrow(run, BLOCK)


def found_in(visits: DataFrame, index: DataFrame, subs: DataFrame, centres: dict[int, np.ndarray], k: int, epsilon: float, chunk: int) -> DataFrame:
    """query_id, vec_id and score of what queries find in the cells they visit. visits: query_id, dim, cell, known, embedding."""
    spark = visits.sparkSession
    sent = spark.sparkContext.broadcast(centres)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = visits.groupBy("dim", "cell").agg(F.count("*").alias("asked"))
    cells = subs.join(asked, ["dim", "cell"]).withColumn("chunks", F.ceil(F.col("asked") / F.lit(chunk)).cast("int"))
    cells = F.broadcast(cells.select("dim", "cell", "subs", "chunks"))  # a row for each cell, as many as there are centres
    own = visits.join(cells, ["dim", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int"))
    own = own.groupBy("dim", "cell", "chunk", "subs").agg(F.collect_list(F.struct("query_id", "known", "embedding")).alias("asked"))
    own = own.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).drop("subs")
    each = index.join(cells.drop("subs"), ["dim", "cell"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    keys = ["dim", "cell", "sub", "chunk"]
    met = own.repartition(n, *keys).join(each.hint("merge"), keys).select("dim", "cell", "ids", "vectors", "codes", "scalars", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                dim, cell, ids, v, codes, scalars = (b.column(j)[i].as_py() for j in range(6))
                asked = b.column("asked")[i].values
                q_ids, known = asked.field("query_id").to_numpy(), asked.field("known").to_numpy()
                q = asked.field("embedding").flatten().to_numpy().reshape(-1, dim)
                real = lambda x, w: np.frombuffer(x, dtype=np.float64).reshape(-1, w)
                out = list(nearest(q_ids, q, np.frombuffer(ids, np.int64), real(v, dim), np.frombuffer(codes, np.uint64).reshape(-1, -(-dim // 64)), real(scalars, 2), sent.value[dim][cell], k, epsilon, known))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([x[0] for x in out], [len(x[1]) for x in out]).astype(np.int64)), pa.array(np.concatenate([x[1] for x in out])), pa.array(np.concatenate([x[2] for x in out]))], names=["query_id", "vec_id", "score"])

    return met.mapInArrow(run, "query_id long, vec_id long, score double")


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, epsilon: float = 4.0, block_rows: int = 2048, chunk: int = 256, probes: int = 2, sample_bytes: int = 1 << 25) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found for each query, all vectors indexed."""
    spark = common.session_of(vectors)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = common.saved(usable(vectors).withColumn("dim", F.size("embedding")), "vectors")
    centres = centres_of(rows, block_rows, sample_bytes)
    placed = common.saved(assigned(rows, centres), "placed")
    cells = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
    subs = common.saved(cells.withColumn("subs", F.ceil(F.col("n") / F.lit(block_rows)).cast("int")), "cells")
    keys = ["dim", "cell", "sub"]
    dealt = placed.join(F.broadcast(subs.select("dim", "cell", "subs")), ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("vec_id"), F.col("subs")).cast("int")).select(*keys, "vec_id", "embedding")
    index = common.saved(blocks(dealt.repartition(n, *keys).sortWithinPartitions(*keys, "vec_id"), centres), "index")
    facts = {(r["dim"], r["cell"]): (r["n"], r["radius"]) for r in subs.collect()}  # as many as there are centres
    sent = spark.sparkContext.broadcast((centres, facts))

    def first(distance: np.ndarray, dim: int, known: float) -> list[int]:
        """The nearest cells, until they hold more than k vectors, and so many at least."""
        chosen, held = [], 0
        for cell in np.argsort(distance, kind="stable").tolist():
            if len(chosen) >= probes and held > k:
                break
            chosen.append(cell)
            held += sent.value[1].get((dim, cell), (0, 0.0))[0]
        return chosen

    def rest(distance: np.ndarray, dim: int, known: float) -> list[int]:
        """The other cells that may hold a vector as near as the k-th that is known."""
        radius = np.array([sent.value[1].get((dim, c), (0, -np.inf))[1] for c in range(len(distance))])
        near = np.flatnonzero(distance - radius <= known * (1 + 1e-9) + 1e-9)
        before = set(first(distance, dim, known))
        return [c for c in near.tolist() if c not in before]

    def visits(asked: DataFrame, choose) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                dims, known = b.column("dim").to_numpy(), b.column("known").to_numpy()
                for dim in np.unique(dims).tolist():
                    if dim not in sent.value[0]:
                        continue
                    own = np.flatnonzero(dims == dim)
                    v = b.column("embedding").take(pa.array(own)).flatten().to_numpy().reshape(-1, dim)
                    away = distances(v, sent.value[0][dim])
                    chosen = [[c for c in choose(away[i], dim, known[row]) if (dim, c) in sent.value[1]] for i, row in enumerate(own.tolist())]
                    at = np.repeat(own, [len(c) for c in chosen])
                    cell = np.array([c for own_cells in chosen for c in own_cells], dtype=np.int32)
                    took = b.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([took.column("query_id"), took.column("dim"), pa.array(cell), took.column("known"), took.column("embedding")], names=["query_id", "dim", "cell", "known", "embedding"])

        return common.saved(asked.select("query_id", "dim", "known", "embedding").mapInArrow(run, "query_id long, dim int, cell int, known double, embedding array<double>"), "visits")

    asked = common.saved(usable(queries).select(F.col("vec_id").alias("query_id"), F.size("embedding").alias("dim"), "embedding"), "queries")
    near = common.saved(best(found_in(visits(asked.withColumn("known", F.lit(float("inf"))), first), index, subs, centres, k, epsilon, chunk), k), "near")
    reach = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).otherwise(float("inf")).alias("known"))
    again = asked.join(reach.hint("merge"), "query_id", "left").withColumn("known", F.coalesce("known", F.lit(float("inf"))))
    more = found_in(visits(again, rest), index, subs, centres, k, epsilon, chunk)
    return best(near.drop("rank").unionByName(more), k)


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id),
d AS (
  SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, v.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])), lambda a, b: a + b)) AS score
  FROM v q JOIN v ON v.vec_id <> q.vec_id AND len(v.e) = len(q.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
