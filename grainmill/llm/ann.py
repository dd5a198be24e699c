"""Nearest neighbours through randomly rotated one-bit codes.

Index: every vector, scaled to length one and taken from a centroid, is turned by a seeded random rotation and kept as
one sign bit a dimension with three correction scalars (its distance from the centroid, the inner product of the code
with the vector it stands for, its length); codes, ids and original vectors lie in blocks of rows, written to the
shared folder. Search: the queries, in blocks of a fixed number, are broadcast to the index blocks; inner products are
estimated from the bits and scalars, and a vector is reranked with its original components if the estimate's upper
error bound reaches the k-th best exact score so far (of the best by estimate, and of the blocks before). A task gives its k best of each query, which are
then merged.

The centroid comes from a bounded sample (`sample_rows`); every vector is indexed. `epsilon` widens the error bounds:
a bound fails with a probability that falls as exp(-c epsilon^2).

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without an id; vectors of different dimension are not compared; candidates of the query's own id are its own row;
equal query rows are answered once, repeated candidate rows each count.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage

BLOCK = 4096


@functools.cache
def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    v = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))


def _by_dim(batch: pa.RecordBatch):
    """Ids and vectors of a batch, by dimension."""
    ids, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    dims = np.diff(offsets)
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield int(dim), ids[at], values[offsets[at][:, None] + np.arange(dim)]


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)  # so that no square overflows
    return vectors / np.sqrt((vectors**2).sum(1, keepdims=True))


def encode(unit: np.ndarray, centroid: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits, and (distance from the centroid, inner product of code and residual) of each vector."""
    dim = unit.shape[1]
    residual = unit - centroid
    far = np.sqrt((residual**2).sum(1))
    turned = residual @ rotation(dim, seed) / np.where(far > 0, far, 1)[:, None]
    bits = turned > 0
    inner = np.abs(turned).sum(1) / math.sqrt(dim)
    return np.packbits(bits, axis=1), np.stack([far, inner], 1).astype(np.float32)


def estimate(codes: np.ndarray, scalars: np.ndarray, queries: np.ndarray, centroid: np.ndarray, seed: int, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """(queries x vectors) estimates of the inner products of unit vectors, and each vector's error bound."""
    dim = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * np.float32(2) - np.float32(1)
    far, inner = scalars[:, 0], np.where(scalars[:, 1] > 0, scalars[:, 1], 1)
    turned = (queries @ rotation(dim, seed)).astype(np.float32)
    near = turned @ signs.T / np.float32(math.sqrt(dim)) * (far / inner) + (queries @ centroid).astype(np.float32)[:, None]
    error = far * np.sqrt(np.maximum(0, 1 - inner**2)) / inner * epsilon / math.sqrt(max(dim - 1, 1)) + 1e-5
    return near, error


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed from the first component to the last in double precision."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def cosine(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, long_a: np.ndarray, long_b: np.ndarray) -> np.ndarray:
    """Cosines of rows i of a and j of b whose lengths are given, summed as `dot` does; a and b have a row for each component, so that what is gathered stays in cache."""
    out, step = np.empty(len(i)), 1 << 14
    for low in range(0, len(i), step):
        x, y = i[low : low + step], j[low : low + step]
        total = np.zeros(len(x))
        for p, q in zip(a, b, strict=True):
            total += p[x] * q[y]
        out[low : low + step] = total / (long_a[x] * long_b[y])
    return np.clip(out, -1, 1)


def centroids_of(rows: DataFrame) -> dict[int, np.ndarray]:
    """The mean of the unit vectors of each dimension: sums in tasks, then by component."""

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, vectors in _by_dim(batch):
                total[dim] = total.get(dim, 0) + np.append(_unit(vectors).sum(0), len(vectors))
        for dim, x in total.items():
            yield pa.record_batch([pa.array(np.full(dim + 1, dim), pa.int32()), pa.array(np.arange(dim + 1), pa.int32()), pa.array(x, pa.float64())], ["dim", "i", "x"])

    made: dict[int, np.ndarray] = {}
    for r in rows.mapInArrow(sums, "dim int, i int, x double").groupBy("dim", "i").agg(F.sum("x").alias("x")).collect():  # a row for each component
        made.setdefault(r["dim"], np.zeros(r["dim"] + 1))[r["i"]] = r["x"]
    return {dim: x[:-1] / x[-1] for dim, x in made.items()}


def index(rows: DataFrame, centroids: dict[int, np.ndarray], seed: int) -> DataFrame:
    """Blocks of rows: dim, ids, codes, scalars, vectors."""

    def build(batches):
        for batch in batches:
            for dim, ids, vectors in _by_dim(batch):
                for low in range(0, len(ids), BLOCK):
                    v = vectors[low : low + BLOCK]
                    codes, scalars = encode(_unit(v), centroids.get(dim, np.zeros(dim)), seed)
                    yield pa.record_batch([pa.array([dim], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids[low : low + BLOCK].astype(np.int64), codes, scalars, v))], ["dim", "ids", "codes", "scalars", "vectors"])

    return rows.mapInArrow(build, "dim int, ids binary, codes binary, scalars binary, vectors binary")


def _search_block(blocks: DataFrame, asked: dict[int, tuple[np.ndarray, np.ndarray]], centroids: dict, k: int, seed: int, epsilon: float) -> DataFrame:
    spread = blocks.sparkSession.sparkContext.broadcast(asked)

    def find(batches):
        best: dict[int, list] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                dim = batch.column(0)[row].as_py()
                if dim not in spread.value:
                    continue
                query_ids, queries = spread.value[dim]
                ids = np.frombuffer(batch.column(1)[row].as_buffer(), np.int64)
                codes = np.frombuffer(batch.column(2)[row].as_buffer(), np.uint8).reshape(len(ids), -1)
                scalars = np.frombuffer(batch.column(3)[row].as_buffer(), np.float32).reshape(-1, 2)
                vectors = np.frombuffer(batch.column(4)[row].as_buffer(), np.float64).reshape(len(ids), dim)
                centroid = centroids.get(dim, np.zeros(dim))
                score, vec = best.setdefault(dim, [np.full((len(query_ids), k), -np.inf), np.full((len(query_ids), k), np.iinfo(np.int64).max)])
                long, columns = np.sqrt(dot(vectors, vectors)), np.ascontiguousarray(vectors.T)
                for low in range(0, len(query_ids), 256):
                    part = slice(low, low + 256)
                    asking, own = queries[part], query_ids[part]
                    long_q = np.sqrt(dot(asking, asking))
                    near, error = estimate(codes, scalars, _unit(asking), centroid, seed, epsilon)
                    turned = np.ascontiguousarray(asking.T)
                    exact = lambda q, v: cosine(turned, columns, q, v, long_q, long)  # noqa: B023, E731
                    # the best by estimate, their exact scores and those of the blocks before give the floor
                    few = min(len(ids), 4 * k + 1)
                    at = np.argpartition(near, len(ids) - few, axis=1)[:, len(ids) - few :].ravel()
                    q = np.repeat(np.arange(len(own)), few)
                    first = np.where(own[q] == ids[at], -np.inf, exact(q, at)).reshape(len(own), few)
                    floor = np.sort(np.concatenate([first, score[part]], axis=1), axis=1)[:, -k]
                    q, v = np.nonzero(near + error >= floor[:, None])
                    other = own[q] != ids[v]
                    q, v = q[other], v[other]
                    held = np.nonzero(score[part] > -np.inf)
                    all_q, all_s, all_v = np.concatenate([q, held[0]]), np.concatenate([exact(q, v), score[part][held]]), np.concatenate([ids[v], vec[part][held]])
                    fine = all_s >= floor[all_q]
                    all_q, all_s, all_v = all_q[fine], all_s[fine], all_v[fine]
                    order = np.lexsort((all_v, -all_s, all_q))
                    all_q, all_s, all_v = all_q[order], all_s[order], all_v[order]
                    place = np.arange(len(all_q)) - np.searchsorted(all_q, all_q)
                    top = place < k
                    score[low + all_q[top], place[top]] = all_s[top]
                    vec[low + all_q[top], place[top]] = all_v[top]
        for dim, (score, vec) in best.items():
            q, place = np.nonzero(score > -np.inf)
            number = np.full(len(q), dim)
            yield pa.record_batch([pa.array(spread.value[dim][0][q]), pa.array(q.astype(np.int64)), pa.array(number, pa.int32()), pa.array(vec[q, place]), pa.array(score[q, place])], ["query_id", "q", "dim", "vec_id", "score"])

    found = blocks.mapInArrow(find, "query_id long, q long, dim int, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "q", "dim").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, asked: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 5, seed: int = 7, epsilon: float = 2.4, sample_rows: int = 8192, query_block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: of each row of `vectors` for which `asked` (on `id`) holds, its k nearest others by cosine."""
    rows = _usable(vectors, vec_id, embedding)
    share = min(1.0, sample_rows / max(1, vectors.count()))
    centroids = centroids_of(rows.sample(share, 3))
    blocks = stage(index(rows, centroids, seed))
    queries = stage(rows.where(asked).distinct())
    parts, out = max(1, -(-queries.count() // query_block)), None
    for part in range(parts):  # each part is a bounded number of queries against all blocks
        taken: dict[int, list] = {}
        for r in queries.where(F.pmod(F.xxhash64("id", "v"), F.lit(parts)) == part).collect():
            taken.setdefault(len(r["v"]), []).append((r["id"], r["v"]))
        held = {dim: (np.array([i for i, _ in sorted(x)], np.int64), np.array([v for _, v in sorted(x)], np.float64)) for dim, x in taken.items()}
        found = _search_block(blocks, held, centroids, k, seed, epsilon)
        out = found if out is None else out.unionByName(found)
    return out
