"""Nearest neighbours by randomly rotated one-bit codes with error bounds.

Vectors are centred, normalised and rotated by one random orthogonal matrix; a code keeps the signs, packed
in 64-bit words, with two correction scalars: the length, and the inner product of the unit vector
with its code. Queries are rotated likewise and rounded to 4-bit planes, so that the estimate of an
inner product is a few ands and bit counts. Its error is bounded with high probability: a vector is
reranked by its exact distance only if its lower bound is within the k-th smallest upper bound.

Equal vectors are one candidate that carries its smallest ids, so a vector that a third of all rows
share costs what any other costs. Distinct query vectors and candidates meet block by block: the grid of
(query block, group of candidates) is dealt out by an equi-join; a cell hands on its k best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbtrace.sources.scratch import materialise

#: Rows of a cell of the grid.
QUERY_ROWS = 1024
CANDIDATE_ROWS = 8192
#: Width of the error bound, in standard deviations.
EPSILON = 3.0
PLANES = 4


class Codes:
    """Codes of a matrix of vectors."""

    def __init__(self, vectors: np.ndarray, centre: np.ndarray, rotation: np.ndarray):
        x = vectors - centre
        self.norm = np.sqrt((x * x).sum(1))
        o = (x / np.where(self.norm > 0, self.norm, 1)[:, None]) @ rotation
        d = o.shape[1]
        self.words = pack(o >= 0)
        # inner product of the unit vector with its code (+-1/sqrt(d))
        self.fit = np.abs(o).sum(1) / np.sqrt(d)
        self.ones = np.bitwise_count(self.words).sum(1).astype(np.int64)


def pack(bits: np.ndarray) -> np.ndarray:
    packed = np.packbits(bits, axis=1)
    wide = np.zeros((len(bits), -(-packed.shape[1] // 8) * 8), np.uint8)
    wide[:, :packed.shape[1]] = packed
    return wide.view(np.uint64)


def rotation_of(d: int, seed: int = 41) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]


def distance_bounds(queries: np.ndarray, codes: Codes, centre: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds (high probability) of squared distances, queries x candidates."""
    x = queries - centre
    norm = np.sqrt((x * x).sum(1))
    q = (x / np.where(norm > 0, norm, 1)[:, None]) @ rotation
    d = q.shape[1]
    low = q.min(1)
    step = np.maximum((q.max(1) - low) / (2 ** PLANES - 1), 1e-12)
    levels = np.rint((q - low[:, None]) / step[:, None]).astype(np.uint8)
    dots = np.zeros((len(q), len(codes.words)))
    for p in range(PLANES):
        plane = pack((levels >> p) & 1 == 1)
        for w in range(plane.shape[1]):
            dots += float(1 << p) * np.bitwise_count(plane[:, w][:, None] & codes.words[None, :, w])
    # sum over code bits of (low + step * level), then from bits 0/1 to signs
    on = dots * step[:, None] + codes.ones[None, :] * low[:, None]
    total = levels.sum(1) * step + d * low
    inner = (2 * on - total[:, None]) / np.sqrt(d)
    fit = np.maximum(codes.fit, 1e-6)
    estimate = inner / fit[None, :]
    # rounding moves an inner product by its own, much smaller error
    error = EPSILON * (np.sqrt(np.maximum(1 - fit ** 2, 0)) / fit / np.sqrt(max(d - 1, 1)))[None, :] + (EPSILON * step / np.sqrt(12))[:, None] / fit[None, :]
    base = norm[:, None] ** 2 + codes.norm[None, :] ** 2
    scale = 2 * norm[:, None] * codes.norm[None, :]
    return base - scale * np.minimum(estimate + error, 1), base - scale * np.maximum(estimate - error, -1)


def nearest(queries: np.ndarray, vectors: np.ndarray, k: int, centre: np.ndarray, rotation: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: places of the vectors that may be among the k nearest, and their exact distances."""
    codes = Codes(vectors, centre, rotation)
    for at in range(0, len(queries), 64):
        part = queries[at:at + 64]
        lower, upper = distance_bounds(part, codes, centre, rotation)
        bar = np.partition(upper, k - 1, 1)[:, k - 1] if upper.shape[1] > k else np.full(len(part), np.inf)
        for i in range(len(part)):
            near = np.flatnonzero(lower[i] <= bar[i] + 1e-9 * (1 + abs(bar[i])))
            diff = vectors[near] - part[i]
            yield at + i, near, np.sqrt((diff * diff).sum(1))


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _centre(rows: DataFrame) -> dict[int, np.ndarray]:
    """Mean vector for each dimension that occurs; a task hands on one sum for each."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        for b in batches:
            for d, part in b.groupby("d"):
                s = sums.setdefault(int(d), [np.zeros(int(d)), 0])
                s[0] += np.stack(part["v"].to_numpy()).sum(0)
                s[1] += len(part)
        yield pd.DataFrame([(d, s.tolist(), n) for d, (s, n) in sums.items()], columns=["d", "s", "n"])

    parts = rows.select("d", "v").mapInPandas(add, "d int, s array<double>, n long")
    cells = parts.select("d", "n", F.posexplode("s")).groupBy("d", "pos").agg((F.sum("col") / F.sum("n")).alias("x")).collect()
    out: dict[int, np.ndarray] = {}
    for r in cells:
        out.setdefault(r.d, np.zeros(r.d))[r.pos] = r.x
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of every row of `vectors` (vec_id, embedding) where `is_query` holds.

    score is the Euclidean distance in double precision; ties go to the smaller vec_id; the query's own id is no
    candidate. Rows without an id, and vectors that are null, empty, zero or hold null or non-finite
    components, take no part; rows of other dimensions aren't compared. An id that repeats is searched once for
    each distinct vector and may be found as often as it stands. Fewer candidates give fewer rows, none give none.
    """
    wide = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where("vec_id is not null").where(usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), wide.alias("v"), F.size("embedding").alias("d"), is_query.alias("asks")
    )
    rows = materialise(rows, "search_rows")
    centres = _centre(rows)
    # a query may find its own id, so one more is kept
    most = k + 1
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    distinct = rows.select("v", "d", "vec_id").withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= most)
    candidates = materialise(distinct.groupBy("v", "d").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "search_candidates")
    asked = materialise(rows.where("asks").select("d", "v").distinct().withColumn("q", F.xxhash64("v", F.lit(1))), "search_queries")
    n_queries, n_candidates = asked.count(), candidates.count()
    n_blocks, n_groups = max(1, -(-n_queries // QUERY_ROWS)), max(1, -(-n_candidates // CANDIDATE_ROWS))

    whole = F.sequence(F.lit(0), F.lit(n_blocks - 1))
    left = candidates.withColumn("g", F.pmod(F.xxhash64("v", F.lit(2)), F.lit(n_groups))).withColumn("b", F.explode(whole))
    right = asked.withColumn("b", F.pmod(F.xxhash64("v", F.lit(3)), F.lit(n_blocks)).cast("int"))
    right = right.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long"))))
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def cell(xs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out = {"v": [], "score": [], "vec_id": []}
        if len(xs) and len(qs):
            d = int(xs["d"].iloc[0])
            vs, queries = np.stack(xs["v"].to_numpy()), np.stack(qs["v"].to_numpy())
            ids = xs["ids"].to_numpy()
            for i, near, dist in nearest(queries, vs, most, shared.value[d], rotation_of(d)):
                best = np.argsort(dist, kind="stable")
                cut = dist[best[min(most, len(best)) - 1]]
                found = sorted((x, int(y)) for x, p in zip(dist, near) if x <= cut for y in ids[p])[:most]
                out["v"] += [queries[i]] * len(found)
                out["score"] += [x for x, _ in found]
                out["vec_id"] += [y for _, y in found]
        return pd.DataFrame(out)

    found = left.groupBy("d", "b", "g").cogroup(right.groupBy("d", "b", "g")).applyInPandas(cell, "v array<double>, score double, vec_id long")
    by_query = Window.partitionBy("v").orderBy("score", "vec_id")
    best = found.withColumn("n", F.row_number().over(by_query)).where(F.col("n") <= most).select("v", "score", "vec_id")
    # a query vector that many rows ask for has its few results once
    lists = best.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("found"))
    queries = rows.where("asks").select(F.col("vec_id").alias("query_id"), "v").distinct()
    others = F.slice(F.filter("found", lambda x: x.vec_id != F.col("query_id")), 1, k)
    return queries.join(lists, "v").select("query_id", F.posexplode(others).alias("n", "x")).select(
        "query_id", (F.col("n") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )
