"""Nearest neighbours by collision counting on single projections.

Vectors are dealt into blocks.  A block keeps, for each of m random projections, its vectors sorted by projected value.  A query opens a
window around its own projected value in every array; a vector in the window has collided.  Windows widen together by virtual
rehashing (radius R, times ``GROWTH`` each round, width W x R), and a vector whose collisions reach the threshold is verified:
its exact distance is computed on the original vector, in double precision.  A query stops in a block once its k-th
distance is at most R (after k vectors are verified, R goes to the k-th distance): a vector within R then has been verified except
with probability below 0.001.  There is no cap on
candidates; where windows cover a whole block, the search is exact.  The k best of all blocks are merged.

Takes no part: rows without an id, null vectors, null or non-finite components, zero vectors.  Queries are compared with vectors of their
own dimension.  A query never meets rows with its own id.  Rows that repeat an id and a vector are one row; an id with different vectors has a candidate for
each, and as a query asks with the smallest of them (component by component, those of fewer first).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

PROJECTIONS = 64
WIDTH = 2.72  # window of radius 1: 83 % of the projections of a vector at distance 1 fall inside
COLLISIONS = 42  # of 64; a vector within R collides 53 times on average
GROWTH = 2.0
SEED = 20150831
BLOCK = 32_768  # vectors of a block, fewer if they have many components
BLOCK_VALUES = 4_000_000  # components of a block
QUERY_BLOCK = 2_048


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>, d) of the rows that take part."""
    v = F.col(embedding).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & good).withColumn(
        "d", F.size("v"))


class Block:
    """Sorted projection arrays of some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.directions = np.random.default_rng(SEED).standard_normal((PROJECTIONS, vectors.shape[1]))
        values = self.directions @ vectors.T
        self.order = np.argsort(values, axis=1, kind="stable")
        self.sorted = np.take_along_axis(values, self.order, axis=1)

    def nearest(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, distances, numbers in the block) of the k nearest found, nearest first."""
        n = len(self.ids)
        at = self.directions @ q
        low = np.array([s.searchsorted(x) for s, x in zip(self.sorted, at)])
        high = low.copy()
        # first radius: in half of the arrays the window holds a 64th of the values, or k
        some = min(n, max(k, n // 64))
        near = [np.abs(s[max(0, i - some):i + some] - x) for s, x, i in zip(self.sorted, at, low)]
        reach = [np.partition(d, some - 1)[some - 1] for d in near]
        radius = max(float(np.median(reach)) * 2 / WIDTH, 1e-12)
        count = np.zeros(n, np.int16)
        seen = np.zeros(n, bool)
        own = self.ids == query_id
        places, distances = [np.zeros(0, np.int64)], [np.zeros(0)]
        found = 0
        while True:
            half = WIDTH * radius / 2
            fresh = []
            for i, (s, x) in enumerate(zip(self.sorted, at)):
                a, b = s.searchsorted(x - half, "left"), s.searchsorted(x + half, "right")
                if a < low[i]:
                    fresh.append(self.order[i, a:low[i]])
                    low[i] = a
                if b > high[i]:
                    fresh.append(self.order[i, high[i]:b])
                    high[i] = b
            if fresh:
                count += np.bincount(np.concatenate(fresh), minlength=n).astype(np.int16)
                new = np.flatnonzero((count >= COLLISIONS) & ~seen)
                seen[new] = True
                new = new[~own[new]]
                places.append(new)
                distances.append(np.sqrt(((self.vectors[new] - q) ** 2).sum(axis=1)))
                found += len(new)
            whole = (low == 0).all() and (high == n).all()
            worst = np.partition(np.concatenate(distances), k - 1)[k - 1] if found >= k else np.inf
            if whole or worst <= radius:
                break
            radius = radius * GROWTH if found < k else worst  # with k verified, the last round opens windows for the k-th distance
        place, distance = np.concatenate(places), np.concatenate(distances)
        best = np.lexsort((self.ids[place], distance))[:k]
        return self.ids[place[best]], distance[best], place[best]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries`` among ``vectors`` (both as ``usable`` gives them)."""
    vectors = vectors.groupBy("vec_id", "d", "v").agg(F.lit(1).alias("one")).drop("one")
    first = queries.groupBy("vec_id").agg(F.min(F.struct("d", "v")).alias("q"))
    queries = first.select("vec_id", "q.v", "q.d")
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d")).first()
    block = max(1, min(block, BLOCK_VALUES // (size["d"] or 1)))
    blocks, query_blocks = max(1, -(-size["n"] // block)), max(1, -(-queries.count() // query_block))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.withColumn("b", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("qb", spread(query_blocks))
    right = queries.withColumn("qb", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(query_blocks)).cast("int")).withColumn("b", spread(blocks))

    def inside(base: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(base) and len(asked):
            index = Block(base["vec_id"].to_numpy(np.int64), np.stack(base["v"].to_numpy()))
            for query_id, q in zip(asked["vec_id"], asked["v"]):
                ids, distances, _ = index.nearest(query_id, np.asarray(q), k)
                out["query_id"] += [query_id] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += distances.tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = left.groupBy("d", "b", "qb").cogroup(right.groupBy("d", "b", "qb")).applyInPandas(inside, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


__all__ = ["Block", "search", "usable"]
