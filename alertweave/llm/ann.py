"""Approximate nearest neighbours by a hash-prefix forest: sorted hash strings, descended to the longest common prefix and ascended in step."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertweave.llm.common import cut

TREES = 128
BITS = 32
#: Candidates a query takes from a shard: this part of its vectors, and at least so many.
SHARE = 0.25
LEAST = 256
SHARD = 16_384
QUERIES = 65_536
SEED = 7


class Forest:
    """Per tree the vectors' hash strings in order. Bit b of a string is the side of the tree's b-th random hyperplane."""

    def __init__(self, vectors: np.ndarray, centre: np.ndarray, trees: int = TREES, seed: int = SEED):
        self.vectors, self.centre = vectors, centre
        random = np.random.default_rng(seed)
        dim = vectors.shape[1]
        # Orthogonal directions in sets of at most `dim` cut a tree's bits more evenly than independent ones.
        self.planes = [np.concatenate([np.linalg.qr(random.standard_normal((dim, dim)))[0] for _ in range(-(-BITS // dim))], axis=1)[:, :BITS] for _ in range(trees)]
        self.order, self.sorted = [], []
        for planes in self.planes:
            strings = self._strings(vectors, planes)
            order = np.argsort(strings, kind="stable")
            self.order.append(order.astype(np.int32))
            self.sorted.append(strings[order])

    def _strings(self, vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
        side = ((vectors - self.centre) @ planes > 0).astype(np.uint64)
        return side @ (np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64))

    def candidates(self, queries: np.ndarray, wanted: int):
        """For each query the numbers of at least `wanted` vectors (all, if there are fewer): those whose string shares the
        longest prefix with the query's in any tree, one level less at a time in all trees together."""
        depth = np.arange(BITS + 1, dtype=np.uint64)
        low = np.empty((len(self.planes), len(queries), BITS + 1), np.int32)
        high = np.empty_like(low)
        for t, planes in enumerate(self.planes):
            own = self._strings(queries, planes)[:, None]
            free = np.uint64(BITS) - depth[None, :]
            first = own >> free << free
            low[t] = np.searchsorted(self.sorted[t], first)
            high[t] = np.searchsorted(self.sorted[t], first + (np.uint64(1) << free) - np.uint64(1), side="right")
        shared = (high - low).sum(axis=0)
        marks = np.zeros(len(self.vectors), bool)
        for q in range(len(queries)):
            # The deepest level that can hold enough; the same vectors in several trees may ask for further ones.
            level = int(np.flatnonzero(shared[q] >= min(wanted, shared[q, 0])).max())
            while True:
                marks[:] = False
                for t, order in enumerate(self.order):
                    marks[order[low[t, q, level] : high[t, q, level]]] = True
                found = np.flatnonzero(marks)
                if len(found) >= wanted or level == 0:
                    break
                level -= 1
            yield found


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors as doubles. Left out are null ids, vectors that are null, empty, zero or hold null or non-finite parts, and those of another length than most (the shorter of equally many)."""
    v = F.col("embedding").cast("array<double>")
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull()
        & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    )
    usual = fine.groupBy(F.size("v").alias("_dim")).count().orderBy(F.desc("count"), "_dim").limit(1).collect()
    return fine.where(F.size("v") == (usual[0]["_dim"] if usual else 0)).distinct()


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, trees: int = TREES, share: float = SHARE, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible by `every` its k nearest found, by Euclidean distance.

    Every usable vector is indexed: they are dealt into shards, each with a forest of its own, and each shard answers the
    queries in blocks with its k nearest candidates, measured in double precision on the original vectors; the k best of all
    shards stay. Ties go to the smaller id; a query's own id is no candidate; an id with several vectors is as near as the nearest of them;
    fewer candidates than k give fewer rows, and an empty table none. Other columns are not read.

    Vectors may repeat in any number, since a shard is dealt by id. The forest's planes and centre are fitted on nothing but
    a mean over all vectors. Memory is that of a shard and a block of queries.
    """
    stored = cut(usable(vectors)).withColumn("_id", F.xxhash64("vec_id"))
    rows, asked = stored.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).first()
    shards, blocks = max(1, -(-rows // shard)), max(1, -(-asked // block))
    dim = len(stored.select("v").first()["v"]) if rows else 0
    centre = np.array(stored.agg(*[F.avg(F.col("v")[i]).alias(f"x{i}") for i in range(dim)]).first()) if rows else np.zeros(0)
    place, line = F.pmod("_id", F.lit(shards)).cast("int"), F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    base = stored.select(place.alias("shard"), numbers(blocks).alias("block"), "vec_id", "v")
    queries = stored.where(F.col("vec_id") % every == 0).select(numbers(shards).alias("shard"), line.alias("block"), "vec_id", "v")

    def answer(key: tuple, own: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[np.ndarray] = []
        if own.num_rows and asking.num_rows:
            ids, who = own.column("vec_id").to_numpy(), asking.column("vec_id").to_numpy()
            data = own.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            points = asking.column("v").combine_chunks().flatten().to_numpy().reshape(len(who), -1)
            forest = Forest(data, centre, trees)
            wanted = max(LEAST, int(np.ceil(share * len(ids))))
            for start in range(0, len(who), 256):
                some = points[start : start + 256]
                for me, point, found in zip(who[start : start + 256], some, forest.candidates(some, wanted + 1), strict=True):
                    found = found[ids[found] != me]
                    score = np.sqrt(((data[found] - point) ** 2).sum(axis=1))
                    best = np.lexsort((ids[found], score))[:k]
                    out.append(np.stack([np.full(len(best), me), ids[found[best]], score[best].view(np.int64)]))
        all_ = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
        return pa.table({"query_id": all_[0], "vec_id": all_[1], "score": np.ascontiguousarray(all_[2]).view(np.float64)})

    found = base.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(answer, "query_id long, vec_id long, score double")
    each = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(ids: np.ndarray, data: np.ndarray, every: int = 100, k: int = 10) -> pd.DataFrame:
    """nearest() by comparing everything, for tests and to measure recall."""
    rows = []
    for q in np.flatnonzero(ids % every == 0):
        score = np.sqrt(((data - data[q]) ** 2).sum(axis=1))
        others = np.flatnonzero(ids != ids[q])
        best = others[np.lexsort((ids[others], score[others]))][:k]
        rows += [(ids[q], rank, ids[b], score[b]) for rank, b in enumerate(best, 1)]
    return pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score"])
