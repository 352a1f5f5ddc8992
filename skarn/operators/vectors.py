"""Exact nearest neighbours of a query set, similarity against concept vectors, threshold sweeps, fusion of distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Bytes of query vectors that one task holds; more queries are dealt to more tasks.
PASS_BYTES = 64_000_000


def _matrix(a: pa.Array, dim: int) -> np.ndarray:
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


class _Nearest:
    """The k nearest so far of a block of queries."""

    def __init__(self, ids: np.ndarray, groups: np.ndarray, qs: np.ndarray, k: int, metric: str):
        self.ids, self.groups, self.qs, self.k, self.metric = ids, groups, qs, k, metric
        self.norms = np.linalg.norm(qs, axis=1)
        self.d, self.i = np.full((len(ids), k), np.inf), np.full((len(ids), k), -1, np.int64)

    def see(self, ids: np.ndarray, groups: np.ndarray, x: np.ndarray) -> None:
        for a in range(0, len(ids), 2048):
            xi, idi = x[a : a + 2048], ids[a : a + 2048]
            if self.metric == "cosine":
                with np.errstate(divide="ignore", invalid="ignore"):
                    d = -np.round((self.qs @ xi.T) / (self.norms[:, None] * np.linalg.norm(xi, axis=1)[None, :]), 6)
                d[~np.isfinite(d)] = np.inf
            else:
                d = np.round(np.sqrt(np.maximum(0, (self.norms**2)[:, None] + (xi**2).sum(1)[None, :] - 2 * self.qs @ xi.T)), 6)
            d[self.ids[:, None] == idi[None, :]] = np.inf
            d[self.groups[:, None] != groups[a : a + 2048][None, :]] = np.inf
            both_d, both_i = np.concatenate([self.d, d], 1), np.concatenate([self.i, np.broadcast_to(idi, d.shape)], 1)
            order = np.lexsort((both_i, both_d), axis=1)[:, : self.k]
            self.d, self.i = np.take_along_axis(both_d, order, 1), np.take_along_axis(both_i, order, 1)

    def rows(self) -> pa.RecordBatch:
        r, c = np.nonzero(np.isfinite(self.d))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[r]), pa.array(self.i[r, c]), pa.array(self.d[r, c])], names=["query", "neighbour", "d"])


def exact_knn(data: DataFrame, id_col: str, vector: str, queries: Column, k: int, dim: int, metric: str = "euclidean", group: str | None = None) -> DataFrame:
    """``query, rank, neighbour, distance`` of the rows for which ``queries`` holds, against all other rows.

    Distances (or cosines) are rounded to 6 decimals, ties go to the smaller id; with ``group`` only rows of the same group count. Null
    vectors, vectors of another length than ``dim`` and ones with null items take no part.

    The queries are dealt to blocks that fit into a task, the rows to as many splits as keep all cores busy; a task reads
    the queries of its block, then streams its split of the rows past them and keeps k per query. Nothing passes
    through the driver; of a query as many lists are merged as there are splits, not as there are tasks.
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = data.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"), (F.col(group) if group else F.lit(0)).cast("string").alias("g"), queries.alias("q"))
    rows = rows.where((F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull()))
    n = rows.where("q").count()
    blocks = max(1, -(-n * dim * 8 // PASS_BYTES))
    splits = max(1, -(-data.sparkSession.sparkContext.defaultParallelism // blocks))
    asked = rows.where("q").select("id", "v", "g", F.lit(0).alias("turn"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"))
    seen = rows.select("id", "v", "g", F.lit(1).alias("turn"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(splits)).cast("int").alias("split"))
    dealt = asked.unionByName(seen).repartition(blocks * splits, "block", "split").sortWithinPartitions("block", "split", "turn")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, best = None, [], None
        for b in batches:
            ids, x, turn, block, split = b.column(0).to_numpy(), _matrix(b.column(1), dim), *(b.column(c).to_numpy() for c in (3, 4, 5))
            groups = np.array(b.column(2).to_pylist(), dtype=object)
            where = np.stack([block, split, turn], 1)
            starts = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]).any(1)]) if len(where) else []
            for a, e in zip(starts, [*starts[1:], len(ids)], strict=True):
                if (own := (int(block[a]), int(split[a]))) != key:
                    if best is not None:
                        yield best.rows()
                    key, held, best = own, [], None
                part = (ids[a:e], groups[a:e], x[a:e])
                if turn[a] == 0:
                    held.append(part)
                elif held or best is not None:
                    if best is None:
                        best, held = _Nearest(*(np.concatenate(c) for c in zip(*held, strict=True)), k, metric), []
                    best.see(*part)
        if best is not None:
            yield best.rows()

    out = dealt.mapInArrow(near, "query bigint, neighbour bigint, d double")
    ranked = out.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("d", "neighbour"))).where(F.col("rank") <= k)
    return ranked.select("query", "rank", "neighbour", (F.abs("d") if metric != "cosine" else -F.col("d")).alias("distance"))


def fuse(near: DataFrame, group: str, how: str, factor: float = 0.5) -> DataFrame:
    """Distances to one neighbour from several parts of a query as one: ``min``, ``shrink`` (times ``factor`` per further hit) or ``average``."""
    d = {"min": F.min("distance"), "shrink": F.min("distance") * F.pow(F.lit(factor), F.count(F.lit(1)) - 1), "average": F.avg("distance")}[how]
    return near.groupBy(group, "neighbour").agg(F.round(d, 6).alias("distance"))


def sweep(sims: DataFrame, label: str, truth: str, sim: str, taus: list[float]) -> DataFrame:
    """Macro F1 of ``sim > tau`` for every threshold, from one aggregate over the similarities: ``tau, f1``."""
    mine = F.col(label) == F.col(truth)
    cols = []
    for i, t in enumerate(taus):
        up = F.col(sim) > F.lit(t)
        cols += [F.count_if(up & mine).alias(f"tp{i}"), F.count_if(up & ~mine).alias(f"fp{i}"), F.count_if(~up & mine).alias(f"fn{i}")]
    per = sims.groupBy(label).agg(*cols)

    def f1(i: int) -> Column:
        den = 2 * F.col(f"tp{i}") + F.col(f"fp{i}") + F.col(f"fn{i}")
        return F.when(den == 0, F.lit(0.0)).otherwise(2 * F.col(f"tp{i}") / den)

    items = F.array(*[F.struct(F.lit(t).alias("tau"), f1(i).alias("f1")) for i, t in enumerate(taus)])
    return per.select(F.inline(items)).groupBy("tau").agg(F.round(F.avg("f1"), 6).alias("f1"))
