"""Filling fixed-capacity containers by harmonic packing.

Lengths are partitioned into reciprocal-capacity classes: class k holds the lengths in (capacity / (k + 1), capacity / k]. It is cut
finer where k is small, into intervals of at most a 128th of their lengths, so that the room of its bins is known. A bin of
an interval of class k takes exactly k of its items; the room that is left for sure takes a fixed number of items
of the intervals that fit, largest first (as super-harmonic packing does; plain harmonic bins leave it unused).
How many bins of each kind there are follows from the counts of the intervals, a table of bounded size whatever the
number of items and the capacity. Workers then fill the bins independently: an item's rank in its interval says its bin. Only the
items that don't make up a bin of their own class, fewer than k per interval, are merged into the last open bins.
Pieces as long as a container need no rank; each is a container.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skarn.runtime import checkpointed, need

#: Lengths up to this are intervals of their own; longer ones are rounded up by less than this fraction of them.
FINE = 128
#: Items of one interval that one task ranks, about.
RANKED = 50_000

Kind = list[tuple[int, int]]


def interval(n: Column, capacity: int) -> Column:
    """The upper end of the interval of a length: a multiple of a power of two, or the upper end of its reciprocal class."""
    width = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(n, F.lit(FINE)) / FINE)))
    return F.least(F.ceil(n / width) * width, F.floor(F.lit(capacity) / F.floor(F.lit(capacity) / n))).cast("int")


def _fill(left: Mapping[int, int], lengths: list[int], room: int) -> Kind:
    """Fixed numbers of the intervals that fit into a room, largest first."""
    kind, at = [], len(lengths)
    while room > 0 and (at := bisect_right(lengths, room, 0, at)) > 0:
        n = lengths[at - 1]
        k = min(room // n, left[n])
        kind.append((n, k))
        room -= n * k
        at -= 1
    return kind


def harmonic_plan(counts: Mapping[int, int], capacity: int) -> list[tuple[int, Kind]]:
    """Kinds of bins as ``(number of bins, [(interval, items per bin), ...])``; they use up all counts."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n > capacity or n < 1 for n in left):
        raise ValueError("lengths must be between 1 and the capacity")
    lengths = sorted(left)
    plan: list[tuple[int, Kind]] = []

    def use(kind: Kind, times: int) -> None:
        plan.append((times, kind))
        for n, k in kind:
            left[n] -= times * k
            if not left[n]:
                del left[n]
                lengths.pop(bisect_right(lengths, n) - 1)

    for n in sorted(left, reverse=True):
        k = capacity // n
        while left.get(n, 0) >= k:
            smaller = lengths[: bisect_right(lengths, n) - 1]
            kind = [(n, k), *_fill(left, smaller, capacity - n * k)]
            use(kind, min(left[m] // j for m, j in kind))
    while lengths:  # the last open bins
        kind = _fill(left, lengths, capacity)
        use(kind, min(left[m] // j for m, j in kind))
    return plan


def split_items(items: DataFrame, id_col: str, size: str, capacity: int) -> DataFrame:
    """``id_col, piece_no, first_token, n_tokens``: an item above the capacity is cut into full pieces and a rest; items without size are dropped."""
    n = F.col(size)
    return items.where(n > 0).select(F.col(id_col), n.alias("_n"), F.posexplode(F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(capacity).cast("bigint"))).alias("piece_no", "first_token")).select(
        id_col, "piece_no", "first_token", F.least(F.lit(capacity), F.col("_n") - F.col("first_token")).cast("int").alias("n_tokens")
    )


def pack(items: DataFrame, id_col: str, size: str, capacity: int) -> DataFrame:
    """Containers ``container_id, doc_ids, pieces, fill`` of all items with a size above 0.

    ``pieces`` lists ``(id, piece_no, first_token, n_tokens)``; an item is cut only if it alone exceeds the capacity.
    Null and zero sizes have no place. Rows with the same id are items each. An empty table gives no containers.
    """
    need(items, id_col, size)
    spark = items.sparkSession
    cut = checkpointed(split_items(items, id_col, size, capacity))
    part = cut.where(F.col("n_tokens") < capacity).withColumn("_class", interval(F.col("n_tokens"), capacity))
    # A row per interval: at most FINE for every doubling of the capacity.
    total = {r["_class"]: r["c"] for r in part.groupBy("_class").agg(F.count(F.lit(1)).alias("c")).collect()}
    salts = spark.createDataFrame([(n, -(-c // RANKED)) for n, c in total.items()], "_class int, _salts int")
    dealt = part.join(F.broadcast(salts), "_class").withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece_no"), "_salts").cast("int"))
    # A row per interval and RANKED items.
    counts = sorted(tuple(r) for r in dealt.groupBy("_class", "_salt").agg(F.count(F.lit(1))).collect())
    offset: dict[tuple[int, int], int] = {}
    seen: dict[int, int] = {}
    for n, salt, c in counts:
        offset[n, salt] = seen.get(n, 0)
        seen[n] = offset[n, salt] + c
    ends: dict[int, list[int]] = {}
    per: dict[int, list[int]] = {}
    base: dict[int, list[int]] = {}
    first_bin = 0
    for times, kind in harmonic_plan(total, capacity):
        for n, k in kind:
            ends.setdefault(n, []).append((ends[n][-1] if n in ends and ends[n] else 0) + times * k)
            per.setdefault(n, []).append(k)
            base.setdefault(n, []).append(first_bin)
        first_bin += times
    sent = spark.sparkContext.broadcast((offset, {n: (np.array(ends[n]), np.array(per[n]), np.array(base[n])) for n in ends}))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offset, plan = sent.value
        for b in batches:
            n, salt, rn = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("_class", "_salt", "_rn"))
            out = np.zeros(len(n), np.int64)
            for v, s in np.unique(np.stack([n, salt]), axis=1).T.tolist():
                own = (n == v) & (salt == s)
                rank = offset[v, s] + rn[own] - 1
                e, k, f = plan[v]
                i = np.searchsorted(e, rank, side="right")
                out[own] = f[i] + (rank - np.concatenate([[0], e])[i]) // k[i]
            yield pa.RecordBatch.from_arrays([pa.array(out), *(b.column(b.schema.get_field_index(c)) for c in (id_col, "piece_no", "first_token", "n_tokens"))], names=["container_id", id_col, "piece_no", "first_token", "n_tokens"])

    kind = dict(items.dtypes)[id_col]
    ranked = dealt.withColumn("_rn", F.row_number().over(W.partitionBy("_class", "_salt").orderBy(id_col, "piece_no")).cast("bigint"))
    placed = ranked.mapInArrow(place, f"container_id bigint, `{id_col}` {kind}, piece_no int, first_token bigint, n_tokens int")
    piece = F.struct(id_col, "piece_no", "first_token", "n_tokens")
    # A container holds at most `capacity` items.
    shared = placed.groupBy("container_id").agg(F.array_sort(F.collect_set(id_col)).alias("doc_ids"), F.array_sort(F.collect_list(piece)).alias("pieces"), F.sum("n_tokens").cast("int").alias("fill"))
    # The written rows keep their places, so their numbers are the same whenever a task runs again.
    own = cut.where(F.col("n_tokens") == capacity).select((F.monotonically_increasing_id() + first_bin).alias("container_id"), F.array(id_col).alias("doc_ids"), F.array(piece).alias("pieces"), F.lit(capacity).alias("fill"))
    return shared.unionByName(own)
