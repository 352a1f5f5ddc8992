"""A sample that matches target proportions: raking, weighted exponential keys, repaired minimums.

1. Weights are raked by iterative proportional fitting over the cells of three category margins: the category with its
   targets, and the band of text length and whether a row has further labels, both as they are in the pool. The cells are a small table,
   whatever the number of rows.
2. Every row gets the exponential key ``-ln(u)/w``, u from a hash of its id, w its cell's weight shared among the cell's rows. The
   rows with the smallest keys of all are the weighted sample; a category's rows among them are what the keys gave it.
3. Minimums are repaired: a category below its need takes its next smallest keys, categories above theirs give
   their largest keys back. Within a category rows of different cells keep their different weights.
4. The residual gaps of the rows drawn are reported; a category with a gap falls short.

Keys are cut in two steps (counts of keys in buckets of a 256th of an octave, then ranks inside the one bucket that the cut falls
in), so no task ever sorts a whole category, even where one holds most rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skarn.llm.burst import SPACE
from skarn.runtime import checkpointed, need

#: Key buckets per octave; the ranked bucket holds about 0.3 % of what is drawn from a category.
PER_OCTAVE = 256
#: Most target categories; their cells are fitted on the driver. More raise an error.
MAX_TARGETS = 100_000


def first_category(labels: Column, none: str = "NO_TTP") -> Column:
    """The first item that isn't null or blank, trimmed and upper-cased; ``none`` if there is none; null for a null array."""
    kept = F.filter(F.transform(labels, lambda x: F.upper(F.regexp_replace(x, f"^{SPACE}|{SPACE}$", ""))), lambda x: x.isNotNull() & (x != ""))
    return F.when(labels.isNotNull(), F.coalesce(F.get(kept, 0), F.lit(none)))


def is_blank(c: Column) -> Column:
    """Null, empty or only whitespace."""
    return c.isNull() | (F.regexp_replace(c, SPACE, "") == "")


def length_band(text: Column) -> Column:
    """The second margin: short (0), middle (1) and long (2) texts, in characters."""
    n = F.length(text)
    return F.when(n < 120, 0).when(n < 200, 1).otherwise(2)


def distinct_pool(df: DataFrame, id_col: str, text: str, labels: str, none: str = "NO_TTP") -> DataFrame:
    """One row per category and different text: ``category, h1, h2, row_id, band, several``; the smallest id stands for its copies.

    Rows whose labels are null, whose text is null or blank or that have no id are unusable and dropped; texts are told
    apart exactly, by 128 bits. ``several``: 1 if some copy has more items than its category.
    """
    need(df, id_col, text, labels)
    more = F.size(F.filter(labels, lambda x: x.isNotNull() & ~is_blank(x))) > 1
    rows = df.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text).alias("text"), first_category(F.col(labels), none).alias("category"), more.cast("int").alias("several"))
    rows = rows.where(F.col("category").isNotNull() & ~is_blank(F.col("text")) & F.col("row_id").isNotNull())
    rows = rows.select("category", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "row_id", length_band(F.col("text")).alias("band"), "several")
    return rows.groupBy("category", "h1", "h2").agg(F.min("row_id").alias("row_id"), F.min("band").alias("band"), F.max("several").alias("several"))


def rake(available: Mapping[tuple, int], margins: list[Mapping], rounds: int = 100, tol: float = 1e-9) -> dict[tuple, float]:
    """Iterative proportional fitting of cell weights to the targets of each margin.

    ``available``: rows by cell (a tuple with one value per margin); ``margins``: target share by value. Values
    without a target get no weight; targets without rows are left out and the rest is scaled. Weights sum to 1.
    """
    cells = [c for c, n in available.items() if n > 0 and all(m.get(v, 0) > 0 for v, m in zip(c, margins, strict=True))]
    if not cells:
        return {}
    w = np.array([float(available[c]) for c in cells])
    w /= w.sum()
    axes = []
    for k, m in enumerate(margins):
        values = sorted({c[k] for c in cells}, key=str)
        place = {v: i for i, v in enumerate(values)}
        t = np.array([m[v] for v in values])
        axes.append((np.array([place[c[k]] for c in cells]), t / t.sum()))
    for _ in range(rounds):
        off = 0.0
        for idx, t in axes:
            have = np.bincount(idx, w, len(t))
            off = max(off, float(np.abs(have - t).max()))
            w *= (t / np.maximum(have, 1e-300))[idx]
        if off < tol:
            break
    w /= w.sum()
    return dict(zip(cells, w.tolist(), strict=True))


def repaired(drawn: np.ndarray, available: np.ndarray, minimum: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """Rows per category after the repair of ``drawn``: at least the minimums where there are so many rows, ``size`` in all where that can be.

    What is drawn beyond the size is taken back from what categories have above their minimums, in proportion to it; what lacks
    is added by weight where rows are left. Minimums go before the size.
    """
    floor = np.minimum(available, minimum)
    q = np.maximum(np.minimum(drawn, available), floor)
    over = int(q.sum()) - size
    if over > 0:
        q = q - _dealt(min(over, int((q - floor).sum())), (q - floor).astype(float), q - floor)
    elif over < 0:
        q = q + _dealt(min(-over, int((available - q).sum())), weight, available - q)
    return q


def _dealt(n: int, weight: np.ndarray, most: np.ndarray) -> np.ndarray:
    """``n`` whole rows in proportion to the weights, at most ``most`` each (whose sum is at least n); rest rows by largest remainders."""
    out = np.zeros(len(most), np.int64)
    while n > 0:
        open_ = out < most
        w = np.where(open_, weight, 0.0)
        w = w if w.sum() > 0 else open_.astype(float)
        share = n * w / w.sum()
        add = np.minimum(np.floor(share).astype(np.int64), most - out)
        if not add.any():
            first = np.lexsort((np.arange(len(w)), -share))
            add[first[open_[first]][:n]] = 1
        out += add
        n -= int(add.sum())
    return out


def _log_key(w: Column, seed: int) -> Column:
    """The binary logarithm of the exponential key of a row, from its id and weight."""
    u = (F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.log2(-F.log(u)) - F.log2(w)


class ProportionalSample:
    """The sample and its report.

    ``rows``: ``row_id, category, band, several, weight`` of ``fraction`` of the rows of the table: different texts within a
    category only, shares as in ``targets`` (``category, target_share, min_rows``, a row per category). A category needs
    the greater of ``min_rows`` and ``target_share * fraction * rows``, not rounded, and gets the next whole number where it has as many texts; the
    sample may so be larger than the fraction by less than a row per category and the minimums. Unusable rows count in the size but
    aren't drawn; categories without a target aren't drawn. ``report``: ``category, target_share, min_rows, needed, available, raked``
    (fitted share), ``keyed`` (rows by the keys alone), ``drawn, lacking`` (need minus rows drawn, at least 0) and ``gap``
    (target share minus share of the sample). An empty table gives an empty sample, and every category lacks what its minimum asks for.
    """

    def __init__(self, df: DataFrame, targets: DataFrame, id_col: str, text: str, labels: str, fraction: float = 0.05, seed: int = 17, none: str = "NO_TTP"):
        spark = df.sparkSession
        asked = targets.select("category", F.col("target_share").cast("double"), F.col("min_rows").cast("bigint")).take(MAX_TARGETS + 1)
        if len(asked) > MAX_TARGETS:
            raise ValueError(f"more than {MAX_TARGETS} target categories")
        self._df, self._columns, self._none, self._seed = df, (id_col, text, labels), none, seed
        n = df.count()
        names = [r["category"] for r in asked]
        share = {r["category"]: r["target_share"] or 0.0 for r in asked}
        needed = {r["category"]: max(float(r["min_rows"] or 0), share[r["category"]] * fraction * n) for r in asked}
        known = spark.createDataFrame([(c,) for c in names], "category string")
        pool = checkpointed(distinct_pool(df, id_col, text, labels, none).join(F.broadcast(known), "category"))
        cell = ["category", "band", "several"]
        # At most six cells per target.
        cells = {(r["category"], r["band"], r["several"]): r["n"] for r in pool.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).collect()}
        margins: list[dict] = [share, {}, {}]
        for c, k in cells.items():
            for i in (1, 2):
                margins[i][c[i]] = margins[i].get(c[i], 0) + k
        fitted = rake(cells, margins)
        least = min((w / cells[c] for c, w in fitted.items() if w > 0), default=1.0) * 1e-6
        weights = {c: max(fitted.get(c, 0.0) / k, least) for c, k in cells.items()}
        schema = "category string, band int, several int, weight double"
        keyed = pool.join(F.broadcast(spark.createDataFrame([(*c, w) for c, w in weights.items()], schema)), cell)
        keyed = keyed.withColumn("_log", _log_key(F.col("weight"), seed)).withColumn("_bucket", F.floor(F.col("_log") * PER_OCTAVE).cast("int"))
        counts = checkpointed(keyed.groupBy("category", "_bucket").agg(F.count(F.lit(1)).alias("n")))
        # The keys span some hundred octaves at most, so this table is small; the common cut lies between two buckets.
        by_bucket = np.array([tuple(r) for r in counts.groupBy("_bucket").agg(F.sum("n")).orderBy("_bucket").collect()], np.int64).reshape(-1, 2)
        size = round(n * fraction)
        below = by_bucket[np.cumsum(by_bucket[:, 1]) <= size, 0]
        under = F.sum(F.when(F.col("_bucket") <= int(below[-1]) if len(below) else F.lit(False), F.col("n")).otherwise(0))
        first = {r["category"]: (r["a"], r["b"]) for r in counts.groupBy("category").agg(F.sum("n").alias("a"), under.alias("b")).collect()}
        available, by_keys = (np.array([first.get(c, (0, 0))[i] for c in names], np.int64) for i in (0, 1))
        raked: dict[str, float] = {}
        for c, w in fitted.items():
            raked[c[0]] = raked.get(c[0], 0.0) + w
        quota = repaired(by_keys, available, np.array([math.ceil(needed[c]) for c in names], np.int64), np.array([raked.get(c, 0.0) for c in names]), size)
        plan = spark.createDataFrame([(c, int(q)) for c, q in zip(names, quota, strict=True) if q > 0], "category string, _n bigint")
        # The bucket that each category's cut falls in, a row per category.
        before = F.coalesce(F.sum("n").over(W.partitionBy("category").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        cut = counts.join(F.broadcast(plan), "category").withColumn("_before", before).where("_before < _n AND _before + n >= _n")
        self._cut = cut.select("category", F.col("_bucket").alias("_cut"), (F.col("_n") - F.col("_before")).alias("_left"))
        self._best = spark.createDataFrame([(c, max((w for k, w in weights.items() if k[0] == c), default=least)) for c in sorted({k[0] for k in weights})], "category string, _most double")
        marked = keyed.join(F.broadcast(self._cut), "category")
        rank = F.row_number().over(W.partitionBy("category").orderBy("_log", "row_id"))
        edge = marked.where("_bucket = _cut").withColumn("_r", rank).where("_r <= _left").drop("_r")
        self.rows = marked.where("_bucket < _cut").unionByName(edge).select("row_id", *cell, "weight")
        known_rows = [(c, share[c], needed[c], int(a), raked.get(c, 0.0), int(b)) for c, a, b in zip(names, available, by_keys, strict=True)]
        base = spark.createDataFrame(known_rows, "category string, target_share double, needed double, available bigint, raked double, keyed bigint")
        drawn = self.rows.groupBy("category").agg(F.count(F.lit(1)).alias("drawn"))
        got = base.join(F.broadcast(drawn), "category", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
        total = F.greatest(F.sum("drawn").over(W.partitionBy()), F.lit(1))
        gap = F.col("target_share") - F.col("drawn") / total
        lacking = F.greatest(F.lit(0.0), F.col("needed") - F.col("drawn"))
        report = got.withColumns({"gap": gap, "lacking": lacking}).join(targets.select("category", "min_rows"), "category")
        self.report = report.select("category", "target_share", "min_rows", "needed", "available", "raked", "keyed", "drawn", "lacking", "gap")

    def texts(self) -> DataFrame:
        """The rows of the sample with their ``text``. Only rows whose own key can reach their category's cut are shuffled."""
        id_col, text, labels = self._columns
        own = self._df.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text).alias("text"), first_category(F.col(labels), self._none).alias("category"))
        near = own.join(F.broadcast(self._cut.join(self._best, "category")), "category")
        near = near.where(_log_key(F.col("_most"), self._seed) <= (F.col("_cut") + 1) / PER_OCTAVE + 1e-9)
        return self.rows.join(near.select("row_id", "text"), "row_id")
