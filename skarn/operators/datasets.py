"""Building datasets: merging, grouping, splitting, sampling, running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skarn.runtime import checkpointed


def first_of(df: DataFrame, key: str, order: str, *keep: str) -> DataFrame:
    """The first row of each key by ``order``; a partial aggregate instead of a window, so hot keys don't hurt."""
    cols = [order, *keep]
    return df.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("_x")).select(key, "_x.*")


def merge_sentences(df: DataFrame, sentence: str, order: str, labels: str, entities: str, document: str) -> DataFrame:
    """Rows with an equal sentence as one: all labels, all entity pairs, the document that came first.

    Labels and pairs are made distinct before they are collected, so a line that recurs everywhere stays small.
    """
    lab = df.select(sentence, F.explode(labels).alias("x")).distinct().groupBy(sentence).agg(F.array_sort(F.collect_set("x")).alias("labels"))
    ent = df.select(sentence, F.explode(entities).alias("x")).distinct().groupBy(sentence).agg(F.array_sort(F.collect_set("x")).alias("entities"))
    base = df.groupBy(sentence).agg(F.min_by(document, order).alias("document"), F.count(F.lit(1)).alias("rows"))
    none = F.array()
    out = base.join(lab, sentence, "left").join(ent, sentence, "left")
    return out.withColumns({"labels": F.coalesce("labels", none.cast("array<string>")), "entities": F.coalesce("entities", none.cast(dict(ent.dtypes)["entities"]))})


def assemble(df: DataFrame, doc: str, order: str, sentence: str, labels: str) -> DataFrame:
    """``doc, sentences, labels``: parallel arrays in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, sentence, labels)))
    x = df.groupBy(doc).agg(rows.alias("_r"))
    return x.select(doc, F.transform("_r", lambda r: r[sentence]).alias("sentences"), F.transform("_r", lambda r: r[labels]).alias("labels"))


def explode_parallel(df: DataFrame, doc: str, sentences: str, labels: str) -> DataFrame:
    """Parallel arrays as one row per sentence: ``doc, pos, sentence, labels``."""
    return df.select(doc, F.posexplode(F.arrays_zip(F.col(sentences).alias("s"), F.col(labels).alias("l"))).alias("pos", "x")).select(doc, "pos", F.col("x.s").alias("sentence"), F.col("x.l").alias("labels"))


def spread(id_col: Column, buckets: int, factor: int = 48271, modulus: int = 2147483647) -> Column:
    """A reproducible bucket of an integer id, the same in any engine."""
    return ((id_col * factor) % modulus) % buckets


def sample_per_label(df: DataFrame, label: str, id_col: str, count: int) -> DataFrame:
    """At most ``count`` rows per label, by spread id; labels with fewer keep all.

    Two steps: the first picks within (label, part), so no label is one task.
    """
    key = [spread(F.col(id_col), 2147483647), F.col(id_col)]
    part = F.pmod(F.xxhash64(id_col), F.lit(32))
    some = df.withColumn("_p", part).withColumn("_r", F.row_number().over(W.partitionBy(label, "_p").orderBy(*key))).where(F.col("_r") <= count)
    return some.withColumn("_r", F.row_number().over(W.partitionBy(label).orderBy(*key))).where(F.col("_r") <= count).drop("_p", "_r")


def running_mean(df: DataFrame, order: str, value: str, width: int = 1000) -> DataFrame:
    """The mean of all values up to each row, in order of an integer column.

    Sums of ranges of ``width`` come first; only they pass through one window, each row adds what its own range holds.
    """
    part = F.floor(F.col(order) / width)
    rows = df.select(order, value, part.alias("_b"))
    sums = rows.groupBy("_b").agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    up = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("_b", F.coalesce(F.sum("_s").over(up), F.lit(0.0)).alias("_s0"), F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_n0"))
    inside = W.partitionBy("_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.join(before, "_b").select(order, value, ((F.col("_s0") + F.sum(value).over(inside)) / (F.col("_n0") + F.count(value).over(inside))).alias("running_mean"))


def positions(df: DataFrame, group: str, order: str, width: int = 1000, name: str = "pos") -> DataFrame:
    """``df`` with the position of each row in its group, from 0, by an integer column whose values differ within a group.

    Ranges of ``width`` values are counted first, so only the counts of a group pass through one window; null groups are a group.
    """
    rows = df.withColumn("_b", F.floor(F.col(order) / width))
    counts = rows.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    up = W.partitionBy(group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select(F.col(group).alias("_g"), F.col("_b").alias("_r"), F.coalesce(F.sum("_c").over(up), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(group, "_b").orderBy(order)) - 1
    ranked = rows.withColumn("_in", inside).join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_r")))
    return ranked.withColumn(name, (F.col("_before") + F.col("_in")).cast("int")).drop("_b", "_g", "_r", "_before", "_in")


def numbered(df: DataFrame, order: str, name: str = "idx") -> DataFrame:
    """``df`` with the place of each row in the order of a column, from 0: ranges are sorted apart, and their sizes added up."""
    spark = df.sparkSession
    rows = checkpointed(df.repartitionByRange(order).sortWithinPartitions(order))
    marked = rows.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = sorted(tuple(r) for r in marked.groupBy("_p").agg(F.count(F.lit(1))).collect())  # a row per partition
    first, total = [], 0
    for p, n in sizes:
        first.append((p, total))
        total += n
    starts = spark.createDataFrame(first, "_p int, _f bigint")
    return marked.join(F.broadcast(starts), "_p").withColumn(name, F.col("_f") + F.col("_m")).drop("_p", "_m", "_f")


def split_by_documents(df: DataFrame, doc: str, share: float, seed: int = 7) -> DataFrame:
    """Whole documents for a test split: in a seeded order while their rows stay within ``share`` of all (prefix rule)."""
    sizes = df.groupBy(doc).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    key = F.md5(F.concat(F.col(doc), F.lit(str(seed))))
    # The first three digits of the key make 4,096 parts; only their sums pass through one window.
    parts = sizes.withColumn("_k", key).withColumn("_b", F.substring("_k", 1, 3))
    sums = parts.groupBy(F.col("_b").alias("_r")).agg(F.sum("n").alias("_s"))
    before = sums.select("_r", F.coalesce(F.sum("_s").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    run = F.sum("n").over(W.partitionBy("_b").orderBy("_k", doc).rowsBetween(W.unboundedPreceding, 0))
    upto = parts.withColumn("_in", run).join(F.broadcast(before), F.col("_b").eqNullSafe(F.col("_r"))).withColumn("upto", F.col("_before") + F.col("_in"))
    return upto.crossJoin(F.broadcast(total)).select(doc, "n", F.when(F.col("upto") <= F.col("total") * share, "test").otherwise("train").alias("split"))


def greedy_split(sizes: list[tuple[str, int]], share: float) -> set[str]:
    """Documents taken in the given order, skipping those that would exceed the share."""
    limit, taken, out = share * sum(n for _, n in sizes), 0, set()
    for d, n in sizes:
        if taken + n <= limit:
            taken += n
            out.add(d)
    return out
