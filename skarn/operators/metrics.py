"""Scores of predicted label sets: per document, per label, over label sets; span and token scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions import sets as st


def row_confusion(true: Column, pred: Column) -> dict[str, Column]:
    """tp, fp and fn of one row: hits and misses weigh as often as they were predicted, what was not found weighs 1."""
    return {
        "tp": F.size(F.filter(pred, lambda x: F.array_contains(true, x))).cast("bigint"),
        "fp": F.size(F.filter(pred, lambda x: ~F.array_contains(true, x))).cast("bigint"),
        "fn": F.size(F.array_except(true, pred)).cast("bigint"),
    }


def pair_counts(df: DataFrame, doc: str, true: str, pred: str) -> DataFrame:
    """``doc, label, in_true, predicted``: for every label of a document whether it is true and how often it was predicted.

    Both lists are exploded in one pass and added up before the shuffle, so a large document is no large group.
    """
    both = F.concat(
        F.transform(true, lambda x: F.struct(x.alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"))),
        F.transform(pred, lambda x: F.struct(x.alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"))),
    )
    return df.select(doc, F.inline(both)).groupBy(doc, "label").agg((F.max("t") > 0).alias("in_true"), F.sum("p").alias("predicted"))


def confusion(pairs: DataFrame, *by: str) -> DataFrame:
    """tp, fp and fn added up over ``by`` (a document, a label, or nothing)."""
    hit, p = F.col("in_true"), F.col("predicted")
    return pairs.groupBy(*by).agg(
        F.sum(F.when(hit, p).otherwise(0)).alias("tp"), F.sum(F.when(hit, 0).otherwise(p)).alias("fp"), F.sum(F.when(hit & (p == 0), 1).otherwise(0)).alias("fn")
    )


def rates(df: DataFrame) -> DataFrame:
    """precision, recall, f1 and support from tp, fp and fn; denominators are at least 1."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.withColumns({"precision": F.round(st.precision(tp, fp), 6), "recall": F.round(st.recall(tp, fn), 6), "f1": F.round(st.f1(tp, fp, fn), 6), "support": tp + fp + fn})


def with_total(counts: DataFrame, name: str, total: str = "Average") -> DataFrame:
    """A report per ``name`` and a last row whose rates come from the sums."""
    summed = counts.rollup(name).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.grouping(name).alias("_g"))
    return rates(summed.withColumn(name, F.when(F.col("_g") == 1, F.lit(total)).otherwise(F.col(name))).drop("_g"))


def multilabel(df: DataFrame, true: str, pred: str) -> DataFrame:
    """micro, macro, weighted and per-sample scores and the share of rows that are wholly right; 0 where a denominator is 0.

    One pass explodes labels into per-label counts (as many rows as labels), one adds up per-row scores.
    """
    t, p = F.array_distinct(true), F.array_distinct(pred)
    pairs = F.concat(
        F.transform(F.array_intersect(t, p), lambda x: F.struct(x.alias("label"), F.lit(1).alias("tp"), F.lit(0).alias("fp"), F.lit(0).alias("fn"))),
        F.transform(F.array_except(p, t), lambda x: F.struct(x.alias("label"), F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn"))),
        F.transform(F.array_except(t, p), lambda x: F.struct(x.alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.lit(1).alias("fn"))),
    )
    per = df.select(F.inline(pairs)).groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b == 0, F.lit(0.0)).otherwise(a / b)

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    per = per.withColumns({"p": ratio(tp, tp + fp), "r": ratio(tp, tp + fn), "f": ratio(2 * tp, 2 * tp + fp + fn), "s": tp + fn})
    out = {}
    for k, num, den in (("precision", F.sum("tp"), F.sum(tp + fp)), ("recall", F.sum("tp"), F.sum(tp + fn)), ("f1", 2 * F.sum("tp"), F.sum(2 * tp + fp + fn))):
        c = k[0]
        out[f"micro_{k}"], out[f"macro_{k}"], out[f"weighted_{k}"] = ratio(num, den), F.avg(c), ratio(F.sum(F.col(c) * F.col("s")), F.sum("s"))
    labels = per.agg(*[F.round(v, 6).alias(k) for k, v in out.items()])
    inter = F.size(F.array_intersect(t, p))
    rows = df.agg(
        F.round(F.avg(ratio(inter, F.size(p))), 6).alias("samples_precision"),
        F.round(F.avg(ratio(inter, F.size(t))), 6).alias("samples_recall"),
        F.round(F.avg(ratio(2 * inter, F.size(t) + F.size(p))), 6).alias("samples_f1"),
        F.round(F.avg(((F.size(t) == inter) & (F.size(p) == inter)).cast("int")), 6).alias("accuracy"),
    )
    return labels.crossJoin(rows)


def span_scores(true: DataFrame, pred: DataFrame, id_col: str, wildcard: str = "ATTACK") -> DataFrame:
    """``id_col, label, tp, fp, fn`` of spans matched by their bounds.

    A span is hit if one of its predicted labels is true or the true label is the wildcard; labels of
    a wrong span are all false positives; a true span that was never predicted is a false negative.
    """
    t = true.select(id_col, "start", "end", F.col("label").alias("t_label"))
    p = pred.groupBy(id_col, "start", "end").agg(F.collect_set("label").alias("p_labels"))
    j = t.join(p, [id_col, "start", "end"], "full")
    hit = F.col("t_label").isNotNull() & F.col("p_labels").isNotNull() & ((F.col("t_label") == wildcard) | F.array_contains("p_labels", F.col("t_label")))
    rows = F.when(hit, F.array(F.struct(F.col("t_label").alias("label"), F.lit(1).alias("tp"), F.lit(0).alias("fp"), F.lit(0).alias("fn"))))
    wrong = F.transform(F.coalesce("p_labels", st.empty()), lambda x: F.struct(x.alias("label"), F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn")))
    missed = F.when(F.col("p_labels").isNull(), F.array(F.struct(F.col("t_label").alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.lit(1).alias("fn")))).otherwise(F.array_except(wrong, wrong))
    return j.select(id_col, F.inline(F.when(hit, rows).otherwise(F.concat(wrong, missed)))).groupBy(id_col, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
