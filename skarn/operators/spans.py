"""Overlap resolution, merging and alignment of spans.

Spans are ``struct<start, end, label>``, half-open. The sweeps work on the array of one document, inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SPAN = "array<struct<start:int,end:int,label:string>>"


def collect(df: DataFrame, id_col: str) -> DataFrame:
    """``id_col, spans``: a document's different spans as one array."""
    return df.groupBy(id_col).agg(F.collect_set(F.struct("start", "end", "label")).alias("spans"))


def keep_longest(spans: Column) -> Column:
    """Longest first, ties by start and label; a span that overlaps a kept one is dropped."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct((s["start"] - s["end"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"))))
    none = F.array().cast(SPAN)

    def step(kept: Column, s: Column) -> Column:
        hit = F.exists(kept, lambda y: (y["start"] < s["end"]) & (s["start"] < y["end"]))
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))))

    return F.array_sort(F.aggregate(keyed, none, step))


def keep_earliest(spans: Column) -> Column:
    """Earliest first, the longer of equal starts; a running end drops what overlaps."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("k"), s["label"].alias("label"))))
    init = F.struct(F.array().cast(SPAN).alias("kept"), F.lit(-1).alias("last"))

    def step(acc: Column, s: Column) -> Column:
        one = F.struct(s["start"].alias("start"), (-s["k"]).alias("end"), s["label"].alias("label"))
        more = F.struct(F.concat(acc["kept"], F.array(one)).alias("kept"), (-s["k"]).alias("last"))
        return F.when(s["start"] >= acc["last"], more).otherwise(acc)

    return F.aggregate(keyed, init, step, lambda acc: acc["kept"])


def merge_runs(tokens: DataFrame, id_col: str, order: str, token: str, flag: str) -> DataFrame:
    """Runs of flagged neighbours as one phrase: ``id_col, start, end, phrase``."""
    by = W.partitionBy(id_col).orderBy(order)
    runs = tokens.where(F.col(flag)).withColumn("_g", F.col(order) - F.row_number().over(by))
    return runs.groupBy(id_col, "_g").agg(
        F.min(order).alias("start"),
        (F.max(order) + 1).alias("end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, token))), lambda x: x[token]), " ").alias("phrase"),
    ).drop("_g")


def align(token_spans: Column, start: Column, end: Column) -> Column:
    """The token span that a character span touches: ``struct<start, end>``; null if it touches none."""
    hit = F.filter(F.transform(token_spans, lambda t, i: F.struct(i.alias("i"), t["start"].alias("start"), t["end"].alias("end"))), lambda t: (t["start"] < end) & (t["end"] > start))
    return F.when(F.size(hit) > 0, F.struct(F.array_min(F.transform(hit, lambda t: t["i"])).alias("start"), (F.array_max(F.transform(hit, lambda t: t["i"])) + 1).alias("end")))


def token_offsets(words: Column) -> Column:
    """Character spans of tokens that single blanks separate."""
    init = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, w: Column) -> Column:
        span = F.struct(acc["at"].alias("start"), (acc["at"] + F.length(w)).alias("end"))
        return F.struct(F.concat(acc["out"], F.array(span)).alias("out"), (acc["at"] + F.length(w) + 1).alias("at"))

    return F.aggregate(words, init, step, lambda a: a["out"])
