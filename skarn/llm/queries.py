"""The queries of the training-data operators, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm import bisect, bpe, burst, cosjoin, graph, multiset, packing, rake, truncation
from skarn.runtime import ship, table

Query = Callable[[SparkSession, str], DataFrame]


def _labels(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select(F.lit(t).alias("dataset"), burst.clean_items(F.col("labels")).alias("labels")) for t in ("tram_train", "bosch_train")]
    return parts[0].unionByName(parts[1])


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    rows = _labels(spark, d)
    totals = rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"))
    return burst.mark_frequencies(burst.term_frequencies(rows, "dataset", "labels"), totals)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_terms(spark, d).where("mark IS NOT NULL").select("dataset", F.col("term").alias("label"), "mark")


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return graph.similar_vectors(table(spark, d, "rag_db"), "rag_id", "embedding", 64, 10)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    near = p2_neighbours(spark, d).where("cosine >= 0.9")
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def _sample(spark: SparkSession, d: str) -> rake.ProportionalSample:
    return rake.ProportionalSample(table(spark, d, "syn_sentence_list"), table(spark, d, "label_targets"), "syn_id", "augmented_sentence", "labels")


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).texts().select(F.col("row_id").alias("syn_id"), "category", F.col("text").alias("augmented_sentence"), "weight")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """What every category needs, has and lacks after the draw."""
    return _sample(spark, d).report.select("category", "target_share", "min_rows", F.round("needed", 6).alias("needed"), "available", F.round("lacking", 6).alias("lacking"))


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    """The fitted share of every category, its rows by the keys alone and after the repair, and the residual gap of its share."""
    return _sample(spark, d).report.select("category", "raked", "keyed", "drawn", "gap")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).report.where("lacking > 0").select("category")


_TRAIN = ("tram_train", "tram_train_augmented_artificial")


def _overlaps(spark: SparkSession, d: str) -> cosjoin.Overlaps:
    ship(spark)
    train = table(spark, d, _TRAIN[0]).select("sent_id", "sentence").unionByName(table(spark, d, _TRAIN[1]).select("sent_id", "sentence"))
    return cosjoin.Overlaps(table(spark, d, "tram_test"), train, "sent_id", "sentence")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).pairs().select(F.least("l_row", "r_row").alias("id_a"), F.greatest("l_row", "r_row").alias("id_b"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every test sentence with its class and the number of training sequences and rows linked to it."""
    o = _overlaps(spark, d)
    n = o.links.groupBy(F.col("l_id").alias("class_id")).agg(F.count(F.lit(1)).alias("links"), F.sum("r_n").alias("train_rows"))
    none = F.lit(0).cast("bigint")
    return o.members(0, n).select(F.col("row_id").alias("sent_id"), "class_id", F.coalesce("links", none).alias("links"), F.coalesce("train_rows", none).alias("train_rows"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping test sentences per training split and source, counted without expanding pairs."""
    o = _overlaps(spark, d)
    where = None
    for t in _TRAIN:
        own = table(spark, d, t).select(F.col("sent_id").alias("row_id"), F.lit(t).alias("split"), "doc_title")
        where = own if where is None else where.unionByName(own)
    src = o.members(1).join(where, "row_id").groupBy("class_id", "split", "doc_title").agg(F.count(F.lit(1)).alias("train_rows"))
    linked = o.links.groupBy(F.col("r_id").alias("class_id")).agg(F.count(F.lit(1)).alias("links"), F.sum("l_n").alias("test_rows"))
    return linked.join(src, "class_id").groupBy("split", "doc_title").agg(F.sum("links").alias("links"), F.sum(F.col("train_rows") * F.col("test_rows")).alias("pairs"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return bisect.split_texts(table(spark, d, "rag_db"), "rag_id", "text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    cut = F.when(F.max("unbroken"), "forced").otherwise("natural")
    return p5_pieces(spark, d).groupBy("rag_id").agg(cut.alias("cut"))


def _papers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ship(spark)
    return multiset.collapse(table(spark, d, "paper_rows"), "paper_id", "title", "authors", "doi")


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d)[1]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d)[0].where("keep_id <> rec_id").select("keep_id", F.col("rec_id").alias("paper_id"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return bpe.encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    sizes = bpe.token_counts(table(spark, d, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "n_tokens", 2048)


def _readings(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return truncation.readings(table(spark, d, "documents"), "doc_id", "text", "source")


def p9_limits(spark: SparkSession, d: str) -> DataFrame:
    return truncation.storage_limits(_readings(spark, d)).select("source", "encoding", "length", "texts")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Texts and cut texts of every source, and which step found them; the share is of all its rows, null and blank texts included."""
    steps = [F.count_if(F.col("cut") & (F.col("step") == k)).alias(f"by_{k}") for k in ("limit", "ending", "corpus")]
    cut = truncation.judged(_readings(spark, d)).groupBy(F.col("source").alias("s")).agg(F.count_if("cut").alias("cut_texts"), *steps)
    rows = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("texts"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("cut_texts", "by_limit", "by_ending", "by_corpus")]
    share = F.round(F.coalesce("cut_texts", F.lit(0)) / F.col("texts"), 6).alias("share")
    return rows.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "texts", *counts, share)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judged(_readings(spark, d)).where("cut").select("doc_id")


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


#: An item of labels as p1 counts it; RE2 has no classes for Unicode spaces beyond \p{Z}.
_ITEM = r"upper(regexp_replace(x, '^[\s\x1c-\x1f\x{85}\p{Z}]+|[\s\x1c-\x1f\x{85}\p{Z}]+$', '', 'g'))"

_P1 = f"""
WITH r AS (SELECT 'tram_train' AS dataset, sent_id, labels FROM tram_train UNION ALL SELECT 'bosch_train', sent_id, labels FROM bosch_train),
i AS (SELECT dataset, sent_id, {_ITEM} AS term FROM (SELECT dataset, sent_id, unnest(labels) AS x FROM r)),
n AS (SELECT dataset, count(*) AS n_rows FROM r GROUP BY dataset),
f AS (SELECT dataset, term, count(*) AS occurrences, count(DISTINCT sent_id) AS records FROM i WHERE term IS NOT NULL AND term <> '' GROUP BY ALL)
SELECT dataset, term, occurrences, records,
  CASE WHEN records < 5 THEN 'rare' WHEN records / n_rows > 0.1 THEN 'common' END AS mark
FROM f JOIN n USING (dataset)
"""

_P3 = f"""
WITH u AS (SELECT augmented_sentence AS s, list_filter(list_transform(labels, lambda x: {_ITEM}), lambda x: x IS NOT NULL AND x <> '') AS l
  FROM syn_sentence_list WHERE labels IS NOT NULL AND augmented_sentence IS NOT NULL),
c AS (SELECT coalesce(l[1], 'NO_TTP') AS category, count(DISTINCT s) AS available FROM u
  WHERE regexp_replace(s, '[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', '', 'g') <> '' GROUP BY 1),
n AS (SELECT count(*) AS n FROM syn_sentence_list)
SELECT category, target_share, min_rows, greatest(min_rows::DOUBLE, target_share * 0.05::DOUBLE * n) AS needed, coalesce(available, 0) AS available
FROM label_targets LEFT JOIN c USING (category), n
"""


#: RE2 repeats at most 1,000 times.
_RUN = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"
_P5 = f"SELECT rag_id, CASE WHEN regexp_matches(text, '{_RUN}{{1000}}{_RUN}{{201}}') THEN 'forced' ELSE 'natural' END AS cut FROM rag_db WHERE length(text) > 1200"


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": _P5,
        "p1_terms": _P1,
        "p1_found": f"SELECT dataset, term AS label, mark FROM ({_P1}) WHERE mark IS NOT NULL",
        "p3_found": f"SELECT category FROM ({_P3}) WHERE available < needed",
        "p3_report": f"SELECT category, target_share, min_rows, round(needed, 6) AS needed, available, round(greatest(0, needed - available), 6) AS lacking FROM ({_P3})",
    }
