"""Queries over compound labels, comparability, lookups and trained word vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import labels as lb
from skarn.operators import datasets as da
from skarn.operators import dictionary as dic
from skarn.operators import trees as tr
from skarn.plans import q_metrics as qm
from skarn.plans import q_tokens as qt
from skarn.plans import q_vectors as qv
from skarn.plans.q_graph import trees
from skarn.plans.registry import query
from skarn.runtime import ship, table

_C = lb.CONCEPT
_JOINED = f"SELECT sent_id, array_to_string(truth, '||') AS label FROM ({qm.GOLD}) WHERE len(truth) > 0"


@query(sql=f"SELECT sent_id, label, regexp_matches(label, '^{_C}(?:\\|\\|{_C})*\\z') AS compound, CASE WHEN regexp_matches(label, '^{_C}(?:\\|\\|{_C})*\\z') THEN string_split(label, '||') ELSE [] END AS parts FROM ({_JOINED})")
def compound_labels(spark: SparkSession, d: str) -> DataFrame:
    g = qm.gold(spark, d).where(F.size("truth") > 0).select("sent_id", F.array_join("truth", "||").alias("label"))
    return g.select("sent_id", "label", lb.is_compound(F.col("label")).alias("compound"), lb.concepts(F.col("label")).alias("parts"))


@query(sql=f"SELECT label, CASE WHEN NOT regexp_matches(label, '^{_C}\\z') THEN NULL WHEN starts_with(label, 'TA') THEN 'tactic' WHEN starts_with(label, 'T') THEN 'technique' WHEN starts_with(label, 'DS') THEN 'data source' WHEN starts_with(label, 'S') THEN 'software' WHEN starts_with(label, 'G') THEN 'group' ELSE 'mitigation' END AS kind, count(*) AS n FROM (SELECT unnest({qm.l_sql('labels')}) AS label FROM bosch_train) GROUP BY ALL")
def concept_kinds(spark: SparkSession, d: str) -> DataFrame:
    from skarn.functions import sets as st

    n = table(spark, d, "bosch_train").select(F.explode(st.labels(F.col("labels"))).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return n.select("label", lb.concept_kind(F.col("label")).alias("kind"), "n")


_SAME = "SELECT doc_title, lower(sentence) AS k, sentence, sent_id FROM tram_train WHERE sentence IS NOT NULL AND doc_title IS NOT NULL"


@query(
    sql=f"""
WITH s AS ({_SAME}), c AS (SELECT doc_title, k, min(sent_id) AS class_id, count(*) AS members, count(DISTINCT sentence) AS texts, count(DISTINCT list_transform(string_split_regex(sentence, '[.!?] +'), lambda x: length(x))) AS boundaries FROM s GROUP BY ALL)
SELECT class_id, members, texts = 1 AS same_tokens, boundaries = 1 AS same_sentences FROM c WHERE members > 1
"""
)
def comparable_docs(spark: SparkSession, d: str) -> DataFrame:
    """Classes of texts of a document that are equal but for case: whether all have the same tokens and the same sentence boundaries.

    One row per class with its number of members; equal texts are counted before the classes are made.
    """
    t = table(spark, d, "tram_train").where("sentence IS NOT NULL AND doc_title IS NOT NULL")
    one = t.groupBy("doc_title", "sentence").agg(F.min("sent_id").alias("i"), F.count(F.lit(1)).alias("n"))
    ends = F.transform(F.split("sentence", "[.!?] +"), lambda x: F.length(x))
    c = one.withColumn("ends", ends).groupBy("doc_title", F.lower("sentence")).agg(F.min("i").alias("class_id"), F.sum("n").alias("members"), F.count(F.lit(1)).alias("texts"), F.count_distinct("ends").alias("b"))
    return c.where("members > 1").select("class_id", "members", (F.col("texts") == 1).alias("same_tokens"), (F.col("b") == 1).alias("same_sentences"))


@query(sql=f"SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS idx FROM (SELECT DISTINCT unnest(truth) AS label FROM ({qm.GOLD}))")
def label_ids(spark: SparkSession, d: str) -> DataFrame:
    """Labels numbered in order."""
    g = qm.gold(spark, d).select(F.explode("truth").alias("label")).distinct()
    return da.numbered(g, "label").select("label", F.col("idx").cast("int").alias("idx"))


@query(sql=f"SELECT query, neighbour, label FROM ({qv._near(qv._DIST, '', 1)})")
def reverse_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The one nearest vector of every query, repeats kept."""
    near = qv.nearest(spark, d, 1)
    lab = table(spark, d, "embeddings").select(F.col("vec_id").alias("query"), "label")
    return near.join(lab, "query").select("query", "neighbour", "label")


@query(sql=f"SELECT sent_id, count(*) AS words, sum(regexp_matches(w, '^[0-9]+$')::INT)::BIGINT AS numbers FROM (SELECT sent_id, unnest(l) AS w FROM ({qt.SENT})) GROUP BY sent_id")
def number_words(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.filter("l", lambda w: w.rlike("^[0-9]+$")))
    return qt.sents(spark, d).where(F.size("l") > 0).select("sent_id", F.size("l").cast("bigint").alias("words"), n.cast("bigint").alias("numbers"))


@query(
    sql=f"""
WITH RECURSIVE s AS (SELECT sent_id, k[1] AS x, k[-1] AS y FROM (SELECT sent_id, list_filter(range(1, len(l) + 1), lambda i: length(l[i]) >= 8) AS k FROM ({qt.SENT})) WHERE len(k) >= 2),
t AS (SELECT sent_id, x, y, x AS a, y AS b, 1 AS n FROM s UNION ALL SELECT sent_id, x, y, CASE WHEN a > b THEN a // 2 ELSE a END, CASE WHEN a > b THEN b ELSE b // 2 END, n + 1 FROM t WHERE a <> b)
SELECT sent_id, (a - 1)::INT AS start, greatest(x, y)::INT AS "end", n::INT AS size FROM t WHERE a = b
"""
)
def min_subtrees(spark: SparkSession, d: str) -> DataFrame:
    """The smallest subtree that holds the first and the last long word of a sentence."""
    ship(spark)

    def span(sid, words, heads):
        known = [i for i, w in enumerate(words) if len(w) >= 8]
        if len(known) < 2:
            return []
        t = tr.minimal_subtree(heads, [known[0], known[-1]])
        return [(sid, min(t), max(t) + 1, len(t))] if t else []

    return tr.map_trees(trees(spark, d), ["sent_id", "l", "heads"], span, "sent_id bigint, start int, end int, size int")


@query()
def word_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Skip-gram word vectors trained on the sentences (small: 16 numbers, words that occur five times)."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    model = Word2Vec(vectorSize=16, minCount=5, seed=1, inputCol="l", outputCol="v", maxIter=1, numPartitions=4).fit(qt.sents(spark, d).where(F.size("l") > 0).select("l"))
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))
