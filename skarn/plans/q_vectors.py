"""Queries over vectors and string similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import vectors as ve
from skarn.operators import datasets as da
from skarn.operators import vectors as ov
from skarn.plans.registry import query
from skarn.runtime import broadcast_if_small, ship, table

_E = "SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings"
_DIST = "round(list_distance(q.v, x.v), 6)"
_COS = "round(list_inner_product(q.v, x.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(x.v, x.v))), 6)"


def _near(d: str, order: str, k: int, extra: str = "") -> str:
    return f"SELECT query, rank, neighbour, d AS distance, label FROM (SELECT q.vec_id AS query, q.label AS label, x.vec_id AS neighbour, {d} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY {d} {order}, x.vec_id)::INT AS rank FROM ({_E}) q, ({_E}) x WHERE q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id {extra}) WHERE rank <= {k}"


def _asked():
    return F.col("vec_id") % 100 == 0


def nearest(spark: SparkSession, d: str, k: int, metric: str = "euclidean", group: str | None = None) -> DataFrame:
    """Every row whose id is divisible by 100 against all rows."""
    ship(spark)
    return ov.exact_knn(table(spark, d, "embeddings"), "vec_id", "embedding", _asked(), k, 64, metric, group)


@query(sql=f"SELECT query, rank, neighbour, distance FROM ({_near(_DIST, '', 5)})")
def knn_euclidean(spark: SparkSession, d: str) -> DataFrame:
    return nearest(spark, d, 5)


@query(sql=f"SELECT query, rank, neighbour, distance AS cosine FROM ({_near(_COS, 'DESC', 5)})")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return nearest(spark, d, 5, "cosine").withColumnRenamed("distance", "cosine")


@query(sql=f"SELECT query, rank, neighbour, distance FROM ({_near(_DIST, '', 5, 'AND q.label = x.label')})")
def knn_partitioned(spark: SparkSession, d: str) -> DataFrame:
    """Nearest among the vectors of the same label, the vector itself left out."""
    return nearest(spark, d, 5, group="label")


def _by_label(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of all queries of a label: the parts of one composite query."""
    lab = table(spark, d, "embeddings").where(_asked()).select(F.col("vec_id").alias("query"), "label")
    return nearest(spark, d, 20).join(lab, "query")


_PARTS = _near(_DIST, "", 20)


@query(sql=f"SELECT label, neighbour, round(min(distance), 6) AS distance FROM ({_PARTS}) GROUP BY ALL")
def knn_dedup(spark: SparkSession, d: str) -> DataFrame:
    return ov.fuse(_by_label(spark, d), "label", "min")


@query(sql=f"SELECT label, neighbour, round(min(distance) * pow(0.5, count(*) - 1), 6) AS distance FROM ({_PARTS}) GROUP BY label, neighbour")
def dist_shrink(spark: SparkSession, d: str) -> DataFrame:
    return ov.fuse(_by_label(spark, d), "label", "shrink")


@query(sql=f"SELECT label, neighbour, round(avg(distance), 6) AS distance FROM ({_PARTS}) GROUP BY label, neighbour")
def dist_average(spark: SparkSession, d: str) -> DataFrame:
    return ov.fuse(_by_label(spark, d), "label", "average")


@query(sql=f"SELECT rag_id, concept_name FROM rag_db WHERE rag_id IN (SELECT neighbour FROM ({_near(_DIST, '', 10)})) ORDER BY rag_id")
def rag_semi(spark: SparkSession, d: str) -> DataFrame:
    """The retrieval table's rows among the best ids, in table order."""
    best = nearest(spark, d, 10).select(F.col("neighbour").alias("rag_id")).distinct()
    return table(spark, d, "rag_db").join(best, "rag_id", "left_semi").select("rag_id", "concept_name").orderBy("rag_id")


# Concept vectors: those of the smallest id of each label.
_CON = "SELECT label AS concept, arg_min(embedding::DOUBLE[], vec_id) AS v FROM embeddings GROUP BY label"
_SIM = f"SELECT q.vec_id, q.label, x.concept, {_COS} AS sim FROM ({_E}) q, ({_CON}) x"


def similarities(spark: SparkSession, d: str) -> DataFrame:
    """``vec_id, label, concept, sim``: every vector against one vector per label (a handful, checked before it is broadcast)."""
    t = table(spark, d, "embeddings").where("embedding IS NOT NULL")
    con = t.groupBy(F.col("label").alias("concept")).agg(F.min_by("embedding", "vec_id").alias("c")).select("concept", "c", ve.norm(F.col("c")).alias("cn"))
    rows = t.select("vec_id", "label", "embedding", ve.norm(F.col("embedding")).alias("n"))
    sim = F.round(ve.cosine(F.col("embedding"), F.col("c"), F.col("n"), F.col("cn")), 6)
    return rows.crossJoin(broadcast_if_small(con)).select("vec_id", "label", "concept", sim.alias("sim"))


@query(sql=f"SELECT vec_id, concept, sim FROM ({_SIM}) WHERE sim > 0.2")
def sim_threshold(spark: SparkSession, d: str) -> DataFrame:
    return similarities(spark, d).where("sim > 0.2").select("vec_id", "concept", "sim")


@query(sql=f"SELECT vec_id, concept, sim FROM ({_SIM}) WHERE sim >= 0.8")
def sim_at_least(spark: SparkSession, d: str) -> DataFrame:
    """Matches of at least 0.80, the bound included."""
    return similarities(spark, d).where("sim >= 0.8").select("vec_id", "concept", "sim")


_EVEN = "SELECT concept FROM (SELECT concept, row_number() OVER (ORDER BY concept) AS r FROM (SELECT DISTINCT label AS concept FROM embeddings)) WHERE r % 2 = 0"


@query(sql=f"SELECT vec_id, list(CASE WHEN concept IN ({_EVEN}) THEN sim ELSE 0 END ORDER BY concept) AS sims FROM ({_SIM}) GROUP BY vec_id")
def sim_masked(spark: SparkSession, d: str) -> DataFrame:
    """Similarities to all concepts in their order, those outside a label subset set to 0."""
    s = similarities(spark, d)
    kept = da.numbered(s.select("concept").distinct(), "concept").where("idx % 2 = 1").select(F.col("concept").alias("kept"))
    masked = s.join(F.broadcast(kept), F.col("concept") == F.col("kept"), "left").select("vec_id", "concept", F.when(F.col("kept").isNull(), 0.0).otherwise(F.col("sim")).alias("sim"))
    return masked.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("concept", "sim"))), lambda x: x["sim"]).alias("sims"))


@query(sql=f"SELECT vec_id, concept, sim FROM ({_SIM}) WHERE label = concept AND sim BETWEEN 0.3 AND 0.9")
def sim_band(spark: SparkSession, d: str) -> DataFrame:
    return similarities(spark, d).where("label = concept AND sim BETWEEN 0.3 AND 0.9").select("vec_id", "concept", "sim")


_TAUS = [round(0.05 + i * 0.45 / 19, 6) for i in range(20)]
_SWEEP = f"SELECT tau, round(avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END), 6) AS f1 FROM (SELECT tau, concept, sum((sim > tau AND label = concept)::INT) AS tp, sum((sim > tau AND label <> concept)::INT) AS fp, sum((sim <= tau AND label = concept)::INT) AS fn FROM ({_SIM}), (SELECT unnest({_TAUS})::DOUBLE AS tau) GROUP BY ALL) GROUP BY tau"


@query(sql=f"SELECT tau, f1, tau = (SELECT tau FROM ({_SWEEP}) ORDER BY f1 DESC, tau LIMIT 1) AS best FROM ({_SWEEP})")
def tau_sweep(spark: SparkSession, d: str) -> DataFrame:
    """F1 of every threshold; the best is the smallest of equals."""
    s = ov.sweep(similarities(spark, d), "concept", "label", "sim", _TAUS)
    best = s.agg(F.min_by("tau", F.struct(-F.col("f1"), "tau")).alias("b"))
    return s.crossJoin(F.broadcast(best)).select("tau", "f1", (F.col("tau") == F.col("b")).alias("best"))


_TWO = "SELECT label AS concept, list(embedding::DOUBLE[] ORDER BY vec_id)[1] AS v1, list(embedding::DOUBLE[] ORDER BY vec_id)[2] AS v2 FROM embeddings GROUP BY label HAVING count(*) > 1"


def _cosd(a: str, b: str) -> str:
    return f"(1 - list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b}))))"


@query(
    sql=f"SELECT vec_id, concept, distance FROM (SELECT vec_id, concept, distance, row_number() OVER (PARTITION BY vec_id ORDER BY distance, concept) AS r FROM (SELECT vec_id, concept, round(0.5 * {_cosd('q.v', 'v1')} + 0.5 * {_cosd('q.v', 'v2')}, 6) AS distance FROM ({_E}) q, ({_TWO}) x)) WHERE r = 1 AND distance < 0.6"
)
def nearest_concept(spark: SparkSession, d: str) -> DataFrame:
    """The concept with the smallest mean of two cosine distances, if below 0.6."""
    t = table(spark, d, "embeddings").where("embedding IS NOT NULL")
    first = F.slice(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), 1, 2)
    small = t.groupBy("label").agg(F.min("vec_id").alias("a")).join(t.select("label", "vec_id"), "label").where("vec_id > a").groupBy("label").agg(F.first("a").alias("a"), F.min("vec_id").alias("b"))
    heads = t.join(broadcast_if_small(small.select(F.explode(F.array("a", "b")).alias("vec_id"))), "vec_id")
    con = heads.groupBy(F.col("label").alias("concept")).agg(first.alias("f")).where(F.size("f") == 2)
    con = con.select("concept", F.col("f")[0]["embedding"].alias("c1"), F.col("f")[1]["embedding"].alias("c2"))
    con = con.withColumns({"n1": ve.norm(F.col("c1")), "n2": ve.norm(F.col("c2"))})
    v, n = F.col("embedding"), F.col("n")
    dist = F.round(0.5 * (1 - ve.cosine(v, F.col("c1"), n, F.col("n1"))) + 0.5 * (1 - ve.cosine(v, F.col("c2"), n, F.col("n2"))), 6)
    x = t.select("vec_id", "embedding", ve.norm(v).alias("n")).crossJoin(broadcast_if_small(con)).select("vec_id", "concept", dist.alias("distance"))
    best = x.groupBy("vec_id").agg(F.min(F.struct("distance", "concept")).alias("b"))
    return best.where("b.distance < 0.6").select("vec_id", "b.concept", "b.distance")


_NAME = "SELECT DISTINCT lower(concept_name) AS name, split_part(lower(concept_name), ' ', 2) AS k FROM rag_db WHERE concept_name IS NOT NULL"


def name_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of concept names that share their second word."""
    n = table(spark, d, "rag_db").where("concept_name IS NOT NULL").select(F.lower("concept_name").alias("name")).distinct().withColumn("k", F.coalesce(F.get(F.split("name", " "), 1), F.lit("")))
    return n.select(F.col("name").alias("a"), "k").join(n.select(F.col("name").alias("b"), "k"), "k").where("a < b").select("a", "b")


@query(sql=f"SELECT a.name AS a, b.name AS b, levenshtein(a.name, b.name)::INT AS edits FROM ({_NAME}) a JOIN ({_NAME}) b USING (k) WHERE a.name < b.name AND levenshtein(a.name, b.name) <= 6")
def levenshtein_pairs(spark: SparkSession, d: str) -> DataFrame:
    return name_pairs(spark, d).withColumn("edits", F.levenshtein("a", "b")).where("edits <= 6")


@query()
def lev_ratio(spark: SparkSession, d: str) -> DataFrame:
    """The indel similarity ``2 * LCS / (length sum)`` of name pairs."""
    import pandas as pd

    from skarn.operators.strings import indel_ratio

    ship(spark)

    def ratio(batches):
        for pdf in batches:
            yield pdf.assign(ratio=[round(indel_ratio(a, b), 6) for a, b in zip(pdf["a"], pdf["b"], strict=True)]) if len(pdf) else pd.DataFrame({"a": [], "b": [], "ratio": []})

    return name_pairs(spark, d).mapInPandas(ratio, "a string, b string, ratio double")
