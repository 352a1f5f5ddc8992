"""Queries over label sets, reports and datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import sets as st
from skarn.operators import datasets as da
from skarn.operators import metrics as me
from skarn.plans.registry import query
from skarn.runtime import table


def l_sql(c: str) -> str:
    return f"coalesce(list_filter(list_transform({c}, lambda x: upper(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))), lambda x: x <> ''), [])"


# Truth is the table's labels. Predictions follow from them by a fixed rule: some are dropped, some added, some twice.
GOLD = f"""
SELECT *, list_concat(list_concat(list_filter(truth, lambda x: (length(x) + sent_id) % 4 <> 0), CASE WHEN sent_id % 7 = 0 THEN ['T2263'] ELSE [] END), CASE WHEN sent_id % 21 = 0 THEN ['T2263', 'T2144'] ELSE [] END) AS pred
FROM (SELECT sent_id, coalesce(trim(doc_title), '') AS doc, sentence, {l_sql('labels')} AS truth FROM (SELECT sent_id, doc_title, sentence, labels FROM tram_train UNION ALL SELECT sent_id, doc_title, sentence, labels FROM tram_test))
"""


def gold(spark: SparkSession, d: str) -> DataFrame:
    """``sent_id, doc, sentence, truth, pred`` of the annotated sentences."""
    cols = ["sent_id", "doc_title", "sentence", "labels"]
    t = table(spark, d, "tram_train").select(*cols).unionByName(table(spark, d, "tram_test").select(*cols))
    t = t.select("sent_id", F.coalesce(F.trim("doc_title"), F.lit("")).alias("doc"), "sentence", st.labels(F.col("labels")).alias("truth"))
    kept = F.filter("truth", lambda x: (F.length(x) + F.col("sent_id")) % 4 != 0)
    one = F.when(F.col("sent_id") % 7 == 0, F.array(F.lit("T2263"))).otherwise(st.empty())
    two = F.when(F.col("sent_id") % 21 == 0, F.array(F.lit("T2263"), F.lit("T2144"))).otherwise(st.empty())
    return t.withColumn("pred", F.concat(kept, one, two))


@query(
    sql=f"SELECT sent_id, len(list_filter(pred, lambda x: list_contains(truth, x)))::BIGINT AS tp, len(list_filter(pred, lambda x: NOT list_contains(truth, x)))::BIGINT AS fp, len(list_filter(list_distinct(truth), lambda x: NOT list_contains(pred, x)))::BIGINT AS fn FROM ({GOLD})"
)
def doc_confusion(spark: SparkSession, d: str) -> DataFrame:
    return gold(spark, d).select("sent_id", *[v.alias(k) for k, v in me.row_confusion(F.col("truth"), F.col("pred")).items()])


_PAIR = f"SELECT doc, label, max(t) > 0 AS in_true, sum(p)::BIGINT AS predicted FROM (SELECT doc, unnest(truth) AS label, 1 AS t, 0 AS p FROM ({GOLD}) UNION ALL SELECT doc, unnest(pred), 0, 1 FROM ({GOLD})) GROUP BY doc, label"
_SUMS = "sum(CASE WHEN in_true THEN predicted ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN in_true THEN 0 ELSE predicted END)::BIGINT AS fp, sum(CASE WHEN in_true AND predicted = 0 THEN 1 ELSE 0 END)::BIGINT AS fn"
_RATES = "round(tp / greatest(1, tp + fp), 6) AS precision, round(tp / greatest(1, tp + fn), 6) AS recall, round(2 * tp / greatest(1, 2 * tp + fp + fn), 6) AS f1, tp + fp + fn AS support"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return me.pair_counts(gold(spark, d), "doc", "truth", "pred")


@query(sql=f"SELECT doc, tp, fp, fn, {_RATES} FROM (SELECT doc, {_SUMS} FROM ({_PAIR}) GROUP BY doc)")
def report_per_file(spark: SparkSession, d: str) -> DataFrame:
    return me.rates(me.confusion(_pairs(spark, d), "doc"))


@query(sql=f"SELECT label, tp, fp, fn, {_RATES} FROM (SELECT label, {_SUMS} FROM ({_PAIR}) GROUP BY label)")
def report_per_label(spark: SparkSession, d: str) -> DataFrame:
    return me.rates(me.confusion(_pairs(spark, d), "label")).orderBy("label")


@query(sql=f"SELECT label AS name, tp, fp, fn, tp + fp + fn AS support FROM (SELECT label, {_SUMS} FROM ({_PAIR}) GROUP BY label)")
def report_statistics(spark: SparkSession, d: str) -> DataFrame:
    return me.confusion(_pairs(spark, d), "label").select(F.col("label").alias("name"), "tp", "fp", "fn", (F.col("tp") + F.col("fp") + F.col("fn")).alias("support"))


@query(sql=f"SELECT coalesce(doc, 'Average') AS doc, tp, fp, fn, {_RATES} FROM (SELECT doc, {_SUMS} FROM ({_PAIR}) GROUP BY ROLLUP (doc))")
def report_rollup(spark: SparkSession, d: str) -> DataFrame:
    return me.with_total(me.confusion(_pairs(spark, d), "doc"), "doc")


def _score_sql(t: str, p: str) -> str:
    i, nt, np_ = f"len(list_intersect({t}, {p}))", f"len(list_distinct({t}))", f"len(list_distinct({p}))"

    def r(a: str, b: str) -> str:
        return f"CASE WHEN {nt} = 0 AND {np_} = 0 THEN 1.0 WHEN {b} = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({b}) END"

    return f"{r(i, np_)} AS p, {r(i, nt)} AS r, {r(i, f'{nt} + {np_} - {i}')} AS a, {r(f'2 * {i}', f'{nt} + {np_}')} AS f"


@query(sql=f"SELECT sent_id, round(p, 6) AS precision, round(r, 6) AS recall, round(a, 6) AS accuracy, round(f, 6) AS f1 FROM (SELECT sent_id, {_score_sql('truth', 'pred')} FROM ({GOLD}))")
def set_metrics(spark: SparkSession, d: str) -> DataFrame:
    return gold(spark, d).select("sent_id", *[F.round(v, 6).alias(k) for k, v in st.set_scores(F.col("truth"), F.col("pred")).items()])


_DOCSET = f"SELECT doc, coalesce(list(label) FILTER (WHERE in_true), []) AS t, coalesce(list(label) FILTER (WHERE predicted > 0), []) AS p FROM ({_PAIR}) GROUP BY doc"


def doc_sets(spark: SparkSession, d: str) -> DataFrame:
    """``doc, t, p``: the label sets of every document that has any label."""
    return _pairs(spark, d).groupBy("doc").agg(F.collect_set(F.when(F.col("in_true"), F.col("label"))).alias("t"), F.collect_set(F.when(F.col("predicted") > 0, F.col("label"))).alias("p"))


@query(sql=f"SELECT count(*) AS docs, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(a), 6) AS accuracy, round(avg(f), 6) AS f1 FROM (SELECT doc, {_score_sql('t', 'p')} FROM ({_DOCSET}))")
def doc_macro(spark: SparkSession, d: str) -> DataFrame:
    s = st.set_scores(F.col("t"), F.col("p"))
    return doc_sets(spark, d).select(*[v.alias(k) for k, v in s.items()]).agg(F.count(F.lit(1)).alias("docs"), *[F.round(F.avg(k), 6).alias(k) for k in s])


_ML = f"""
WITH g AS (SELECT sent_id, list_distinct(truth) AS t, list_distinct(pred) AS p FROM ({GOLD})),
u AS (SELECT label, sum(a * b) AS tp, sum((1 - a) * b) AS fp, sum(a * (1 - b)) AS fn FROM (SELECT sent_id, label, max(a) AS a, max(b) AS b FROM (SELECT sent_id, unnest(t) AS label, 1 AS a, 0 AS b FROM g UNION ALL SELECT sent_id, unnest(p), 0, 1 FROM g) GROUP BY ALL) GROUP BY label),
v AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS pr, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS re, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f, tp + fn AS s FROM u),
w AS (SELECT *, len(list_intersect(t, p)) AS i FROM g)
SELECT round(sum(tp) / sum(tp + fp), 6) AS micro_precision, round(sum(tp) / sum(tp + fn), 6) AS micro_recall, round(2 * sum(tp) / sum(2 * tp + fp + fn), 6) AS micro_f1,
  round(avg(pr), 6) AS macro_precision, round(avg(re), 6) AS macro_recall, round(avg(f), 6) AS macro_f1,
  round(sum(pr * s) / sum(s), 6) AS weighted_precision, round(sum(re * s) / sum(s), 6) AS weighted_recall, round(sum(f * s) / sum(s), 6) AS weighted_f1,
  (SELECT round(avg(CASE WHEN len(p) = 0 THEN 0 ELSE i / len(p) END), 6) FROM w) AS samples_precision, (SELECT round(avg(CASE WHEN len(t) = 0 THEN 0 ELSE i / len(t) END), 6) FROM w) AS samples_recall,
  (SELECT round(avg(CASE WHEN len(t) + len(p) = 0 THEN 0 ELSE 2 * i / (len(t) + len(p)) END), 6) FROM w) AS samples_f1, (SELECT round(avg((list_sort(t) = list_sort(p))::INT), 6) FROM w) AS accuracy
FROM v
"""


@query(sql=_ML)
def multilabel_metrics(spark: SparkSession, d: str) -> DataFrame:
    return me.multilabel(gold(spark, d), "truth", "pred")


# Label sets: the most wanted 10 and 25 categories, and all of them.
_SETS = "SELECT s.set_name, list(category ORDER BY target_share DESC, category) AS members FROM (SELECT *, row_number() OVER (ORDER BY target_share DESC, category) AS rn FROM label_targets WHERE category <> 'NO_TTP'), (VALUES ('top10', 10), ('top25', 25), ('all', 1000000000)) AS s(set_name, k) WHERE rn <= k GROUP BY s.set_name"


def label_sets(spark: SparkSession, d: str) -> DataFrame:
    """``set_name, members``: three rows made of the table of targets, which has a fixed small size."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("target_share")).alias("k"), "category")))
    one = table(spark, d, "label_targets").where("category <> 'NO_TTP'").agg(F.transform(order, lambda x: x["category"]).alias("all"))
    cut = F.array(*[F.struct(F.lit(n).alias("set_name"), F.slice("all", 1, k).alias("members")) for n, k in (("top10", 10), ("top25", 25), ("all", 2**31 - 1))])
    return one.select(F.inline(cut))


@query(
    sql=f"""
SELECT set_name, count(*) AS docs, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f), 6) AS f1 FROM (
  SELECT set_name, {_score_sql('tt', 'pp')} FROM (SELECT set_name, list_intersect(t, members) AS tt, list_intersect(p, members) AS pp FROM ({_DOCSET}), ({_SETS}))) GROUP BY set_name
"""
)
def labelset_metrics(spark: SparkSession, d: str) -> DataFrame:
    x = doc_sets(spark, d).crossJoin(F.broadcast(label_sets(spark, d))).select("set_name", F.array_intersect("t", "members").alias("t"), F.array_intersect("p", "members").alias("p"))
    s = st.set_scores(F.col("t"), F.col("p"))
    out = x.select("set_name", *[s[k].alias(k) for k in ("precision", "recall", "f1")])
    return out.groupBy("set_name").agg(F.count(F.lit(1)).alias("docs"), *[F.round(F.avg(k), 6).alias(k) for k in ("precision", "recall", "f1")])


_TOP10 = f"SELECT members FROM ({_SETS}) WHERE set_name = 'top10'"


@query(sql=f"SELECT sent_id, list_transform(list_append(members, 'NO_TTP'), lambda x: list_contains(CASE WHEN len(truth) = 0 THEN ['NO_TTP'] ELSE truth END, x)::INT) AS hot FROM ({GOLD}), ({_TOP10})")
def multi_hot(spark: SparkSession, d: str) -> DataFrame:
    """One number per label of the set and a last one, ``NO_TTP``, for rows without labels."""
    top = label_sets(spark, d).where("set_name = 'top10'").select(F.concat("members", F.array(F.lit("NO_TTP"))).alias("members"))
    own = F.when(F.size("truth") == 0, F.array(F.lit("NO_TTP"))).otherwise(F.col("truth"))
    return gold(spark, d).crossJoin(F.broadcast(top)).select("sent_id", st.multi_hot(own, F.col("members")).alias("hot"))


@query(sql=f"SELECT doc, list_transform(members, lambda x: list_contains(t, x)::INT) AS hot FROM ({_DOCSET}), ({_TOP10})")
def doc_or(spark: SparkSession, d: str) -> DataFrame:
    """The multi-hot vector of a document: the OR of its sentences'."""
    top = label_sets(spark, d).where("set_name = 'top10'")
    return doc_sets(spark, d).crossJoin(F.broadcast(top)).select("doc", st.multi_hot(F.col("t"), F.col("members")).alias("hot"))


@query(sql=f"SELECT sent_id, CASE WHEN list_contains(members, label) THEN label ELSE 'NO_TTP' END AS label FROM (SELECT sent_id, unnest(CASE WHEN len(truth) = 0 THEN [NULL] ELSE truth END) AS label FROM ({GOLD})), ({_TOP10})")
def explode_label(spark: SparkSession, d: str) -> DataFrame:
    top = label_sets(spark, d).where("set_name = 'top10'")
    x = gold(spark, d).select("sent_id", F.explode_outer("truth").alias("label")).crossJoin(F.broadcast(top))
    return x.select("sent_id", F.when(F.array_contains("members", F.col("label")), F.col("label")).otherwise("NO_TTP").alias("label"))


@query(sql=f"SELECT sent_id, list_transform(truth, lambda x: regexp_replace(x, '^(T[0-9]{{4}}).[0-9]{{3}}.*$', '\\1')) AS labels FROM ({GOLD})")
def collapse_labels(spark: SparkSession, d: str) -> DataFrame:
    return gold(spark, d).select("sent_id", st.collapse(F.col("truth")).alias("labels"))


@query(sql=f"SELECT sent_id, list_sort(list_intersect(truth, members)) AS kept FROM ({GOLD}), (SELECT members FROM ({_SETS}) WHERE set_name = 'top25')")
def label_restrict(spark: SparkSession, d: str) -> DataFrame:
    top = label_sets(spark, d).where("set_name = 'top25'")
    return gold(spark, d).crossJoin(F.broadcast(top)).select("sent_id", F.array_sort(F.array_intersect("truth", "members")).alias("kept"))


def _labels_of(t: str) -> str:
    return f"SELECT DISTINCT unnest({l_sql('labels')}) AS label FROM {t}"


@query(
    sql=f"SELECT 'both' AS part, label FROM (({_labels_of('tram_train')}) INTERSECT ({_labels_of('bosch_train')})) UNION ALL SELECT 'first', label FROM (({_labels_of('tram_train')}) EXCEPT ({_labels_of('bosch_train')})) UNION ALL SELECT 'any', label FROM (({_labels_of('tram_train')}) UNION ({_labels_of('bosch_train')}))"
)
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    """Labels of both datasets, of the first only, and of any: one grouped pass marks the sides of every label."""
    side = [table(spark, d, t).select(F.explode(st.labels(F.col("labels"))).alias("label"), F.lit(b).alias("b")) for t, b in (("tram_train", 1), ("bosch_train", 2))]
    g = side[0].unionByName(side[1]).groupBy("label").agg(F.bit_or("b").alias("b"))
    parts = F.array_compact(F.array(F.when(F.col("b") == 3, F.lit("both")), F.when(F.col("b") == 1, F.lit("first")), F.lit("any")))
    return g.select(F.explode(parts).alias("part"), "label")


@query(sql=f"{_labels_of('syn_sentence_list')}")
def distinct_exploded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "syn_sentence_list").select(F.explode(st.labels(F.col("labels"))).alias("label")).distinct()


_FREQ = f"SELECT label, count(*) AS n FROM (SELECT unnest(truth) AS label FROM ({GOLD})) GROUP BY label"


def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return gold(spark, d).select(F.explode("truth").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(sql=_FREQ)
def label_freq(spark: SparkSession, d: str) -> DataFrame:
    return label_counts(spark, d).orderBy(F.desc("n"), "label")


@query(sql=f"WITH f AS ({_FREQ}) SELECT label, n, round((SELECT avg(n) FROM f), 6) AS mean, (SELECT median(n) FROM f)::DOUBLE AS median FROM f WHERE n >= (SELECT min(n) FROM (SELECT n FROM f ORDER BY n DESC, label LIMIT 10))")
def label_cut(spark: SparkSession, d: str) -> DataFrame:
    """Labels at least as frequent as the tenth (ties kept), with the mean and median of all."""
    f = label_counts(spark, d)
    kth = f.orderBy(F.desc("n"), "label").limit(10).agg(F.min("n").alias("kth"))
    stats = f.agg(F.round(F.avg("n"), 6).alias("mean"), F.median("n").alias("median"))
    return f.crossJoin(F.broadcast(kth)).crossJoin(F.broadcast(stats)).where("n >= kth").select("label", "n", "mean", "median")


@query(sql=f"SELECT len(truth)::INT AS n_labels, count(*) AS n, min(length(sentence))::INT AS shortest, max(length(sentence))::INT AS longest, round(avg(length(sentence)), 6) AS mean FROM ({GOLD}) GROUP BY 1")
def group_stats(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("sentence")
    return gold(spark, d).groupBy(F.size("truth").alias("n_labels")).agg(F.count(F.lit(1)).alias("n"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("mean"))


@query(sql=f"SELECT doc, sent_id, n FROM (SELECT doc, sent_id, len(pred)::INT AS n, row_number() OVER (PARTITION BY doc ORDER BY len(pred) DESC, sent_id) AS r FROM ({GOLD})) WHERE r = 1")
def best_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The row of each group with the most predictions, the first on ties."""
    n = F.size("pred")
    best = F.min_by(F.struct("sent_id", n.alias("n")), F.struct(-n, "sent_id"))
    return gold(spark, d).groupBy("doc").agg(best.alias("x")).select("doc", "x.sent_id", "x.n")


@query(sql=f"SELECT a, b, count(*) AS n FROM (SELECT sent_id, unnest(list_distinct(truth)) AS a, truth FROM ({GOLD})), LATERAL (SELECT unnest(list_distinct(truth)) AS b) WHERE a < b GROUP BY a, b")
def cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of labels of a sentence; the pairs are made inside the row, not by a self-join."""
    s = F.array_sort(F.array_distinct("truth"))
    pairs = F.flatten(F.transform(s, lambda a, i: F.transform(F.slice(s, i + 2, F.size(s)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return gold(spark, d).select(F.inline(pairs)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query(sql=f"SELECT doc, list_sort(list_distinct(flatten(list(truth)))) AS labels, string_agg(sentence, chr(10) ORDER BY sent_id) AS text, count(*) AS n FROM ({GOLD}) GROUP BY doc")
def doc_rollup(spark: SparkSession, d: str) -> DataFrame:
    g = gold(spark, d)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_id", "sentence"))), lambda x: x["sentence"]), "\n")
    base = g.groupBy("doc").agg(text.alias("text"), F.count(F.lit(1)).alias("n"))
    labs = g.select("doc", F.explode("truth").alias("x")).distinct().groupBy("doc").agg(F.array_sort(F.collect_set("x")).alias("labels"))
    has = F.coalesce("labels", st.empty())
    return base.join(labs, "doc", "left").select("doc", has.alias("labels"), F.when(F.col("text") != "", F.col("text")).alias("text"), "n")


@query(
    sql=f"""
SELECT sentence, list_sort(list_distinct(flatten(list(l)))) AS labels, list_sort(list_distinct(coalesce(flatten(list(e)), []))) AS entities, arg_min(doc, sent_id) AS document, count(*) AS rows
FROM (SELECT sent_id, sentence, {l_sql('labels')} AS l, list_transform(coalesce(entities, []), lambda x: x._1 || ':' || x._2) AS e, coalesce(document_name, '') AS doc FROM bosch_train WHERE sentence IS NOT NULL) GROUP BY sentence
"""
)
def merge_sentences(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "bosch_train").where("sentence IS NOT NULL")
    ents = F.coalesce(F.transform("entities", lambda x: F.concat(x["_1"], F.lit(":"), x["_2"])), st.empty())
    t = t.select("sent_id", "sentence", st.labels(F.col("labels")).alias("l"), F.filter(ents, lambda x: x.isNotNull()).alias("e"), F.coalesce("document_name", F.lit("")).alias("doc"))
    return da.merge_sentences(t, "sentence", "sent_id", "l", "e", "doc")


_ASM = f"SELECT doc, list(sentence ORDER BY sent_id) AS sentences, list(truth ORDER BY sent_id) AS labels FROM (SELECT sent_id, doc, coalesce(sentence, '') AS sentence, truth FROM ({GOLD})) GROUP BY doc"


def _assembled(spark: SparkSession, d: str) -> DataFrame:
    return da.assemble(gold(spark, d).withColumn("sentence", F.coalesce("sentence", F.lit(""))), "doc", "sent_id", "sentence", "truth")


@query(sql=_ASM)
def doc_assemble(spark: SparkSession, d: str) -> DataFrame:
    return _assembled(spark, d)


@query(sql=f"SELECT doc, (generate_subscripts(sentences, 1) - 1)::INT AS pos, unnest(sentences) AS sentence, unnest(labels) AS labels FROM ({_ASM})")
def zip_explode(spark: SparkSession, d: str) -> DataFrame:
    return da.explode_parallel(_assembled(spark, d), "doc", "sentences", "labels")


@query(sql="SELECT event_id, value, round(avg(value) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS running_mean FROM events")
def running_mean(spark: SparkSession, d: str) -> DataFrame:
    return da.running_mean(table(spark, d, "events"), "event_id", "value").withColumn("running_mean", F.round("running_mean", 6))


@query(
    sql=f"""
WITH t AS (SELECT doc AS stem, list(DISTINCT x) AS l FROM (SELECT doc, unnest(truth) AS x FROM ({GOLD})) GROUP BY doc),
p AS (SELECT doc || '.json' AS file, list(DISTINCT x) AS l FROM (SELECT doc, unnest(pred) AS x FROM ({GOLD})) GROUP BY doc)
SELECT stem, len(list_intersect(t.l, p.l))::INT AS hits FROM p JOIN t ON regexp_replace(file, '\\.json$', '') = stem
"""
)
def eval_join(spark: SparkSession, d: str) -> DataFrame:
    """Predictions joined with truth by file stem."""
    g = gold(spark, d)
    t = g.select(F.col("doc").alias("stem"), F.explode("truth").alias("x")).groupBy("stem").agg(F.collect_set("x").alias("t"))
    p = g.select(F.concat("doc", F.lit(".json")).alias("file"), F.explode("pred").alias("x")).groupBy("file").agg(F.collect_set("x").alias("p"))
    return p.withColumn("stem", F.regexp_replace("file", r"\.json\z", "")).join(t, "stem").select("stem", F.size(F.array_intersect("t", "p")).alias("hits"))


_KEYS = "SELECT doc_id, '/data/' || coalesce(source, 'x') || '/' || doc_id || '.txt' AS path FROM documents"


@query(
    sql=f"""
WITH m AS (SELECT CASE doc_id % 3 WHEN 0 THEN '/data/' || coalesce(source, 'x') || '/' || doc_id || '.txt' WHEN 1 THEN doc_id || '.txt' ELSE doc_id::VARCHAR END AS key, coalesce(lang, '?') AS label FROM documents)
SELECT doc_id, coalesce(a.label, b.label, c.label) AS label FROM ({_KEYS}) k LEFT JOIN m a ON a.key = path LEFT JOIN m b ON b.key = doc_id || '.txt' LEFT JOIN m c ON c.key = doc_id::VARCHAR
"""
)
def label_lookup_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Labels of a file by full path, else base name, else stem; the three keys are tried in one join."""
    t = table(spark, d, "documents")
    path = F.concat(F.lit("/data/"), F.coalesce("source", F.lit("x")), F.lit("/"), F.col("doc_id"), F.lit(".txt"))
    key = F.when(F.col("doc_id") % 3 == 0, path).when(F.col("doc_id") % 3 == 1, F.concat("doc_id", F.lit(".txt"))).otherwise(F.col("doc_id").cast("string"))
    m = t.select(key.alias("key"), F.coalesce("lang", F.lit("?")).alias("label"))
    base = F.element_at(F.split(path, "/"), -1)
    tries = t.select("doc_id", F.posexplode(F.array(path, base, F.regexp_replace(base, r"\.txt\z", ""))).alias("ord", "key"))
    return tries.join(m, "key").groupBy("doc_id").agg(F.min_by("label", "ord").alias("label"))


# Token attributes of two annotators: the second differs by a fixed rule.
_ATTR = f"SELECT sent_id, i, 'P' || (length(token) % 5) AS pos_t, 'P' || ((length(token) + (sent_id + i) % 6 // 5) % 5) AS pos_p, 'D' || (i % 3) AS dep_t, 'D' || ((i + (sent_id % 4) // 3) % 3) AS dep_p FROM (SELECT sent_id, unnest(string_split(sentence, ' ')) AS token, generate_subscripts(string_split(sentence, ' '), 1) - 1 AS i FROM tram_train WHERE sentence IS NOT NULL)"


def attributes(spark: SparkSession, d: str) -> DataFrame:
    """``sent_id, i, pos_t, pos_p, dep_t, dep_p`` of every blank-separated token."""
    t = table(spark, d, "tram_train").where("sentence IS NOT NULL").select("sent_id", F.posexplode(F.split("sentence", " ")).alias("i", "token"))
    n = F.length("token")
    slip = F.floor((F.col("sent_id") + F.col("i")) % 6 / 5)
    turn = F.floor(F.col("sent_id") % 4 / 3)
    c = {"pos_t": ("P", n % 5), "pos_p": ("P", (n + slip) % 5), "dep_t": ("D", F.col("i") % 3), "dep_p": ("D", (F.col("i") + turn) % 3)}
    return t.select("sent_id", "i", *[F.concat(F.lit(a), e).alias(k) for k, (a, e) in c.items()])


_LONG = f"SELECT 'pos' AS attr, pos_t AS t, pos_p AS p FROM ({_ATTR}) UNION ALL SELECT 'dep', dep_t, dep_p FROM ({_ATTR})"


@query(
    sql=f"""
WITH l AS (SELECT attr, t, p, count(*) AS n FROM ({_LONG}) GROUP BY ALL),
k AS (SELECT attr, label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT attr, t AS label, CASE WHEN t = p THEN n ELSE 0 END AS tp, 0 AS fp, CASE WHEN t <> p THEN n ELSE 0 END AS fn FROM l UNION ALL SELECT attr, p, 0, CASE WHEN t <> p THEN n ELSE 0 END, 0 FROM l) GROUP BY ALL)
SELECT attr, round(sum(tp / greatest(1, tp + fp) * (tp + fn)) / sum(tp + fn), 6) AS precision, round(sum(tp / greatest(1, tp + fn) * (tp + fn)) / sum(tp + fn), 6) AS recall, sum(tp + fn)::BIGINT AS support FROM k GROUP BY attr
"""
)
def attr_report(spark: SparkSession, d: str) -> DataFrame:
    """Agreement per attribute, weighted by support."""
    pair = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(f"{a}_t").alias("t"), F.col(f"{a}_p").alias("p")) for a in ("pos", "dep")])
    n = attributes(spark, d).select(F.inline(pair)).groupBy("attr", "t", "p").agg(F.count(F.lit(1)).alias("n"))
    same = F.col("t") == F.col("p")
    hit, miss = F.when(same, F.col("n")).otherwise(0), F.when(same, 0).otherwise(F.col("n"))
    zero = F.lit(0).cast("bigint")
    true_side = F.struct(F.col("t").alias("label"), hit.alias("tp"), zero.alias("fp"), miss.alias("fn"))
    pred_side = F.struct(F.col("p").alias("label"), zero.alias("tp"), miss.alias("fp"), zero.alias("fn"))
    sides = F.array(true_side, pred_side)
    k = n.select("attr", F.inline(sides)).groupBy("attr", "label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    s = F.col("tp") + F.col("fn")
    w = k.groupBy("attr").agg(F.sum(st.precision(F.col("tp"), F.col("fp")) * s).alias("a"), F.sum(st.recall(F.col("tp"), F.col("fn")) * s).alias("b"), F.sum(s).alias("support"))
    return w.select("attr", F.round(F.col("a") / F.col("support"), 6).alias("precision"), F.round(F.col("b") / F.col("support"), 6).alias("recall"), "support")


@query(sql=f"SELECT pos_t AS truth, pos_p AS pred, count(*) AS n FROM ({_ATTR}) WHERE pos_t <> 'P0' GROUP BY ALL")
def token_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Confusion counts of tokens, padding (P0) left out."""
    return attributes(spark, d).where("pos_t <> 'P0'").groupBy(F.col("pos_t").alias("truth"), F.col("pos_p").alias("pred")).agg(F.count(F.lit(1)).alias("n"))


# Spans of two annotators over the same tokens, by rule.
_TS = f"SELECT sent_id, i::INT AS start, (i + 2)::INT AS \"end\", CASE WHEN i % 9 = 0 THEN 'ATTACK' ELSE 'T' || (i % 4) END AS label FROM ({_ATTR}) WHERE (i + sent_id) % 6 = 0"
_PS = f"SELECT sent_id, i::INT AS start, (i + 2)::INT AS \"end\", 'T' || ((i + (sent_id % 5) // 4) % 4) AS label FROM ({_ATTR}) WHERE (i + sent_id) % 6 = 0 AND i % 5 <> 0 OR (i + sent_id) % 11 = 0"


def span_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = attributes(spark, d).select("sent_id", "i")
    i, s = F.col("i"), F.col("sent_id")
    bounds = ["sent_id", i.alias("start"), (i + 2).alias("end")]
    t = a.where((i + s) % 6 == 0).select(*bounds, F.when(i % 9 == 0, "ATTACK").otherwise(F.concat(F.lit("T"), i % 4)).alias("label"))
    p = a.where(((i + s) % 6 == 0) & (i % 5 != 0) | ((i + s) % 11 == 0)).select(*bounds, F.concat(F.lit("T"), (i + F.floor(s % 5 / 4)) % 4).alias("label"))
    return t, p


@query(sql=f'SELECT sent_id, start, "end", t.label AS truth, p.label AS pred FROM ({_TS}) t FULL JOIN ({_PS}) p USING (sent_id, start, "end")')
def entity_outer(spark: SparkSession, d: str) -> DataFrame:
    t, p = span_sides(spark, d)
    return t.withColumnRenamed("label", "truth").join(p.withColumnRenamed("label", "pred"), ["sent_id", "start", "end"], "full")


_SPAN = f"""
SELECT sent_id, label, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM (
  SELECT sent_id, unnest(CASE WHEN t IS NOT NULL AND p IS NOT NULL AND (t = 'ATTACK' OR list_contains(p, t)) THEN [{{'label': t, 'tp': 1, 'fp': 0, 'fn': 0}}]
    ELSE list_concat(list_transform(coalesce(p, []), lambda x: {{'label': x, 'tp': 0, 'fp': 1, 'fn': 0}}), CASE WHEN p IS NULL THEN [{{'label': t, 'tp': 0, 'fp': 0, 'fn': 1}}] ELSE [] END) END, recursive := true)
  FROM (SELECT * FROM (SELECT sent_id, start, "end", label AS t FROM ({_TS})) FULL JOIN (SELECT sent_id, start, "end", list(DISTINCT label) AS p FROM ({_PS}) GROUP BY ALL) USING (sent_id, start, "end"))) GROUP BY ALL
"""


@query(sql=f"SELECT sent_id, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM ({_SPAN}) GROUP BY sent_id")
def span_eval(spark: SparkSession, d: str) -> DataFrame:
    t, p = span_sides(spark, d)
    return me.span_scores(t, p, "sent_id").groupBy("sent_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


@query(sql=f"SELECT coalesce(label, 'Total') AS label, tp, fp, fn, {_RATES} FROM (SELECT label, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM ({_SPAN}) GROUP BY ROLLUP (label))")
def span_eval_label(spark: SparkSession, d: str) -> DataFrame:
    t, p = span_sides(spark, d)
    counts = me.span_scores(t, p, "sent_id").groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return me.with_total(counts, "label", "Total")
