"""Queries that build datasets, prompts and configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skarn.functions import prompts as pr
from skarn.functions import sets as st
from skarn.operators import datasets as da
from skarn.plans.q_metrics import GOLD, gold, l_sql
from skarn.plans.registry import query
from skarn.runtime import table


@query(sql="SELECT paper_id, seg AS segment, regexp_matches(seg, '^[TSMGa-z]') AS kept FROM (SELECT paper_id, string_split(url, '/')[-1] AS seg FROM paper_rows WHERE url IS NOT NULL)")
def url_last_segment(spark: SparkSession, d: str) -> DataFrame:
    seg = F.element_at(F.split("url", "/"), -1)
    return table(spark, d, "paper_rows").where("url IS NOT NULL").select("paper_id", seg.alias("segment"), seg.rlike("^[TSMGa-z]").alias("kept"))


@query(
    sql=f"""
WITH t AS (SELECT DISTINCT upper(regexp_replace(technique_id, '^\\s+|\\s+$', '', 'g')) AS id, min(concept_name) AS name FROM rag_db WHERE technique_id IS NOT NULL GROUP BY 1)
SELECT c.id, CASE WHEN p.name IS NOT NULL THEN p.name || ' (' || coalesce(c.name, '') || ')' ELSE c.name END AS title FROM t c LEFT JOIN t p ON contains(c.id, '.') AND p.id = split_part(c.id, '.', 1)
"""
)
def parent_title(spark: SparkSession, d: str) -> DataFrame:
    """Sub-techniques are titled ``Parent (Sub)``."""
    ids = F.upper(F.regexp_replace("technique_id", r"^\s+|\s+$", ""))
    t = table(spark, d, "rag_db").where("technique_id IS NOT NULL").groupBy(ids.alias("id")).agg(F.min("concept_name").alias("name"))
    p = t.select(F.col("id").alias("p_id"), F.col("name").alias("p_name"))
    up = F.when(F.contains("id", F.lit(".")), F.substring_index("id", ".", 1))
    titled = F.when(F.col("p_name").isNotNull(), F.concat("p_name", F.lit(" ("), F.coalesce("name", F.lit("")), F.lit(")"))).otherwise(F.col("name"))
    return t.join(p, up == F.col("p_id"), "left").select("id", titled.alias("title"))


# The roles and the instruction of the prompts.
_ASK = "List the technique ids that this sentence describes."


@query(
    sql=f"""
WITH r AS (SELECT list(x ORDER BY k, x) AS top FROM (SELECT category || ' ' || round(target_share, 5)::VARCHAR AS x, -target_share AS k FROM label_targets WHERE category <> 'NO_TTP' ORDER BY k, x LIMIT 6))
SELECT sent_id, '{_ASK}' || chr(10) || array_to_string(list_transform(top, lambda y: split_part(y, ' ', 1)), ', ') || chr(10) || sentence AS prompt FROM ({GOLD}), r WHERE sentence IS NOT NULL
"""
)
def prompt_build(spark: SparkSession, d: str) -> DataFrame:
    """A retrieval prompt: the instruction, at most six allowed entries, the sentence."""
    x = F.concat("category", F.lit(" "), F.round("target_share", 5).cast("string"))
    six = table(spark, d, "label_targets").where("category <> 'NO_TTP'").select("category", (-F.col("target_share")).alias("k"), x.alias("x")).orderBy("k", "x").limit(6)
    top = six.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "x", "category"))), lambda s: s["category"]), ", ").alias("top"))
    return gold(spark, d).where("sentence IS NOT NULL").crossJoin(F.broadcast(top)).select("sent_id", F.concat_ws("\n", F.lit(_ASK), "top", "sentence").alias("prompt"))


def _p_sql(kind: str, text: str, entries: str = "''", few: bool = False) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "' || chr(10) || "
    shots = "".join(q(x) for x in ["Examples, which have nothing to do with the text to analyse:", *(f'- "{s}" -> {a}' for s, a in pr.EXAMPLES)]) if few else ""
    return q(pr.ASK[kind]) + (f"{entries} || chr(10) || " if entries != "''" else "") + shots + f"'`' || {text} || '`'"


@query(sql=f"SELECT doc_id, {_p_sql('report', 'text')} AS prompt FROM documents WHERE text IS NOT NULL")
def prompt_base(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", pr.ask("report", F.col("text")).alias("prompt"))


@query(sql=f"SELECT sent_id, {_p_sql('sentence', 'sentence', few=True)} AS prompt FROM tram_test WHERE sentence IS NOT NULL")
def prompt_few_shot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tram_test").where("sentence IS NOT NULL").select("sent_id", pr.ask("sentence", F.col("sentence"), few_shot=True).alias("prompt"))


@query(sql=f"SELECT sent_id, {_p_sql('sentence', 'sentence')} AS prompt FROM tram_test WHERE sentence IS NOT NULL")
def prompt_sentence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tram_test").where("sentence IS NOT NULL").select("sent_id", pr.ask("sentence", F.col("sentence")).alias("prompt"))


_ENTRY = "SELECT DISTINCT ON (id) id, '- ' || id || ' - ' || coalesce(concept_name, '') || ': ' || coalesce(string_split(description, chr(10))[1], '') AS line FROM (SELECT upper(regexp_replace(technique_id, '^\\s+|\\s+$', '', 'g')) AS id, concept_name, description, rag_id FROM rag_db WHERE technique_id IS NOT NULL) ORDER BY id, rag_id"


@query(
    sql=f"""
SELECT sent_id, {_p_sql('judge', 'sentence', 'lines')} AS prompt FROM (SELECT sent_id, any_value(sentence) AS sentence, string_agg(line, chr(10) ORDER BY line) AS lines
FROM (SELECT DISTINCT sent_id, sentence, unnest(truth) AS id FROM ({GOLD}) WHERE sentence IS NOT NULL) JOIN ({_ENTRY}) USING (id) GROUP BY sent_id)
"""
)
def prompt_judge(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of a sentence that the concept table knows, with the first line of their descriptions."""
    c = table(spark, d, "rag_db").where("technique_id IS NOT NULL").select(F.upper(F.regexp_replace("technique_id", r"^\s+|\s+$", "")).alias("id"), "concept_name", "description", "rag_id")
    c = c.groupBy("id").agg(F.min_by(F.struct("concept_name", "description"), "rag_id").alias("x")).select("id", pr.entry(F.col("id"), F.col("x.concept_name"), F.col("x.description")).alias("line"))
    g = gold(spark, d).where("sentence IS NOT NULL")
    lines = g.select("sent_id", F.explode(F.array_distinct("truth")).alias("id")).join(c, "id").groupBy("sent_id").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return g.join(lines, "sent_id").select("sent_id", pr.ask("judge", F.col("sentence"), entries=F.col("lines")).alias("prompt"))


# Answer templates, chosen by id.
_TEMPLATES = ("The sentence shows: ", "Techniques: ", "Found: ")
_ANSWER = f"CASE WHEN len(truth) = 0 THEN 'NO_TTP' ELSE [{', '.join(repr(t) for t in _TEMPLATES)}][sent_id % 3 + 1] || array_to_string(truth, ', ') END"


def chats(spark: SparkSession, d: str) -> DataFrame:
    g = gold(spark, d).where("sentence IS NOT NULL")
    answer = F.when(F.size("truth") == 0, "NO_TTP").otherwise(F.concat(F.get(F.array(*map(F.lit, _TEMPLATES)), (F.col("sent_id") % 3).cast("int")), F.array_join("truth", ", ")))
    turns = F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", F.lit(_ASK)), ("user", F.col("sentence")), ("assistant", answer))])
    return g.select("sent_id", turns.alias("messages"))


_CHAT = f"SELECT sent_id, [{{'role': 'system', 'content': '{_ASK}'}}, {{'role': 'user', 'content': sentence}}, {{'role': 'assistant', 'content': {_ANSWER}}}] AS messages FROM ({GOLD}) WHERE sentence IS NOT NULL"


@query(sql=f"SELECT sent_id, m.role AS role, m.content AS content FROM (SELECT sent_id, unnest(messages) AS m FROM ({_CHAT}))")
def chat_build(spark: SparkSession, d: str) -> DataFrame:
    return chats(spark, d).select("sent_id", F.inline("messages"))


@query(sql=f"SELECT sent_id, array_to_string(list_transform(messages, lambda m: '<|' || m.role || '|>' || chr(10) || m.content), chr(10)) AS text FROM ({_CHAT})")
def chat_flatten(spark: SparkSession, d: str) -> DataFrame:
    return chats(spark, d).select("sent_id", F.array_join(F.transform("messages", lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"])), "\n").alias("text"))


@query(sql="SELECT event_id, 1 / (1 + exp(-(value - 20) / 10)) > 0.5 AS hit FROM events")
def sigmoid_threshold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", (1 / (1 + F.exp(-(F.col("value") - 20) / 10)) > 0.5).alias("hit"))


_GRID = {"model": ["base", "large"], "rate": [0.00001, 0.00002, 0.00005], "batch": [8, 16], "epochs": [3, 5]}


@query(
    sql="SELECT row_number() OVER (ORDER BY model, rate, batch, epochs)::INT AS run, model, rate, batch, epochs FROM (SELECT unnest(['base', 'large']) AS model), (SELECT unnest([0.00001, 0.00002, 0.00005])::DOUBLE AS rate), (SELECT unnest([8, 16])::INT AS batch), (SELECT unnest([3, 5])::INT AS epochs)"
)
def param_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every combination of the settings, numbered; a table of fixed size."""
    out = spark.range(1)
    for k, v in _GRID.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, v))).alias(k))
    return out.select(F.row_number().over(W.orderBy(*_GRID)).alias("run"), *_GRID)


_D = "coalesce(trim(doc_title), '')"


@query(sql=f"SELECT sent_id FROM tram_train_augmented_artificial WHERE {_D} NOT IN (SELECT DISTINCT {_D} FROM tram_test)")
def split_anti(spark: SparkSession, d: str) -> DataFrame:
    """Augmented rows of documents that the test split doesn't have."""
    doc = F.coalesce(F.trim("doc_title"), F.lit("")).alias("doc")
    test = table(spark, d, "tram_test").select(doc).distinct()
    return table(spark, d, "tram_train_augmented_artificial").select("sent_id", doc).join(test, "doc", "left_anti").select("sent_id")


@query(sql=f"WITH s AS (SELECT doc, count(*) AS n FROM ({GOLD}) GROUP BY doc) SELECT doc, n, CASE WHEN sum(n) OVER (ORDER BY md5(doc || '7'), doc ROWS UNBOUNDED PRECEDING) <= 0.2 * (SELECT sum(n) FROM s) THEN 'test' ELSE 'train' END AS split FROM s")
def split_by_doc(spark: SparkSession, d: str) -> DataFrame:
    return da.split_by_documents(gold(spark, d), "doc", 0.2)


@query(sql="SELECT sent_id, CASE WHEN ((sent_id * 48271) % 2147483647) % 100 < 80 THEN 'train' ELSE 'test' END AS split FROM tram_train")
def split_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tram_train").select("sent_id", F.when(da.spread(F.col("sent_id"), 100) < 80, "train").otherwise("test").alias("split"))


_SPREAD = "((sent_id * 48271) % 2147483647) % 2147483647"
_EXP = f"SELECT sent_id, label FROM (SELECT sent_id, unnest(list_distinct(truth)) AS label FROM ({GOLD}))"


@query(sql=f"SELECT label, sent_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_SPREAD}, sent_id) AS r FROM ({_EXP})) WHERE r <= 5")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    x = gold(spark, d).select("sent_id", F.explode(F.array_distinct("truth")).alias("label"))
    return da.sample_per_label(x, "label", "sent_id", 5).select("label", "sent_id")


@query(
    sql=f"WITH c AS (SELECT sent_id, (len(truth) > 0)::INT AS y FROM ({GOLD})), m AS (SELECT min(n) AS k FROM (SELECT y, count(*) AS n FROM c GROUP BY y)) SELECT y, sent_id FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {_SPREAD}, sent_id) AS r FROM c), m WHERE r <= k"
)
def balance_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every class cut to the size of the smallest.

    The cut is a value of the spread key, found from counts of its high part, so no class is sorted in one task.
    """
    key = da.spread(F.col("sent_id"), 2147483647)
    c = gold(spark, d).select("sent_id", (F.size("truth") > 0).cast("int").alias("y"), key.alias("k")).withColumn("b", F.floor(F.col("k") / (1 << 19)))
    n = c.groupBy("y", "b").agg(F.count(F.lit(1)).alias("n"))  # at most 4096 rows per class
    size = n.groupBy("y").agg(F.sum("n").alias("n")).agg(F.min("n").alias("size"))
    before = n.withColumn("before", F.sum("n").over(W.partitionBy("y").orderBy("b")) - F.col("n")).crossJoin(F.broadcast(size))
    x = c.join(F.broadcast(before.where("before < size")), ["y", "b"])
    inside = F.row_number().over(W.partitionBy("y", "b").orderBy("k", "sent_id"))
    return x.withColumn("r", F.col("before") + inside).where("r <= size").select("y", "sent_id")


@query(
    sql="SELECT sent_id, sentence, doc, entities FROM (SELECT sent_id, sentence, coalesce(doc_title, '?') AS doc, -1::BIGINT AS entities FROM tram_train UNION ALL SELECT sent_id, sentence, coalesce(document_name, '?'), coalesce(len(entities), -1)::BIGINT FROM bosch_train)"
)
def union_fill(spark: SparkSession, d: str) -> DataFrame:
    """Two datasets with different columns under one schema; what one lacks is filled."""
    a = table(spark, d, "tram_train").select("sent_id", "sentence", F.col("doc_title").alias("doc"))
    b = table(spark, d, "bosch_train").select("sent_id", "sentence", F.col("document_name").alias("doc"), F.when(F.col("entities").isNotNull(), F.size("entities")).cast("bigint").alias("entities"))
    return a.unionByName(b, allowMissingColumns=True).fillna({"doc": "?", "entities": -1})


@query(sql="SELECT sentence, sent_id, doc_title FROM (SELECT *, row_number() OVER (PARTITION BY sentence ORDER BY sent_id) AS r FROM tram_train) WHERE r = 1")
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return da.first_of(table(spark, d, "tram_train"), "sentence", "sent_id", "doc_title")


@query(
    sql="SELECT event_id, user_id, json_extract_string(props, '$.k')::INT AS k, event_type = 'click' AS source_click, event_type = 'error' AS source_error, event_type = 'view' AS source_view FROM events"
)
def props_onehot(spark: SparkSession, d: str) -> DataFrame:
    """A nested property flattened, with one boolean column per source."""
    flags = [(F.col("event_type") == s).alias(f"source_{s}") for s in ("click", "error", "view")]
    return table(spark, d, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("int").alias("k"), *flags)


@query(sql=f"SELECT ds, count(*) FILTER (WHERE label = 'T2263') AS \"T2263\", count(*) FILTER (WHERE label = 'T2144') AS \"T2144\", count(*) FILTER (WHERE label = 'T2216') AS \"T2216\" FROM (SELECT 'tram' AS ds, unnest({l_sql('labels')}) AS label FROM tram_train UNION ALL SELECT 'bosch', unnest({l_sql('labels')}) FROM bosch_train) GROUP BY ds")
def pivot_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Labels as columns, datasets as rows."""
    parts = [table(spark, d, t).select(F.lit(n).alias("ds"), F.explode(st.labels(F.col("labels"))).alias("label")) for t, n in (("tram_train", "tram"), ("bosch_train", "bosch"))]
    return parts[0].unionByName(parts[1]).groupBy("ds").pivot("label", ["T2263", "T2144", "T2216"]).agg(F.count(F.lit(1))).fillna(0)
