"""Queries over texts: scans, cleaning, splitting, indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import indicators as ioc
from skarn.functions import text as tx
from skarn.plans.registry import query
from skarn.runtime import table


def _sq(s: str) -> str:
    """A text as an SQL literal."""
    return "'" + s.replace("'", "''") + "'"


def _chain(col: str, pairs) -> str:
    """The same replacements as in the column expressions, for the other engine."""
    for a, b in pairs:
        col = f"regexp_replace({col}, {_sq(a)}, {_sq(b)}, 'g')"
    return col


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _map(name: str, sql_expr: str, expr, out: str) -> None:
    """A query that maps every document's text to one value."""
    query(name, f"SELECT doc_id, {sql_expr} AS {out} FROM documents WHERE text IS NOT NULL")(
        lambda spark, d: docs(spark, d).where("text IS NOT NULL").select("doc_id", expr(F.col("text")).alias(out))
    )


@query(sql="SELECT doc_id, text, length(text)::BIGINT AS chars FROM documents WHERE text IS NOT NULL AND text <> ''")
def scan_documents(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).where("text IS NOT NULL AND text <> ''").select("doc_id", "text", F.length("text").cast("bigint").alias("chars"))


@query(sql="SELECT doc_id, json_object('doc_id', doc_id, 'lang', lang, 'source', source, 'n_chars', n_chars) AS body FROM documents")
def doc_to_json(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.to_json(F.struct("doc_id", "lang", "source", "n_chars"), {"ignoreNullFields": "false"}).alias("body"))


_LINES = "list_transform(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^[ \\t]+|[ \\t]+$', '', 'g'))"
_map("normalize_lines", f"array_to_string(list_filter({_LINES}, lambda x: x <> ''), chr(10))", tx.normalize_lines, "lines")
_map(
    "add_punctuation",
    "CASE WHEN length(text) > 0 AND contains(',.?!:;', right(text, 1)) THEN text ELSE regexp_replace(text, '[ \\t\\r\\n]+$', '') || '.' END",
    tx.add_punctuation,
    "closed",
)
_PARAS = "string_split_regex(text, '\\n[ \\t]*\\n[ \\t\\n]*')"
_map(
    "paragraph_close",
    f"array_to_string(list_transform({_PARAS}, lambda p: CASE WHEN regexp_matches(p, '[.,?!:;''\"()\\[\\]{{}}]$') THEN p ELSE p || '.' END), chr(10) || chr(10))",
    tx.close_paragraphs,
    "closed",
)
_CLEAR = "replace(replace(replace(replace(lower(text), '\\n', chr(10)), '\\t', ' '), '\\r', ' '), chr(9), ' ')"
_map(
    "clear_text",
    f"regexp_replace(replace(regexp_replace(trim(regexp_replace({_CLEAR}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '(\\\\*x[0-9a-f]{{2}}){{2,}}', ' ', 'g'), 'windows nt', 'windowsnt'), '[^\\x00-\\x7F]', '', 'g')",
    tx.clear_text,
    "clean",
)
_map("mask_iocs", _chain("text", ioc.MASKS), ioc.mask, "masked")
_map("refang", _chain("text", ioc.REFANG), ioc.refang, "plain")


@query(
    sql="""
SELECT doc_id, pos::INT AS pos, s AS sentence FROM (
  SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS pos FROM (
    SELECT doc_id, list_filter(string_split(regexp_replace(replace(regexp_replace(text, '\\n+', chr(10), 'g'), chr(9), ' '), '([.!?]) +', '\\1' || chr(10), 'g'), chr(10)), lambda s: replace(s, ' ', '') <> '') AS l
    FROM documents WHERE text IS NOT NULL))
"""
)
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", F.posexplode(tx.sentences_by_rule(F.col("text"))).alias("pos", "sentence"))


@query(
    sql="""
SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS pos, unnest(l) AS sentence
FROM (SELECT doc_id, string_split(replace(text, chr(10), ' '), '. ') AS l FROM documents WHERE text IS NOT NULL)
"""
)
def sentence_split_period(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", F.posexplode(tx.sentences_by_period(F.col("text"))).alias("pos", "sentence"))


@query(
    sql="""
SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS pos, unnest(l) AS paragraph
FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\n{2,}'), lambda p: p <> '') AS l FROM documents WHERE text IS NOT NULL)
"""
)
def para_split(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", F.posexplode(tx.split_breaks(F.col("text"))).alias("pos", "paragraph"))


@query(
    sql="""
SELECT doc_id, i::INT AS start, substring(text, i + 1, 500) AS chunk
FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 20, 0), 480)) AS i FROM documents WHERE text IS NOT NULL)
"""
)
def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", F.inline(tx.char_chunks(F.col("text"))))


_WORDS = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '')"


@query(
    sql=f"""
SELECT doc_id, (i // 64)::INT AS pos, array_to_string(l[i + 1 : i + 64], ' ') AS chunk
FROM (SELECT doc_id, l, unnest(range(0, len(l), 64)) AS i FROM (SELECT doc_id, {_WORDS} AS l FROM documents WHERE text IS NOT NULL))
"""
)
def chunk_tokens(spark: SparkSession, d: str) -> DataFrame:
    parts = tx.token_chunks(tx.words(F.col("text")), 64)
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", F.posexplode(parts).alias("pos", "c")).select("doc_id", "pos", F.array_join("c", " ").alias("chunk"))


def _catalog_sql(value: str) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, {_sq(k)} AS kind, unnest(regexp_extract_all(text, {_sq(p)})) AS {value} FROM documents WHERE text IS NOT NULL" for k, p in ioc.CATALOG)


@query(sql=_catalog_sql("value"))
def ioc_extract(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.inline(ioc.indicators(F.col("text"))))


@query(sql=f"SELECT kind, count(*) AS hits, count(DISTINCT lower(value)) AS values, count(DISTINCT doc_id) AS docs FROM ({_catalog_sql('value')}) GROUP BY kind")
def ioc_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hits, different values and documents per kind: counted per value first, so that no distinct expands the hits."""
    hits = docs(spark, d).select(ioc.indicators(F.col("text")).alias("x"))
    none = F.lit(None).cast("string")
    one = F.transform("x", lambda h: F.struct(h["kind"].alias("kind"), F.lower(h["value"]).alias("value"), F.lit(1).alias("n"), F.lit(0).alias("d")))
    kinds = F.transform(F.array_distinct(F.transform("x", lambda h: h["kind"])), lambda k: F.struct(k.alias("kind"), none.alias("value"), F.lit(0).alias("n"), F.lit(1).alias("d")))
    per = hits.select(F.inline(F.concat(one, kinds))).groupBy("kind", "value").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    return per.groupBy("kind").agg(F.sum("n").alias("hits"), F.count("value").alias("values"), F.sum("d").alias("docs"))


@query(sql=f"SELECT doc_id, unnest(regexp_extract_all(text, {_sq(ioc.PATTERN['URL'])})) AS url FROM documents WHERE text IS NOT NULL")
def url_extract(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.explode(ioc.found(F.col("text"), "URL")).alias("url"))


@query(
    sql=f"""
WITH c AS (SELECT DISTINCT technique_id FROM rag_db WHERE regexp_matches(technique_id, '^T[0-9]{{4}}(\\.[0-9]{{3}})?\\z'))
SELECT DISTINCT doc_id, id FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_sq(ioc.TECHNIQUE_ID)})) AS id FROM documents WHERE text IS NOT NULL) JOIN c ON id = technique_id
UNION ALL
SELECT DISTINCT -syn_id, id FROM (SELECT syn_id, unnest(labels) AS id FROM syn_sentence_list) JOIN c ON id = technique_id
"""
)
def extract_ids(spark: SparkSession, d: str) -> DataFrame:
    """Technique ids in documents and in label text, kept if the concept table knows them."""
    known = table(spark, d, "rag_db").where(F.col("technique_id").rlike(r"^T[0-9]{4}(\.[0-9]{3})?\z")).select(F.col("technique_id").alias("id")).distinct()
    a = docs(spark, d).select("doc_id", F.explode(ioc.technique_ids(F.col("text"))).alias("id"))
    b = table(spark, d, "syn_sentence_list").select((-F.col("syn_id")).alias("doc_id"), F.explode(F.array_distinct("labels")).alias("id"))
    return a.unionByName(b).join(known, "id", "left_semi").select("doc_id", "id")


@query(sql="SELECT sent_id, list_sort(list_filter(labels, lambda x: regexp_matches(x, '^(?:T|TA)[0-9]{4}'))) AS kept FROM tram_train WHERE labels IS NOT NULL")
def label_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = F.filter("labels", lambda x: x.rlike(r"^(?:T|TA)[0-9]{4}"))
    return table(spark, d, "tram_train").where("labels IS NOT NULL").select("sent_id", F.array_sort(kept).alias("kept"))


# Token rules of the entity tagger, in order.
TOKEN_RULES = (
    ("actor", "apt[a-z0-9-]+|actors*|attackers*"),
    ("executable", "executables*|payloads*|malwares*|stagers*|scripts*|commands*|ssh|scp"),
    ("file", "files*|documents*|attachments*"),
    ("network", "network|hosts*|urls*|e-*mails*|dns|c2"),
    ("registry", "registry"),
    ("vulnerability", "exploit|vulnerability"),
    ("system", "tasks*|driver|system|service|credentials*"),
)
_RULE_SQL = "CASE " + " ".join(f"WHEN regexp_full_match(w, '{p}') THEN '{k}'" for k, p in TOKEN_RULES) + " END"


@query(
    sql=f"""
SELECT kind, w AS word, count(*) AS n FROM (SELECT w, {_RULE_SQL} AS kind FROM (SELECT unnest({_WORDS}) AS w FROM documents WHERE text IS NOT NULL))
WHERE kind IS NOT NULL GROUP BY ALL
"""
)
def token_rules(spark: SparkSession, d: str) -> DataFrame:
    """Entity types of tokens by the first rule that matches the whole token; each different token is tested once."""
    n = docs(spark, d).select(F.explode(tx.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    kind = F.coalesce(*[F.when(F.col("word").rlike(f"^(?:{p})$"), F.lit(k)) for k, p in TOKEN_RULES])
    return n.select(kind.alias("kind"), "word", "n").where("kind IS NOT NULL")


# Pages are made of the documents: no table holds raw HTML.
_PAGE_SQL = "'<html><head><title>' || coalesce(title, '') || '</title></head><body><h1>' || coalesce(title, '') || '</h1><p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), chr(10) || chr(10), '</p><p>') || '</p></body></html>'"


def pages(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, url, html``: every document wrapped as a page of its source."""
    body = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n\n"), F.lit("</p><p>"))
    t = F.coalesce("title", F.lit(""))
    html = F.concat(F.lit("<html><head><title>"), t, F.lit("</title></head><body><h1>"), t, F.lit("</h1><p>"), body, F.lit("</p></body></html>"))
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", F.concat(F.lit("https://www."), F.coalesce("source", F.lit("unknown")), F.lit(".com/reports/"), F.col("doc_id")).alias("url"), html.alias("html"))


@query(sql=f"SELECT doc_id, regexp_extract({_PAGE_SQL}, '(?is)<title[^>]*>(.*?)</title>', 1) AS page_title FROM documents WHERE text IS NOT NULL")
def html_title(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("doc_id", tx.html_title(F.col("html")).alias("page_title"))


@query(
    sql="""
SELECT doc_id, CASE WHEN starts_with(text, '%PDF') THEN 'pdf' WHEN starts_with(text, 'PK') THEN 'zip'
  WHEN regexp_matches(text, '(?i)^[ \\t\\r\\n]*(?:<!doctype html|<html|<head|<body)') THEN 'html'
  WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 'unicode' ELSE 'ascii' END AS kind
FROM documents WHERE text IS NOT NULL
"""
)
def page_sniff(spark: SparkSession, d: str) -> DataFrame:
    """The kind of a document from its first bytes."""
    from skarn.sources.readers import sniff

    return docs(spark, d).where("text IS NOT NULL").select("doc_id", sniff(F.col("text")).alias("kind"))


# The literature filter's words, matched anywhere in a venue.
VENUE_WORDS = ("bio", "medical", "medicine", "biomedical", "health", "nature", "energy", "sensors", "sunrise", "radio", "clinical", "law", "behavior", "cognition", "liver", "blood", "multimedia")

_TITLE_SQL = "title"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _TITLE_SQL = f"replace({_TITLE_SQL}, '{_a}', '{_b}')"
_TITLE_SQL = f"regexp_replace(lower({_TITLE_SQL}), '[!\"#$%''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{{|}}~]', '', 'g')"
_MERGED = f"SELECT paper_id, t AS title, venue, pub_year FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY paper_id) AS r FROM (SELECT *, {_TITLE_SQL} AS t FROM paper_rows)) WHERE r = 1"


def merged_papers(spark: SparkSession, d: str) -> DataFrame:
    """Papers by normalized title, the smallest id of each kept."""
    rows = table(spark, d, "paper_rows").withColumn("title", tx.strip_title(F.col("title")))
    return rows.groupBy("title").agg(F.min_by(F.struct("paper_id", "venue", "pub_year"), "paper_id").alias("p")).select("p.paper_id", "title", "p.venue", "p.pub_year")


@query(sql=_MERGED)
def papers_merge(spark: SparkSession, d: str) -> DataFrame:
    return merged_papers(spark, d).orderBy("pub_year", "title")


@query(
    sql=f"SELECT paper_id, title, venue, try_cast(pub_year AS DOUBLE) AS year FROM ({_MERGED}) WHERE try_cast(pub_year AS DOUBLE) >= 2015 AND NOT regexp_matches(lower(coalesce(venue, '')), '{'|'.join(VENUE_WORDS)}')"
)
def papers_filter(spark: SparkSession, d: str) -> DataFrame:
    year = F.expr("try_cast(pub_year AS DOUBLE)")
    out = F.exists(F.array(*map(F.lit, VENUE_WORDS)), lambda w: F.contains(F.lower(F.coalesce("venue", F.lit(""))), w))
    return merged_papers(spark, d).where((year >= 2015) & ~out).select("paper_id", "title", "venue", year.alias("year"))
