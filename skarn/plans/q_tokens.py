"""Queries over tokens, dictionaries, spans and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skarn.functions import indicators as ioc
from skarn.functions.text import words
from skarn.operators import datasets as da
from skarn.operators import dictionary as dic
from skarn.operators import spans as sp
from skarn.operators import tokens as tk
from skarn.plans.registry import query
from skarn.runtime import ship, table

#: Words of a text in the other engine.
def w_sql(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '[^a-z0-9]+'), lambda w: w <> '')"


_TOK = f"SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, {w_sql('text')} AS l FROM documents WHERE text IS NOT NULL)"
SENT = f"SELECT sent_id, doc_title, sentence, {w_sql('sentence')} AS l FROM tram_train WHERE sentence IS NOT NULL"


def doc_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tk.token_table(table(spark, d, "documents"), "doc_id", "text")


def sents(spark: SparkSession, d: str) -> DataFrame:
    """Training sentences with their words: ``sent_id, doc_title, sentence, l``."""
    return table(spark, d, "tram_train").where("sentence IS NOT NULL").select("sent_id", "doc_title", "sentence", words(F.col("sentence")).alias("l"))


@query(sql=f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({_TOK}) GROUP BY token")
def word_count(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and documents of every word; the document count comes from per-document counts, not from a distinct."""
    per_doc = tk.word_counts(doc_tokens(spark, d), "doc_id")
    return per_doc.groupBy("token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


@query(sql=f"SELECT doc_id, count(*) AS n, count(DISTINCT token) AS kinds FROM ({_TOK}) GROUP BY doc_id")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    w = words(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(w).cast("bigint").alias("n"), F.size(F.array_distinct(w)).cast("bigint").alias("kinds")).where("n > 0")


_TOP = f"SELECT token, n FROM (SELECT token, count(*) AS n FROM ({_TOK}) GROUP BY token ORDER BY n DESC, token LIMIT 200) WHERE n >= 20"
_SPECIAL = "SELECT unnest(['[PAD]', '[UNK]', '[CLS]', '[SEP]', '[MASK]']) AS token"
_VOCAB = f"WITH top AS ({_TOP}) SELECT token, n FROM top UNION ALL SELECT token, 0 FROM ({_SPECIAL}) WHERE token NOT IN (SELECT token FROM top)"


def vocab(spark: SparkSession, d: str) -> DataFrame:
    return tk.vocabulary(tk.word_counts(doc_tokens(spark, d)), 200, 20)


@query(sql=_VOCAB)
def vocab_topk(spark: SparkSession, d: str) -> DataFrame:
    return vocab(spark, d)


@query(
    sql=f"""
SELECT token, sum(n)::BIGINT AS n FROM (
  SELECT token, count(*) AS n FROM ({_TOK}) GROUP BY token
  UNION ALL SELECT unnest(l), 1 FROM ({SENT})) GROUP BY token
"""
)
def vocab_merge(spark: SparkSession, d: str) -> DataFrame:
    a = tk.word_counts(doc_tokens(spark, d))
    b = tk.word_counts(sents(spark, d).select(F.explode("l").alias("token")))
    return tk.merge_vocabularies(a, b)


@query(
    sql=f"""
WITH v AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS idx FROM ({_VOCAB})),
t AS (SELECT sent_id, unnest(l) AS token, generate_subscripts(l, 1) AS i FROM ({SENT}))
SELECT sent_id, list(coalesce(idx, (SELECT idx FROM v WHERE token = '[UNK]'))::INT ORDER BY i) AS ids FROM t LEFT JOIN v USING (token) GROUP BY sent_id
"""
)
def vocab_encode(spark: SparkSession, d: str) -> DataFrame:
    index = tk.index_map(vocab(spark, d))  # at most 205 tokens in one row
    return sents(spark, d).where(F.size("l") > 0).crossJoin(F.broadcast(index)).select("sent_id", tk.encode(F.col("l"), F.col("index")).alias("ids"))


# Lemmas: a rule-made table of candidates stands in for a lexicon.
_CAND = f"""
SELECT DISTINCT token AS word, lemma, pos FROM (SELECT unnest(l) AS token FROM ({SENT})),
LATERAL (VALUES (regexp_replace(token, '(ing|ed|es|s)$', ''), 'VERB'), (regexp_replace(token, 's$', ''), 'NOUN'), (token, 'X')) AS c(lemma, pos) WHERE length(lemma) >= 3
"""
_PICK = f"SELECT word, lemma, pos FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY length(lemma), pos <> 'VERB', pos, lemma) AS r FROM ({_CAND})) WHERE r = 1"


def lemma_candidates(spark: SparkSession, d: str) -> DataFrame:
    t = sents(spark, d).select(F.explode("l").alias("word")).distinct()
    forms = F.array(
        F.struct(F.regexp_replace("word", r"(ing|ed|es|s)$", "").alias("lemma"), F.lit("VERB").alias("pos")),
        F.struct(F.regexp_replace("word", r"s$", "").alias("lemma"), F.lit("NOUN").alias("pos")),
        F.struct(F.col("word").alias("lemma"), F.lit("X").alias("pos")),
    )
    return t.select("word", F.inline(forms)).where(F.length("lemma") >= 3).distinct()


@query(sql=_PICK)
def lemma_pick(spark: SparkSession, d: str) -> DataFrame:
    return tk.pick_lemma(lemma_candidates(spark, d))


# Hand-made overrides for irregular words.
_OVERRIDE = (("written", "write"), ("overwrote", "overwrite"), ("hid", "hide"), ("data", "datum"), ("stole", "steal"))
_OVER_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _OVERRIDE) + ") AS o(word, o_lemma)"


@query(
    sql=f"WITH o AS ({_OVER_SQL}), p AS ({_PICK}) SELECT sent_id, i::INT AS i, token, coalesce(o_lemma, lemma, token) AS lemma FROM (SELECT sent_id, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS i FROM ({SENT})) LEFT JOIN p ON token = p.word LEFT JOIN o ON token = o.word"
)
def lemma_override(spark: SparkSession, d: str) -> DataFrame:
    over = spark.createDataFrame(_OVERRIDE, "token string, o_lemma string")
    pick = tk.pick_lemma(lemma_candidates(spark, d)).select(F.col("word").alias("token"), "lemma")
    t = sents(spark, d).select("sent_id", F.posexplode("l").alias("i", "token"))
    return t.join(pick, "token", "left").join(F.broadcast(over), "token", "left").select("sent_id", "i", "token", F.coalesce("o_lemma", "lemma", "token").alias("lemma"))


@query(
    sql=f"""
WITH p AS ({_PICK}) SELECT sent_id, i::INT AS i, CASE WHEN regexp_matches(token, '^[0-9]+$') THEN '[NUMBER]' WHEN regexp_full_match(token, '[0-9a-f]{{32,}}') THEN '[HASH]' ELSE lower(coalesce(lemma, token)) END AS base
FROM (SELECT sent_id, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS i FROM ({SENT})) LEFT JOIN p ON token = word
"""
)
def token_base(spark: SparkSession, d: str) -> DataFrame:
    """A token as a string: its special type, else its lemma, else itself."""
    pick = tk.pick_lemma(lemma_candidates(spark, d)).select(F.col("word").alias("token"), "lemma")
    t = sents(spark, d).select("sent_id", F.posexplode("l").alias("i", "token"))
    base = F.when(F.col("token").rlike("^[0-9]+$"), "[NUMBER]").when(F.col("token").rlike("^[0-9a-f]{32,}$"), "[HASH]").otherwise(tk.base_form(F.col("token"), F.col("lemma")))
    return t.join(pick, "token", "left").select("sent_id", "i", base.alias("base"))


# The dictionary: concept names of the retrieval table.
_CONCEPT = "upper(regexp_replace(technique_id, '^\\s+|\\s+$', '', 'g'))"
_ROWS = f"SELECT DISTINCT {_CONCEPT} AS label, x AS phrase FROM (SELECT technique_id, unnest([concept_name, split_part(concept_name, ' ', 2), {_CONCEPT}]) AS x FROM rag_db WHERE concept_name IS NOT NULL AND technique_id IS NOT NULL) WHERE trim(x) <> '' AND regexp_matches({_CONCEPT}, '^[TSGMD]') AND {_CONCEPT} NOT IN ('S1053.001', 'S1053.002') AND NOT ({_CONCEPT} = 'S0110' AND x = 'at')"
_DICT = f"SELECT p, string_agg(DISTINCT label, '||' ORDER BY label) AS label FROM (SELECT label, {w_sql('phrase')} AS p FROM ({_ROWS})) WHERE len(p) > 0 GROUP BY p"


def concepts(spark: SparkSession, d: str) -> DataFrame:
    """``label, phrases``: concept names, their second word as alias, and the id itself."""
    t = table(spark, d, "rag_db").where("concept_name IS NOT NULL AND technique_id IS NOT NULL")
    second = F.coalesce(F.get(F.split("concept_name", " "), 1), F.lit(""))
    label = F.upper(F.regexp_replace("technique_id", r"^\s+|\s+$", ""))
    return t.select(label.alias("label"), F.array("concept_name", second, label).alias("phrases")).distinct()


@query(sql=_ROWS)
def dict_explode(spark: SparkSession, d: str) -> DataFrame:
    return dic.phrase_rows(concepts(spark, d), "label", "phrases")


def _dict(spark: SparkSession, d: str) -> DataFrame:
    return dic.compile_phrases(dic.phrase_rows(concepts(spark, d), "label", "phrases"))


_AT = f"SELECT sent_id, l, unnest(range(1, len(l) + 1)) AS i FROM ({SENT})"
_MATCH = f"WITH dict AS ({_DICT}) SELECT sent_id, (i - 1)::INT AS start, (i - 1 + len(p))::INT AS \"end\", label FROM ({_AT}) JOIN dict ON l[i] = p[1] AND l[i : i + len(p) - 1] = p"


@query(sql=_MATCH)
def phrase_match(spark: SparkSession, d: str) -> DataFrame:
    return dic.match_phrases(sents(spark, d), "sent_id", "l", _dict(spark, d))


@query(sql=f'SELECT sent_id, start, max("end") AS "end", max_by(label, "end") AS label FROM ({_MATCH}) GROUP BY sent_id, start')
def dict_match(spark: SparkSession, d: str) -> DataFrame:
    """Every start, the longest phrase per start."""
    return dic.match_phrases(sents(spark, d), "sent_id", "l", _dict(spark, d), longest=True)


_PUNCT_L = "list_filter(string_split(regexp_replace(lower(sentence), '([^a-z0-9 ])', ' \\1 ', 'g'), ' '), lambda w: w <> '')"
_PSENT = f"SELECT sent_id, {_PUNCT_L} AS q FROM tram_train WHERE sentence IS NOT NULL"


@query(
    sql=f"""
WITH dict AS ({_DICT}), t AS (SELECT sent_id, list_filter(q, lambda w: regexp_matches(w, '^[a-z0-9]+$')) AS l FROM ({_PSENT}))
SELECT sent_id, label, count(*) AS n FROM (SELECT sent_id, l, unnest(range(1, len(l) + 1)) AS i FROM t) JOIN dict ON l[i] = p[1] AND l[i : i + len(p) - 1] = p GROUP BY sent_id, label
"""
)
def phrase_match_punct(spark: SparkSession, d: str) -> DataFrame:
    """Phrases with any punctuation tokens between their words."""
    marked = F.filter(F.split(F.regexp_replace(F.lower("sentence"), r"([^a-z0-9 ])", " $1 "), " "), lambda w: w.rlike("^[a-z0-9]+$"))
    t = table(spark, d, "tram_train").where("sentence IS NOT NULL").select("sent_id", marked.alias("l"))
    return dic.match_phrases(t, "sent_id", "l", _dict(spark, d)).groupBy("sent_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    sql=f"SELECT sent_id, i::INT AS i, token, kind AS pattern FROM (SELECT sent_id, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS i FROM ({SENT})) JOIN (SELECT split_part(lower(concept_name), ' ', 1) AS value, min({_CONCEPT}) AS kind FROM rag_db WHERE concept_name IS NOT NULL AND technique_id IS NOT NULL GROUP BY 1) ON token = value"
)
def attr_match(spark: SparkSession, d: str) -> DataFrame:
    """Tokens whose lower form is the first word of a concept name."""
    t = sents(spark, d).select("sent_id", F.posexplode("l").alias("i", "token"))
    pats = concepts(spark, d).select(F.get(F.split(F.lower(F.get("phrases", 0)), " "), 0).alias("value"), "label").groupBy("value").agg(F.min("label").alias("pattern"))
    return dic.match_attribute(t, "token", pats).select("sent_id", "i", "token", "pattern")


@query(
    sql=f"SELECT sent_id, i::INT AS i, token, label AS pattern FROM (SELECT sent_id, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS i FROM ({SENT})) JOIN (SELECT DISTINCT split_part(lower(concept_name), ' ', 1) AS value, {_CONCEPT} AS label FROM rag_db WHERE concept_name IS NOT NULL AND technique_id IS NOT NULL) ON token = value"
)
def attr_match_set(spark: SparkSession, d: str) -> DataFrame:
    """As attr_match, with every pattern that has the value."""
    t = sents(spark, d).select("sent_id", F.posexplode("l").alias("i", "token"))
    pats = concepts(spark, d).select(F.get(F.split(F.lower(F.get("phrases", 0)), " "), 0).alias("value"), F.col("label").alias("pattern"))
    return dic.match_attribute(t, "token", pats, "SET").select("sent_id", "i", "token", "pattern")


_BAGS = f"SELECT label, bag FROM (SELECT DISTINCT label, list_sort(list_distinct(list_filter({w_sql('phrase')}, lambda w: w NOT IN ({', '.join(repr(w) for w in dic.LIGHT_WORDS)})))) AS bag FROM ({_ROWS})) WHERE len(bag) > 0"


@query(sql=f"SELECT sent_id, label, array_to_string(bag, ' ') AS bag FROM ({SENT}) JOIN ({_BAGS}) ON list_has_all(l, bag)")
def bag_match(spark: SparkSession, d: str) -> DataFrame:
    bags = dic.compile_bags(dic.phrase_rows(concepts(spark, d), "label", "phrases"))
    return dic.match_bags(sents(spark, d), "sent_id", "l", bags).select("sent_id", "label", "bag")


@query()
def bag_spans(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    bags = dic.compile_bags(dic.phrase_rows(concepts(spark, d), "label", "phrases"))
    return dic.bag_spans(dic.match_bags(sents(spark, d), "sent_id", "l", bags), "sent_id")


# Synonyms: words that share a concept's second word stand for each other.
_SYN = "SELECT DISTINCT lower(a.w) AS word, lower(b.w) AS synonym FROM (SELECT DISTINCT split_part(concept_name, ' ', 1) AS w, split_part(concept_name, ' ', 2) AS k FROM rag_db WHERE concept_name IS NOT NULL) a JOIN (SELECT DISTINCT split_part(concept_name, ' ', 1) AS w, split_part(concept_name, ' ', 2) AS k FROM rag_db WHERE concept_name IS NOT NULL) b USING (k) WHERE k <> ''"


@query(sql=f"SELECT token, list_sort(list(DISTINCT synonym)) AS related, count(DISTINCT sent_id) AS sentences FROM (SELECT sent_id, unnest(l) AS token FROM ({SENT})) JOIN ({_SYN}) ON token = word GROUP BY token")
def synonym_match(spark: SparkSession, d: str) -> DataFrame:
    parts = F.split("concept_name", " ")
    c = table(spark, d, "rag_db").where("concept_name IS NOT NULL").select(F.lower(F.get(parts, 0)).alias("w"), F.get(parts, 1).alias("k")).where("k IS NOT NULL AND k <> ''").distinct()
    syn = c.alias("a").join(c.alias("b"), "k").select(F.col("a.w").alias("token"), F.col("b.w").alias("synonym")).distinct()
    related = syn.groupBy("token").agg(F.array_sort(F.collect_set("synonym")).alias("related"))
    n = sents(spark, d).select(F.explode(F.array_distinct("l")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("sentences"))
    return n.join(related, "token").select("token", "related", "sentences")


_NAMES = f"SELECT DISTINCT {_CONCEPT} AS id, lower(concept_name) AS name FROM rag_db WHERE concept_name IS NOT NULL AND technique_id IS NOT NULL"


@query(sql=f"SELECT sent_id, list_sort(list(DISTINCT id)) AS ids FROM tram_train JOIN ({_NAMES}) ON contains(lower(sentence), name) GROUP BY sent_id")
def name_contains(spark: SparkSession, d: str) -> DataFrame:
    """Ids of concepts whose name occurs anywhere in the sentence, also inside longer words.

    The names are one automaton in every worker, so each sentence is read once; their number is checked.
    """
    from skarn.operators.strings import substrings_in

    ship(spark)
    names = table(spark, d, "rag_db").where("concept_name IS NOT NULL AND technique_id IS NOT NULL").select(F.upper(F.regexp_replace("technique_id", r"^\s+|\s+$", "")).alias("id"), F.lower("concept_name").alias("name")).distinct()
    t = table(spark, d, "tram_train").where("sentence IS NOT NULL").select("sent_id", F.lower("sentence").alias("sentence"))
    return substrings_in(t, "sent_id", "sentence", names, "id", "name")


# Overlapping spans made by a rule over positions and lengths.
_RULE = "(start * 7 + n * 3 + sent_id) % 5 = 0 AND start + n <= size"
_SPANS = f"SELECT sent_id, start::INT AS start, (start + n)::INT AS \"end\", 'L' || n AS label FROM (SELECT sent_id, len(l) AS size, unnest(range(0, len(l))) AS start, l FROM ({SENT})), (SELECT unnest([1, 2, 3]) AS n) WHERE {_RULE}"


def rule_spans(spark: SparkSession, d: str) -> DataFrame:
    at = sents(spark, d).select("sent_id", F.size("l").alias("size"), F.explode(F.sequence(F.lit(0), F.size("l") - 1)).alias("start"))
    n = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("n")
    return at.where("size > 0").select("*", n).where(_RULE).select("sent_id", "start", (F.col("start") + F.col("n")).alias("end"), F.concat(F.lit("L"), F.col("n")).alias("label"))


_HIT = "len(list_filter(a, lambda y: y.s < b[1].e AND b[1].s < y.e)) > 0"
def _longest(src: str) -> str:
    return f"""
SELECT sent_id, unnest(list_reduce(list_transform(v, lambda x: [x]), lambda a, b: CASE WHEN {_HIT} THEN a ELSE list_concat(a, b) END)) AS x
FROM (SELECT sent_id, list({{'s': start, 'e': "end", 'l': label}} ORDER BY start - "end", start, label) AS v FROM ({src}) GROUP BY sent_id)
"""


@query(sql=f'SELECT sent_id, x.s AS start, x.e AS "end", x.l AS label FROM ({_longest(_SPANS)})')
def overlap_longest(spark: SparkSession, d: str) -> DataFrame:
    return sp.collect(rule_spans(spark, d), "sent_id").select("sent_id", F.inline(sp.keep_longest(F.col("spans"))))


_EARLY = f"""
SELECT sent_id, unnest(list_reduce(list_transform(v, lambda x: [x]), lambda a, b: CASE WHEN a[-1].e > b[1].s THEN a ELSE list_concat(a, b) END)) AS x
FROM (SELECT sent_id, list({{'s': start, 'e': "end", 'l': label}} ORDER BY start, -"end", label) AS v FROM ({_SPANS}) GROUP BY sent_id)
"""


@query(sql=f'SELECT sent_id, x.s AS start, x.e AS "end", x.l AS label FROM ({_EARLY})')
def overlap_earliest(spark: SparkSession, d: str) -> DataFrame:
    return sp.collect(rule_spans(spark, d), "sent_id").select("sent_id", F.inline(sp.keep_earliest(F.col("spans"))))


_BOTH = f"SELECT * FROM ({_SPANS}) UNION ALL {_MATCH.replace('WITH dict AS (' + _DICT + ') ', '').replace('JOIN dict', 'JOIN (' + _DICT + ') dict')}"


@query(sql=f'SELECT sent_id, x.s AS start, x.e AS "end", x.l AS label FROM ({_longest(_BOTH)})')
def merge_spans(spark: SparkSession, d: str) -> DataFrame:
    """The spans of two matchers, overlaps resolved together."""
    both = rule_spans(spark, d).unionByName(dic.match_phrases(sents(spark, d), "sent_id", "l", _dict(spark, d)))
    return sp.collect(both, "sent_id").select("sent_id", F.inline(sp.keep_longest(F.col("spans"))))


@query(
    sql=f"""
SELECT sent_id, min(i)::INT AS start, (max(i) + 1)::INT AS "end", string_agg(token, ' ' ORDER BY i) AS phrase
FROM (SELECT *, i - row_number() OVER (PARTITION BY sent_id ORDER BY i) AS g FROM (SELECT sent_id, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS i FROM ({SENT})) WHERE length(token) >= 7)
GROUP BY sent_id, g HAVING count(*) >= 2
"""
)
def merge_entities(spark: SparkSession, d: str) -> DataFrame:
    """Runs of at least two neighbouring long words as one phrase."""
    t = sents(spark, d).select("sent_id", F.posexplode("l").alias("i", "token")).withColumn("flag", F.length("token") >= 7)
    return sp.merge_runs(t, "sent_id", "i", "token", "flag").where(F.col("end") - F.col("start") >= 2)


@query(
    sql="""
WITH s AS (SELECT sent_id, string_split(sentence, ' ') AS l, regexp_extract(sentence, '[0-9][0-9.]*') AS m, strpos(sentence, regexp_extract(sentence, '[0-9][0-9.]*')) - 1 AS a FROM tram_train WHERE regexp_matches(sentence, '[0-9][0-9.]*')),
t AS (SELECT sent_id, a, a + length(m) AS b, unnest(l) AS w, generate_subscripts(l, 1) - 1 AS i FROM s),
o AS (SELECT *, coalesce(sum(length(w) + 1) OVER (PARTITION BY sent_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM t)
SELECT sent_id, min(i)::INT AS start, (max(i) + 1)::INT AS "end" FROM o WHERE st < b AND st + length(w) > a GROUP BY sent_id
"""
)
def span_align(spark: SparkSession, d: str) -> DataFrame:
    """The token span of the first number of each sentence."""
    num = F.regexp_extract("sentence", "[0-9][0-9.]*", 0)
    t = table(spark, d, "tram_train").select("sent_id", "sentence", num.alias("m")).where("m <> ''")
    a = F.expr("locate(m, sentence)") - 1
    x = sp.align(sp.token_offsets(F.split("sentence", " ")), a, a + F.length("m"))
    return t.select("sent_id", x.alias("x")).where("x IS NOT NULL").select("sent_id", "x.start", "x.end")


@query(
    sql=f"""
SELECT sent_id, (i - 1)::INT AS i, l[i] AS token, [CASE WHEN i - 2 >= 1 THEN l[i - 2] ELSE '' END, CASE WHEN i - 1 >= 1 THEN l[i - 1] ELSE '' END] AS "left",
  [CASE WHEN i + 1 <= len(l) THEN l[i + 1] ELSE '' END, CASE WHEN i + 2 <= len(l) THEN l[i + 2] ELSE '' END] AS "right" FROM ({_AT})
"""
)
def context_window(spark: SparkSession, d: str) -> DataFrame:
    return sents(spark, d).select("sent_id", F.inline(tk.context(F.col("l"), 2, 2)))


@query(sql=f"SELECT sent_id, doc_title, (row_number() OVER (PARTITION BY doc_title ORDER BY sent_id) - 1)::INT AS pos, len(l)::INT AS n FROM ({SENT})")
def sent_index(spark: SparkSession, d: str) -> DataFrame:
    return da.positions(sents(spark, d).select("sent_id", "doc_title", F.size("l").alias("n")), "doc_title", "sent_id").select("sent_id", "doc_title", "pos", "n")


_PAIR = "SELECT doc_title, (row_number() OVER w - 1)::INT AS pos, sentence AS first, lead(sentence) OVER w AS second, lead(sent_id) OVER w AS nxt FROM tram_train WHERE sentence IS NOT NULL WINDOW w AS (PARTITION BY doc_title ORDER BY sent_id)"


@query(sql=f"SELECT doc_title, pos, first, second FROM ({_PAIR}) WHERE nxt IS NOT NULL")
def sentence_pairs(spark: SparkSession, d: str) -> DataFrame:
    return tk.pairs(sents(spark, d), "doc_title", "sent_id", "sentence")


@query(sql=f"SELECT doc_title, pos, first, second FROM ({_PAIR}) WHERE nxt IS NOT NULL AND pos % 2 = 0")
def sentence_pairs_skip(spark: SparkSession, d: str) -> DataFrame:
    return tk.pairs(sents(spark, d), "doc_title", "sent_id", "sentence", skip=True)


# Coreference: the mentions of one word in a sentence are a chain; some carry a label.
_MENT = f"SELECT sent_id, token, i, CASE WHEN (i * 3 + sent_id) % 4 = 0 THEN 'E' || (i % 3) ELSE '' END AS label FROM (SELECT sent_id, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS i FROM ({SENT}))"


@query(
    sql=f"""
WITH m AS ({_MENT}), n AS (SELECT sent_id, token, label, count(*) AS c FROM m WHERE label <> '' GROUP BY ALL),
w AS (SELECT sent_id, token, arg_max(label, i) AS last FROM m GROUP BY ALL),
b AS (SELECT sent_id, token, CASE WHEN last <> '' THEN last ELSE label END AS chain_label FROM (SELECT *, row_number() OVER (PARTITION BY sent_id, token ORDER BY c DESC, label) AS r FROM n) JOIN w USING (sent_id, token) WHERE r = 1)
SELECT sent_id, i::INT AS i, token, CASE WHEN label <> '' THEN label ELSE coalesce(chain_label, '') END AS label FROM m LEFT JOIN b USING (sent_id, token)
"""
)
def coref_fill(spark: SparkSession, d: str) -> DataFrame:
    """Unlabelled mentions take the label of their chain's most specific mention (here the last one), else the most frequent one."""
    label = F.when((F.col("i") * 3 + F.col("sent_id")) % 4 == 0, F.concat(F.lit("E"), F.col("i") % 3)).otherwise("")
    m = sents(spark, d).select("sent_id", F.posexplode("l").alias("i", "token")).withColumn("label", label)
    last = W.partitionBy("sent_id", "token").orderBy(F.desc("i"))
    marked = m.withColumn("specific", F.row_number().over(last) == 1)
    return tk.propagate(marked, ["sent_id", "token"], "label", "specific").select("sent_id", "i", "token", "label")


@query()
def ioc_spans(spark: SparkSession, d: str) -> DataFrame:
    """Indicators with their character offsets, overlaps resolved earliest first."""
    from skarn.operators.strings import regex_spans

    ship(spark)
    hits = regex_spans(table(spark, d, "documents"), "doc_id", "text", ioc.CATALOG)
    return hits.select("doc_id", F.inline(sp.keep_earliest(F.col("spans"))))


@query()
def ioc_protect(spark: SparkSession, d: str) -> DataFrame:
    """Texts with their indicators replaced by stand-in words, and a map back to the originals."""
    from skarn.operators.strings import protect

    ship(spark)
    return protect(table(spark, d, "documents"), "doc_id", "text", [*ioc.PROTECTED, *((k, p) for k, p in ioc.CATALOG if k in ioc.STAND_INS and k != "URL")], ioc.STAND_INS)
