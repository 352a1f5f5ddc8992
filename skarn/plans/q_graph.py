"""Queries over pages, trees and graphs, and the flagship flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import html as ht
from skarn.functions import sets as st
from skarn.functions.text import words
from skarn.operators import dictionary as dic
from skarn.operators import graphs as gr
from skarn.operators import metrics as me
from skarn.operators import trees as tr
from skarn.plans import q_metrics as qm
from skarn.plans import q_tokens as qt
from skarn.plans.q_text import pages
from skarn.plans.registry import query
from skarn.runtime import broadcast_if_small, checkpointed, ship, table


@query()
def html_text(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return ht.extract_text(pages(spark, d), "doc_id", "html")


@query()
def html_table(spark: SparkSession, d: str) -> DataFrame:
    """Tables of pages made of the documents' pipe rows."""
    ship(spark)
    cells = F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^\|.*\|$") & ~x.rlike(r"^[|: -]+$")), lambda line: F.concat(F.lit("<tr><td>"), F.regexp_replace(F.regexp_replace(line, r"^\|[ ]*|[ ]*\|$", ""), r"[ ]*\|[ ]*", "</td><td>"), F.lit("</td></tr>")))
    p = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", cells.alias("rows")).where(F.size("rows") > 0)
    return ht.extract_tables(p.select("doc_id", F.concat(F.lit("<table>"), F.array_join("rows", ""), F.lit("</table>")).alias("html")), "doc_id", "html")


# Sites are dealt to the documents by id.
_SITES = [s[0] for s in ht.SITES]
_HOSTS = [f"www{h}" if h[0] == "." else h if "." in h else f"www.{h}.org" for h in _SITES]


def _site(host):
    """The first rule whose name is part of the host."""
    return F.coalesce(*[F.when(F.contains(host, F.lit(s)), F.lit(s)) for s in _SITES])


_DISPATCH = "CASE " + " ".join(f"WHEN contains(host, '{s}') THEN '{s}'" for s in _SITES) + " END"
_HOST_SQL = "[" + ", ".join(f"'{h}'" for h in _HOSTS) + "]"


def _urls(spark: SparkSession, d: str) -> DataFrame:
    host = F.get(F.array(*map(F.lit, _HOSTS)), F.pmod("doc_id", F.lit(len(_HOSTS))).cast("int"))
    return pages(spark, d).withColumn("url", F.concat(F.lit("https://"), host, F.lit("/reports/"), F.col("doc_id")))


@query(sql=f"SELECT doc_id, host, {_DISPATCH} AS site FROM (SELECT doc_id, regexp_extract('https://' || {_HOST_SQL}[doc_id % {len(_HOSTS)} + 1] || '/reports/' || doc_id, '^[a-z]+://([^/:?#]+)', 1) AS host FROM documents WHERE text IS NOT NULL)")
def url_dispatch(spark: SparkSession, d: str) -> DataFrame:
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    return _urls(spark, d).select("doc_id", host.alias("host")).withColumn("site", _site(F.col("host")))


@query()
def page_article(spark: SparkSession, d: str) -> DataFrame:
    """Articles by site rule; each page is laid out as its site's rule expects."""
    ship(spark)

    def opened(selector: str, inner):
        parts = [p for p in selector.split(" | ")[0].split(" > ") if p]
        out = inner
        for p in reversed(parts):
            tag, cls, ident, key, value = ht._STEP.match(p).groups()
            attr = f' class="{cls}"' if cls else f' id="{ident}"' if ident else f' {key}="{value}"' if key else ""
            out = F.concat(F.lit(f"<{tag}{attr}>"), out, F.lit(f"</{tag}>"))
        return out

    body = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    title = F.coalesce("title", F.lit(""))
    n = F.pmod("doc_id", F.lit(len(_SITES)))
    layout = None  # only the layout of a page's own site is built
    for i, (_, t, b, _) in enumerate(ht.SITES):
        one = F.concat(F.lit("<html>"), opened(t, title) if t else F.lit(""), opened(b, body) if b != "html" else body, F.lit("</html>"))
        layout = F.when(n == i, one) if layout is None else layout.when(n == i, one)
    p = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.get(F.array(*map(F.lit, _SITES)), n.cast("int")).alias("site"), layout.alias("html"))
    return ht.extract_articles(p, "doc_id", "site", "html")


# Trees: no parser is at hand, so the head of token i (from 1) is i // 2.
def trees(spark: SparkSession, d: str) -> DataFrame:
    """``sent_id, l, heads, deps, pos`` of the training sentences."""
    # Relations and parts of speech, dealt by position.
    deps, pos = ["nsubj", "dobj", "prep", "amod", "det"], ["NOUN", "VERB", "DET", "ADP"]
    s = qt.sents(spark, d).where(F.size("l") > 0)
    heads = F.transform("l", lambda _, j: F.when(j == 0, 0).otherwise(F.floor((j + 1) / 2).cast("int") - 1))
    return s.select("sent_id", "l", heads.alias("heads"), F.transform("l", lambda _, j: F.get(F.array(*map(F.lit, deps)), j % 5)).alias("deps"), F.transform("l", lambda _, j: F.get(F.array(*map(F.lit, pos)), j % 4)).alias("pos"))


_N = f"SELECT sent_id, len(l) AS n FROM ({qt.SENT}) WHERE len(l) > 0"
_BFS = f"""
WITH RECURSIVE s AS ({_N}), t AS (SELECT sent_id, n, 1 AS i, 0 AS depth FROM s UNION ALL SELECT sent_id, n, c, depth + 1 FROM (SELECT sent_id, n, depth, unnest([2 * i, 2 * i + 1]) AS c FROM t) WHERE c <= n)
SELECT sent_id, (i - 1)::INT AS i, depth::INT AS depth, (row_number() OVER (PARTITION BY sent_id ORDER BY depth, i) - 1)::INT AS bfs FROM t
"""


@query(sql=_BFS)
def tree_bfs(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)

    def order(sid, heads):
        dep = tr.depths(heads)
        return [(sid, i, dep[i], k) for k, i in enumerate(tr.bfs(heads))]

    return tr.map_trees(trees(spark, d), ["sent_id", "heads"], order, "sent_id bigint, i int, depth int, bfs int")


@query(
    sql=f"""
WITH RECURSIVE s AS ({_N}), t AS (SELECT sent_id, (n + 1) // 2 AS a, n AS b FROM s UNION ALL SELECT sent_id, CASE WHEN a > b THEN a // 2 ELSE a END, CASE WHEN a > b THEN b ELSE b // 2 END FROM t WHERE a <> b)
SELECT sent_id, (a - 1)::INT AS lca FROM t WHERE a = b
"""
)
def tree_lca(spark: SparkSession, d: str) -> DataFrame:
    """The lowest common ancestor of the middle and the last token."""
    ship(spark)
    return tr.map_trees(trees(spark, d), ["sent_id", "heads"], lambda sid, h: [(sid, tr.lca(h, (len(h) + 1) // 2 - 1, len(h) - 1))], "sent_id bigint, lca int")


@query()
def subphrase(spark: SparkSession, d: str) -> DataFrame:
    """Bag matches whose smallest subtree holds no other content word."""
    ship(spark)
    bags = dic.compile_bags(dic.phrase_rows(qt.concepts(spark, d), "label", "phrases"))
    m = dic.match_bags(qt.sents(spark, d), "sent_id", "l", bags).join(trees(spark, d), "sent_id")

    def check(sid, label, spots, heads, pos):
        return [(sid, label, min(c), max(c) + 1) for c in tr.subphrases(heads, pos, [list(s) for s in spots])]

    return tr.map_trees(m, ["sent_id", "label", "spots", "heads", "pos"], check, "sent_id bigint, label string, start int, end int").distinct()


_BELOW = "len(list_filter(range(1, 32), lambda k: (o + 1) // (1::BIGINT << k) = v + 1)) > 0"


@query(sql=f"SELECT sent_id, v::INT AS verb, o::INT AS object FROM (SELECT sent_id, v, unnest(range(1, n, 5)) AS o FROM (SELECT sent_id, n, unnest(range(1, n, 4)) AS v FROM ({_N}))) WHERE o <> v AND {_BELOW}")
def tree_match(spark: SparkSession, d: str) -> DataFrame:
    """A verb with an object anywhere below it."""
    ship(spark)

    def find(sid, heads, deps, pos):
        verbs, objects = [i for i, p in enumerate(pos) if p == "VERB"], [i for i, x in enumerate(deps) if "obj" in x]
        return [(sid, *m) for m in tr.match_pattern(heads, [verbs, objects], [(0, ">>")])]

    return tr.map_trees(trees(spark, d), ["sent_id", "heads", "deps", "pos"], find, "sent_id bigint, verb int, object int")


_PAIR_NAMES = f"SELECT DISTINCT {qt._CONCEPT} AS label, w[1] AS a, w[2] AS b FROM (SELECT technique_id, {qt.w_sql('concept_name')} AS w FROM rag_db WHERE concept_name IS NOT NULL AND technique_id IS NOT NULL) WHERE len(w) = 2"
_WORDS = f"SELECT sent_id, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS i FROM ({qt.SENT})"


def _pair_sql(related: str) -> str:
    return f"SELECT sent_id, label, v::INT AS first, o::INT AS second FROM (SELECT x.sent_id, label, x.i AS v, y.i AS o FROM ({_PAIR_NAMES}) p JOIN ({_WORDS}) x ON x.token = p.a JOIN ({_WORDS}) y ON y.token = p.b AND y.sent_id = x.sent_id) WHERE o <> v AND ({related})"


def _name_patterns(spark: SparkSession, d: str, operators: tuple[str, ...]) -> DataFrame:
    """Concept names of two words as dependency patterns: the second word stands in one of the relations to the first."""
    ship(spark)
    t = table(spark, d, "rag_db").where("concept_name IS NOT NULL AND technique_id IS NOT NULL")
    pats = t.select(F.upper(F.regexp_replace("technique_id", r"^\s+|\s+$", "")).alias("label"), words(F.col("concept_name")).alias("w")).where(F.size("w") == 2).distinct()
    pats = pats.groupBy(F.get("w", 0).alias("a"), F.get("w", 1).alias("b")).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    s = trees(spark, d)
    hits = s.select("sent_id", F.explode(F.array_distinct("l")).alias("a")).join(broadcast_if_small(pats), "a").join(s.select("sent_id", "l", "heads"), "sent_id").where(F.array_contains("l", F.col("b")))

    def find(sid, labels, a, b, l, heads):
        fits = [[i for i, w in enumerate(l) if w == x] for x in (a, b)]
        found = {m for op in operators for m in tr.match_pattern(heads, fits, [(0, op)])}
        return [(sid, x, *m) for m in sorted(found) for x in labels]

    return tr.map_trees(hits, ["sent_id", "labels", "a", "b", "l", "heads"], find, "sent_id bigint, label string, first int, second int")


@query(sql=_pair_sql(_BELOW))
def action_match(spark: SparkSession, d: str) -> DataFrame:
    """An action and its target anywhere below it."""
    return _name_patterns(spark, d, (">>",))


@query(sql=_pair_sql(_BELOW + " OR " + _BELOW.replace("(o + 1)", "(v + 1)").replace("= v + 1", "= o + 1")))
def fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    """Both words on one path to the root, in either order."""
    return _name_patterns(spark, d, (">>", "<<"))


@query()
def svo(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)

    def find(sid, words, heads, deps, pos):
        return [(sid, words[s], " ".join(words[v] for v in vs), words[o]) for s, vs, o in tr.triples(heads, deps, pos)]

    return tr.map_trees(trees(spark, d), ["sent_id", "l", "heads", "deps", "pos"], find, "sent_id bigint, subject string, verbs string, object string")


@query(
    sql=f"""
SELECT sent_id, src::INT AS src, dst::INT AS dst FROM (SELECT sent_id, lag(b.i) OVER (PARTITION BY sent_id ORDER BY bfs) AS src, b.i AS dst FROM ({_BFS}) b JOIN (SELECT sent_id, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS i FROM ({qt.SENT})) USING (sent_id, i) WHERE length(token) >= 8) WHERE src IS NOT NULL
"""
)
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Known tokens linked in breadth-first order of their tree."""
    ship(spark)

    def link(sid, words, heads):
        known = [i for i in tr.bfs(heads) if len(words[i]) >= 8]
        return [(sid, a, b) for a, b in zip(known, known[1:], strict=False)]

    return tr.map_trees(trees(spark, d), ["sent_id", "l", "heads"], link, "sent_id bigint, src int, dst int")


# Entities of a sentence, blank and null names left out.
_ENT = "SELECT sent_id, coalesce(document_name, '') AS doc, list_filter(list_transform(entities, lambda x: {'t': coalesce(x._1, '?'), 'n': lower(x._2)}), lambda x: x.n <> '') AS e FROM bosch_train WHERE entities IS NOT NULL"


def entities(spark: SparkSession, d: str) -> DataFrame:
    """``sent_id, doc, e``: typed, lower-cased entities in order."""
    e = F.transform("entities", lambda x: F.struct(F.coalesce(x["_1"], F.lit("?")).alias("t"), F.lower(x["_2"]).alias("n")))
    return table(spark, d, "bosch_train").where("entities IS NOT NULL").select("sent_id", F.coalesce("document_name", F.lit("")).alias("doc"), F.filter(e, lambda x: x["n"].isNotNull() & (x["n"] != "")).alias("e"))


@query(sql=f"SELECT doc, x.n AS node, list_sort(list(DISTINCT x.t)) AS types, count(*) AS mentions FROM (SELECT doc, unnest(e) AS x FROM ({_ENT})) GROUP BY doc, x.n")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    x = entities(spark, d).select("doc", F.explode("e").alias("x"))
    return x.groupBy("doc", F.col("x.n").alias("node")).agg(F.array_sort(F.collect_set("x.t")).alias("types"), F.count(F.lit(1)).alias("mentions"))


_EDGE = f"SELECT DISTINCT a, b FROM (SELECT sent_id, e[i].n AS a, e[i + 1].n AS b FROM (SELECT *, unnest(range(1, len(e))) AS i FROM ({_ENT}))) WHERE a <> b"


def entity_edges(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring entities of a sentence."""
    pair = F.arrays_zip(F.slice("e", 1, F.greatest(F.size("e") - 1, F.lit(0))).alias("a"), F.slice("e", 2, F.greatest(F.size("e") - 1, F.lit(0))).alias("b"))
    return entities(spark, d).select(F.explode(pair).alias("x")).select(F.col("x.a.n").alias("a"), F.col("x.b.n").alias("b")).where("a <> b").distinct()


_REACH = f"WITH RECURSIVE u AS (SELECT a, b FROM ({_EDGE}) UNION SELECT b, a FROM ({_EDGE})), r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)"


@query(sql=f"{_REACH} SELECT a AS node, least(a, min(b)) AS component FROM r GROUP BY a")
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    return gr.components(entity_edges(spark, d), "a", "b")


@query(
    sql=f"""
WITH RECURSIVE u AS (SELECT a, b FROM ({_EDGE}) UNION SELECT b, a FROM ({_EDGE})), r AS (SELECT min(a) AS node, 0 AS hops FROM u UNION SELECT u.b, hops + 1 FROM r JOIN u ON r.node = u.a WHERE hops < 15)
SELECT node, min(hops)::INT AS hops FROM r GROUP BY node
"""
)
def graph_shortest(spark: SparkSession, d: str) -> DataFrame:
    """Hops from the first node in order."""
    e = entity_edges(spark, d)
    start = e.select(F.least("a", "b").alias("x")).agg(F.min("x").alias("node")).where("node IS NOT NULL")
    return gr.distances(e, "a", "b", start)


_TECH = "SELECT DISTINCT upper(regexp_replace(technique_id, '^\\s+|\\s+$', '', 'g')) AS id, split_part(concept_name, ' ', 2) AS tactic FROM rag_db WHERE technique_id IS NOT NULL AND concept_name IS NOT NULL"


@query(
    sql=f"WITH t AS ({_TECH}) SELECT a.id, list_sort(list(DISTINCT b.id) FILTER (WHERE b.id IS NOT NULL)) AS subs, list_sort(list(DISTINCT a.tactic)) AS tactics FROM t a LEFT JOIN t b ON starts_with(b.id, a.id || '.') WHERE NOT contains(a.id, '.') GROUP BY a.id"
)
def graph_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Sub-techniques and tactics of every technique."""
    parts = F.split("concept_name", " ")
    t = table(spark, d, "rag_db").where("technique_id IS NOT NULL AND concept_name IS NOT NULL").select(F.upper(F.regexp_replace("technique_id", r"^\s+|\s+$", "")).alias("id"), F.coalesce(F.get(parts, 1), F.lit("")).alias("tactic")).distinct()
    sup = t.where(~F.contains("id", F.lit("."))).groupBy("id").agg(F.array_sort(F.collect_set("tactic")).alias("tactics"))
    sub = t.where(F.contains("id", F.lit("."))).select(F.substring_index("id", ".", 1).alias("up"), F.col("id").alias("s")).groupBy("up").agg(F.array_sort(F.collect_set("s")).alias("subs"))
    return sup.join(sub, sup["id"] == sub["up"], "left").select("id", "subs", "tactics")


def report_graphs(spark: SparkSession, d: str) -> DataFrame:
    """``sent_id, technique, nodes, edges``: the entities of a sentence as a chain, one row per technique of the sentence."""
    t = table(spark, d, "bosch_train").select("sent_id", F.array_distinct(F.filter(st.labels(F.col("labels")), lambda x: x.rlike(r"^T[0-9]{4}"))).alias("t"))
    e = entities(spark, d).where(F.size("e") > 0)
    nodes = F.transform("e", lambda x: F.struct(x["t"].alias("type"), F.split(x["n"], " ").alias("nlp"), F.filter(F.array(x["n"]), lambda y: y.rlike("[0-9]")).alias("ioc"), F.lit(1).alias("count"))).cast("array<struct<type:string,nlp:array<string>,ioc:array<string>,count:int>>")
    edges = F.transform(F.slice("e", 2, F.size("e")), lambda _, i: F.struct(i.alias("src"), (i + 1).alias("dst"), F.lit(1).alias("count"))).cast("array<struct<src:int,dst:int,count:int>>")
    return e.join(t, "sent_id").select("sent_id", F.explode("t").alias("technique"), nodes.alias("nodes"), edges.alias("edges"))


@query()
def graph_merge(spark: SparkSession, d: str) -> DataFrame:
    """Entities of a sentence that are one node: groups of positions."""
    ship(spark)

    def merge(sid, e):
        nodes = [{"type": x["t"], "nlp": x["n"].split(), "ioc": [x["n"]]} for x in e]
        return [(sid, g) for g in gr.contract(nodes)]

    return tr.map_trees(entities(spark, d), ["sent_id", "e"], merge, "sent_id bigint, members array<int>")


def templates(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    g = report_graphs(spark, d).select("technique", F.col("sent_id").alias("ord"), "nodes", "edges", F.lit(1).alias("total_count"))
    return gr.learn_templates(g)


@query()
def template_learn(spark: SparkSession, d: str) -> DataFrame:
    return templates(spark, d)


_TN = f"SELECT technique, x.t AS type, count(*) AS c FROM (SELECT technique, unnest(e) AS x FROM ({_ENT}) JOIN (SELECT sent_id, unnest(list_distinct(list_filter({qm.l_sql('labels')}, lambda y: regexp_matches(y, '^T[0-9]{{4}}')))) AS technique FROM bosch_train) USING (sent_id)) GROUP BY ALL"


@query(sql=f"SELECT technique, list({{'type': type, 'count': CASE WHEN c <= 2 THEN 0 ELSE c END::INT}} ORDER BY type) AS nodes, sum(CASE WHEN c <= 2 THEN 0 ELSE c END)::INT AS norm FROM ({_TN}) GROUP BY technique")
def template_prune(spark: SparkSession, d: str) -> DataFrame:
    """Node types of a technique with rare ones set to 0, and what is left added up."""
    n = report_graphs(spark, d).select("technique", F.explode("nodes").alias("x")).groupBy("technique", F.col("x.type").alias("type")).agg(F.count(F.lit(1)).cast("int").alias("count"))
    t = n.groupBy("technique").agg(F.array_sort(F.collect_list(F.struct("type", "count"))).alias("nodes"))
    return gr.prune(t).select("technique", "nodes", "norm")


#: Templates that a worker holds at once; more take several passes over the graphs.
TEMPLATES = 5000


@query()
def graph_align(spark: SparkSession, d: str) -> DataFrame:
    """Techniques that the graph of a sentence reaches a score of 0.9 with."""
    pruned = checkpointed(gr.prune(templates(spark, d)))
    graphs = report_graphs(spark, d).dropDuplicates(["sent_id"]).select("sent_id", "nodes", F.transform("edges", lambda e: F.struct(e["src"], e["dst"])).alias("edges"))
    slices = max(1, -(-pruned.count() // TEMPLATES))
    out = None
    for k in range(slices):
        rows = pruned.where(F.pmod(F.xxhash64("technique"), F.lit(slices)) == k).collect()
        one = gr.align_all(graphs, [(r["technique"], ([n.asDict() for n in r["nodes"]], [tuple(e) for e in r["edges"]], r["norm"])) for r in rows], "sent_id")
        out = one if out is None else out.unionByName(one)
    return out


_FLAG = f"""
WITH hit AS (SELECT DISTINCT sent_id, unnest(string_split(label, '||')) AS label FROM ({qt._MATCH})),
pair AS (SELECT doc, label, max(t) AS t, max(p) AS p FROM (SELECT coalesce(trim(doc_title), '') AS doc, unnest({qm.l_sql('labels')}) AS label, 1 AS t, 0 AS p FROM tram_train WHERE sentence IS NOT NULL
  UNION ALL SELECT coalesce(trim(doc_title), ''), hit.label, 0, 1 FROM hit JOIN tram_train USING (sent_id)) GROUP BY doc, label)
SELECT coalesce(doc, 'Average') AS doc, tp, fp, fn, {qm._RATES} FROM (SELECT doc, sum(t * p)::BIGINT AS tp, sum((1 - t) * p)::BIGINT AS fp, sum(t * (1 - p))::BIGINT AS fn FROM pair GROUP BY ROLLUP (doc))
"""


@query(sql=_FLAG)
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Sentences to dictionary labels to scores per document, with a total row."""
    doc = F.coalesce(F.trim("doc_title"), F.lit("")).alias("doc")
    t = table(spark, d, "tram_train").where("sentence IS NOT NULL").select("sent_id", doc, st.labels(F.col("labels")).alias("truth"))
    hits = dic.match_phrases(qt.sents(spark, d), "sent_id", "l", qt._dict(spark, d))
    pred = hits.select("sent_id", F.explode(F.split("label", r"\|\|")).alias("label")).groupBy("sent_id").agg(F.collect_set("label").alias("pred"))
    g = t.join(pred, "sent_id", "left").withColumn("pred", F.coalesce("pred", st.empty()))
    pairs = me.pair_counts(g, "doc", "truth", "pred").withColumn("predicted", F.least(F.lit(1), "predicted"))
    return me.with_total(me.confusion(pairs, "doc"), "doc")


@query(sql="SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def events_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows over the events: the batch form of the streaming example."""
    from skarn.streaming.windows import tumbling

    return tumbling(table(spark, d, "events"), "ts", "1 hour", "event_type", "value")


