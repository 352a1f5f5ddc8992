import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.functions import html as ht
from skarn.operators import datasets as da
from skarn.operators import dictionary as dic
from skarn.operators import graphs as gr
from skarn.operators import metrics as me
from skarn.operators import spans as sp
from skarn.operators import strings as ss
from skarn.operators import tokens as tk
from skarn.operators import trees as tr
from skarn.operators import vectors as ov
from skarn.runtime import ship


def overlap(a, b):
    return a[0] < b[1] and b[0] < a[1]


@pytest.mark.parametrize("seed", range(3))
def test_overlap_rules(spark, seed):
    r = random.Random(seed)
    docs = [(i, [(a, a + r.randint(1, 6), r.choice("AB")) for a in (r.randint(0, 30) for _ in range(r.randint(0, 14)))]) for i in range(60)]
    df = spark.createDataFrame(docs, f"id int, spans {sp.SPAN}")
    got = {x["id"]: x for x in df.select("id", sp.keep_longest(F.col("spans")).alias("l"), sp.keep_earliest(F.col("spans")).alias("e")).collect()}
    for i, spans in docs:
        longest, kept = sorted(spans, key=lambda s: (s[0] - s[1], s[0], s[2])), []
        for s in longest:
            if not any(overlap(s, k) for k in kept):
                kept.append(s)
        assert [tuple(x) for x in got[i]["l"]] == sorted((s[0], s[1], s[2]) for s in kept)
        early, end = [], -1
        for s in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
            if s[0] >= end:
                early.append(s)
                end = s[1]
        assert [tuple(x) for x in got[i]["e"]] == early


def test_phrases_and_bags(spark):
    rows = spark.createDataFrame([("A", "remote desktop"), ("B", "Remote  Desktop"), ("C", "remote desktop session"), ("D", "session remote"), ("E", " ")], "label string, phrase string")
    t = spark.createDataFrame([(1, "a remote desktop session via remote".split()), (2, [])], "sid int, l array<string>")
    d = dic.compile_phrases(rows)
    assert {(x["start"], x["end"], x["label"]) for x in dic.match_phrases(t, "sid", "l", d).collect()} == {(1, 3, "A||B"), (1, 4, "C")}
    assert {(x["start"], x["label"]) for x in dic.match_phrases(t, "sid", "l", d, longest=True).collect()} == {(1, "C")}
    bags = dic.match_bags(t, "sid", "l", dic.compile_bags(rows))
    assert {x["label"] for x in bags.collect()} == {"A", "B", "C", "D"}
    assert {(x["start"], x["end"]) for x in dic.bag_spans(bags.where("label = 'D'"), "sid").collect()} == {(1, 4)}


def test_tightest_against_all_choices():
    from itertools import product

    r = random.Random(1)
    for _ in range(200):
        spots = [sorted(r.sample(range(20), r.randint(1, 4))) for _ in range(r.randint(1, 3))]
        got = dic.tightest(spots)
        best = min(max(c) - min(c) for c in product(*spots))
        assert got[0][1] - 1 - got[0][0] == best
        assert len(got) <= min(map(len, spots)) and [b - a for a, b in got] == sorted(b - a for a, b in got)


def test_vocabulary(spark):
    c = spark.createDataFrame([("a", 3), ("b", 1), ("[UNK]", 9)], "token string, n bigint")
    assert {tuple(r) for r in tk.vocabulary(c, 1, 1).collect()} == {("[UNK]", 9), ("[PAD]", 0), ("[CLS]", 0), ("[SEP]", 0), ("[MASK]", 0)}
    assert {tuple(r) for r in tk.vocabulary(c, 2, 4).collect()} == {("[UNK]", 9), ("[PAD]", 0), ("[CLS]", 0), ("[SEP]", 0), ("[MASK]", 0)}


def test_report_average_comes_from_sums(spark):
    df = spark.createDataFrame([("x", 2, 1, 1), ("y", 0, 0, 0)], "name string, tp bigint, fp bigint, fn bigint")
    got = {r["name"]: (r["precision"], r["recall"], r["f1"]) for r in me.with_total(df, "name").collect()}
    assert got["y"] == (0, 0, 0) and got["Average"] == got["x"] == pytest.approx((0.666667, 0.666667, 0.666667))


def test_fusion(spark):
    df = spark.createDataFrame([(1, 7, 1.0), (1, 7, 2.0), (1, 7, 3.0)], "g int, neighbour int, distance double")
    assert ov.fuse(df, "g", "shrink").first()["distance"] == 0.25
    assert ov.fuse(df, "g", "average").first()["distance"] == 2.0


def test_exact_knn_in_several_passes(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(ov, "PASS_BYTES", 300)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4)).round(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None), (98, [1.0])], "id int, v array<double>")
    got = {}
    for r in ov.exact_knn(df, "id", "v", F.col("id") % 5 == 0, 3, 4).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["neighbour"]))
    assert set(got) == {i for i in range(60) if i % 5 == 0}
    for q, near in got.items():
        d = np.round(np.linalg.norm(x - x[q], axis=1), 6)
        want = sorted((j for j in range(60) if j != q), key=lambda j: (d[j], j))[:3]
        assert [n for _, n in sorted(near)] == want


def test_running_mean_and_samples(spark):
    df = spark.range(100).select("id", (F.col("id") * 1.5).alias("v"))
    got = {r["id"]: r["running_mean"] for r in da.running_mean(df, "id", "v", width=7).collect()}
    assert all(got[i] == pytest.approx(np.mean([j * 1.5 for j in range(i + 1)])) for i in range(100))
    x = df.select("id", (F.col("id") % 2).alias("y"))
    s = da.sample_per_label(x, "y", "id", 5)
    assert {r["y"]: r["count"] for r in s.groupBy("y").count().collect()} == {0: 5, 1: 5}
    assert da.greedy_split([("a", 30), ("b", 5), ("c", 65)], 0.2) == {"b"}


def test_trees():
    heads = [0, 0, 0, 1, 1, 2, 5]
    assert tr.depths(heads) == [0, 1, 1, 2, 2, 2, 3]
    assert tr.bfs(heads) == [0, 1, 2, 3, 4, 5, 6]
    assert tr.lca(heads, 3, 4) == 1 and tr.lca(heads, 3, 6) == 0
    assert tr.minimal_subtree(heads, [3, 4]) == {1, 3, 4}
    assert tr.is_subphrase(heads, ["VERB", "DET", "X", "X", "X", "X", "X"], [3, 4])
    assert not tr.is_subphrase(heads, ["VERB", "NOUN", "X", "X", "X", "X", "X"], [3, 4])
    assert tr.depths([1, 0]) == [-1, -1]
    assert tr.triples([1, 1, 1], ["nsubj", "root", "dobj"], ["NOUN", "VERB", "NOUN"]) == [(0, [1], 2)]


def test_components_against_union_find(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 230)] + [(300, 300)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    got = {x["node"]: x["component"] for x in gr.components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {n: find(n) for n in {x for e in edges for x in e}}


def test_distances(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (8, 9)], "a int, b int")
    got = {x["node"]: x["hops"] for x in gr.distances(e, "a", "b", spark.createDataFrame([(1,)], "n int")).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2}


def test_templates_and_alignment():
    node = lambda t, w, i=(): {"type": t, "nlp": [w], "ioc": list(i), "count": 1}
    g = ([node("file", "payload"), node("net", "server")], [(0, 1)])
    nodes, edges, total = gr.learn([(g[0], g[1], 1)] * 3)
    assert [n["count"] for n in nodes] == [3, 3] and edges == {(0, 1): 3} and total == 3
    t = (nodes, [(0, 1, 3)], 6)
    assert gr.align(g, t) == pytest.approx((3 * 1.4 * 2 + 3 * 1.4) / 7)
    assert gr.align(([node("actor", "x")], []), ([node("actor", "x")], [], 0)) == 0
    assert gr.contract([node("a", "x", ["1.2"]), node("a", "y", ["1.2"]), node("a", "x", ["9"])]) == [[0, 1], [2]]


def test_indel_ratio():
    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    r = random.Random(0)
    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in range(2))
        assert ss.indel_ratio(a, b) == pytest.approx(2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1)


def test_html():
    text, code = ht.page_text("<html><head><title>T</title><style>x</style></head><body><h1>Head</h1><p>One <b>two</b> &amp;\n three</p><ul><li>a</li><li>b.</li><li>c</li></ul><pre>x  y</pre></body></html>")
    assert text.startswith("T.\n") and "Head." in text and 'One "' in text and "& three." in text and "a;" in text and "b." in text and "c." in text
    assert [text[a:b].strip() for a, b in code] == ["x  y"]
    assert ht.page_text("") == ("", []) and ht.page_text("<p></p><li>")[0].strip() == ""
    assert ht.tables("<table><tr><th>a</th><th>b</th></tr><tr><td>1 </td><td>2</td></tr></table>") == ["a\tb\n1\t2"]
    page = '<html><div class="article-hero x"><h1>Big</h1></div><div class="article-text">Body<div class="ad">no</div></div></html>'
    assert ht.article(page, "div.article-hero > h1", "div.article-text", ("div.ad",)) == ("Big.", "Body", None)
    assert ht.article(page, "", "div#none", ())[2] == "no div#none"


def test_protect(spark):
    ship(spark)
    df = spark.createDataFrame([(1, "get 10.0.0.1 now"), (2, None)], "id int, t string")
    r = ss.protect(df, "id", "t", [("IP", r"\d+\.\d+\.\d+\.\d+"), ("N", r"10\.0")], {"IP": "host", "N": "n"}).collect()
    assert [(x["id"], x["protected"], x["originals"]) for x in r] == [(1, "get  host  now", {4: "10.0.0.1"})]


def test_span_scores(spark):
    t = spark.createDataFrame([(1, 0, 2, "A"), (1, 4, 5, "ATTACK"), (1, 7, 8, "B")], "d int, start int, end int, label string")
    p = spark.createDataFrame([(1, 0, 2, "A"), (1, 0, 2, "C"), (1, 4, 5, "Z"), (1, 9, 10, "B")], "d int, start int, end int, label string")
    got = {r["label"]: (r["tp"], r["fp"], r["fn"]) for r in me.span_scores(t, p, "d").collect()}
    assert got == {"A": (1, 0, 0), "ATTACK": (1, 0, 0), "B": (0, 1, 1)}


def test_distances_of_a_chain_longer_than_the_rounds(spark, monkeypatch):
    from skarn.operators import graphs

    monkeypatch.setattr(graphs, "ROUNDS", 3)
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)], "a int, b int")
    got = graphs.distances(edges, "a", "b", spark.createDataFrame([(0,)], "n int"))
    assert {r["node"]: r["hops"] for r in got.collect()} == {i: i for i in range(7)}


def test_alignment_is_the_best_of_all_combinations():
    from itertools import product

    r = random.Random(4)

    def node(kind, words, c=1):
        return {"type": kind, "ioc": [], "nlp": words, "count": c}

    for _ in range(30):
        g_nodes = [node(r.choice("ab"), [r.choice(["load", "loads", "run", "ran", "drop"])]) for _ in range(6)]
        g_edges = [(i, j) for i in range(6) for j in range(6) if i != j and r.random() < 0.25]
        t_nodes = [node(r.choice("ab"), [r.choice(["load", "run", "drop"])], r.randint(1, 4)) for _ in range(5)]
        t_edges = [(i, j, r.randint(1, 3)) for i in range(5) for j in range(5) if i != j and r.random() < 0.4]
        near = {}
        for a in range(6):
            level, d, seen = [a], 0, {a}
            while level:
                d += 1
                level = [y for x in level for p, y in g_edges if p == x and not (y in seen or seen.add(y))]
                near.update({(a, y): d for y in level})
        cand = {}
        for k, t in enumerate(t_nodes):
            own = [(i, s) for i, n in enumerate(g_nodes) if (s := gr.node_similarity(t, n)) >= 0.7]
            if own:
                cand[k] = own
        best = 0.0
        for combo in product(*cand.values()):
            pick = dict(zip(cand, combo, strict=True))
            score = sum(t_nodes[k]["count"] * s for k, (_, s) in pick.items())
            for a, b, c in t_edges:
                if a in pick and b in pick and (pick[a][0], pick[b][0]) in near:
                    score += c * (pick[a][1] * pick[b][1]) ** 0.5 / near[pick[a][0], pick[b][0]]
            best = max(best, score)
        assert gr.align((g_nodes, g_edges), (t_nodes, t_edges, 6)) == pytest.approx(best / 7 if cand else 0)


def test_long_chains_are_walked_to_the_end(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(250)], "a int, b int").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        far = gr.distances(e, "a", "b", spark.createDataFrame([(0,)], "n int"))
        assert far.agg(F.max("hops"), F.count("hops")).first()[:] == (250, 251)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_subphrases_use_all_slots():
    """Five and six words, against all combinations."""
    r = random.Random(6)
    for _ in range(60):
        n = r.randint(6, 12)
        heads = [0] + [r.randrange(i) for i in range(1, n)]
        pos = [r.choice(["NOUN", "VERB", "DET", "ADP"]) for _ in range(n)]
        slots = [r.sample(range(n), r.randint(1, 2)) for _ in range(r.choice([1, 5, 6]))]
        assert tr.subphrases(heads, pos, slots) == sorted({c for c in dic.combinations(slots) if tr.is_subphrase(heads, pos, list(c))} | set()) or len(slots) == 0
    # a word that occurs fifty times in each of three slots is decided slot by slot
    heads = [max(0, i - 1) for i in range(150)]
    assert len(tr.subphrases(heads, ["NOUN"] * 150, [list(range(0, 150, 3)), list(range(1, 150, 3)), list(range(2, 150, 3))])) > 40


def test_dependency_patterns():
    heads = [1, 1, 1, 2, 3]  # 1 is the root; 2 below it, 3 below 2, 4 below 3
    assert tr.match_pattern(heads, [[1, 2], [3, 4]], [(0, ">>")]) == [(1, 3), (1, 4), (2, 3), (2, 4)]
    assert tr.match_pattern(heads, [[1, 2], [3, 4]], [(0, ">")]) == [(2, 3)]
    assert tr.match_pattern(heads, [[4], [1, 2], [3]], [(0, "<<"), (1, ">")]) == [(4, 2, 3)]
    assert tr.match_pattern(heads, [[3], [2, 1]], [(0, "<")]) == [(3, 2)]
    assert tr.action_pattern(["use", "quietly"], ["key"]) == (["use", "quietly", "key"], [(0, ">>"), (0, ">>")])


def test_names_in_several_passes(spark, monkeypatch):
    ship(spark)
    names = spark.createDataFrame([(f"N{i}", f"name{i}") for i in range(20)] + [("X", None), ("Y", "")], "i string, n string")
    t = spark.createDataFrame([(1, "has name3 and name12"), (2, None), (3, "no")], "k int, t string")
    want = [(1, ["N1", "N12", "N3"])]
    assert [tuple(r) for r in ss.substrings_in(t, "k", "t", names, "i", "n").collect()] == want
    monkeypatch.setattr(ss, "NAMES", 3)
    assert [tuple(r) for r in ss.substrings_in(t, "k", "t", names, "i", "n").collect()] == want


def test_attribute_patterns_and_greedy_modes(spark):
    t = spark.createDataFrame([(0, "run"), (1, None), (2, "load"), (3, "x")], "i int, w string")
    p = dic.attribute_patterns(spark, {"A": "run", "B": {"IN": ["run", "load"]}})
    assert {(r["i"], r["pattern"]) for r in dic.match_attribute(t, "w", p).collect()} == {(0, "A"), (0, "B"), (2, "B")}
    assert {(r["i"], r["pattern"]) for r in dic.match_attribute(t, "w", p, "FIRST").collect()} == {(0, "A"), (2, "B")}
    with pytest.raises(ValueError, match="several patterns"):
        dic.match_attribute(t, "w", p, "ERROR")
    with pytest.raises(ValueError, match="greedy"):
        dic.match_attribute(t, "w", p, "LAST")
    with pytest.raises(NotImplementedError, match="REGEX"):
        dic.attribute_patterns(spark, {"A": {"REGEX": "r.*"}})


def test_what_a_dictionary_leaves_out(spark):
    c = spark.createDataFrame([("S0110", ["at", "At job", None, " "]), ("S1053.001", ["x"]), ("T1", ["at"]), ("X9", ["y"]), (None, ["z"])], "label string, phrases array<string>")
    rows = dic.phrase_rows(c, "label", "phrases")
    assert {tuple(r) for r in rows.collect()} == {("S0110", "At job"), ("T1", "at")}
    bags = dic.compile_bags(spark.createDataFrame([("A", "use of the key"), ("B", "of the")], "label string, phrase string"))
    assert {(r["label"], r["slot"], r["n_slots"]) for r in bags.collect()} == {("A", "key", 2), ("A", "use", 2)}


def test_labels_of_chains(spark):
    rows = [("c", 0, "", False), ("c", 1, "X", False), ("c", 2, "X", False), ("c", 3, "Y", True), ("d", 0, None, True), ("d", 1, "Z", False), ("d", 2, "W", False), ("d", 3, "Z", False), ("e", 0, "", True)]
    m = spark.createDataFrame(rows, "chain string, i int, label string, top boolean")
    got = {(r["chain"], r["i"]): r["label"] for r in tk.propagate(m, ["chain"], "label", "top").collect()}
    assert got == {("c", 0): "Y", ("c", 1): "X", ("c", 2): "X", ("c", 3): "Y", ("d", 0): "Z", ("d", 1): "Z", ("d", 2): "W", ("d", 3): "Z", ("e", 0): ""}


def test_positions_and_numbers_of_hot_groups(spark):
    r = random.Random(8)
    rows = [(i * 7, None if i % 3 else "a", f"s{r.randrange(10**6):06d}") for i in range(400)]
    df = spark.createDataFrame(rows, "k bigint, g string, s string").repartition(5)
    got = {x["k"]: x["pos"] for x in da.positions(df, "g", "k", width=100).collect()}
    for g in ("a", None):
        own = sorted(k for k, h, _ in rows if h == g)
        assert [got[k] for k in own] == list(range(len(own)))
    order = sorted(x[2] for x in rows)
    assert [x["s"] for x in da.numbered(df, "s").orderBy("idx").collect()] == order
    assert da.numbered(df.limit(0), "s").count() == 0
    first = {(x["pos"], x["second"]) for x in tk.pairs(df, "g", "k", "s").where("g = 'a'").collect()}
    own = [s for k, g, s in sorted(rows) if g == "a"]
    assert first == {(i, own[i + 1]) for i in range(len(own) - 1)}


def test_alignment_of_many_similar_candidates_ends():
    """Every node of a graph fits every node of the templates; a search of one pair after another took 26 s for the first 28 of the 160."""
    r = random.Random(8)
    graphs = [([{"type": r.choice("abcd"), "ioc": [], "nlp": [r.choice(["load", "loads", "reload", "loaded"])]} for _ in range(4)], [(0, 1), (1, 2), (2, 3)]) for _ in range(40)]
    templates = [([{"type": r.choice("abcd"), "ioc": [], "nlp": [w], "count": r.randint(0, 9)} for w in ["load", "reload", "loads"] * 3], [(a, b, r.randint(1, 9)) for a in range(9) for b in range(9) if a != b], 50) for _ in range(4)]
    began = time.monotonic()
    found = [x for *_, s in gr.Aligner(templates).scores(graphs, 0.9) for x in s]
    assert len(found) == 160 and time.monotonic() - began < 30


def test_vocabulary_has_the_ratio_of_every_string():
    r = random.Random(5)
    words = ["".join(r.choice("abcé") for _ in range(r.choice([0, 1, 8, 16, 17, 63, 64, 65, 130]))) for _ in range(80)]
    voc = ss.Vocabulary(words)
    for a in [*words, "zz"]:
        got = voc.ratios(a)
        assert all(got[i] == ss.indel_ratio(a, w) for w, i in voc.place.items())


def test_learning_takes_the_first_most_similar_node():
    r = random.Random(9)
    words = ["load", "loads", "run", "ran", "drop", "", "10.0.0.1", "10.0.0.2"]
    for _ in range(100):
        graphs = [([{"type": r.choice("ab"), "nlp": r.sample(words, r.randint(0, 2)), "ioc": r.sample(words[6:], r.randint(0, 1))} for _ in range(3)], [(0, 1), (1, 2)], 1) for _ in range(6)]
        nodes, edges = [], {}
        for g_nodes, g_edges, _ in graphs:
            place = []
            for x in g_nodes:
                sims = [gr.node_similarity(n, x) for n in nodes]
                k = sims.index(max(sims)) if sims and max(sims) > 0.7 else len(nodes)
                if k < len(nodes):
                    nodes[k] |= {"count": nodes[k]["count"] + 1} | {f: sorted({*nodes[k][f], *x[f]}) for f in ("nlp", "ioc")}
                else:
                    nodes.append({**x, "count": 1})
                place.append(k)
            for a, b in g_edges:
                edges[place[a], place[b]] = edges.get((place[a], place[b]), 0) + 1
        assert gr.learn(graphs) == (nodes, edges, 6)
