import pytest
from pyspark.sql import functions as F

from skarn.llm import burst


def rows(df):
    return {(r["dataset"], r["term"]): (r["occurrences"], r["records"]) for r in df.collect()}


def test_trie_bursts_and_keeps_counts():
    t = burst.BurstTrie(burst=2)
    words = ["a", "ab", "abc", "abd", "b", "", "abc", "ä", "abcdef"]
    for w in words:
        t.add(w, 1, 1)
    got = {w: o for w, o, _ in t.items()}
    assert got == {w: words.count(w) for w in words}
    assert t.size == len(set(words))


def test_counts_nulls_repeats_and_clashing_columns(spark):
    data = [("x", ["a", " a\t", None, "", "b"], 1), ("x", ["A\n"], 2), ("x", None, 3), ("y", [], 4), (None, ["c"], 5), ("y", ["t" * 5000], 6)]
    df = spark.createDataFrame(data, "dataset string, labels array<string>, term int")
    clean = df.withColumn("labels", burst.clean_items(F.col("labels")))
    got = rows(burst.term_frequencies(clean, "dataset", "labels"))
    assert got == {("x", "A"): (3, 2), ("x", "B"): (1, 1), ("", "C"): (1, 1), ("y", "T" * 5000): (1, 1)}


def test_brute_force(spark):
    data = [(str(i % 3), [f"w{(i * j) % 17}" for j in range(i % 7)]) for i in range(500)]
    got = rows(burst.term_frequencies(spark.createDataFrame(data, "dataset string, terms array<string>").repartition(7), "dataset", "terms"))
    want = {}
    for d, ts in data:
        for t in ts:
            o, r = want.get((d, t), (0, 0))
            want[d, t] = (o + 1, r)
        for t in set(ts):
            o, r = want[d, t]
            want[d, t] = (o, r + 1)
    assert got == want


def test_empty_table_and_missing_column(spark):
    df = spark.createDataFrame([], "dataset string, terms array<string>")
    assert burst.term_frequencies(df, "dataset", "terms").count() == 0
    with pytest.raises(ValueError, match="missing"):
        burst.term_frequencies(df, "dataset", "nope")


def test_marks(spark):
    f = spark.createDataFrame([("d", "a", 9, 4), ("d", "b", 9, 5), ("d", "c", 30, 10), ("d", "e", 30, 11)], "dataset string, term string, occurrences bigint, records bigint")
    n = spark.createDataFrame([("d", 100)], "dataset string, n_rows bigint")
    assert {r["term"]: r["mark"] for r in burst.mark_frequencies(f, n).collect()} == {"a": "rare", "b": None, "c": None, "e": "common"}


def test_subtrees_of_different_depth_merge():
    import random

    r = random.Random(2)
    terms = ["".join(r.choice("abc") for _ in range(r.randint(0, 7))) for _ in range(3000)]
    whole, parts = burst.BurstTrie(4), [burst.BurstTrie(b) for b in (1, 3, 50, 4000)]
    for i, t in enumerate(terms):
        whole.add(t, 2, 1)
        parts[i % 4].add(t, 2, 1)
    merged = burst.BurstTrie(4)
    leaves = [x for p in parts for x in p.leaves()]
    r.shuffle(leaves)
    for prefix, box in leaves:
        merged.graft(prefix, {k: list(c) for k, c in box.items()})
    assert sorted(merged.items()) == sorted(whole.items())


def test_routes_split_heavy_prefixes():
    got = burst.routes({"T1": 50, "T2": 5, "T10": 60, "S": 3}, 40)
    assert got == {"", "T", "S", "T1", "T2", "T10"}
    assert burst.routes({"a": 1}, 10) == {""} and burst.routes({}, 1) == {""}


def test_many_routes(spark, monkeypatch):
    monkeypatch.setattr(burst, "ROUTES", 40)
    monkeypatch.setattr(burst, "BURST", 3)
    data = [("d", [f"T{(i * j) % 997}", "T", ""]) for i in range(300) for j in range(3)]
    got = rows(burst.term_frequencies(spark.createDataFrame(data, "dataset string, terms array<string>").repartition(6), "dataset", "terms"))
    from collections import Counter

    want = Counter(t for _, ts in data for t in ts)
    assert {t: o for (_, t), (o, _) in got.items()} == want
