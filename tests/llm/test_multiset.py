import random

import pytest

from skarn.llm import multiset


def test_keys():
    assert multiset.letters("  Caf&eacute;: <b>") == "caféb"
    assert multiset.letters("Café") == "café"
    assert multiset.letters(None) == "" and multiset.letters(" -_ ") == ""
    assert sorted(multiset.author_words("Doe, J. and Ann &amp; Bo")) == ["ann", "bo", "doe", "j"]
    assert multiset.doi_letters("https://doi.org/10.1/AB-c") == "101abc" == multiset.doi_letters("DOI: 10.1/abc")
    assert multiset.doi_letters("n/a") == "" == multiset.doi_letters(None)


def test_fingerprint_ignores_order_but_not_names_or_repeats():
    a = multiset.fingerprint([("t", "x"), ("a", "p"), ("a", "q")])
    assert a == multiset.fingerprint([("a", "q"), ("t", "x"), ("a", "p")])
    assert a != multiset.fingerprint([("a", "x"), ("t", "p"), ("a", "q")])
    assert multiset.fingerprint([("a", "p"), ("a", "p")]) != multiset.fingerprint([("a", "p")])


def run(spark, rows, bits=64):
    df = spark.createDataFrame(rows, "pid bigint, title string, authors string, doi string").selectExpr("*", "'x' AS keep_id")
    members, records = multiset.collapse(df, "pid", "title", "authors", "doi", bits)
    return sorted(tuple(r) for r in members.collect()), {r["keep_id"]: r["copies"] for r in records.collect()}


@pytest.mark.parametrize("bits", [64, 1])
def test_collapse_against_brute_force(spark, bits):
    """With fingerprints of two bits many different records share one."""
    from collections import Counter

    r = random.Random(3)
    titles = ["A study", "a  STUDY.", "Another &amp; one", "another one", "é", "é", None, "??"]
    auths = ["A B and C", "C, A; B", "A B", "A A B", None, "and", ""]
    dois = ["10.1/x", "doi:10.1/X", None, "none", "10.2/x"]
    rows = [(i, r.choice(titles), r.choice(auths), r.choice(dois)) for i in range(300)]
    members, records = run(spark, rows, bits)
    groups = {}
    for i, t, a, d in rows:
        if multiset.letters(t):
            groups.setdefault((multiset.letters(t), frozenset(Counter(multiset.author_words(a)).items()), multiset.doi_letters(d)), []).append(i)
    assert members == sorted((min(g), i) for g in groups.values() for i in g)
    assert records == {min(g): len(g) for g in groups.values()}


def test_hot_class_and_empty_table(spark):
    members, records = run(spark, [(i, "Same", "A B" if i % 2 else "B A", None) for i in range(500)])
    assert records == {0: 500} and len(members) == 500
    assert run(spark, []) == ([], {})
    assert run(spark, [(1, None, None, None)]) == ([], {})


def test_no_sort_in_the_verification(spark):
    df = spark.createDataFrame([(1, "t", "A B", None), (2, "t", "B A", None)], "pid bigint, title string, authors string, doi string")
    members, records = multiset.collapse(df, "pid", "title", "authors", "doi")
    for x in (members, records):
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert "Sort" not in plan
    assert sorted(map(tuple, members.collect())) == [(1, 1), (1, 2)]


def test_null_ids_and_long_fields(spark):
    rows = [(None, "t", "a", None), (1, "x" * 200_000, "a " * 50_000, None), (2, "X" * 200_000, "A " * 50_000, "")]
    assert run(spark, rows) == ([(1, 1), (1, 2)], {1: 2})
