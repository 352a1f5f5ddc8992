import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.llm import rake


def test_rake_meets_both_margins():
    w = rake.rake({("a", "x"): 10, ("a", "y"): 40, ("b", "x"): 30, ("b", "y"): 20}, [{"a": 0.3, "b": 0.7}, {"x": 0.5, "y": 0.5}])
    assert w["a", "x"] + w["a", "y"] == pytest.approx(0.3)
    assert w["a", "x"] + w["b", "x"] == pytest.approx(0.5)
    assert rake.rake({}, [{"a": 1.0}]) == {}
    assert set(rake.rake({("a",): 5, ("b",): 0}, [{"a": 0.5, "b": 0.5}])) == {("a",)}


def test_repair_of_minimums():
    def repair(drawn, available, minimum, weight, size):
        return rake.repaired(*(np.array(x) for x in (drawn, available, minimum)), np.array(weight, float), size).tolist()

    assert repair([95, 4, 1], [1000, 6, 2], [0, 6, 5], [0.9, 0.05, 0.05], 100) == [92, 6, 2]
    assert repair([10, 0], [1000, 50], [0, 0], [1.0, 0.0], 100) == [100, 0]
    assert repair([10, 0], [20, 50], [0, 0], [1.0, 0.0], 60) == [20, 40]
    assert repair([10, 0], [20, 50], [30, 30], [1.0, 0.0], 5) == [20, 30]
    assert repair([], [], [], [], 7) == []


def test_first_category(spark):
    df = spark.createDataFrame([([None, " ", "\tt1\n", "T2"],), ([],), (None,), ([" "],)], "l array<string>")
    assert [r[0] for r in df.select(rake.first_category(F.col("l"))).collect()] == ["T1", "NO_TTP", None, "NO_TTP"]


def tables(spark):
    rows = []
    for i in range(2000):
        cat = ["A"] if i % 10 < 6 else [] if i % 10 < 9 else ["b "]
        rows.append((i, f"text {i % 1500} " + "x" * (i % 250), cat))
    rows += [(5000 + i, "same text", ["C"]) for i in range(50)] + [(6000, None, ["A"]), (6001, "  ", ["A"]), (6002, "q", None)]
    syn = spark.createDataFrame(rows, "syn_id bigint, augmented_sentence string, labels array<string>").withColumn("category", F.lit("clash"))
    targets = spark.createDataFrame([("A", 0.5, 2), ("NO_TTP", 0.3, 2), ("B", 0.1, 5), ("C", 0.05, 3), ("D", 0.05, 1)], "category string, target_share double, min_rows int")
    return syn, targets


def sample_of(syn, targets, fraction=0.05, **more):
    return rake.ProportionalSample(syn, targets, "syn_id", "augmented_sentence", "labels", fraction, **more)


def test_sample_and_report(spark):
    syn, targets = tables(spark)
    s = sample_of(syn, targets, 0.1)
    got = s.texts().collect()
    n = syn.count()
    assert round(0.1 * n) <= len(got) < round(0.1 * n) + 5
    assert len({(r["category"], r["text"]) for r in got}) == len(got)
    own = {r["syn_id"]: r for r in syn.collect()}
    assert all(own[r["row_id"]]["augmented_sentence"] == r["text"] for r in got)
    rep = {r["category"]: r for r in s.report.collect()}
    drawn = {c: sum(r["category"] == c for r in got) for c in rep}
    assert {c: r["drawn"] for c, r in rep.items()} == drawn
    assert set(rep) == {"A", "NO_TTP", "B", "C", "D"}
    assert drawn["C"] == 1 and drawn["B"] >= 5 and drawn["D"] == 0
    assert all(drawn[c] >= r["needed"] or drawn[c] == r["available"] for c, r in rep.items())
    assert {c for c, r in rep.items() if r["lacking"] > 0} == {"C", "D"}
    assert sum(r["raked"] for r in rep.values()) == pytest.approx(1)
    again = {r["row_id"] for r in sample_of(syn.repartition(3), targets, 0.1).rows.collect()}
    assert again == {r["row_id"] for r in got}


def test_weights_differ_within_a_category(spark):
    """Half of the rows are long, but the second margin asks for what the pool has; a category of only short texts shifts the weights of the others."""
    rows = [(i, f"{i} " + ("x" * 300 if i % 2 else "y"), ["A"]) for i in range(4000)] + [(10_000 + i, f"{i} b", ["B"]) for i in range(4000)]
    syn = spark.createDataFrame(rows, "syn_id bigint, augmented_sentence string, labels array<string>")
    targets = spark.createDataFrame([("A", 0.5, 0), ("B", 0.5, 0)], "category string, target_share double, min_rows int")
    s = sample_of(syn, targets, 0.1)
    w = {(r["category"], r["band"]): r["weight"] for r in s.rows.collect()}
    assert set(w) == {("A", 0), ("A", 2), ("B", 0)}
    n = {(r["category"], r["band"]): r["count"] for r in s.rows.groupBy("category", "band").count().collect()}
    assert sum(n.values()) == 800 and abs(n["B", 0] - 400) <= 60 and abs(n["A", 2] - 200) <= 50
    targets = spark.createDataFrame([("A", 0.7, 0), ("B", 0.3, 0)], "category string, target_share double, min_rows int")
    w = {(r["category"], r["band"]): r["weight"] for r in sample_of(syn, targets, 0.1).rows.collect()}
    assert w["A", 0] > 1.5 * w["A", 2]


def test_a_hot_category_and_copies(spark):
    rows = [(i, "same line", ["A"]) for i in range(3000)] + [(5000 + i, f"line {i}", ["A", "T9"]) for i in range(3000)] + [(9000 + i, f"line {i}", ["B"]) for i in range(20)]
    syn = spark.createDataFrame(rows, "syn_id bigint, augmented_sentence string, labels array<string>")
    targets = spark.createDataFrame([("A", 0.9, 1), ("B", 0.1, 1)], "category string, target_share double, min_rows int")
    s = sample_of(syn, targets)
    rep = {r["category"]: r for r in s.report.collect()}
    assert rep["A"]["available"] == 3001 and rep["B"]["drawn"] == 20 and rep["B"]["lacking"] == pytest.approx(0.1 * 0.05 * 6020 - 20)
    assert s.rows.count() == 301


def test_empty_table(spark):
    syn, targets = tables(spark)
    s = sample_of(syn.limit(0), targets)
    assert s.texts().count() == 0
    assert {r["category"] for r in s.report.where("lacking > 0").collect()} == {"A", "NO_TTP", "B", "C", "D"}


def test_too_many_targets_are_an_error(spark):
    syn, _ = tables(spark)
    targets = spark.range(rake.MAX_TARGETS + 1).select(F.col("id").cast("string").alias("category"), F.lit(1e-5).alias("target_share"), F.lit(1).alias("min_rows"))
    with pytest.raises(ValueError, match="target categories"):
        sample_of(syn, targets)


def test_null_ids_and_long_texts(spark):
    syn = spark.createDataFrame([(None, "a", ["A"]), (1, "x" * 300_000, ["A"]), (2, "b", [None, " "])], "syn_id bigint, augmented_sentence string, labels array<string>")
    targets = spark.createDataFrame([("A", 1.0, 1)], "category string, target_share double, min_rows int")
    assert [(r["row_id"], len(r["text"])) for r in sample_of(syn, targets).texts().collect()] == [(1, 300_000)]
