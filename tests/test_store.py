import pytest
from pyspark.sql import functions as F

from skarn.functions import labels as lb
from skarn.plans import pipeline
from skarn.sources import store

D = "/root/testdata/sf0.001"


def test_datasets(spark):
    train, test = store.load_dataset(spark, D, "tram")
    assert train.columns == test.columns == ["sent_id", "sentence", "labels", "document"]
    a, b = store.load_dataset(spark, D, "bosch")
    assert a.count() + b.count() == spark.read.parquet(f"{D}/bosch_train.parquet").count() and b.count() > 0
    assert a.join(b, "sent_id").count() == 0
    with pytest.raises(ValueError, match="unknown"):
        store.load_dataset(spark, D, "x")


def test_embed_table(spark):
    df = spark.createDataFrame([(1, "a", "bb"), (2, "a", "bb"), (3, "c", None)], "id int, t string, u string")
    got = {r["id"]: r["embedding"] for r in store.embed_table(df, "id", "t", "u", embed=lambda ts: [[float(len(t))] for t in ts]).collect()}
    assert got == {1: [6.0], 2: [6.0], 3: [1.0]}


def test_retries_are_bounded():
    calls = []

    def bad(texts):
        calls.append(1)
        raise OSError

    with pytest.raises(OSError):
        store.with_retries(bad, 3, 0.0)(["x"])
    assert len(calls) == 3


def test_catalog_log_and_graph(spark, tmp_path):
    c = store.catalog_table(spark, [("B", "b+"), ("A", "a")])
    assert [tuple(r) for r in store.catalog_from_json(spark, store.catalog_json(c)).collect()] == [("B", 0, "b+"), ("A", 1, "a")]
    store.log_run(spark.range(2), str(tmp_path / "log"), model="m")
    store.log_run(spark.range(1), str(tmp_path / "log"), model="n")
    assert spark.read.parquet(str(tmp_path / "log")).groupBy("run_model").count().count() == 2
    (tmp_path / "g.gml").write_text('graph [\n node [ id 0 label "A b" ]\n node [ id 1 label "C" ]\n edge [ source 0 target 1 kind "x" ]\n]')
    nodes, edges = store.knowledge_graph(spark, str(tmp_path / "g.gml"))
    assert {(r["id"], r["props"]["label"]) for r in nodes.collect()} == {("0", "A b"), ("1", "C")}
    assert [(r["src"], r["dst"]) for r in edges.collect()] == [("0", "1")]


def test_pipeline(spark):
    stages = [("need", pipeline.require("id")), ("double", lambda df: df.withColumn("id", F.col("id") * 2)), ("one", lambda df: df.where("id < 4"))]
    assert pipeline.run(spark.range(5), stages).count() == 2
    assert pipeline.run(spark.range(5), stages, without=["one"]).count() == 5
    with pytest.raises(ValueError, match="unknown"):
        pipeline.run(spark.range(1), stages, without=["x"])
    with pytest.raises(ValueError, match="missing"):
        pipeline.run(spark.range(1), [("need", pipeline.require("x"))])


def test_label_expressions(spark):
    df = spark.createDataFrame([("T1059.003||S0446",), ("TA0011",), ("x",), ("T1",)], "l string")
    got = [tuple(r) for r in df.select(lb.is_compound(F.col("l")), lb.concepts(F.col("l")), lb.concept_kind(F.col("l"))).collect()]
    assert got == [(True, ["T1059.003", "S0446"], None), (True, ["TA0011"], "tactic"), (False, [], None), (False, [], None)]
    r = spark.createDataFrame([("r/1_tram_big_bert", 3725, "-12")], "f string, s int, i string").select(lb.run_setup(F.col("f")).alias("x"), lb.clock(F.col("s")).alias("c"), lb.is_integer(F.col("i")).alias("i")).first()
    assert (r["x"]["run"], r["x"]["dataset"], r["x"]["model"], r["c"], r["i"]) == ("1", "tram", "big_bert", "1:02:05", True)
