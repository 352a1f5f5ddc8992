import pytest
from pyspark.sql import functions as F

from skarn import runtime as rt


def test_join_groups_with_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(rt, "HOT", 20)
    monkeypatch.setattr(rt, "HOT_GROUPS", 10)
    rows = spark.range(300).select("id", F.when(F.col("id") < 150, 0).otherwise(F.col("id") % 50).alias("k"), F.lit("r").alias("n"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first"))
    out = rt.join_groups(rows, groups, ["k"], "size", 300)
    assert out.columns == ["k", "id", "n", "first"]
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, rows.join(groups.drop("size"), "k").collect()))
    assert "BroadcastHashJoin" in out._jdf.queryExecution().toString()
    assert rt.join_groups(rows.limit(0), groups.limit(0), ["k"], "size", 0).count() == 0


def test_broadcast_only_by_checked_bytes(spark):
    df = spark.createDataFrame([(i, "x" * 100) for i in range(100)], "a int, b string")
    assert "ResolvedHint (strategy=broadcast)" in rt.broadcast_if_small(df)._jdf.queryExecution().toString()
    assert "broadcast" not in rt.broadcast_if_small(df, 1000)._jdf.queryExecution().toString()
    assert rt.broadcast_if_small(df.limit(0)).count() == 0


def test_missing_columns():
    class Table:
        columns = ["a"]

    with pytest.raises(ValueError, match="missing columns"):
        rt.need(Table(), "a", "b")
