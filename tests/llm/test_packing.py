import random

import pytest

from skarn.llm import packing


def test_plan_uses_all_and_never_overfills():
    r = random.Random(2)
    for cap in (1, 7, 64, 2048):
        counts = {r.randint(1, cap): r.randint(1, 50) for _ in range(200)}
        used = {}
        bins = 0
        for times, kind in packing.harmonic_plan(counts, cap):
            assert times > 0 and sum(n * k for n, k in kind) <= cap
            bins += times
            for n, k in kind:
                used[n] = used.get(n, 0) + times * k
        assert used == counts
        assert bins >= -(-sum(n * c for n, c in counts.items()) // cap)
    assert packing.harmonic_plan({}, 10) == []
    with pytest.raises(ValueError, match="lengths"):
        packing.harmonic_plan({11: 1}, 10)


def test_bins_hold_the_fixed_number_of_their_class():
    """All bins but the last open ones are opened by k items of class k."""
    r = random.Random(3)
    counts = {n: 1000 for n in r.sample(range(1, 2048), 300)}
    plan = packing.harmonic_plan(counts, 2048)
    own = sum(t for t, kind in plan if kind[0][1] == 2048 // kind[0][0])
    assert own / sum(t for t, _ in plan) > 0.99


def test_intervals_stay_in_their_class(spark):
    from pyspark.sql import functions as F

    for cap in (1, 5, 100, 2048, 1_000_000):
        df = spark.range(1, min(cap, 3000) + 1).select(((F.col("id") * 7919) % cap + 1).alias("n"))
        got = df.select("n", packing.interval(F.col("n"), cap).alias("u")).collect()
        assert all(x["n"] <= x["u"] <= cap and cap // x["n"] == cap // x["u"] and x["u"] - x["n"] <= x["n"] / packing.FINE for x in got)
        assert len({x["u"] for x in got}) <= packing.FINE * 16


def run(spark, sizes, cap):
    df = spark.createDataFrame([(i, n, 1) for i, n in sizes], "doc_id bigint, n bigint, fill int")
    return packing.pack(df, "doc_id", "n", cap).collect()


def test_every_token_once(spark):
    r = random.Random(4)
    sizes = [(i, r.choice([None, 0, 1, 3, 50, 99, 100, 101, 250, 777, r.randint(1, 300)])) for i in range(800)]
    out = run(spark, sizes, 100)
    got = {}
    for c in out:
        assert c["fill"] == sum(p["n_tokens"] for p in c["pieces"]) <= 100
        assert c["doc_ids"] == sorted({p["doc_id"] for p in c["pieces"]})
        for p in c["pieces"]:
            got.setdefault(p["doc_id"], []).append((p["first_token"], p["n_tokens"]))
    for i, n in sizes:
        if not n:
            assert i not in got
            continue
        at = 0
        for a, k in sorted(got[i]):
            assert a == at
            at += k
        assert at == n and len(got[i]) == -(-n // 100)
    assert len({c["container_id"] for c in out}) == len(out)
    total = sum(n or 0 for _, n in sizes)
    assert total / (100 * len(out)) > 0.97


def test_equal_lengths_and_empty(spark):
    out = run(spark, [(i, 34) for i in range(1000)], 100)
    assert sorted(c["fill"] for c in out) == [68] * 500
    assert run(spark, [], 100) == []


def test_hot_lengths_are_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 50)
    out = run(spark, [(i, 34 if i % 3 else 250) for i in range(900)], 100)
    assert sum(c["fill"] for c in out) == 600 * 34 + 300 * 250
    assert sorted(c["fill"] for c in out if len(c["pieces"]) == 1 and c["fill"] == 100) == [100] * 600
    assert len({c["container_id"] for c in out}) == len(out)
