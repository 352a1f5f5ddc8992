import numpy as np
from pyspark.sql import functions as F

from skarn.llm import graph
from skarn.llm.queries import p2_neighbours
from skarn.runtime import ship


def brute(ids, x, k):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(u @ u.T, 6)
    out = {}
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]
        out[ids[i]] = [ids[j] for j in order]
    return out


def found(df):
    got = {}
    for r in df.orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    return got


def test_small_table_is_exact_with_copies_and_ties(spark):
    ship(spark)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 8))
    x[5] = x[3]
    x[9] = x[3] * 2.5
    x[20:26] = x[19]
    ids = [int(i) * 3 + 1 for i in rng.permutation(40)]
    df = spark.createDataFrame([(i, v.tolist(), "z") for i, v in zip(ids, x, strict=True)], "k bigint, vec array<double>, id string")
    assert found(graph.similar_vectors(df, "k", "vec", 8, 5)) == brute(ids, x, 5)


def test_unusable_vectors_take_no_part(spark):
    ok = [1.0, 2.0]
    bad = [None, [1.0], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 2.0, 3.0], []]
    df = spark.createDataFrame([(0, ok), (1, [2.0, 1.0]), *[(i + 2, v) for i, v in enumerate(bad)]], "id bigint, v array<double>")
    assert found(graph.similar_vectors(df, "id", "v", 2, 3)) == {0: [1], 1: [0]}
    assert graph.similar_vectors(df.where("id > 1"), "id", "v", 2, 3).count() == 0


def test_hot_copies(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT", 20)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 6))
    x[:30] = x[0]
    x[30] = x[0] * 3
    ids = list(range(100, 190))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "id bigint, v array<double>")
    assert found(graph.similar_vectors(df, "id", "v", 6, 4)) == brute(ids, x, 4)


def test_split_shards_search_every_part(spark, monkeypatch):
    monkeypatch.setattr(graph, "MAX_SHARD", 40)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 6))
    ids = list(range(200))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "id bigint, v array<double>")
    got, want = found(graph.similar_vectors(df, "id", "v", 6, 4)), brute(ids, x, 4)
    assert np.mean([len(set(got[i]) & set(want[i])) / 4 for i in ids]) > 0.9


def test_graph_recall():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = graph.ShardGraph(x)
    near = g.neighbours(10)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    top = np.argpartition(-s, 10, axis=1)[:, :10]
    assert (near[:, :, None] == top[:, None, :]).any(1).mean() > 0.95
    assert (g.edges >= 0).sum(1).max() <= graph.SLOTS


def test_searches_enter_at_few_nodes():
    assert graph.TOP <= 256 and graph.ENTRIES < graph.TOP


def test_recall_on_the_table(spark):
    """All rows whose id is divisible by 100 against brute force, where there are many shards of a few thousand nodes."""
    d = "/root/testdata/sf0.1"
    got = found(p2_neighbours(spark, d))
    t = spark.read.parquet(f"{d}/rag_db.parquet").where(graph.usable(F.col("embedding"), 64)).select("rag_id", "embedding").orderBy("rag_id").toPandas()
    ids, x = t["rag_id"].to_numpy(), np.stack(t["embedding"].tolist())
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert set(got) == set(ids.tolist())
    hits = []
    for i in np.flatnonzero(ids % 100 == 0):
        s = np.round(u @ u[i], 6)
        s[i] = -2
        hits.append(len(set(got[ids[i]]) & set(ids[np.lexsort((ids, -s))[:10]].tolist())) / 10)
    assert len(hits) > 100 and np.mean(hits) >= 0.9


def test_two_levels_of_centres_route_like_one():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(6000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    c = graph.Centres(x, 600)
    assert 400 < len(c) <= 640
    got = c.nearest(x[:1000], 2)
    best = np.argsort(-(x[:1000] @ c.all.T), axis=1)[:, :2]
    assert (got[:, :, None] == best[:, None, :]).any(1).mean() > 0.9


def test_centres_of_a_hot_third_differ():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[:1000] = x[0]
    x /= np.linalg.norm(x, axis=1)[:, None]
    c = graph.fit_centres(x, 75)
    s = c @ c.T
    np.fill_diagonal(s, -1)
    assert len(c) > 60 and s.max() < 0.9999


def test_recall_around_a_hot_third_with_many_centres(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(graph, "HOT", 200)
    monkeypatch.setattr(graph, "PER_CENTRE", 60)
    monkeypatch.setattr(graph, "SAMPLE", 2500)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16))
    x[:1000] = x[0]
    x[1000:1030] = x[0] + rng.normal(size=(30, 16)) * 0.2 * np.linalg.norm(x[0]) / 4
    ids = [int(i) for i in rng.permutation(3000)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "id bigint, v array<double>")
    got = found(graph.similar_vectors(df, "id", "v", 16, 10))
    want = brute(ids, x, 10)
    assert all(got[i] == want[i] for i in ids[:1000])
    # a variant's nearest row is a copy of the hot vector, or another variant
    assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in ids[1000:1030]]) > 0.9


def test_many_lengths_of_one_direction_rank_by_id(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(graph, "HOT", 50)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 6))
    x[:100] = x[0] * rng.uniform(0.1, 9, size=(100, 1))
    x[100:140] = x[100] * rng.uniform(0.1, 9, size=(40, 1))
    ids = [int(i) for i in rng.permutation(300)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "id bigint, v array<double>")
    got, want = found(graph.similar_vectors(df, "id", "v", 6, 10)), brute(ids, x, 10)
    assert all(got[i] == want[i] for i in ids[:140])


def test_ties_beyond_the_kept_candidates_are_exact():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 8))
    for a in range(0, 600, 100):  # near copies, whose cosines round to 1
        x[a : a + 100] = x[a] + rng.normal(size=(100, 8)) * 1e-5
    x[600:630] = x[600] + rng.normal(size=(30, 8)) * 1e-5
    ids = rng.permutation(3000).astype(np.int64)
    got, _, ok = graph._lists(ids, [None] * 3000, x, np.ones(3000, bool), 10)
    want = brute(ids.tolist(), x, 10)
    assert ok.all()
    for i in range(630):
        assert [j for j in got[i] if j != ids[i]][:10] == want[ids[i]]
