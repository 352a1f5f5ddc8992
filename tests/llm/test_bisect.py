import random

import pytest

from pyspark.sql import functions as F

from skarn.llm import bisect


def check(text, limit=1200, overlap=100):
    ps = bisect.pieces(text, limit, overlap)
    assert "".join(text[c:b] for _, c, b, _ in ps) == text
    for i, (a, c, b, forced) in enumerate(ps):
        assert b - a <= limit and a <= c < b
        assert c - a <= overlap
        if i:
            assert a >= ps[i - 1][1]
            shared = text[a:c]
            if shared:
                assert a == ps[i - 1][1] or text[a - 1].isspace() or text[a].isspace() or ps[i - 1][1] == a
                assert not forced
            assert forced or text[c - 1].isspace() or text[c].isspace() or text[c - 1] in "。！？”’」』）"
    return ps


def test_prefers_paragraphs_then_sentences():
    p = "word " * 100
    ps = check(p.strip() + ".\n\n" + p + "\n\n" + p.strip())
    assert all(t.endswith("\n\n") for t in [(p.strip() + ".\n\n" + p + "\n\n" + p.strip())[c:b] for _, c, b, _ in ps][:-1])
    assert not any(f for *_, f in ps)


@pytest.mark.parametrize("n,forced", [(1200, False), (1201, True), (1101, False), (1150, False), (5000, True)])
def test_runs_without_space(n, forced):
    for text in ("x" * n + " tail of words " * 40, "head of words " * 100 + "x" * n, "a b " * 400 + "x" * n + "\n" + "c d " * 400, "x" * n + " " * 30 + "y" * 50 + " z" * 300):
        if len(text) > 1200:
            assert any(f for *_, f in check(text)) == forced


def test_random_texts_round_trip():
    r = random.Random(1)
    for _ in range(300):
        parts = []
        for _ in range(r.randint(1, 60)):
            parts.append(r.choice(["x" * r.randint(1, 30), "y" * r.randint(1, 2500) if r.random() < 0.03 else "w", "Ende。", "end. ", "\n\n", " ", "\t", "\n", "   ", "é" * 5]) + r.choice(["", " ", " "]))
        text = "".join(parts) * r.randint(1, 12)
        if len(text) > 1200:
            run = max((len(w) for w in text.split()), default=0)
            assert any(f for *_, f in check(text)) == (run > 1200)


def test_only_space():
    check(" " * 5000)
    check("a" + " " * 3000 + "b")


def test_table(spark):
    rows = [(1, None, "q"), (2, "", "q"), (3, "w " * 600, "q"), (4, "w " * 601, "q"), (4, "w " * 601, "q"), (5, "x" * 1201, "q")]
    df = spark.createDataFrame(rows, "piece_no bigint, text string, piece string")
    with pytest.raises(ValueError, match="overlap"):
        bisect.split_texts(df, "piece_no", "text", 10, 10)
    df = df.withColumnRenamed("piece_no", "id")
    out = bisect.split_texts(df, "id", "text").collect()
    assert {r["id"] for r in out} == {4, 5}
    assert sum(r["forced"] for r in out) == 1
    assert sum(r["end_char"] - r["core_char"] for r in out) == 2 * 1202 + 1201
    assert bisect.split_texts(df.limit(0), "id", "text").count() == 0


def test_a_run_with_ideographic_stops_is_unbroken(spark):
    df = spark.createDataFrame([(1, "漢字。" * 500), (2, "word " * 400)], "i bigint, t string")
    got = {r["i"]: (r["u"], r["f"]) for r in bisect.split_texts(df, "i", "t").groupBy("i").agg(F.max("unbroken").alias("u"), F.max("forced").alias("f")).collect()}
    assert got == {1: (True, False), 2: (False, False)}
