import random

import pytest

from skarn.llm import cosjoin
from skarn.runtime import ship


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(3))
def test_within_edits(seed):
    r = random.Random(seed)
    for _ in range(400):
        a = [r.choice("abcd") for _ in range(r.randint(0, 14))]
        b = [r.choice("abcd") for _ in range(r.randint(0, 14))] if r.random() < 0.3 else [x for x in a if r.random() > 0.1] + [r.choice("ab")] * r.randint(0, 2)
        k = r.randint(0, 4)
        assert cosjoin.within_edits(a, b, k) == (edits(a, b) <= k)


def mutate(r, w, k):
    w = list(w)
    for _ in range(k):
        op, i = r.random(), r.randrange(len(w))
        if op < 0.4:
            w[i] = f"n{r.randrange(1000)}"
        elif op < 0.7 and len(w) > 1:
            del w[i]
        else:
            w.insert(i, r.choice(w))
    return w


def pairs(o):
    return sorted(map(tuple, o.pairs().collect()))


def test_no_pair_is_lost(spark):
    """Against all pairs: short, middle and very long sentences, few different words, repeats, lengths around the borders."""
    ship(spark)
    r = random.Random(5)
    base = [[f"w{int(r.random() ** 2 * 60)}" for _ in range(n)] for n in (1, 3, 9, 10, 11, 19, 20, 21, 25, 30, 39, 40, 63, 64, 68, 69, 70, 71, 75, 77, 120, 400) for _ in range(3)]
    test = [(i, " ".join(w)) for i, w in enumerate(base)]
    train = []
    for w in base:
        for k in range(0, len(w) // 10 + 3):
            train.append((10_000 + len(train), "  ".join(mutate(r, w, k)).upper() + "."))
    train += [(90_000, None), (90_001, ""), (90_002, "___ --"), (90_003, test[5][1]), (90_004, test[5][1])]
    a = spark.createDataFrame(test, "id bigint, s string").withColumnRenamed("s", "words")
    b = spark.createDataFrame(train, "id bigint, words string")
    got = pairs(cosjoin.Overlaps(a, b, "id", "words"))
    import regex

    split = lambda s: regex.findall(r"[\p{L}\p{N}]+", (s or "").lower())
    want = []
    for i, x in test:
        for j, y in train:
            p, q = split(x), split(y)
            n = max(len(p), len(q))
            if p and q and abs(len(p) - len(q)) <= n // 10 and edits(p, q) <= n // 10:
                want.append((i, j))
    assert got == sorted(want)
    assert len(want) > 200


def test_copies_are_one_class_and_empty_sides(spark):
    a = spark.createDataFrame([(i, "Back to top") for i in range(50)], "id bigint, s string")
    b = spark.createDataFrame([(100 + i, "back, to top!") for i in range(70)], "id bigint, s string")
    o = cosjoin.Overlaps(a, b, "id", "s")
    assert [tuple(r) for r in o.links.collect()] == [(0, 100, 50, 70)]
    assert o.members(0).count() == 50 and o.members(1).count() == 70
    assert pairs(o) == [(i, 100 + j) for i in range(50) for j in range(70)]
    assert pairs(cosjoin.Overlaps(a.limit(0), b, "id", "s")) == []


def test_hot_classes_are_dealt_to_parts(spark, monkeypatch):
    from skarn import runtime

    monkeypatch.setattr(cosjoin, "PART", 7)
    monkeypatch.setattr(runtime, "HOT", 10)
    monkeypatch.setattr(runtime, "HOT_GROUPS", 5)
    line = "one two three four five six seven eight nine ten"
    a = spark.createDataFrame([(i, line if i < 30 else f"{line} {i}") for i in range(40)], "id bigint, s string")
    b = spark.createDataFrame([(100 + i, line if i < 50 else f"x{i} {line}") for i in range(60)] + [(None, line)], "id bigint, s string")
    got = pairs(cosjoin.Overlaps(a, b, "id", "s"))
    # ten words with one more differ by one, two lines with a word more each by two
    assert got == sorted([(i, 100 + j) for i in range(30) for j in range(60)] + [(i, 100 + j) for i in range(30, 40) for j in range(50)])


def test_words(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("Ä_b-2３ don’t",), ("",), ("_ _",), (None,)], "s string")
    assert [r[0] for r in df.select(cosjoin.plain(F.col("s"))).collect()] == ["ä b 2３ don t", "", "", None]


def test_very_long_near_copies():
    r = random.Random(9)
    a = [f"w{r.randrange(500)}" for _ in range(100_000)]
    b = a[:10] + ["new"] + a[10:50_000] + a[50_003:]
    assert cosjoin.within_edits(a, b, 10_000) and not cosjoin.within_edits(a, b, 3)
