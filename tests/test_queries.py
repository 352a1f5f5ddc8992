"""Every registered core query against its SQL, and that those without SQL run."""

import math
import os

import duckdb
import pytest

from skarn.plans import core

D = "/root/testdata/sf0.001"


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else str(int(v)) if v.is_integer() else f"{v:.6g}"
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_sql(spark, duck, name):
    df = core.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    rel = duck.execute(core.SQL[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=str)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_runs(spark, name):
    assert core.QUERIES[name](spark, D).count() > 0


def test_entry():
    import __spark_entry__ as e

    assert set(core.SQL) <= set(e.oracle_sql()) and set(core.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_word_vectors_are_returned(spark):
    got = {r["word"]: r["vector"] for r in core.QUERIES["word_vectors"](spark, "/root/testdata/sf0.001").collect()}
    assert got
    assert all(len(v) == 16 and all(map(math.isfinite, v)) and any(v) for v in got.values())
