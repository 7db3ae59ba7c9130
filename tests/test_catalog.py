"""Every registered query of the engine against its SQL in DuckDB, and the contract's shape."""

import math
import os

import duckdb
import pytest

from larkspur import catalog


def norm(v):
    if v is None:
        return None
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v.asDict().values())
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{t}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    cols = sorted(df.columns)
    want = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    expected = sorted((tuple(norm(r[k]) for k in at) for r in want.fetchall()), key=repr)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == expected


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_shuffled_input_gives_the_same_groups(spark, sf):
    from larkspur.operators import query as O
    from larkspur.plans.model import relations

    r = relations(spark, sf)
    a = {tuple(x) for x in O.semantic_groups(r).collect()}
    b = {tuple(x) for x in O.semantic_groups(r.repartition(7, "target")).collect()}
    assert a == b
