"""Places, codes, ranks and digest trees against plain sorting, at any partitioning."""

import hashlib
import random

from larkspur.operators import ordered

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def _rows(n=900):
    rng = random.Random(n)
    return [(rng.choice(["hot"] * 6 + ["a", "b", "c", None]), rng.choice([None, *range(400)]), rng.choice([None, "", "x", "é", "long" * 5])) for _ in range(n)]


def _key(row):
    return [(v is not None, v if v is not None else "") for v in row]


def test_places_and_codes(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "k string, o int, v string").repartition(7)
    got = sorted((r["place"], tuple(r)[:3]) for r in ordered.placed(df, ["k", "o", "v"]).collect())
    assert [p for p, _ in got] == list(range(len(rows))) and [r for _, r in got] == sorted(rows, key=_key)
    codes = {r["value"]: r["code"] for r in ordered.dense_codes(df.select("v")).collect()}
    assert codes == {v: n for n, v in enumerate([None, "", "long" * 5, "x", "é"])}
    assert ordered.placed(df.limit(0), ["k"]).count() == 0 and ordered.dense_codes(df.select("v").limit(0)).count() == 0


def _tree(items, block):
    while True:
        items = [sha("\n".join(items[k : k + block])) for k in range(0, len(items), block)]
        if len(items) == 1:
            return items[0]


def test_digest_trees_at_any_partitioning(spark):
    rows = _rows(1300)
    by = {}
    for k, o, v in sorted(rows, key=_key):
        if k is not None:
            by.setdefault(k, []).append(v or "")
    for block in (5, 64, 2000):
        want = {k: (len(v), _tree(v, block)) for k, v in by.items()}
        for parts in (1, 9):
            df = spark.createDataFrame(rows, "k string, o int, v string").repartition(parts)
            assert {r["k"]: (r["n"], r["digest"]) for r in ordered.digest_tree(df, "k", ["o", "v"], "v", block=block).collect()} == want
    assert ordered.digest_tree(df.limit(0), "k", ["o"], "v").count() == 0


def test_no_global_window(spark, sf):
    from larkspur import catalog

    for name in ("F20", "F21", "F22", "SRC19", "K1", "K22b", "ST5", "W15"):
        plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "SinglePartition" not in plan, name
