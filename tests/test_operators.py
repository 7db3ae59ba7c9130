"""Operators on small literal rows: orders, cycles, folds, anchors and the event stream."""

from pyspark.sql import functions as F

from larkspur.functions import scalar as S
from larkspur.operators import evidence as E
from larkspur.operators import graph as G
from larkspur.streaming import log as L


def test_owner_orders_and_frontier(spark):
    edges = spark.createDataFrame([("seed", "container"), ("container", "root")], "src string, dst string")
    seeds = spark.createDataFrame([("seed",)], "node string")
    assert {tuple(r) for r in G.orders(edges, seeds, 5).collect()} == {("seed", 0), ("container", 1), ("root", 2)}


def test_paths_end_in_leaf_and_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    got = {(">".join(r["path"]), r["status"]) for r in G.paths(edges, spark.createDataFrame([("a",)], "node string"), 10, 20).collect()}
    assert got == {("a>b>a", "cycle"), ("a>b>c", "leaf")}


def test_obligations_follow_their_predecessors(spark):
    e = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "x", "y"), (4, "p", "q"), (5, "q", "p")], "id long, src string, dst string")
    got = {r["id"]: (r["parents"], r["depth"]) for r in G.obligations(e).collect()}
    assert got[1] == ([], 0) and got[2] == ([1], 1) and got[3] == ([], 0) and got[4][1] is None


def test_runs_stop_block_and_go_on(spark):
    schema = "k long, n long, action string, reason string, digest string, acknowledged boolean, goal boolean"
    rows = [(1, n, "stop", "net", "d", None, True) for n in range(3)] + [(1, 3, "continue", None, None, None, True)]
    rows += [(2, n, *x, True) for n, x in enumerate([("stop", "a", "d", None), ("stop", "b", "d", None), ("advance", None, None, None), ("stop", "b", "d", None)])]
    rows += [(3, 0, "stop", "x", "d", None, False), (3, 1, "continue", None, None, None, False), (3, 2, "advance", None, None, None, False)]
    rows += [(4, n, "advance", None, None, None, False) for n in range(8)] + [(4, 8, "complete", None, None, None, False), (4, 9, "continue", None, None, None, False)]
    rows += [(5, 0, "checkpoint", None, "d", None, False), (5, 1, "complete", None, None, None, False)]
    rows += [(6, n, "stop", "net", "d", None, True) for n in range(3)] + [(6, 3, "continue", None, None, True, True)]
    got = {r["k"]: tuple(r)[1:] for r in L.folded_states(spark.createDataFrame(rows, schema), "k", "n").collect()}
    assert got[1] == (0, "blocked", "net", 3, 0, 1) and got[2] == (1, "stopped", "b", 1, 0, 0)
    assert got[3] == (1, "running", None, 0, 1, 0) and got[4] == (8, "complete", "stage-8-validated", 0, 0, 1)
    assert got[5] == (0, "stopped", "partial-checkpoint", 0, 0, 1) and got[6] == (0, "running", None, 0, 1, 0)


def test_statuses_and_resolutions(spark):
    status = lambda v: spark.range(1).select(S.normalize_status(F.lit(v).cast("string"))).first()[0]
    want = {"partial": "partial", "noise": "noise", "unknown": "unknown", "closed": "unknown", "matched": "candidate", "source-confirmed": "confirmed", "known": "unknown", "": "unknown", None: "unknown", "checked-no-usage": "checked-no-usage"}
    assert {v: status(v) for v in want} == want
    resolution = lambda s, a: spark.range(1).select(S.expected_resolution(F.lit(s), F.lit(a))).first()[0]
    assert [resolution(*x) for x in (("OUT_OF_SCOPE_X", "AVAILABLE"), ("IN", "AVAILABLE"), ("IN", "TECHNICALLY_UNREADABLE"), ("IN", "GONE"))] == ["EXCLUDED_WITH_REASON", "PENDING_REVIEW", "INPUT_REQUIRED", "BLOCKING_FINDING_CREATED"]


def test_alias_chain_takes_few_rounds(spark):
    pairs = spark.range(500).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("a"), F.lpad((F.col("id") + 1).cast("string"), 4, "0").alias("b"))
    assert {tuple(r) for r in G.alias_components(pairs).groupBy("component").count().collect()} == {("0000", 501)}


def test_different_usage_at_one_range_stays_two_rows(spark):
    c = spark.createDataFrame([(1, "f", 1, "read", "a", "t", "candidate", "x"), (2, "f", 1, "write", "a", "t", "source-confirmed", "xx"), (3, "f", 1, "write", "b", "u", "candidate", "x")], "id long, file string, line int, usage string, alias string, term string, status string, excerpt string")
    got = {r["usage"]: r for r in E.canonical(c, ["file", "line", "usage"], "id").collect()}
    assert len(got) == 2 and got["write"]["status"] == "source-confirmed" and got["write"]["aliases"] == ["a", "b"] and got["write"]["excerpt"] == "xx"


def test_redaction(spark):
    dirty = "bearer abc123 Bearer x.y sk-12345678 my_token=q PRIVATE_KEY=z https://u:p@h/x https://a@h"
    keys = F.create_map(*[F.lit(x) for k in ("credential", "session", "private_key", "apiKey", "n") for x in (k, "v")])
    row = spark.range(1).select(S.redact(F.lit(dirty)).alias("r"), S.redact_map(keys).alias("m"), F.length(S.redact(F.lit("x" * 1200))).alias("n")).first()
    assert row["r"] == "Bearer [REDACTED] Bearer [REDACTED] [REDACTED] my_token=[REDACTED] PRIVATE_KEY=[REDACTED] https://[REDACTED]@h/x https://a@h"
    assert row["m"] == {**dict.fromkeys(("credential", "session", "private_key", "apiKey"), "[REDACTED]"), "n": "v"} and row["n"] == 1000


def test_wildcards(spark):
    df = spark.createDataFrame([("app.Foo",), ("app.Bar",), ("xapp.Foo",)], "v string")
    assert [r[0] for r in df.where(F.col("v").rlike(S.wildcard("APP.f*, *.bar"))).collect()] == ["app.Foo", "app.Bar"]


def test_event_log_is_numbered_across_batches(spark, tmp_path):
    schema = "log string, event string, payload string, at long"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def push(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)
        q = L.append_events(spark.readStream.schema(schema).json(src), out, str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    push([("a", "x", "sk-abcdefgh1", 1), ("a", "y", "", 2), ("b", "x", "", 1)])
    push([("a", "z", "", 3)])
    got = {(r["log"], r["event"]): (r["sequence"], r["payload"]) for r in spark.read.parquet(out).collect()}
    assert got == {("a", "x"): (1, "[REDACTED]"), ("a", "y"): (2, ""), ("b", "x"): (1, ""), ("a", "z"): (3, "")}


def test_possible_returns_of_linear_code(spark):
    from larkspur.operators.returns import possible_returns

    schema = "method string, block int, seq int, kind string, name string, type string, switch_seq int, parameter int, key string, case_value string"
    body = lambda m, *rows: [(m, 0, k, *r, None, None, None, None) for k, r in enumerate(rows)]
    case = lambda m, b, at, value, *rows: [(m, b, 100 * b + k, *r, at, 0, "kind", value) for k, r in enumerate(rows)]
    rows = body("direct", ("return", None, "A"), ("return", None, "Dead"))
    rows += body("last", ("declare", "x", "A"), ("assign", "x", "B"), ("return", "x", None))
    rows += body("lost", ("declare", "x", "A"), ("assign", "x", None), ("return", "x", None))
    rows += body("void", ("declare", "x", "A"), ("flow", None, None), ("return", "x", None))
    rows += body("after", ("flow", None, None), ("declare", "x", "A"), ("return", "x", None))
    rows += body("thrown", ("throw", None, None), ("return", None, "A"))
    rows += body("cases", ("switch", None, None), ("return", None, "Z"))
    rows += case("cases", 1, 0, "one", ("declare", "x", "A"), ("return", "x", None)) + case("cases", 2, 0, None, ("return", None, "D"))
    rows += case("cases", 3, 0, "three", ("flow", None, None), ("return", None, "F")) + case("cases", 4, 0, "four", ("return", None, "A"))
    rows += body("dead", ("return", None, "A"), ("switch", None, None)) + case("dead", 1, 1, "one", ("return", None, "B"))
    got = {tuple(r)[:5] for r in possible_returns(spark.createDataFrame(rows, schema)).collect()}
    plain = lambda m, t: (m, t, None, None, None)
    assert got == {plain("direct", "A"), plain("last", "B"), plain("after", "A"), plain("cases", "Z"), ("cases", "A", 0, "kind", "one"), plain("cases", "D"), plain("cases", "F"), ("cases", "A", 0, "kind", "four"), plain("dead", "A")}
    assert possible_returns(spark.createDataFrame([], schema)).count() == 0
