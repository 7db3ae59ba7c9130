"""The registry's gate on small cases, revisions in force, forks and artifacts by hand."""

from pyspark.sql import functions as F

from larkspur.operators import registry as R

EVIDENCE = "artifact_id string, revision string, active boolean"


def _source(spark, **x):
    row = {"source_id": "a", "scope": "IN_SCOPE", "availability": "AVAILABLE", "reason": "", "discovery_ref": None, "observation_revision": None, "content_revision": "sha256:" + "0" * 64, "content_path": "f", "actual_revision": "sha256:" + "0" * 64, "resolution": "REVIEWED", "review_revision": "sha256:" + "0" * 64, "parts": 2, "method": "MAIN_READ", "verified": None, "discovered": [], "evidence_ref": None, "url": None, "required_mockup": None} | x
    df = spark.createDataFrame([tuple(row.values())], R.SOURCE)
    return df.withColumn("observation_revision", F.coalesce("observation_revision", R.revision(*[F.col(c) for c in ("source_id", "scope", "availability", "reason", "discovery_ref")])))


def test_gate_rules(spark):
    good = "sha256:" + "1" * 64
    evidence = spark.createDataFrame([("e", good, True), ("off", good, False)], EVIDENCE)
    cases = [
        (_source(spark), set()),
        (_source(spark, resolution="PENDING_REVIEW"), {"open:PENDING_REVIEW"}),
        (_source(spark, actual_revision=None), {"content-gone"}),
        (_source(spark, content_path=None, actual_revision=None, url="u", required_mockup=True), {"mockup-content"}),
        (_source(spark, method="DELEGATED_EXTRACTION_VERIFIED"), {"review-unverified"}),
        (_source(spark, discovered=["a", "b"]), {"unknown-discovery:b"}),
        (_source(spark, scope=None), {"scope-or-availability"}),
        (_source(spark, availability="CONFIRMED_ABSENT_FROM_REQUIREMENTS_PACKAGE", content_revision=None, resolution="BLOCKING_FINDING_CREATED", evidence_ref=f"e@{good}"), set()),
        (_source(spark, availability="CONFIRMED_ABSENT_FROM_REQUIREMENTS_PACKAGE", content_revision=None, resolution="BLOCKING_FINDING_CREATED", evidence_ref=f"off@{good}"), {"evidence-not-in-force"}),
        (_source(spark, observation_revision="x", resolution=None), {"observation-revision", "resolution", "open:"}),
    ]
    tagged = [R.gate(df, evidence).withColumn("k", F.lit(k)) for k, (df, _) in enumerate(cases)]
    got = {k: set() for k in range(len(cases))}
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    for r in every.collect():
        got[r["k"]].add(r["error"])
    assert got == {k: want for k, (_, want) in enumerate(cases)}
    assert [r["error"] for r in R.gate(_source(spark).limit(0), evidence).collect()] == ["empty-registry"]


def test_revisions_and_forks(spark):
    revisions = spark.createDataFrame([("s", 1, "a"), ("s", 5, "b"), ("s", 9, "a")], "k string, at int, revision string")
    seen = spark.createDataFrame([("s", 0, "a"), ("s", 1, "a"), ("s", 5, "a"), ("s", 8, "c"), ("s", 9, "b"), ("t", 1, "a")], "k string, at int, seen string")
    got = {(r["k"], r["at"]): (r["revision"], r["until"], r["status"]) for r in R.in_force(seen, revisions, "k").collect()}
    assert got == {("s", 0): (None, None, "EARLY"), ("s", 1): ("a", 5, "CURRENT"), ("s", 5): ("b", 9, "STALE"), ("s", 8): ("b", 9, "FOREIGN"), ("s", 9): ("a", None, "STALE"), ("t", 1): (None, None, "EARLY")}
    artifacts = spark.createDataFrame([("l", 1, 2, "x"), ("l", 2, 5, "y"), ("l", 6, 5, "z")], "k string, at int, stage int, name string")
    forks = spark.createDataFrame([("l", 3, 4), ("m", 3, 0)], "k string, at int, stage int")
    assert {r["name"]: r["state"] for r in R.forked(artifacts, forks, "k").collect()} == {"x": "retained", "y": "superseded", "z": "retained"}


def test_artifact_history(spark):
    events = spark.createDataFrame([(1, 0, "add"), (1, 1, "issue"), (1, 2, "issue"), (1, 3, "update"), (1, 4, "review"), (1, 5, "issue"), (2, 1, "add")], "k int, at int, event string")
    got = [tuple(r)[1:] for r in R.artifact_history(events, "k").orderBy("artifact").collect()]
    assert got == [(1, 1, "STALE", 2, "superseded"), (2, 1, "STALE", 3, "update"), (3, 2, "CURRENT", None, None)]
