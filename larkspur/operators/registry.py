"""A registry of requirement sources: the gate's rules as error rows, revisions in force, artifacts that changes make stale.

Defined cases: a source with an unknown scope or availability has that error alone (and may be a duplicate); an empty registry is
an error of no source; a null id is an id; of events at one time, changes come before issues.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.scalar import expected_resolution

_c = F.col
#: What sources, reviews and evidence may say.
SCOPES = ("IN_SCOPE", "OUT_OF_SCOPE_BY_MODE", "OUT_OF_SCOPE_BY_CONTENT")
AVAILABILITY = ("AVAILABLE", "NOT_PROVIDED_TO_AGENT", "TECHNICALLY_UNREADABLE", "CONFIRMED_ABSENT_FROM_REQUIREMENTS_PACKAGE")
FINAL = ("REVIEWED", "EXCLUDED_WITH_REASON", "BLOCKING_FINDING_CREATED")
METHODS = ("MAIN_READ", "DELEGATED_EXTRACTION_VERIFIED")
REVISION = "^sha256:[0-9a-f]{64}$"
#: The columns of a source; review_revision to discovered are its review's, actual_revision the hash of its file now (null: gone).
SOURCE = "source_id string, scope string, availability string, reason string, discovery_ref string, observation_revision string, content_revision string, content_path string, actual_revision string, resolution string, review_revision string, parts int, method string, verified boolean, discovered array<string>, evidence_ref string, url string, required_mockup boolean"


def revision(*parts) -> Column:
    """The revision of a text of lines."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]), 256))


def evidence_revision(kind, statement, active) -> Column:
    return revision(kind, statement, active.cast("string"))


def source_errors(sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """(source_id, error) of every rule that a source (columns of SOURCE) breaks; evidence: (artifact_id, revision, active)."""
    known = F.coalesce(_c("scope").isin(*SCOPES) & _c("availability").isin(*AVAILABILITY), F.lit(False))
    available, reviewed = _c("availability") == "AVAILABLE", _c("resolution") == "REVIEWED"
    absent = _c("availability") == "CONFIRMED_ABSENT_FROM_REQUIREMENTS_PACKAGE"
    no = lambda c: F.coalesce(c, F.lit(False))
    rules = {
        "observation-revision": ~_c("observation_revision").eqNullSafe(revision(_c("source_id"), _c("scope"), _c("availability"), _c("reason"), _c("discovery_ref"))),
        "content-revision": available & ~no(_c("content_revision").rlike(REVISION)),
        "content-gone": available & _c("content_path").isNotNull() & _c("actual_revision").isNull(),
        "content-changed": available & _c("content_path").isNotNull() & _c("actual_revision").isNotNull() & ~_c("actual_revision").eqNullSafe(_c("content_revision")),
        "revision-of-unavailable": ~available & (F.coalesce("content_revision", F.lit("")) != ""),
        "resolution": ~no((_c("resolution") == expected_resolution(_c("scope"), _c("availability"))) | reviewed),
        "reviewed-unavailable": reviewed & ~((_c("scope") == "IN_SCOPE") & available),
        "review-evidence": reviewed & ~no(_c("review_revision").eqNullSafe(_c("content_revision")) & (_c("parts") > 0)),
        "review-method": reviewed & ~no(_c("method").isin(*METHODS)),
        "review-unverified": reviewed & (_c("method") == METHODS[1]) & ~no(_c("verified")),
        "absence-evidence": absent & (F.coalesce("evidence_ref", F.lit("")) == ""),
        "mockup-content": (F.coalesce("url", F.lit("")) != "") & no(_c("required_mockup")) & reviewed & _c("content_path").isNull(),
    }
    own = F.array(*[F.when(no(broken), F.lit(name)) for name, broken in rules.items()])
    errors = F.when(~known, F.array(F.lit("scope-or-availability"))).otherwise(own)
    single = sources.select("source_id", F.explode(F.array_compact(errors)).alias("error"))
    twice = sources.groupBy("source_id").agg(F.count("*").alias("n")).where("n > 1").select("source_id", F.lit("duplicate-id").alias("error"))
    sound = sources.where(known)
    ids = sources.select(_c("source_id").alias("found")).distinct()
    lost = sound.where(reviewed).select("source_id", F.explode("discovered").alias("found")).join(ids, "found", "left_anti").select("source_id", F.concat(F.lit("unknown-discovery:"), "found").alias("error"))
    refs = sound.where(absent & (F.coalesce("evidence_ref", F.lit("")) != "")).select("source_id", "evidence_ref", F.substring_index("evidence_ref", "@", 1).alias("artifact_id"), F.regexp_extract("evidence_ref", "@(.*)$", 1).alias("wanted"))
    held = evidence.where("active").select("artifact_id", _c("revision").alias("held")).distinct()
    met = refs.join(held, (refs["artifact_id"] == held["artifact_id"]) & (refs["wanted"] == held["held"]), "left")
    sound_ref = (_c("wanted").rlike(REVISION)) & (refs["artifact_id"] != "")
    bad = met.where(~sound_ref | _c("held").isNull()).select("source_id", F.when(~sound_ref, "evidence-format").otherwise("evidence-not-in-force").alias("error"))
    none = sources.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("source_id"), F.lit("empty-registry").alias("error"))
    return reduce(DataFrame.unionByName, [single, twice, lost, bad, none])


def gate(sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """source_errors, and the sources whose resolution leaves the gate open: no rows close it."""
    return source_errors(sources, evidence).unionByName(sources.where(~F.coalesce(_c("resolution").isin(*FINAL), F.lit(False))).select("source_id", F.concat(F.lit("open:"), F.coalesce("resolution", F.lit(""))).alias("error")))


def in_force(observations: DataFrame, revisions: DataFrame, key: str) -> DataFrame:
    """observations (key, at, seen, ...) with the revision in force at their time, since when and until when, and whether what was seen is CURRENT, STALE (an earlier one), EARLY (before the first) or FOREIGN (never one before).

    Revisions (key, at, revision) are intervals up to the key's next one. Both sides meet in one order a key; none is paired with the other.
    """
    rest = [c for c in observations.columns if c not in (key, "at")]
    none = F.lit(None).cast(observations.select(F.struct(*rest).alias("x")).schema["x"].dataType)
    spans = revisions.select(key, "at", "revision", F.lead("at").over(Window.partitionBy(key).orderBy("at")).alias("until"))
    one = spans.select(key, "at", F.lit(0).alias("turn"), none.alias("x"), F.struct(_c("at").alias("since"), "until", "revision").alias("r"))
    two = observations.select(key, "at", F.lit(1).alias("turn"), F.struct(*rest).alias("x"), F.lit(None).cast(one.schema["r"].dataType).alias("r"))
    w = Window.partitionBy(key).orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = one.unionByName(two).withColumn("held", F.last("r", ignorenulls=True).over(w)).where("turn = 1").select(key, "at", "x.*", "held.revision", "held.since", "held.until")
    # A revision's first time tells whether what was seen had been one.
    first = revisions.groupBy(key, _c("revision").alias("seen")).agg(F.min("at").alias("seen_since"))
    met = met.join(first, [key, "seen"], "left")
    status = F.when(_c("revision").isNull(), "EARLY").when(_c("seen") == _c("revision"), "CURRENT").when(_c("seen_since") <= _c("at"), "STALE").otherwise("FOREIGN")
    return met.withColumn("status", status).drop("seen_since")


def forked(artifacts: DataFrame, forks: DataFrame, key: str) -> DataFrame:
    """artifacts (key, at, stage, ...) and whether they are retained: a fork (key, at, stage) supersedes what was made before it for its stage or a later one."""
    rest = [c for c in artifacts.columns if c not in (key, "at")]
    none = F.lit(None).cast(artifacts.select(F.struct(*rest).alias("x")).schema["x"].dataType)
    both = artifacts.select(key, "at", F.struct(*rest).alias("x"), F.lit(None).cast("int").alias("fork")).unionByName(forks.select(key, "at", none.alias("x"), _c("stage").cast("int").alias("fork")))
    later = Window.partitionBy(key).orderBy(_c("at").desc()).rangeBetween(Window.unboundedPreceding, -1)
    told = both.withColumn("least", F.min("fork").over(later)).where("x is not null").select(key, "at", "x.*", "least")
    return told.withColumn("state", F.when(_c("least") <= _c("stage"), "superseded").otherwise("retained")).drop("least")


def artifact_history(events: DataFrame, case: str) -> DataFrame:
    """(case, artifact, run, status, stale_at, reason) of every issued artifact of events (case, at, event): issue makes the current artifact; the first other event after it makes it stale and begins a run; the next issue supersedes it."""
    order = Window.partitionBy(case).orderBy("at", F.when(_c("event") == "issue", 1).otherwise(0))
    told = events.withColumn("artifact", F.sum((_c("event") == "issue").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("artifact > 0")
    change = F.min(F.when(_c("event") != "issue", F.struct("at", "event")))
    each = told.groupBy(case, "artifact").agg(F.min(F.when(_c("event") == "issue", _c("at"))).alias("issued"), change.alias("change"))
    w = Window.partitionBy(case).orderBy("artifact")
    runs = F.coalesce(F.sum(_c("change").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    after = F.lead("issued").over(w)
    full = each.select(case, "artifact", runs.alias("run"), "change", after.alias("after"))
    reason = F.when(_c("change").isNotNull(), _c("change.event")).when(_c("after").isNotNull(), "superseded")
    return full.select(case, "artifact", "run", F.when(reason.isNull(), "CURRENT").otherwise("STALE").alias("status"), F.coalesce("change.at", "after").alias("stale_at"), reason.alias("reason"))
