"""Stateful and incremental behaviours: event logs, content-addressed caches, folds of transitions, staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.scalar import redact

_c = F.col


def append_events(stream: DataFrame, sink_dir: str, checkpoint_dir: str):
    """Append redacted events to a log, each with a sequence number that goes on from the log's last.

    A batch is numbered by its log key and written once for its batch number, so a batch that is run again leaves
    no second copy. stream has log, event, payload and at; forged sequence columns aren't read.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        clean = batch.select("log", "event", redact(_c("payload")).alias("payload"), "at")
        last = _last(spark, sink_dir, number)
        ranked = clean.withColumn("n", F.row_number().over(Window.partitionBy("log").orderBy("at", "event", "payload")))
        out = ranked.join(last, "log", "left").select("log", "event", "payload", "at", (F.coalesce("last", F.lit(0)) + _c("n")).alias("sequence"))
        out.write.mode("overwrite").parquet(f"{sink_dir}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir)


def _last(spark: SparkSession, sink_dir: str, number: int) -> DataFrame:
    try:
        log = spark.read.parquet(sink_dir)
    except Exception as e:  # the log's first batch: nothing is there yet
        if number:
            raise e
        return spark.createDataFrame([], "log string, last long")
    return log.where(_c("batch") < number).groupBy("log").agg(F.max("sequence").alias("last"))


def numbered(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The batch form of append_events: events numbered from 1 within their log."""
    return events.withColumn("sequence", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def with_cache(files: DataFrame, cache: DataFrame, key: str, analyze) -> tuple[DataFrame, DataFrame]:
    """(all results, new results): files whose key is stored are read from the cache, the others analysed."""
    fresh = analyze(files.join(cache.select(key), key, "left_anti"))
    known = files.select(key).join(cache, key)
    return known.unionByName(fresh), fresh


def stale(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status): what a changed, missing or new source means for what was reviewed."""
    j = old.select(key, _c(digest).alias("was")).join(new.select(key, _c(digest).alias("now")), key, "full_outer")
    status = F.when(_c("now").isNull(), "TECHNICALLY_UNREADABLE").when(_c("was").isNull() | (_c("was") != _c("now")), "PENDING_REVIEW").otherwise("CURRENT")
    return j.select(key, status.alias("status"))


#: A run's last stage, how many equal stops block a goal's run, and reasons.
LAST_STAGE, STOPS_TO_BLOCK = 8, 3
PARTIAL, VALIDATED = "partial-checkpoint", "stage-8-validated"


def folded_states(transitions: DataFrame, key: str, order: str) -> DataFrame:
    """(key, stage, status, reason, times, runs, refused): the state after each run's ordered transitions, an explicit fold over its events.

    transitions has action, reason, digest, acknowledged and goal (whether a goal drives the run). advance closes a stage and
    forgets what stopped the run; checkpoint and stop stop it, and a goal's run is blocked by STOPS_TO_BLOCK stops of one
    reason and digest in a row; continue starts it again, unless it is complete, or blocked and not acknowledged; complete
    takes the last stage. refused counts transitions that the state doesn't allow: they change nothing. A run has few events.
    """
    fields = [F.struct(order, "action", "reason", "digest", F.coalesce("acknowledged", F.lit(False)).alias("acknowledged"), F.coalesce("goal", F.lit(False)).alias("goal"))]
    events = transitions.groupBy(key).agg(F.array_sort(F.collect_list(fields[0])).alias("events"))
    none = F.lit(None).cast("string")
    start = F.struct(F.lit(0).alias("stage"), F.lit("running").alias("status"), none.alias("reason"), none.alias("digest"), F.lit(0).alias("times"), F.lit(0).alias("runs"), F.lit(0).alias("refused"))

    def step(s, e):
        is_ = lambda name: e["action"] == name
        over = (s["status"] == "complete") | ((s["status"] == "blocked") & ~e["acknowledged"])
        bad = (is_("continue") & over) | (is_("complete") & (s["stage"] != LAST_STAGE)) | (is_("advance") & (s["stage"] >= LAST_STAGE))
        again = s["reason"].eqNullSafe(e["reason"]) & s["digest"].eqNullSafe(e["digest"])
        times = F.when(is_("stop"), F.when(again, s["times"] + 1).otherwise(1)).when(is_("advance") | (is_("continue") & e["acknowledged"]), 0).otherwise(s["times"])
        status = F.when(is_("continue"), "running").when(is_("checkpoint"), "stopped").when(is_("stop"), F.when(e["goal"] & (times >= STOPS_TO_BLOCK), "blocked").otherwise("stopped")).when(is_("complete"), "complete").otherwise(s["status"])
        reason = F.when(is_("checkpoint"), F.coalesce(e["reason"], F.lit(PARTIAL))).when(is_("stop"), e["reason"]).when(is_("complete"), VALIDATED).otherwise(none)
        digest = F.when(is_("stop") | is_("checkpoint"), e["digest"]).otherwise(s["digest"])
        moved = F.struct((s["stage"] + is_("advance").cast("int")).alias("stage"), status.alias("status"), reason.alias("reason"), digest.alias("digest"), times.alias("times"), (s["runs"] + is_("continue").cast("int")).alias("runs"), s["refused"].alias("refused"))
        return F.when(bad, s.withField("refused", s["refused"] + 1)).otherwise(moved)

    out = events.select(key, F.aggregate("events", start, step).alias("s"))
    return out.select(key, *[f"s.{c}" for c in ("stage", "status", "reason", "times", "runs", "refused")])
