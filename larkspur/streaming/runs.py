"""Runs of a staged inventory as keyed state: each event moves its run's state, in a stream or over a table.

An event is (run, n, action, stage, artifact, digest, reason, next_action, probe, acknowledged, goal): n orders a run's events.
A run's state is a row, its probes are a map beside it, so that neither an event list nor a run's history is gathered; an event
whose n the run has passed changes nothing, so replays are harmless, as long as a run's events come in order from one trigger to the next.
Within a trigger they are sorted.

Defined cases: start names a goal's objective and comes first or never; a null stage means the run's current one; an event that the
state doesn't allow changes nothing but `refused` and `refusal`; a null run is a run of its own; a null n, or an unknown action, is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from larkspur.streaming.log import LAST_STAGE, PARTIAL, STOPS_TO_BLOCK, VALIDATED

EVENT = "run long, n long, action string, stage int, artifact string, digest string, reason string, next_action string, probe string, acknowledged boolean, goal string"
#: The state's columns, and what a run begins with.
FIRST = {"last_n": -1, "stage": -1, "status": "running", "reason": None, "digest": None, "times": 0, "runs": 0, "run_stages": 0, "artifact": None, "artifact_digest": None, "resume": None, "resume_digest": None, "next_action": None, "goal": None, "probes": 0, "refused": 0, "refusal": None}
_NUMBERS = {"last_n": "long", "stage": "int", "times": "int", "runs": "int", "run_stages": "int", "probes": "int", "refused": "int"}
STATE = ", ".join(f"{c} {_NUMBERS.get(c, 'string')}" for c in FIRST)


def refusal(s: dict, e: dict, probed: bool) -> str | None:
    """Why the state doesn't allow the event, if it doesn't; probed: whether the run has the event's probe."""
    action, at = e["action"], s["stage"] + 1
    stage = at if e["stage"] is None else e["stage"]
    if action == "start":
        return "started" if s["last_n"] >= 0 else None
    if action == "continue":
        if s["status"] == "complete":
            return "complete"
        if s["status"] == "blocked" and not e["acknowledged"]:
            return "blocked"
        return "objective" if s["goal"] is not None and e["goal"] != s["goal"] else None
    if action == "advance":
        return "stage" if stage != at or stage > LAST_STAGE else None
    if action == "probe":
        return "stage" if stage != at else "probe" if probed or e["probe"] is None else None
    if action == "complete":
        return None if s["stage"] == LAST_STAGE else "open-stages"
    return None if action in ("checkpoint", "stop") else "action"


def moved(s: dict, e: dict) -> dict:
    """The state after an event that it allows."""
    action = e["action"]
    if action == "start":
        return s | {"goal": e["goal"]}
    if action == "continue":
        return s | {"status": "running", "runs": s["runs"] + 1, "run_stages": 0, "reason": None, "times": 0 if e["acknowledged"] else s["times"]}
    if action == "checkpoint":
        return s | {"status": "stopped", "reason": e["reason"] or PARTIAL, "digest": e["digest"], "resume": e["artifact"], "resume_digest": e["digest"], "next_action": e["next_action"]}
    if action == "stop":
        times = s["times"] + 1 if (s["reason"], s["digest"]) == (e["reason"], e["digest"]) else 1
        return s | {"status": "blocked" if s["goal"] is not None and times >= STOPS_TO_BLOCK else "stopped", "reason": e["reason"], "digest": e["digest"], "times": times}
    closed = {"resume": None, "resume_digest": None, "next_action": None}
    if action == "advance":
        return s | closed | {"stage": s["stage"] + 1, "artifact": e["artifact"], "artifact_digest": e["digest"], "run_stages": s["run_stages"] + 1, "times": 0, "reason": None}
    if action == "complete":
        return s | closed | {"status": "complete", "reason": VALIDATED}
    return s | {"probes": s["probes"] + 1}


class RunProcessor(StatefulProcessor):
    """One run's state and probes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE)
        self.probes = handle.getMapState("probes", "probe string", "parent int, artifact string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s = dict(zip(FIRST, self.state.get(), strict=True)) if self.state.exists() else dict(FIRST)
        events = pd.concat(list(rows)).sort_values("n", kind="stable")
        for e in events.astype(object).where(events.notna(), None).to_dict("records"):
            if e["n"] is None:
                s |= {"refused": s["refused"] + 1, "refusal": "order"}
            elif e["n"] > s["last_n"]:
                probe = (e["probe"],)
                why = refusal(s, e, e["action"] == "probe" and e["probe"] is not None and self.probes.containsKey(probe))
                if why is None:
                    if e["action"] == "probe":
                        self.probes.updateValue(probe, (s["stage"] + 1, e["artifact"]))
                    s = moved(s, e)
                else:
                    s |= {"refused": s["refused"] + 1, "refusal": why}
                s["last_n"] = int(e["n"])
        self.state.update(tuple(s.values()))
        yield pd.DataFrame([{"run": key[0]} | s])

    def close(self) -> None:
        pass


PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_states(events: DataFrame) -> DataFrame:
    """(run, and the columns of FIRST): each run's state after the trigger's events, or, over a table, after all. events has EVENT's columns."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # the one that keeps state of any kind by key
    spark.streams.active  # noqa: B018  the driver's part of the state stores begins with the streams, which a table doesn't need
    names = [c.split()[0] for c in EVENT.split(", ")]
    return events.select(*names).groupBy("run").transformWithStateInPandas(RunProcessor(), f"run long, {STATE}", "Update", "None")


def follow(events: DataFrame, sink: str, checkpoint: str):
    """A stream of events into a sink of states, one folder a trigger: a trigger that is run again writes over its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return run_states(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)


def latest(states: DataFrame) -> DataFrame:
    """Each run's last state of a sink."""
    columns = [c for c in states.columns if c not in ("run", "batch")]
    return states.groupBy("run").agg({"batch": "max"}).withColumnRenamed("max(batch)", "batch").join(states, ["run", "batch"]).select("run", *columns)
