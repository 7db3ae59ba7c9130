"""Run states: the same end by any split of a stream, replays that change nothing, and what is refused."""

import random

from larkspur.streaming import runs

NAMES = [c.split()[0] for c in runs.EVENT.split(", ")]


def _events(seed=5):
    rng = random.Random(seed)
    out = []
    for run in range(12):
        for n in range(rng.randrange(1, 40)):
            action = "start" if n == 0 and run % 3 else rng.choice(["advance"] * 5 + ["continue", "checkpoint", "stop", "stop", "probe", "complete", "odd"])
            out.append((run, n, action, rng.choice([None, None, None, 1]), f"a{n}", rng.choice(["d", "e"]), rng.choice([None, "r"]), None, rng.choice(["p", "q", None]), rng.random() < 0.4, rng.choice(["g", "g", "h"]) if run % 2 else None))
    return out


def _fold(events):
    """The end states by plain folding, with probes as sets."""
    out = {}
    for e in sorted(events, key=lambda e: (e[0], e[1])):
        s, probes = out.setdefault(e[0], (dict(runs.FIRST), set()))
        e = dict(zip(NAMES, e))
        if e["n"] <= s["last_n"]:
            continue
        why = runs.refusal(s, e, e["probe"] in probes)
        if why is None and e["action"] == "probe":
            probes.add(e["probe"])
        s = runs.moved(s, e) if why is None else s | {"refused": s["refused"] + 1, "refusal": why}
        out[e["run"]] = (s | {"last_n": e["n"]}, probes)
    return {run: tuple(s.values()) for run, (s, _) in out.items()}


def test_same_states_by_any_split_and_with_replays(spark, tmp_path):
    events = _events()
    want = _fold(events)
    assert {s[2] for s in want.values()} >= {"running", "stopped"} and any(s[15] for s in want.values())
    table = spark.createDataFrame(events, runs.EVENT)
    assert {r[0]: tuple(r)[1:] for r in runs.run_states(table.unionByName(table)).collect()} == want
    for name, cuts in {"one": [0, 99], "three": [0, 5, 20, 99], "again": [0, 30, 10, 99]}.items():
        at = f"file://{tmp_path}/{name}"
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            # "again": the second lot repeats events that the first had.
            table.where(f"n >= {min(lo, hi)} and n < {max(lo, hi)}").coalesce(1).write.mode("append").parquet(f"{at}/in")
            stream = spark.readStream.schema(runs.EVENT).parquet(f"{at}/in")
            runs.follow(stream, f"{at}/out", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        if name == "again":
            table.where("n >= 30").coalesce(1).write.mode("append").parquet(f"{at}/in")
            runs.follow(spark.readStream.schema(runs.EVENT).parquet(f"{at}/in"), f"{at}/out", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        assert {r["run"]: tuple(r)[1:] for r in runs.latest(spark.read.parquet(f"{at}/out")).collect()} == want, name


def test_protocol():
    at = lambda **x: runs.FIRST | x
    e = lambda action, **x: dict.fromkeys(NAMES) | {"action": action, "acknowledged": False} | x
    assert runs.refusal(at(status="complete"), e("continue"), False) == "complete"
    assert runs.refusal(at(status="blocked"), e("continue"), False) == "blocked" and runs.refusal(at(status="blocked"), e("continue", acknowledged=True), False) is None
    assert runs.refusal(at(goal="g"), e("continue", goal="h"), False) == "objective" and runs.refusal(at(goal="g"), e("continue", goal="g"), False) is None
    assert runs.refusal(at(stage=3), e("advance", stage=3), False) == "stage" and runs.refusal(at(stage=3), e("advance", stage=4), False) is None and runs.refusal(at(stage=8), e("advance"), False) == "stage"
    assert runs.refusal(at(stage=3), e("probe", stage=4, probe="p"), True) == "probe" and runs.refusal(at(stage=3), e("probe", stage=5, probe="p"), False) == "stage"
    assert runs.refusal(at(stage=7), e("complete"), False) == "open-stages" and runs.refusal(at(), e("jump"), False) == "action" and runs.refusal(at(last_n=0), e("start"), False) == "started"
    s = at(goal="g")
    for _ in range(3):
        s = runs.moved(s, e("stop", reason="net", digest="d"))
    assert (s["status"], s["times"]) == ("blocked", 3)
    s = runs.moved(s, e("checkpoint", artifact="a", digest="x", next_action="look"))
    assert (s["status"], s["reason"], s["resume"], s["resume_digest"], s["next_action"]) == ("stopped", "partial-checkpoint", "a", "x", "look")
    s = runs.moved(s, e("advance", artifact="b", digest="y"))
    assert (s["stage"], s["artifact"], s["artifact_digest"], s["resume"], s["times"], s["status"]) == (0, "b", "y", None, 0, "stopped")
