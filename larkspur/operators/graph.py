"""Graphs of names: paths, reachability, orders, obligations, aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.components import components
from larkspur.session import keep

_c = F.col


#: After so many rounds what has been seen is written anew, so that plans stay short.
FOLD = 16


def _spread(edges: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """(node, level): breadth-first rounds over the frontier alone; a round adds its frontier to what has been seen."""
    edges = keep(edges.select("src", "dst").distinct(), "edges")
    seen = frontier = keep(roots.select("node", F.lit(0).alias("level")).distinct(), "seen")
    for k in range(1, most + 1):
        new = frontier.join(edges, frontier["node"] == edges["src"]).select(_c("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = keep(new.withColumn("level", F.lit(k)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if k % FOLD == 0:
            seen = keep(seen, "seen")
    return seen


def reachable(edges: DataFrame, roots: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(node): what roots reach over edges (src, dst)."""
    return _spread(edges, roots, most_rounds).select("node")


def orders(edges: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """(node, level): the least number of steps from a seed along edges (src, dst), up to most."""
    return _spread(edges, seeds, most)


def paths(edges: DataFrame, seeds: DataFrame, most_depth: int, most_branches: int) -> DataFrame:
    """(seed, path, status): every path from a seed, ended by leaf, cycle or max-depth; a node's branches are cut in order of dst."""
    from pyspark.sql import Window

    cut = edges.select("src", "dst").distinct().withColumn("branch", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(_c("branch") <= most_branches).select("src", "dst")
    cut = keep(cut, "edges")
    open_ = seeds.select(_c("node").alias("seed"), F.array("node").alias("path"))
    done = None
    for depth in range(most_depth + 1):
        last = F.element_at("path", -1)
        step = open_.withColumn("last", last).join(cut, _c("last") == _c("src"), "left")
        ended = step.select("seed", F.when(_c("dst").isNull(), _c("path")).otherwise(F.concat("path", F.array("dst"))).alias("path"), F.when(_c("dst").isNull(), "leaf").when(F.array_contains("path", _c("dst")), "cycle").when(F.lit(depth == most_depth), "max-depth").alias("status"))
        ended = keep(ended, "paths")
        closed = ended.where("status is not null")
        done = closed if done is None else done.unionByName(closed)
        open_ = ended.where("status is null").select("seed", "path")
        if open_.isEmpty():
            break
    return done


def obligations(edges: DataFrame) -> DataFrame:
    """(id, parents, depth): an obligation per edge of an acyclic graph after all of its predecessors, by layers."""
    ids = edges.select("id", "src", "dst")
    before = ids.alias("a").join(ids.alias("b"), _c("a.src") == _c("b.dst")).select(_c("a.id").alias("id"), _c("b.id").alias("pred"))
    before = keep(before, "before")
    placed = keep(ids.join(before, "id", "left_anti").select("id", F.lit(0).alias("depth")), "placed")
    while True:
        waiting = before.join(placed.select("id"), "id", "left_anti")
        ready = waiting.join(placed.select(_c("id").alias("pred"), "depth"), "pred", "left").groupBy("id").agg(F.max("depth").alias("depth"), F.count("*").alias("n"), F.count("depth").alias("met")).where("n = met").select("id", (_c("depth") + 1).alias("depth"))
        ready = keep(ready, "ready")
        if ready.isEmpty():
            break
        placed = keep(placed.unionByName(ready), "placed")
    parents = before.groupBy("id").agg(F.array_sort(F.collect_set("pred")).alias("parents"))
    # What stays unplaced hangs on a cycle: it is kept without a depth.
    return ids.select("id").join(placed, "id", "left").join(parents, "id", "left").select("id", F.coalesce("parents", F.array().cast("array<bigint>")).alias("parents"), "depth")


def alias_components(pairs: DataFrame) -> DataFrame:
    """(name, component): union-find over alias pairs (a, b); the least name names a component, and a name without another one its own."""
    names = pairs.select("a").union(pairs.select("b")).toDF("name").where("name is not null").distinct()
    linked = components(pairs, "a", "b").select(_c("node").alias("name"), "component")
    return names.join(linked, "name", "left").select("name", F.coalesce("component", "name").alias("component"))
