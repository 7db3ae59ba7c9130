"""Distributed union-find over a table of links, in DataFrame operations only.

Each round gives every node a parent, the first of its neighbours and itself in
an order, and moves the links to the parents. The first rounds order by id, which
folds stars to their smallest node at once; later ones by a hash of id and round,
so that a chain in whatever order shrinks to about half a round: rounds grow with
the logarithm of the longest path. What was connected stays connected until one
root is left; its smallest node then names the component. Nothing is collected but
whether any link is left; a hub's minimum is combined on the map side, and the
joins that move links are plain ones, whose skewed partitions Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.session import discard, keep

#: Rounds that order by id.
BY_ID = 2


def components(links: DataFrame, a: str, b: str, count: list[int] | None = None) -> DataFrame:
    """(node, component) for every node of links with a partner: component is the smallest node that it reaches.

    Nulls and self links are ignored; repeated and reversed links count once. No links: an empty table. count gets the number of rounds.
    """
    edges = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    edges = keep(edges, "links")
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        turn = len(levels)
        order = (lambda c: F.col(c)) if turn < BY_ID else (lambda c: F.xxhash64(c, F.lit(turn)))  # noqa: B023
        ends = edges.select("x", "y").union(edges.select("y", "x")).toDF("node", "other")
        # min_by keeps two numbers, so that partial sums stay in generated code.
        first = ends.groupBy("node").agg(F.min_by("other", order("other")).alias("other"))
        parents = keep(first.select("node", F.when(order("other") < order("node"), F.col("other")).otherwise(F.col("node")).alias("parent")), "parents")
        levels.append(parents)
        px = parents.select(F.col("node").alias("x"), F.col("parent").alias("px"))
        py = parents.select(F.col("node").alias("y"), F.col("parent").alias("py"))
        half = edges.join(px, "x").select("px", "y").distinct()  # links of a star fold before their other ends move
        moved = keep(half.join(py, "y").where("px <> py").select(F.least("px", "py").alias("x"), F.greatest("px", "py").alias("y")).distinct(), "links")
        discard(edges)
        edges = moved
    if count is not None:
        count.append(len(levels))
    if not levels:
        return links.select(F.col(a).alias("node"), F.col(a).alias("component")).limit(0)
    hashed = len(levels) > BY_ID
    labels = levels.pop().withColumnRenamed("parent", "component")
    while levels:
        up = labels.select(F.col("node").alias("parent"), F.col("component").alias("upper"))
        labels = levels.pop().join(up, "parent", "left").select("node", F.coalesce("upper", "parent").alias("component"))
        if len(levels) % 6 == 5:
            labels = keep(labels, "labels")
    if not hashed:
        return labels
    labels = keep(labels, "labels")
    least = labels.groupBy("component").agg(F.min("node").alias("least"))
    return labels.join(least, "component").select("node", F.col("least").alias("component"))
