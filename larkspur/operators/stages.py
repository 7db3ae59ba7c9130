"""The second stage as a fixpoint: owners found by one round's searches are the next round's terms, until none is new.

Semi-naive: a round searches only what the round before found, and what is known is never searched again. Each round's nodes and
hits are written tables. A node's order is the round that found it; MAX_ORDER bounds the rounds, and nodes of that order are told as such.

Defined cases: a null entity or repository is no node; relations that aren't confirmed are hits, and leave their repository's stage
partial, but lead no further; no seeds give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.scalar import stable_hash
from larkspur.session import keep

_c = F.col
MAX_ORDER = 12


def frontier_searches(nodes: DataFrame, max_order: int = MAX_ORDER) -> DataFrame:
    """(search_id, repository, command, term, order) for the nodes (entity, repository, order) of the highest order, unless that is the last one."""
    top = nodes.agg(F.max("order").alias("top"))
    last = nodes.join(F.broadcast(top)).where((_c("order") == _c("top")) & (_c("top") < max_order))
    terms = last.select("repository", _c("entity").alias("term"), "order").distinct()
    return terms.select(stable_hash({"command": F.lit("find"), "repository": _c("repository"), "term": _c("term")}).alias("search_id"), "repository", F.lit("find").alias("command"), "term", "order")


def boundary_searches(boundaries: DataFrame, consumers: DataFrame) -> DataFrame:
    """(search_id, term, producer, consumer, profile) of the third stage: each boundary (term, producer, file) in each other consumer (repository, profile); without a profile it stays to be looked at by hand (status unprofiled)."""
    met = boundaries.join(F.broadcast(consumers), _c("repository") != _c("producer"))
    key = {"consumer": _c("repository"), "producer": _c("producer"), "term": _c("term")}
    return met.select(stable_hash(key).alias("search_id"), "term", "producer", _c("repository").alias("consumer"), "profile", F.when(_c("profile").isNull(), "unprofiled").otherwise("planned").alias("status"))


def run_stage2(relations: DataFrame, seeds: DataFrame, max_order: int = MAX_ORDER) -> tuple[DataFrame, DataFrame]:
    """(nodes, evidence) of searches for the owners of seeds (entity, repository) among relations (id, owner, target, repository, status).

    nodes: (repository, entity, order, hits, outcome, stage): outcome is advanced (its search found a new owner), exhausted or limit-reached; stage is closed if no node of the repository
    reached the limit and every hit is confirmed, else partial. evidence: (id, repository, term, order) of each relation that a search found, once.
    """
    edges = keep(relations.select("id", "owner", "target", "repository", "status"), "relations")
    nodes = keep(seeds.where("entity is not null and repository is not null").select("entity", "repository").distinct().withColumn("order", F.lit(0)), "nodes")
    found, levels, advanced = [], [nodes], []
    frontier = nodes
    for order in range(max_order):
        searches = frontier_searches(frontier, max_order).select("repository", _c("term").alias("target"))
        hits = keep(edges.join(searches, ["repository", "target"]), "hits")
        found.append(hits.select("id", "repository", _c("target").alias("term"), F.lit(order).alias("order"), "status"))
        known = reduce(DataFrame.unionByName, levels).select(_c("entity").alias("owner"), "repository")
        new = hits.where("status = 'confirmed' and owner is not null").join(known, ["owner", "repository"], "left_anti")
        advanced.append(new.select("repository", _c("target").alias("entity")).distinct())
        frontier = keep(new.select(_c("owner").alias("entity"), "repository").distinct().withColumn("order", F.lit(order + 1)), "nodes")
        if frontier.isEmpty():
            break
        levels.append(frontier)
    none = nodes.select("repository", "entity").limit(0)
    evidence = reduce(DataFrame.unionByName, found) if found else edges.select("id", "repository", _c("target").alias("term"), F.lit(0).alias("order"), "status").limit(0)
    every = reduce(DataFrame.unionByName, levels)
    on = reduce(DataFrame.unionByName, advanced, none).distinct().withColumn("on", F.lit(True))
    counts = evidence.groupBy("repository", _c("term").alias("entity")).agg(F.count_distinct("id").alias("hits"), F.bool_or(_c("status") != "confirmed").alias("unsure"))
    told = every.join(counts, ["repository", "entity"], "left").join(on, ["repository", "entity"], "left")
    told = told.withColumn("outcome", F.when(_c("order") >= max_order, "limit-reached").when(_c("on"), "advanced").otherwise("exhausted"))
    stages = told.groupBy("repository").agg(F.when(F.bool_or((_c("outcome") == "limit-reached") | F.coalesce("unsure", F.lit(False))), "partial").otherwise("closed").alias("stage"))
    out = told.join(stages, "repository").select("repository", "entity", "order", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), "outcome", "stage")
    return out, evidence.groupBy("id", "repository", "term").agg(F.min("order").alias("order"))
