"""Canonical evidence: merged candidates, aliases, exact resolution, comparisons and error rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_c = F.col


def canonical(candidates: DataFrame, key: list[str], order: str) -> DataFrame:
    """Candidates of one identity merged: sets of aliases and terms, the best confirmation, the longest excerpt.

    Aggregates combine on the map side; ties go to the least of the order column.
    """
    best = F.max_by("status", F.struct(F.when(_c("status") == "source-confirmed", 1).otherwise(0), -_c(order)))
    longest = F.max_by("excerpt", F.struct(F.length("excerpt"), -_c(order)))
    return candidates.groupBy(*key).agg(F.min(order).alias("id"), F.array_sort(F.collect_set("alias")).alias("aliases"), F.array_sort(F.collect_set("term")).alias("terms"), best.alias("status"), longest.alias("excerpt"), F.count("*").alias("found"))


def alias_index(evidence: DataFrame) -> DataFrame:
    return evidence.select("id", F.explode("aliases").alias("alias")).groupBy("alias").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def resolve(refs: DataFrame, index: DataFrame) -> DataFrame:
    """(ref, id, outcome): a reference names exactly one identity, none, or several."""
    j = refs.join(index, refs["ref"] == index["alias"], "left")
    n = F.coalesce(F.size("ids"), F.lit(0))
    return j.select("ref", F.when(n == 1, F.get("ids", F.lit(0))).alias("id"), F.when(n == 1, "exact").when(n > 1, "ambiguous").otherwise("missing").alias("outcome"))


def attribute(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, repo, outcome): the one root that a path lies under; an equi-join on each of the path's own prefixes, not on roots."""
    parts = F.split("path", "/")
    prefixes = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("root"))
    hits = prefixes.join(roots, "root").groupBy("path").agg(F.count("*").alias("n"), F.min("repo").alias("repo"))
    j = paths.join(hits, "path", "left")
    return j.select("path", F.when(_c("n") == 1, _c("repo")).alias("repo"), F.when(_c("n") == 1, "attributed").when(_c("n") > 1, "ambiguous").otherwise("outside").alias("outcome"))


def merge_rows(rows: DataFrame, key: str, seq: str, fields: list[str]) -> DataFrame:
    """Rows of one id: each field's last value that isn't null, and the fields whose values differ."""
    last = [F.max_by(f, F.when(_c(f).isNotNull(), _c(seq))).alias(f) for f in fields]
    differ = [F.when(F.countDistinct(f) > 1, F.lit(f)) for f in fields]
    return rows.groupBy(key).agg(*last, F.array_compact(F.array(*differ)).alias("conflicts"), F.count("*").alias("rows"))


def compare(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change): added, removed or changed rows of two runs; a full outer join with null-safe equality."""
    b = before.select(key, F.struct(*fields).alias("before"))
    a = after.select(key, F.struct(*fields).alias("after"))
    j = b.join(a, key, "full_outer")
    change = F.when(_c("before").isNull(), "added").when(_c("after").isNull(), "removed").when(~_c("before").eqNullSafe(_c("after")), "changed")
    return j.select(key, change.alias("change")).where("change is not null")


def errors(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, error): one row for each rule that a row breaks, in one pass; a rule that is null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(key, F.explode(broken).alias("error"))


def dangling(rows: DataFrame, key: str, refs: str, declared: DataFrame, declared_key: str) -> DataFrame:
    """(key, ref): references that name no declared id."""
    return rows.select(key, F.explode(refs).alias("ref")).join(declared.select(_c(declared_key).alias("ref")).distinct(), "ref", "left_anti").select(key, "ref")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
