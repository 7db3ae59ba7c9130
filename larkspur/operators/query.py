"""Commands over symbols and relations: predicates, post-filters, envelopes and grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.scalar import UNIT, same_name, truthy, wildcard

_c = F.col


def rank_of(confidence: Column) -> Column:
    return F.when(confidence == "exact", 3).when(confidence == "resolved", 2).when(confidence.isin("candidate", "name-inferred"), 1).otherwise(0)


def run_query(command: str, relations: DataFrame, symbols: DataFrame, *, owner: str | None = None, field: str | None = None, kind: str | None = None, symbol: str | None = None, type_: str | None = None, terms: list[str] | None = None) -> DataFrame:
    """The rows of one command; an unknown command gives all relations."""
    r, s = relations, symbols
    calls = _c("relation").isin("call", "construct")
    if command in ("symbols", "index"):
        return s.where(_c("kind") == kind) if kind else s
    if command == "methods":
        out = s.where(_c("kind").contains("method"))
        return out.where(same_name(_c("owner"), F.lit(owner))) if owner else out
    if command == "fields":
        out = r.where(_c("field") != "")
        out = out.where(same_name(_c("owner"), F.lit(owner))) if owner else out
        return out.where(_c("field") == field) if field else out
    if command == "reads":
        out = r.where(_c("relation") == "field-read")
        return out.where(_c("field") == field) if field else out
    if command in ("writes", "assignments"):
        out = r.where(_c("relation").contains("write") | _c("relation").contains("to-field") | (_c("relation") == "object-field"))
        return out.where(_c("field") == field) if field else out
    from_symbol = same_name(_c("source_symbol"), F.lit(symbol or "")) | _c("source_symbol").startswith((symbol or "") + ".")
    if command == "calls":
        return r.where(calls & (from_symbol | same_name(_c("target"), F.lit(symbol)))) if symbol else r.where(calls)
    if command == "callers":
        return r.where(calls & same_name(_c("target"), F.lit(symbol or "")))
    if command == "callees":
        return r.where(calls & from_symbol)
    if command in ("owners", "recipients"):
        stored = _c("relation").contains("write") | _c("relation").contains("to-field") | (_c("relation") == "object-field") | _c("relation").startswith("collection-")
        by_target = same_name(_c("target"), F.lit(type_))
        out = r.where(stored & (by_target | F.exists("candidate_types", lambda x: same_name(x, F.lit(type_))))).withColumn("match_mode", F.when(by_target, "target").otherwise("candidate"))
        if command == "recipients":
            return out
        local = s.where((_c("kind") == "variable") & same_name(_c("inferred_type"), F.lit(type_))).select("id", "owner", F.lit("local-instance").alias("relation"), _c("name").alias("field"), _c("inferred_type").alias("target"), _c("qualified_name").alias("source_symbol"), "line", "file", F.lit("local").alias("match_mode"))
        return out.unionByName(local, allowMissingColumns=True)
    if command == "collections":
        return r.where(_c("relation").startswith("collection-"))
    if command in ("find", "summary"):
        both = s.select("id", F.lit("symbol").alias("set"), _c("owner"), _c("qualified_name").alias("name"), _c("kind").alias("what"), "file").unionByName(r.select("id", F.lit("relation").alias("set"), _c("owner"), _c("target").alias("name"), _c("relation").alias("what"), "file"))
        text = F.lower(F.to_json(F.struct("owner", "name", "what", "file")))
        hit = F.lit(False)
        for t in terms or []:
            hit = hit | text.contains(t.lower())
        return both.where(hit)
    return r


def post_filter(rows: DataFrame, *, owner: str | None = None, field: str | None = None, kind: str | None = None) -> DataFrame:
    for name, value in (("owner", owner), ("field", field), ("kind", kind)):
        if value is not None and name in rows.columns:
            rows = rows.where(same_name(_c(name), F.lit(value)) if name == "owner" else _c(name) == value)
    return rows


def line_range(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Rows with any evidence that starts within the lines."""
    return rows.where(F.exists("evidence", lambda e: e["line"].between(start, end)))


def min_confidence(rows: DataFrame, least: str) -> DataFrame:
    return rows.where(F.array_max(F.transform("evidence", lambda e: rank_of(e["confidence"]))) >= rank_of(F.lit(least)))


def evidence_rows(relations: DataFrame) -> DataFrame:
    """One row for each semantic key, with its evidence gathered; keys have few rows each."""
    return relations.groupBy("owner", "relation", "field", "target").agg(F.array_sort(F.collect_set(F.struct("line", "confidence"))).alias("evidence"))


def bounded(rows: DataFrame, most: int, order: list[str]) -> DataFrame:
    """The first rows in order, with total, returned and truncated on each; ranked in parallel by top-k, counted apart."""
    total = rows.agg(F.count("*").alias("total"))
    top = rows.orderBy(*order).limit(most)
    return top.join(F.broadcast(total)).withColumn("returned", F.least("total", F.lit(most))).withColumn("truncated", _c("total") > most)


def group_key(owner: Column, relation: Column, field: Column, target: Column) -> Column:
    """g- and twelve hex digits over the group's parts; empty parts count as unknown."""
    parts = [truthy(c, F.lit("unknown")) for c in (owner, relation, field, target)]
    return F.concat(F.lit("g-"), F.substring(F.sha2(F.concat_ws(UNIT, *parts), 256), 1, 12))


def semantic_groups(relations: DataFrame) -> DataFrame:
    """Groups of relations by key: items, evidence rows, distinct sources, first example by id."""
    keyed = relations.withColumn("key", group_key(_c("owner"), _c("relation"), F.coalesce(F.nullif(_c("field"), F.lit("")), _c("method")), _c("target")))
    return keyed.groupBy("key").agg(F.count("*").alias("items"), F.countDistinct("source_symbol").alias("source_symbols"), F.min_by("owner", "id").alias("owner"), F.min_by("relation", "id").alias("relation"), F.min_by("target", "id").alias("target"), F.min("id").alias("example"))


def filter_groups(groups: DataFrame, **patterns: str) -> DataFrame:
    """Wildcard lists by column: alternatives within one, all columns must match."""
    for name, pattern in patterns.items():
        groups = groups.where(F.coalesce(_c(name), F.lit("")).rlike(wildcard(pattern)))
    return groups


def usage_kind(relation: Column) -> Column:
    return F.when(relation.rlike("write|to-field|object-field"), "write").when(relation.rlike("read|to-return|to-call"), "read").when(relation.rlike("^(call|construct)"), "call").when(relation.rlike("^collection-"), "store").when(relation.rlike("import|export"), "dependency").otherwise("other")


def relation_shape(relation: Column) -> Column:
    return F.when(relation == "construct", "construct").when(relation.startswith("collection-") | (relation == "object-field"), "contain").when(relation.contains("write") | relation.contains("to-field"), "transform").when(relation == "field-read", "read").when(relation.contains("call-argument"), "argument").when(relation.contains("return"), "return").when(relation.isin("import", "export"), "boundary")
