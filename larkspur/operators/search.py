"""Searching lines by pattern tables, ranked and windowed results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_c = F.col


def matches(lines: DataFrame, patterns: list[tuple[str, str, bool, bool]]) -> DataFrame:
    """lines with one row for each pattern that it matches; patterns are (id, value, regex, case sensitive).

    Patterns are a request's few literals, compiled once each into the scan's own filter: no join is needed.
    """
    tests = [F.when(_test(_c("text"), value, regex, case), F.lit(pid)) for pid, value, regex, case in patterns]
    return lines.withColumn("hits", F.array_compact(F.array(*tests))).where(F.size("hits") > 0).withColumn("pattern", F.explode("hits")).drop("hits")


def wanted(text: Column, patterns: list[tuple[str, str, bool, bool]]) -> Column:
    """Whether a whole text may have a line that matches one of patterns: no text without is split into lines. Patterns of one line match in the text too, their anchors at line ends."""
    return reduce(Column.__or__, [_test(text, f"(?m){value}" if regex else value, regex, case) for _, value, regex, case in patterns])


def _test(text: Column, value: str, regex: bool, case: bool) -> Column:
    if regex:
        return text.rlike(value if case else f"(?i){value}")
    return text.contains(value) if case else F.lower(text).contains(value.lower())


def grouped(hits: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Totals and the first anchor of each group, all counted though at most `most` are returned."""
    return hits.groupBy(*keys).agg(F.count("*").alias("total_matches"), F.min(F.struct("doc_id", "line")).alias("first")).select(*keys, "total_matches", F.least("total_matches", F.lit(most)).alias("returned"), (_c("total_matches") > most).alias("truncated"), _c("first.doc_id").alias("first_doc"), _c("first.line").alias("first_line"))


def evidence_type(group: Column, layer: Column, text: Column) -> Column:
    return F.when(text.rlike("(?i)license|generated"), "noise").when(group == "analog", "analog").when(layer.rlike("src1$|store"), "persistence-path").when(layer.rlike("src2$|out"), "output-path").when(group == "direct", "direct-or-structural").otherwise("candidate")


def round_robin(rows: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """One row of each group a round, groups in order: exact when a place belongs to one group. The cut is a top-k."""
    rounds = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("round", rounds).orderBy("round", group).limit(most)


def required_first(rows: DataFrame, bucket: str, order: list[str], required: Column, most: int) -> DataFrame:
    rounds = F.row_number().over(Window.partitionBy(bucket, required).orderBy(*order))
    return rows.withColumn("required", required).withColumn("round", rounds).orderBy(_c("required").desc(), "round", bucket, *order).limit(most)


def relevance(terms: list[str], field: Column, target: Column, owner: Column, relation: Column) -> Column:
    """The first hit of each term weighs: field 12 or 9 within, target 8 or 6, owner 5, relation 2."""
    score = F.lit(0)
    for t in terms:
        low = lambda c: F.lower(F.coalesce(c, F.lit("")))
        t = t.lower()
        score = score + F.when(low(field) == t, 12).when(low(field).contains(t), 9).when(low(target) == t, 8).when(low(target).contains(t), 6).when(low(owner).contains(t), 5).when(low(relation).contains(t), 2).otherwise(0)
    return score


def diverse(groups: DataFrame, most: int) -> DataFrame:
    """Top rows round by round over buckets of owner and relation: within a round by score, then bucket."""
    bucket = F.concat_ws("|", "owner", "relation")
    rounds = F.row_number().over(Window.partitionBy("owner", "relation").orderBy(_c("score").desc(), "key"))
    return groups.withColumn("bucket", bucket).withColumn("round", rounds).orderBy("round", _c("score").desc(), "bucket").limit(most)


def merged_ranges(anchors: DataFrame, file: str, start: str, end: str) -> DataFrame:
    """Islands of overlapping or adjacent ranges in each file."""
    w = Window.partitionBy(file).orderBy(start, end)
    marked = anchors.withColumn("reach", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    marked = marked.withColumn("island", F.sum(F.when(_c("reach").isNull() | (_c(start) > _c("reach") + 1), 1).otherwise(0)).over(w))
    return marked.groupBy(file, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("anchors"))


def sessions(rows: DataFrame, key: str, at: str, gap: float) -> DataFrame:
    """Rows of one key closer than gap to the one before share a session number."""
    w = Window.partitionBy(key).orderBy(at)
    return rows.withColumn("session", F.sum(F.when(_c(at) - F.lag(at).over(w) <= gap, 0).otherwise(1)).over(w))
