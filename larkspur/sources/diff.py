"""Unified diffs and git listings as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.scalar import SECRET_LINE, SECRET_MARK

_c = F.col


def sections(diffs: DataFrame) -> DataFrame:
    """(diff_id, pos, path, section): one row for each file of a diff column; the new name, or the header's where there is none."""
    parts = diffs.select("diff_id", F.posexplode(F.split("diff", "(?m)(?=^diff --git )")).alias("pos", "section")).where("section <> ''")
    named = [F.nullif(F.regexp_extract("section", p, 1), F.lit("")) for p in ("(?m)^\\+\\+\\+ b/(.+)$", "(?m)^diff --git a/.+? b/(.+)$")]
    return parts.select("diff_id", "pos", F.coalesce(*named).alias("path"), "section").where("path is not null")


#: Which paths are tests and which are generated, what marks a binary file, and which lines of a test say something.
TEST_PATH = r"(?i)(^|/)(test|tests|__tests__)(/|$)|\.(test|spec)\.[^.]+$"
GENERATED_PATH = r"(?i)(^|/)(dist|build|coverage|vendor)(/|$)|\.min\.[^.]+$|(^|/)(package-lock|yarn\.lock|pnpm-lock)"
BINARY = r"GIT binary patch|Binary files .* differ"
TEST_LINE = r"\b(describe|it|test|expect|beforeEach|afterEach|mockImplementation|mockReturnValue|toBe|toEqual|toContain|toHaveBeenCalled)\b|^\s*//"


def classify(path: Column, section: Column) -> dict[str, Column]:
    return {
        "test": path.rlike(TEST_PATH),
        "generated": path.rlike(GENERATED_PATH),
        "binary": section.rlike(BINARY),
        "change": F.when(section.rlike("(?m)new file mode"), "added").when(section.rlike("(?m)deleted file mode"), "removed").otherwise("updated"),
    }


def diff_lines(diffs: DataFrame) -> DataFrame:
    """(diff_id, path, test, change, pos, type, line, text): added and deleted lines with their numbers in the new and the old file.

    Binary and generated files have no lines, a test's lines are only those that say something of a test, and lines with
    credentials are replaced.
    """
    whole = sections(diffs)
    whole = whole.select("diff_id", "path", "pos", "section", *[c.alias(k) for k, c in classify(_c("path"), _c("section")).items()]).where("not binary and not generated")
    raw = whole.select("diff_id", "path", _c("pos").alias("file"), "test", "change", F.posexplode(F.split("section", "\r?\n")).alias("pos", "raw"))
    hunk = raw.withColumn("old0", F.nullif(F.regexp_extract("raw", "^@@ -(\\d+)(?:,\\d+)? \\+\\d+(?:,\\d+)? @@", 1), F.lit("")).cast("int")).withColumn("new0", F.nullif(F.regexp_extract("raw", "^@@ -\\d+(?:,\\d+)? \\+(\\d+)(?:,\\d+)? @@", 1), F.lit("")).cast("int"))
    by_file = Window.partitionBy("diff_id", "file").orderBy("pos")
    hunk = hunk.withColumn("hunk", F.count("old0").over(by_file)).where("hunk > 0")
    inside = Window.partitionBy("diff_id", "file", "hunk").orderBy("pos")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    first = F.when(_c("raw").rlike("^(\\+\\+\\+|---)"), "").otherwise(_c("raw").substr(1, 1))
    count = lambda *kinds: F.coalesce(F.sum(F.when(_c("old0").isNull() & first.isin(*kinds), 1).otherwise(0)).over(earlier), F.lit(0))
    at = hunk.withColumn("old", F.first("old0").over(inside) + count("-", " ")).withColumn("new", F.first("new0").over(inside) + count("+", " "))
    at = at.where(_c("old0").isNull() & first.isin("+", "-"))
    text = F.expr("substring(raw, 2)")
    out = at.select("diff_id", "path", "test", "change", "pos", F.when(first == "+", "added").otherwise("deleted").alias("type"), F.when(first == "+", _c("new")).otherwise(_c("old")).cast("int").alias("line"), F.when(text.rlike(SECRET_LINE), F.lit(SECRET_MARK)).otherwise(text).alias("text"))
    return out.where(~_c("test") | _c("text").rlike(TEST_LINE))


#: What lines are looked through for; flags' constants and tests in added and deleted lines, the rest in added ones.
FLAG_CONSTANT = r"""\b(?:const|let|var)\s+([A-Z][A-Z0-9_]*(?:FEATURE|FLAG|TOGGLE)[A-Z0-9_]*)\s*=\s*["']([^"']+)["']"""
TEST_NAME = r"""\b(?:describe|it|test)\(\s*["']([^"']+)["']"""
ADDED = (
    ("symbol", r"\.prototype\.([A-Za-z_$][\w$]*)\s*="),
    ("symbol", r"\b([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+)\s*=\s*(?:\{|function\b|class\b)"),
    ("symbol", r"\bfunction\s+([A-Za-z_$][\w$]*)\s*\("),
    ("symbol", r"\bclass\s+([A-Za-z_$][\w$]*)\b"),
    ("feature_flag", r"""\bisEnabled\(\s*["']([^"']+)["']"""),
    ("event", r"""\b(?:sendEvent|trigger)\(\s*["']([^"']+)["']"""),
    ("callback_value", r"""\b(?:choice|action|result)\s*===?\s*["']([^"']+)["']"""),
)
CALLBACK, QUOTED = r"(?i)\bcallback\b", r"""["']([^"']+)["']"""
RULE = r"(?i)\b(threshold|limit|timeout|weight|score|mode)[A-Za-z0-9_$]*\s*[:=]"


def candidates(lines: DataFrame) -> DataFrame:
    """(diff_id, path, line, type, value): facts of diff_lines' rows, each once."""
    text, added = _c("text"), _c("type") == "added"

    def facts(kind: Column, pattern: str, group: int = 1, when: Column | None = None) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda v: F.struct(kind.alias("type"), v.alias("value")))
        return found if when is None else F.when(when, found).otherwise(F.filter(found, lambda _: F.lit(False)))

    test = F.when(_c("change") == "added", "test_added").when((_c("change") == "removed") | ~added, "test_removed").otherwise("test_updated")
    first_test = F.slice(facts(test, TEST_NAME, when=_c("test")), 1, 1)
    rule = F.when(added & text.rlike(RULE), F.array(F.struct(F.lit("rule").alias("type"), F.btrim(text, F.lit(" \t\r\x0b\f")).alias("value"))))
    arrays = [facts(F.lit("feature_flag"), FLAG_CONSTANT, 2), facts(F.lit("toggle_binding"), FLAG_CONSTANT), first_test, *[facts(F.lit(k), p, when=added) for k, p in ADDED], facts(F.lit("callback_value"), QUOTED, when=added & text.rlike(CALLBACK)), rule]
    found = F.flatten(F.array_compact(F.array(*arrays)))
    return lines.select("diff_id", "path", "line", F.explode(found).alias("f")).select("diff_id", "path", "line", "f.type", "f.value").distinct()


def numstat(rows: DataFrame, text: str) -> DataFrame:
    """Insertions, deletions, files and binary files of numstat lines."""
    parts = rows.select("diff_id", F.split(text, "\t").alias("p"))
    return parts.groupBy("diff_id").agg(F.sum(F.get("p", F.lit(0)).try_cast("long")).alias("insertions"), F.sum(F.get("p", F.lit(1)).try_cast("long")).alias("deletions"), F.count("*").alias("files"), F.count_if(F.get("p", F.lit(0)) == "-").alias("binary"))


def name_status(rows: DataFrame, text: str) -> DataFrame:
    """(diff_id, path, status) of NUL-delimited status and path pairs; statuses outside A, M, D, T are errors."""
    parts = rows.select("diff_id", F.posexplode(F.split(text, "\x00")).alias("pos", "v")).where("v <> ''")
    pairs = parts.groupBy("diff_id", F.floor(_c("pos") / 2).alias("k")).agg(F.max(F.when(_c("pos") % 2 == 0, _c("v"))).alias("status"), F.max(F.when(_c("pos") % 2 == 1, _c("v"))).alias("path"))
    return pairs.select("diff_id", "path", F.when(_c("status").isin("A", "M", "D", "T"), _c("status")).otherwise(F.raise_error(F.concat(F.lit("unknown status "), "status"))).alias("status"))
