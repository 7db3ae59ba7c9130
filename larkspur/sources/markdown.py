"""Markdown sections and pipe tables as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_c = F.col


def markdown_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line, section, title, level): each line with the heading that it stands under."""
    l = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = _c("line").rlike("^#{1,6} ")
    l = l.withColumn("section", F.sum(F.when(head, 1).otherwise(0)).over(w)).withColumn("heading", F.last(F.when(head, _c("line")), True).over(w))
    return l.select(key, "pos", "line", "section", F.regexp_replace("heading", "^#+ ", "").alias("title"), F.length(F.regexp_extract("heading", "^(#+)", 1)).alias("level"))


def table_rows(lines: DataFrame, key: str) -> DataFrame:
    """(key, section, title, row, cells): data rows of pipe tables, without headers and rules."""
    pipe = lines.where(_c("line").rlike("^\\s*\\|.*\\|\\s*$"))
    rule = _c("line").rlike("^[\\s|:-]+$")
    w = Window.partitionBy(key, "section").orderBy("pos")
    marked = pipe.withColumn("rule", rule).withColumn("after", F.max(F.when(rule, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    body = marked.where("after = 1 and not rule")
    cells = F.transform(F.split(F.regexp_replace("line", "^\\s*\\||\\|\\s*$", ""), "\\|"), lambda c: F.btrim(c))
    return body.select(key, "section", "title", F.row_number().over(w).alias("row"), cells.alias("cells"))
