"""Orders without one task: places, dense codes and digests of ordered rows, and lookups that no hot key holds up.

Rows are sorted over range partitions; a row's place is its number within its partition and the rows of the partitions
before it, of which there are as many counts as partitions. A digest of ordered rows is a tree: BLOCK rows of a key, by their rank in it,
make one digest of their joined items, those digests are the next level's rows, until a key has one. So the digest is
the same however the rows are dealt, up to BLOCK rows it is that of the joined items, and no key is a list.

Defined cases: nulls come first; equal rows have places of their own, in any order among them, which no digest tells apart; no rows give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.session import keep

_c = F.col
#: Rows of one digest of a tree. A key with more than one in HOT of the rows is hot; there are fewer than HOT such keys.
BLOCK, HOT = 1024, 1000


def placed(df: DataFrame, order: list[str]) -> DataFrame:
    """df with each row's place in the order, from 0."""
    kept = keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_row", 33)
    before, offsets = 0, []
    for r in sorted(kept.groupBy(part.alias("part")).count().collect()):  # a row for each range partition
        offsets.append((r["part"], before))
        before += r["count"]
    starts = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    numbered = kept.join(F.broadcast(starts), part == _c("_part"))
    return numbered.withColumn("place", _c("_before") + _c("_row") - F.shiftleft(part, 33)).drop("_row", "_part", "_before")


def dense_codes(values: DataFrame) -> DataFrame:
    """(value, code): the distinct values of the one column, numbered from 0 in their order."""
    return placed(values.toDF("value").distinct(), ["value"]).select("value", _c("place").alias("code"))


def looked_up(rows: DataFrame, found: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows left joined with found, which has a row for each key, with how many of the `total` rows have it (column count).

    No task meets a hot key's rows: found's rows of hot keys, fewer than HOT, are broadcast; only the other rows are dealt by key.
    Rows with a null key find nothing.
    """
    hot = F.coalesce(_c(count) * HOT > total, F.lit(False))
    near = F.broadcast(found.where(hot))
    far = rows.join(F.broadcast(found.where(hot).select(key)), key, "left_anti").join(found.where(~hot), key, "left")
    return rows.join(near, key).unionByName(far)


def ranked(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with their rank (from 0) within their key, in the order; a null key's rows have none."""
    at = keep(placed(rows, [key, *order]), "ranked")
    firsts = at.groupBy(key).agg(F.min("place").alias("_first"), F.count("*").alias("_rows"))
    return looked_up(at, firsts, key, "_rows", at.count()).withColumn("rank", _c("place") - _c("_first")).drop("place", "_first", "_rows")


def digest_tree(rows: DataFrame, key: str, order: list[str], item: str, separator: str = "\n", block: int = BLOCK, digest=lambda text: F.sha2(text, 256), levels: int | None = None) -> DataFrame:
    """(key, n, digest): of each key's rows the number, and the tree's root over their items (a string column) in the order.

    levels: the tree ends there, with a row for each block of the last level: block ** levels rows of a key, in the order, have one.
    """
    level = ranked(rows.where(_c(key).isNotNull()).select(key, *order, _c(item).alias("_item")), key, order).select(key, "rank", "_item", F.lit(1).cast("long").alias("_n"))
    joined: Column = digest(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("_item", F.lit("")).alias("v")))), lambda x: x["v"]), separator))
    root, made = None, 0
    while root is None or made != levels and root.agg(F.max("rank")).first()[0]:
        # Above the first level a key's only digest is its root already.
        value = joined if root is None else F.when((F.count("*") == 1) & (F.max("rank") == 0), F.max("_item")).otherwise(joined)
        blocks = (level if root is None else root).groupBy(key, F.floor(_c("rank") / block).alias("_block")).agg(value.alias("_item"), F.sum("_n").alias("_n"))
        root, made = keep(blocks.withColumnRenamed("_block", "rank"), "digests"), made + 1
    return root.select(key, _c("_n").alias("n"), _c("_item").alias("digest"))
