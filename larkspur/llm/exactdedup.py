"""Exact duplicates by two-pass Bloom filtering, in DataFrame operations only.

Texts are equal when identical after each run of ASCII white space becomes one space.
The first pass counts the cells that hashes fall into, CELLS of one block of the
filter for each row, added up before they travel; cells that several rows share are
set in the block's bitmap. The second pass tests every row: a row with a cell of its own
can have no equal, is alone, and passes straight through. Only rows whose cells are all
shared - repeated ones and, at BITS bits a row, about 1.4 % of the others - are dealt by
the SHA-256 of their texts and compared by it: the filter spares work and decides nothing.

The filter grows with the rows. It is broadcast while its size, known before it is made, is at most
BROADCAST_BYTES; beyond, rows go to their blocks, as two numbers a row and not as texts.
A group of copies of any size is counted before it travels, and what its rows need of it comes back
by broadcast if the group is hot.

Defined cases: a null text counts as empty, and empty texts equal each other (a text of white space
alone is one space); the row of smallest doc_id stays, a null doc_id coming last; of rows equal in text and
doc_id exactly one is marked kept; texts of any length are read whole; no rows give no rows; columns but doc_id
and text are not read, whatever their names, and distinct_documents returns them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.rows import looked_up, unwrapped, wrapped
from larkspur.session import keep

#: Bits of a bitmap, of the filter a row (a power of two up to twice as many), and cells of a row.
BLOCK_BITS, BITS, CELLS = 1 << 15, 16, 2
BROADCAST_BYTES = 1 << 26


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def _blocks(n: int) -> int:
    return 1 << max(0, (BITS * n - 1).bit_length() - (BLOCK_BITS - 1).bit_length())


def _cell(h: Column, k: int) -> Column:
    """The k-th cell of a hash in its block: 15 of the upper bits, as the lower ones choose the block."""
    return F.shiftrightunsigned(h, 49 - 15 * k).bitwiseAND(BLOCK_BITS - 1).cast("int")


def shared_cells(hashes: DataFrame, blocks: int) -> DataFrame:
    """(block, bits): for each block with any, the bitmap of the cells that more than one row's hash (column h) falls into."""
    h = F.col("h")
    cells = hashes.select(F.pmod(h, F.lit(blocks)).alias("block"), F.explode(F.array_distinct(F.array(*[_cell(h, k) for k in range(CELLS)]))).alias("cell"))
    shared = cells.groupBy("block", "cell").agg(F.count("*").alias("rows")).where("rows > 1")
    # A block's cells, at most BLOCK_BITS of them, meet before a bitmap is made: none travels.
    return shared.select("block", "cell").repartition("block").groupBy("block").agg(F.bitmap_construct_agg(F.col("cell").cast("long")).alias("bits"))


def _tested(rows: DataFrame, cells: DataFrame, blocks: int) -> DataFrame:
    """rows (with a hash h) and whether each may be repeated."""
    small = blocks * BLOCK_BITS // 8 <= BROADCAST_BYTES
    block = F.pmod(F.col("h"), F.lit(blocks))
    met = rows.withColumn("block", block).join(F.broadcast(cells) if small else cells, "block", "left")

    def is_set(cell: Column) -> Column:
        byte = F.conv(F.hex(F.substring("bits", F.shiftright(cell, 3) + 1, F.lit(1))), 16, 10).cast("long")
        return F.getbit(byte, cell.bitwiseAND(7)) == 1

    may = F.lit(True)
    for k in range(CELLS):
        may = may & is_set(_cell(F.col("h"), k))
    return met.withColumn("may", F.coalesce(may, F.lit(False))).drop("block", "bits")


def _passes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Every row's digest, the possibly repeated rows, and the filter with its number of blocks."""
    digests = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), _digest(F.col("text")).alias("digest"))
    digests = keep(digests.withColumn("h", F.xxhash64("digest")), "digests")  # texts are read once
    blocks = _blocks(digests.count())
    cells = keep(shared_cells(digests.select("h"), blocks), "cells")
    tested = _tested(digests, cells, blocks)
    again = keep(tested.where("may").drop("may"), "again")
    return tested.where("not may").drop("may"), again, cells, blocks


def _groups(again: DataFrame) -> DataFrame:
    """(digest, n, first): the rows of each possibly repeated text, and the one that stays."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_no"))
    return keep(again.groupBy("digest").agg(F.count("*").alias("n"), first.alias("first")), "groups")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs."""
    alone, again, _, _ = _passes(docs)
    groups = _groups(again)
    met = looked_up(again, groups.select("digest", "n", F.col("first.doc_id").alias("keep_id"), F.col("first.row_no").alias("keep_no")), "digest", "n", again.count())
    out = met.select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("row_no") == F.col("keep_no")).alias("kept"), "digest")
    rest = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    return rest.unionByName(out).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """docs with one row of each text. Only possibly repeated rows are dealt out, and of these those that carry a staying doc_id are compared as wholes."""
    _, again, cells, blocks = _passes(docs)
    stays = _groups(again).select("digest", F.col("first.doc_id").alias("keep_id"))
    own = wrapped(docs, digest=_digest(F.col("text"))).withColumn("h", F.xxhash64("digest"))
    tested = _tested(own, cells, blocks)
    x, y = tested.where("may").alias("x"), stays.alias("y")
    kept = x.join(y, (F.col("x.digest") == F.col("y.digest")) & F.col("x.own_id").eqNullSafe(F.col("y.keep_id"))).select("x.row", "x.digest").dropDuplicates(["digest"]).select("row")
    return unwrapped(tested.where("not may").select("row").unionByName(kept), docs.columns)


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents),
g AS (SELECT text, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256 FROM t JOIN g USING (text)
"""
