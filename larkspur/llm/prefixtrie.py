"""Prefix trie of rebuilt conversations by preorder intervals.

Every conversation is rebuilt from the first turns of its hundred's first one and its own later turns.
A node is a distinct sequence of first turns; the conversations that begin so are its members.

1. Sequences are ranked in lexicographic order of their turns' digests. A sequence is cut into blocks of at most FAN
   turns; a block's text is its digests in order, distinct texts are sorted over range partitions, and a text's
   rank stands for the block in blocks of blocks, until each sequence is one block. So no conversation is gathered, however
   long, and each round sorts fewer, equally short texts.
2. A node's name is a digest of its turns, chained along the blocks from the top level down. Grouped by it, the
   turns give the node's members, their smallest conv_id, and the first and last rank of its members.
3. In the order of (first rank, depth) nodes stand in preorder, and a subtree ends where the nodes that begin
   at its last rank end. Leaves and savings of a subtree are differences of running sums there, which are made in each range
   partition and moved by the sums of the partitions before: one row a partition is all that the driver sees.

The ids that end at a node are hashed in ascending order, which is one text's digest and can't be dealt out: ranges of ids are
joined into chunks in parallel, and the chunks of a node stream through one task, which holds one batch at a time.
What belongs to a hot key (a turn that many begin with, a parent of many children, a long conversation) comes by broadcast.

Defined cases: a null conv_id is no conversation (no member); a null turn comes first; turns of one number are ordered by
role, then text, and equal rows are as many turns; a null role or text is empty; texts of any length are read whole; the
hundred of a negative conv_id is that of truncated division; no conversations give no nodes; columns but conv_id, turn, role
and text are not read, whatever their names. Digests are of 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.rows import looked_up
from larkspur.session import keep

#: Turns of a block, turns that a conversation may take from its hundred's first, and conversations of a hundred.
FAN, HEADS, HUNDRED = 32, 6, 100
#: Ids that are joined into one chunk.
CHUNK = 4096


def _scanned(df: DataFrame, order: list[str], columns: list[str], sums: list[str], name: str) -> DataFrame:
    """columns of df with each row's place in the order (from 0) and the sums of the columns `sums` up to and with it."""
    made = df.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns)
    schema = ", ".join(f"`{c}` {t}" for c, t in made.dtypes) + ", part int, place long" + "".join(f", to_{s} long" for s in sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, so_far = TaskContext.get().partitionId(), 0, [0] * len(sums)
        for b in batches:
            n = b.num_rows
            more = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))]
            for k, s in enumerate(sums):
                up = so_far[k] + np.cumsum(b.column(b.schema.get_field_index(s)).to_numpy(zero_copy_only=False), dtype=np.int64)
                so_far[k] = int(up[-1]) if n else so_far[k]
                more.append(pa.array(up))
            at += n
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "part", "place", *[f"to_{s}" for s in sums]])

    kept = keep(made.mapInArrow(run, schema), name)
    ends = ["place", *[f"to_{s}" for s in sums]]
    # A row for each range partition.
    parts = sorted(kept.groupBy("part").agg((F.max("place") + 1).alias("place"), *[F.max(c).alias(c) for c in ends[1:]]).collect())
    before = [(p["part"], *at) for p, at in zip(parts, zip(*[accumulate([p[c] for p in parts[:-1]], initial=0) for c in ends], strict=True), strict=True)] if parts else []
    offsets = df.sparkSession.createDataFrame(before, "part int" + "".join(f", before_{c} long" for c in ends))
    out = kept.join(F.broadcast(offsets), "part").select(*columns, *[(F.col(c) + F.col(f"before_{c}")).alias(c) for c in ends])
    out._kept_at = kept._kept_at
    return out


def _rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, size) of every conversation with its number of rebuilt turns; and (c, i, key, chars, last) of every rebuilt turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    said = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    key = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text"))
    said = said.withColumns({"key": key, "chars": F.length("text").cast("long")})
    turns = _scanned(said, ["c", "turn", "role", "text"], ["c", "key", "chars"], [], "turns")
    convs = keep(turns.groupBy("c").agg(F.min("place").alias("first"), F.count("*").alias("own")), "convs")
    takes = F.crc32(F.col("c").cast("string").cast("binary")) % HEADS
    convs = convs.withColumns({"giver": F.col("c") - F.col("c") % HUNDRED, "takes": takes})
    givers = convs.select(F.col("c").alias("giver"), F.col("own").alias("has"))
    # At most HUNDRED conversations have one giver.
    convs = convs.join(givers, "giver", "left").withColumn("given", F.least("takes", F.coalesce("has", F.lit(0))))
    convs = keep(convs.withColumn("size", F.col("given") + F.greatest(F.col("own") - F.col("takes"), F.lit(0))), "rebuilt")
    met = looked_up(turns, convs.select("c", "first", "own", "takes", "given", "size"), "c", "own", turns.count())
    placed = met.withColumn("i", F.col("place") - F.col("first"))
    later = placed.where("i >= takes").select("c", (F.col("i") - F.col("takes") + F.col("given")).alias("i"), "key", "chars", "size")
    heads = placed.where(F.col("i") < HEADS - 1).select(F.col("c").alias("giver"), "i", "key", "chars")
    given = convs.where("given > 0").select("giver", "c", "given", "size").join(heads, "giver").where("i < given").select("c", "i", "key", "chars", "size")
    rebuilt = later.unionByName(given)
    return convs.select("c", "size"), rebuilt.select("c", "i", "key", "chars", (F.col("i") + 1 == F.col("size")).alias("last"))


def _blocks(items: DataFrame, level: int) -> DataFrame:
    """(c, j, items, text): the items (c, i, key, ...) of each block of FAN in order, and their keys in one text."""
    own = [c for c in items.columns if c != "c"]
    blocks = items.groupBy("c", F.floor(F.col("i") / FAN).alias("j")).agg(F.array_sort(F.collect_list(F.struct(*own))).alias("items"))
    return keep(blocks.withColumn("text", F.array_join(F.col("items.key"), "")), f"blocks-{level}")


def _ranks(blocks: DataFrame, level: int) -> DataFrame:
    """(text, n, rank): every distinct text of blocks, how many have it, and a number in the order of the texts."""
    texts = blocks.groupBy("text").agg(F.count("*").alias("n"))
    return keep(texts.repartitionByRange("text").sortWithinPartitions("text").withColumn("rank", F.monotonically_increasing_id()), f"ranks-{level}")


def _chained(level: int) -> Column:
    """The names of a block's sequences: its start, then one for each item; the last one of a full block is given from above. Ranks of two levels may be equal: the level stands in the name."""
    steps = F.aggregate(F.col("items.key"), F.array("start"), lambda acc, k: F.concat(acc, F.array(F.md5(F.concat(F.element_at(acc, -1), F.lit(f":{level}:"), k)))))
    full = (F.size("items") == FAN) & F.col("end").isNotNull()
    return F.when(full, F.concat(F.slice(steps, 1, FAN), F.array("end"))).otherwise(steps)


def _members(items: DataFrame) -> DataFrame:
    """(key, parent, depth, chars, last, c, rank) for every rebuilt turn: the node that it leads to, and its sequence's rank."""
    levels: list[DataFrame] = []
    while True:
        blocks = _blocks(items, len(levels))
        ranks = _ranks(blocks, len(levels))
        levels.append(blocks)
        ranked = looked_up(blocks.select("c", "j", "text"), ranks, "text", "n", blocks.count())
        if not blocks.agg(F.max("j")).first()[0]:  # none, or each sequence is one block
            break
        items = ranked.select("c", F.col("j").alias("i"), F.lpad(F.lower(F.hex("rank")), 16, "0").alias("key"))
    starts = ranked.select("c", "j", F.lit("").alias("start"), F.lit(None).cast("string").alias("end"), "rank")
    while len(levels) > 1:
        named = levels.pop().drop("text").join(starts, ["c", "j"]).withColumn("names", _chained(len(levels)))
        inner = F.transform("items", lambda x, p: F.struct(x["i"].alias("j"), F.get("names", p).alias("start"), F.get("names", p + 1).alias("end")))
        starts = keep(named.select("c", "rank", F.explode(inner).alias("x")).select("c", "x.j", "x.start", "x.end", "rank"), f"starts-{len(levels)}")
    named = levels.pop().drop("text").join(starts, ["c", "j"]).withColumn("names", _chained(0))
    nodes = F.transform("items", lambda x, p: F.struct(F.get("names", p + 1).alias("key"), F.get("names", p).alias("parent"), (x["i"] + 1).alias("depth"), x["chars"].alias("chars"), x["last"].alias("last")))
    return keep(named.select("c", "rank", F.explode(nodes).alias("x")).select("x.*", "c", "rank"), "members")


def _ends(rows: DataFrame) -> DataFrame:
    """(key, ends_sha256): the digest of each key's ids (column c), ascending and joined by commas."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            keys, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            cuts = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)]
            spans = [(k, min(k + CHUNK, hi)) for lo, hi in zip(cuts, cuts[1:], strict=False) for k in range(lo, hi, CHUNK)]
            out = [(keys[lo], part, seq + n, ",".join(map(str, ids[lo:hi]))) for n, (lo, hi) in enumerate(spans)]
            seq += len(out)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["key", "part", "seq", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            done = []
            for k, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k == key:
                    state.update(b",")
                else:
                    if state:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["key", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    joined = rows.select("key", "c").repartitionByRange("key", "c").sortWithinPartitions("key", "c").mapInArrow(chunks, "key string, part long, seq long, ids string")
    streams = joined.repartition("key").sortWithinPartitions("key", "part", "seq").select("key", "ids")
    return streams.mapInArrow(digest, "key string, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and its interval, preorder to subtree_end (both counted from 0, included)."""
    convs, items = _rebuilt(conversations)
    members = _members(items)
    # Digests name all of a node's constants, so that longs alone are added up.
    nodes = members.groupBy("key", "parent", "depth", "chars").agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.min("rank").alias("first"), F.max("rank").alias("last_rank"))
    empty, none = F.lit(""), F.lit(None).cast("string")
    root = convs.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").join(F.broadcast(members.agg(F.coalesce(F.max("rank"), F.lit(-1)).alias("last_rank"))))
    root = root.select(empty.alias("key"), none.alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), "conv_id", "n_convs", F.lit(-1).cast("long").alias("first"), "last_rank")
    nodes = keep(nodes.unionByName(root), "nodes")

    parents = keep(nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children")), "parents")
    family = nodes.join(parents, "key", "left").withColumns({"saved": (F.col("n_convs") - 1) * F.col("chars"), "leaf": F.col("n_children").isNull().cast("long")})
    placed = _scanned(family, ["first", "depth"], ["key", "parent", "conv_id", "depth", "n_convs", "first", "last_rank", "n_children", "saved", "leaf"], ["saved", "leaf"], "preorder")

    # Where the nodes end that begin at a rank; -1 is the root's.
    ended = placed.groupBy(F.col("first").alias("last_rank")).agg(F.max("place").alias("subtree_end"), F.max("to_saved").alias("end_saved"), F.max("to_leaf").alias("end_leaf"))
    ended = ended.join(placed.groupBy("last_rank").agg(F.count("*").alias("met")), "last_rank")
    total = nodes.count()
    spans = looked_up(placed, ended, "last_rank", "met", total)
    above = parents.join(nodes.select("key", F.col("conv_id").alias("parent_conv_id")), "key").select(F.col("key").alias("parent"), F.col("n_children").alias("siblings"), "parent_conv_id")
    spans = looked_up(spans, above, "parent", "siblings", total)

    at_root = convs.where("size = 0").select(empty.alias("key"), "c")
    ends = _ends(members.where("last").select("key", "c").unionByName(at_root))
    out = spans.join(ends, "key", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        (F.col("end_leaf") - F.col("to_leaf") + F.col("leaf")).alias("n_leaves"), (F.col("end_saved") - F.col("to_saved") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), F.col("place").alias("preorder"), "subtree_end",
    )


ORACLE = r"""
WITH own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i,
                    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
bytes AS (SELECT c, n, list_transform(range(1, len(CAST(c AS VARCHAR)) + 1), lambda k: CAST(ascii(CAST(c AS VARCHAR)[k]) AS BIGINT)) AS b FROM (SELECT c, count(*) AS n FROM own GROUP BY c)),
conv AS (SELECT c, n, c - c % 100 AS giver,
                xor(list_reduce(list_prepend(4294967295, b), lambda crc, x: list_reduce(list_prepend(xor(crc, x), [0, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r >> 1, (r & 1) * 3988292384))), 4294967295) % 6 AS h FROM bytes),
giving AS (SELECT a.c, a.n, a.giver, a.h, least(a.h, coalesce(g.n, 0)) AS m FROM conv a LEFT JOIN conv g ON g.c = a.giver),
turn AS (SELECT g.c, o.i AS d, o.role, o.text FROM giving g JOIN own o ON o.c = g.giver AND o.i < g.m
         UNION ALL SELECT g.c, o.i - g.h + g.m, o.role, o.text FROM giving g JOIN own o ON o.c = g.c AND o.i >= g.h),
path AS (SELECT c, d + 1 AS depth, length(text) AS chars, count(*) OVER (PARTITION BY c) AS size,
                string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d) AS path FROM turn),
prefix AS (SELECT c, depth, chars, path, depth = size AS last FROM path UNION ALL SELECT c, 0, 0, '', c NOT IN (SELECT c FROM turn) FROM giving),
above AS (SELECT path, depth, chars, last, c, lag(path) OVER (PARTITION BY c ORDER BY depth) AS parent FROM prefix),
node AS (SELECT path, depth, chars, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE last), '') AS ends FROM above GROUP BY path, depth, chars),
kids AS (SELECT parent, count(*) AS n FROM node WHERE parent IS NOT NULL GROUP BY parent),
flag AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON kids.parent = node.path),
below AS (SELECT a.path, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.chars) AS saved FROM flag a JOIN flag b ON starts_with(b.path, a.path) GROUP BY a.path)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, b.n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM flag f JOIN below b ON b.path = f.path LEFT JOIN node p ON p.path = f.parent
"""
