"""SimHash near-duplicates by a binary trie self-join.

Fingerprints: the majority of the bits of the XXH64 hashes (seed 42) of all word
shingles. Distinct fingerprints are the leaves of a binary trie over their bits.
The join walks pairs of trie nodes from the root down, carries how many bits
differ so far, and drops a pair as soon as that exceeds the budget. To deal the
walk out without copying a node to its many near ones, there is a trie for each of
apart + 1 rotations of the bits: of a pair's at most `apart` differing bits none falls
into one of the apart + 1 stretches, so in the trie that begins with that stretch
the pair is below one node of its first `depth` bits (depth grows with the data, up
to the stretch's 12 bits). Beyond, seven tries begin with two bytes each, 16 bits: a pair
has four equal bytes of eight, so two of one of BYTE_GROUPS. Each such node is a task's work,
in parts where it is large (on average from about 2 x 10^9 distinct fingerprints on); a task
walks its two subtries breadth first, a level of node pairs at a time, in numpy.

A document without words has fingerprint zero and links like any other; a null
text is one without words. Copies share a fingerprint and meet again only in the
last join, so a group of copies costs one leaf. Tasks send a spanning forest of
the links that they find, which loses no connection and no component.

Defined cases: repeated rows of a doc_id each get their row; a null doc_id has no
name to give: its component is the smallest doc_id that it reaches, null when alone;
texts of any length are read whole; an empty table gives no rows; columns but
doc_id and text are not read, whatever their names, and distinct_documents returns
them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.components import components
from larkspur.llm.rows import looked_up, unwrapped, wrapped
from larkspur.session import keep, short_batches

SEED, WORDS, BITS_APART = 42, 4, 4
#: Fingerprints below a node that is one task's work, on average; how many a part of a larger node has; node pairs at or below LEAF candidates are compared directly.
BLOCK, PART, LEAF, FRONTIER = 4096, 1 << 15, 64, 1 << 14
BROADCAST_NODES = 1 << 17
_WEIGHT = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)


def text_fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit fingerprint of one whole text."""
    toks = (text or "").encode().lower().split()
    if not toks:
        return 0
    hashes = _shingle_hashes(toks, words)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[k : k + 8192].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(_WEIGHT[2 * ones > len(hashes)].sum(dtype=np.uint64))


def _shingle_hashes(toks: list[bytes], words: int) -> np.ndarray:
    joined, digest = b" ".join(toks), xxhash.xxh64_intdigest
    if len(toks) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(x) + 1 for x in toks]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts[: -words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of every row of docs; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([text_fingerprint(x.as_py(), words) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _near(a: np.ndarray, b: np.ndarray, first: int, budget: int, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (into sorted a, sorted b) at most `apart` bits apart; all of a share their first bits, as do all of b, and budget of the bits are left."""
    found_a, found_b = [np.zeros(0, int)], [np.zeros(0, int)]
    ones: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    # Breadth first over at most FRONTIER node pairs at once, depth first between such lots: memory stays bounded.
    todo = [(first, (np.array([0]), np.array([len(a)]), np.array([0]), np.array([len(b)]), np.array([budget])))]
    while todo:
        bit, pairs = todo.pop()
        if len(pairs[0]) > FRONTIER:
            todo += [(bit, tuple(x[k : k + FRONTIER] for x in pairs)) for k in range(0, len(pairs[0]), FRONTIER)]
            continue
        alo, ahi, blo, bhi, left = pairs
        small = (ahi - alo) * (bhi - blo) <= LEAF
        if bit == 64:  # equal fingerprints, which are distinct in a block: single leaves
            small[:] = True
        pick = np.flatnonzero(small)
        la, lb = ahi[pick] - alo[pick], bhi[pick] - blo[pick]
        each = la * lb
        at = np.repeat(np.arange(len(pick)), each)
        rank = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
        i, j = alo[pick][at] + rank // lb[at], blo[pick][at] + rank % lb[at]
        ok = np.bitwise_count(a[i] ^ b[j]) <= apart
        found_a.append(i[ok].astype(np.int32))
        found_b.append(j[ok].astype(np.int32))
        alo, ahi, blo, bhi, left = (x[~small] for x in pairs)
        if not len(alo):
            continue
        if bit not in ones:
            ones[bit] = tuple(np.r_[0, np.cumsum(x >> np.uint64(63 - bit) & np.uint64(1))].astype(np.int64) for x in (a, b))
        ones_a, ones_b = ones[bit]
        amid, bmid = ahi - (ones_a[ahi] - ones_a[alo]), bhi - (ones_b[bhi] - ones_b[blo])
        pairs = tuple(np.concatenate(x) for x in zip((alo, amid, blo, bmid, left), (amid, ahi, bmid, bhi, left), (alo, amid, bmid, bhi, left - 1), (amid, ahi, blo, bmid, left - 1), strict=True))
        on = (pairs[0] < pairs[1]) & (pairs[2] < pairs[3]) & (pairs[4] >= 0)
        todo.append((bit + 1, tuple(x[on] for x in pairs)))
    return np.concatenate(found_a), np.concatenate(found_b)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches by links (i, j)."""
    root = np.arange(n)
    while len(i):
        ri, rj = root[i], root[j]
        on = ri != rj
        if not on.any():
            break
        i, j, ri, rj = i[on], j[on], ri[on], rj[on]
        np.minimum.at(root, np.maximum(ri, rj), np.minimum(ri, rj))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return root


#: Where a pair may differ in 4 of 8 bytes, the 4 equal ones hold two of one of these groups: so many tries begin with two equal bytes.
BYTE_GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))


def _orders(apart: int, depth: int) -> list[list[tuple[int, int]]]:
    """For each trie, the stretches (first bit, length) of a fingerprint in the order in which it reads them.

    Rotations by apart + 1 stretches, while one stretch is deep enough; for deeper tries pairs of bytes come first.
    """
    step = 64 // (apart + 1)
    if depth <= step or apart != 4:
        return [[(k * step, 64 - k * step), (0, k * step)] if k else [(0, 64)] for k in range(apart + 1)]
    pairs = [(i, j) for g in BYTE_GROUPS for i in g for j in g if i < j]
    return [[(8 * x, 8) for x in (i, j, *[y for y in range(8) if y not in (i, j)])] for i, j in pairs]


def _read(fp: Column, order: list[tuple[int, int]]) -> Column:
    """The bits of a fingerprint in an order of its stretches."""
    out, at = F.lit(0).cast("long"), 0
    for first, length in order:
        bits = F.shiftrightunsigned(F.shiftleft(fp, first), 64 - length) if length < 64 else fp
        out, at = out.bitwiseOR(F.shiftleft(bits, 64 - at - length) if at + length < 64 else bits), at + length
    return out


def _unread(fps: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """What _read made of fingerprints, in their own order again."""
    out, at = np.zeros_like(fps), 0
    for first, length in order:
        bits = fps << np.uint64(at) >> np.uint64(64 - length)
        out, at = out | bits << np.uint64(64 - first - length), at + length
    return out


def trie_links(classes: DataFrame, apart: int = BITS_APART, block: int = BLOCK, part: int = PART) -> DataFrame:
    """(a, b): links of a spanning forest of all pairs of distinct fingerprints (column fp) at most `apart` bits apart."""
    total = classes.count()
    depth = (total // block).bit_length() if total > block else 0
    orders = _orders(apart, depth) if depth else [[(0, 64)]]
    depth = min(depth, 64 // len(orders) if len(orders) <= apart + 1 else 16)
    rows = classes.select(F.posexplode(F.array(*[_read(F.col("fp"), o) for o in orders])).alias("trie", "turned"))
    node = F.shiftrightunsigned("turned", 64 - depth).cast("int") if depth else F.lit(0)
    rows = rows.select("trie", node.alias("node"), "turned")
    # Large nodes, of at most len(orders) x 2 ** depth, are cut into parts, which meet in pairs.
    sizes = keep(rows.groupBy("trie", "node").count().where(F.col("count") > 2 * part).select("trie", "node", F.ceil(F.col("count") / part).cast("int").alias("parts")), "parts")
    small = sizes.count() <= BROADCAST_NODES
    rows = rows.join(F.broadcast(sizes) if small else sizes, ["trie", "node"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("turned"), F.col("parts")).cast("int"))
    # A part meets every part of its node once: the pair is named by the lower and the higher.
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("part")).alias("low"), F.greatest(p, F.col("part")).alias("high")))
    rows = rows.withColumn("meet", F.explode(meets)).select("trie", "node", "meet.low", "meet.high", "part", "turned")

    def join(t: pa.Table) -> pa.Table:
        fps, part = t.column("turned").to_numpy().view(np.uint64), t.column("part").to_numpy()
        low, high, order = t.column("low")[0].as_py(), t.column("high")[0].as_py(), orders[t.column("trie")[0].as_py()]
        a = np.sort(fps[part == low])
        if low == high:
            i, j = _near(a, a, depth, apart, apart)
            i, j = i[i < j], j[i < j]
            both = a
        else:
            b = np.sort(fps[part == high])
            i, j = _near(a, b, depth, apart, apart)
            j, both = len(a) + j, np.concatenate([a, b])
        root = _forest(len(both), i, j)
        hung = np.flatnonzero(root != np.arange(len(root)))
        out = _unread(np.stack([both[hung], both[root[hung]]], 1), order)
        return pa.table({"a": out[:, 0].copy().view(np.int64), "b": out[:, 1].copy().view(np.int64)})

    return rows.groupBy("trie", "node", "low", "high").applyInArrow(join, "a long, b long")


def simhash_components(docs: DataFrame, words: int = WORDS, apart: int = BITS_APART) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs; rows with a null doc_id take part in no component of their own (null when alone)."""
    short_batches(docs.sparkSession)
    fps = keep(fingerprints(docs, words), "fingerprints")
    classes = keep(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "classes")
    linked = components(trie_links(classes.select("fp"), apart), "a", "b").select(F.col("node").alias("fp"), "component")
    placed = keep(classes.join(linked, "fp", "left").select("fp", "rep", "rows", F.coalesce("component", "fp").alias("component")), "placed")
    # A fingerprint of many copies, and a component of many fingerprints, are looked up by broadcast.
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("members"))
    by_fp = looked_up(placed, least, "component", "members", placed.count()).select("fp", "component_id", "rows")
    return looked_up(fps, by_fp, "fp", "rows", fps.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def distinct_documents(docs: DataFrame, words: int = WORDS, apart: int = BITS_APART) -> DataFrame:
    """docs with one document of each component, the one of smallest doc_id; rows without a doc_id can't be named and stay."""
    found = simhash_components(docs, words, apart)
    heads = found.where("doc_id = component_id").select(F.col("doc_id").alias("head_id")).distinct()
    own = wrapped(docs)
    named = own.join(heads, F.col("own_id") == F.col("head_id")).dropDuplicates(["own_id"]).select("row")
    return unwrapped(named.unionByName(own.where("own_id is null").select("row")), docs.columns)
