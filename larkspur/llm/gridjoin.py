"""Embedding near-duplicates by an epsilon grid order join.

Vectors of length one within cosine t of each other are at most
eps = sqrt(2 - 2 t) apart, in every projection too. Vectors are projected on the
leading DIMS principal directions, cut into cells of eps, and sorted by their
cells (the epsilon grid order). The sorted sequence is dealt into intervals of WIDE vectors, a row
each; two intervals meet unless their bounding boxes are provably over eps apart. Within a pair of
intervals the join recurses down to pairs of blocks of BLOCK, by the same rule. Surviving block pairs are compared
by a bound of the cosine from SHORT directions and the lengths of what they leave out, or, where that leaves many, by whole vectors
in float32; what comes near the threshold is decided in float64.

Equal vectors are one class: a hot vector is one row of the join. A vector is shuffled twice, to find its equals and to be sorted. Pairs
of intervals are a Cartesian product of the written table's partitions: each task reads two of them where they lie, so nothing is
copied for its partners. Rows keep the number of links (from classes' sizes) and meet components through a
spanning forest of each pair. The work of comparing grows with the square of the vectors that no box parts.

Defined cases: a null or zero vector, or one with null or non-finite parts, links
with nothing (n_links 0, its own component); vectors of another length than the
most common one only link among themselves; a null vec_id is a vector like
others, but names no component; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from larkspur.llm.components import components
from larkspur.llm.simhash import _forest
from larkspur.session import forget_shuffles, keep

COSINE, DIMS, SHORT, BLOCK, WIDE, SAMPLE = 0.9, 8, 24, 1024, 8192, 4096
#: Pairs of intervals that one Arrow batch holds.
PAIRS = 4


def _usable(v) -> bool:
    return v is not None and len(v) > 0 and np.isfinite(v).all() and bool(np.any(v))


def _units(raw: bytes, n: int, dtype: str) -> np.ndarray:
    """Vectors of length one, in float64, from the bytes of n vectors of equal length."""
    v = np.frombuffer(raw, dtype).reshape(n, -1).astype(np.float64)
    v /= np.maximum(v.max(1, keepdims=True), -v.min(1, keepdims=True))
    v /= np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
    return v


def _directions(some: np.ndarray) -> np.ndarray:
    """The principal directions of unit vectors (rows), the leading one first."""
    return np.linalg.eigh(np.atleast_2d(np.cov(some, rowvar=False)))[1][:, ::-1] if len(some) > 1 else np.eye(some.shape[1])


def _order(classes: DataFrame, axes: np.ndarray, dtype: str, eps: float) -> DataFrame:
    """(class_id, copies, raw, cell): classes with their cells as a sortable string."""
    axes = axes[:, :DIMS]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.clip(np.floor(_units(b"".join(batch.column(2).to_pylist()), batch.num_rows, dtype) @ axes / eps) + 128, 0, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in cells], pa.binary())], ["class_id", "copies", "raw", "cell"])

    return classes.select("class_id", "copies", "raw").mapInArrow(place, "class_id long, copies long, raw binary, cell binary")


def _block_pairs(low: np.ndarray, high: np.ndarray, eps: float) -> np.ndarray:
    """Pairs (i <= j) of blocks whose bounding boxes come within eps, by recursion over pairs of intervals of the sequence."""
    n = len(low)
    if not n:
        return np.zeros((0, 2), int)
    levels = [(low, high)]
    while len(levels[-1][0]) > 1:
        a, b = levels[-1]
        if len(a) % 2:
            a, b = np.concatenate([a, a[-1:]]), np.concatenate([b, b[-1:]])
        levels.append((a.reshape(-1, 2, a.shape[1]).min(1), b.reshape(-1, 2, b.shape[1]).max(1)))
    pairs = np.zeros((1, 2), int)
    for a, b in levels[::-1]:
        gap = np.maximum(0, np.maximum(a[pairs[:, 0]] - b[pairs[:, 1]], a[pairs[:, 1]] - b[pairs[:, 0]]))
        pairs = pairs[(gap**2).sum(1) <= eps * eps]
        if a is low:
            break
        below = len(levels[[x is a for x, _ in levels].index(True) - 1][0])
        pairs = np.unique((2 * pairs[:, None, :] + np.array([[0, 0], [0, 1], [1, 0], [1, 1]])).reshape(-1, 2), axis=0)
        pairs = pairs[(pairs[:, 0] <= pairs[:, 1]) & (pairs[:, 1] < below)]
    return pairs


def _exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs (i, j) of rows reach the cosine, in float64."""
    return np.concatenate([np.einsum("ij,ij->i", a[i[k : k + 65536]], b[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.zeros(0)]) >= cosine


class _Interval:
    """The unit vectors of an interval, their SHORT leading parts with the length of the rest, and the boxes of its blocks."""

    def __init__(self, raw: bytes, ids: bytes, copies: bytes, axes: np.ndarray, dtype: str):
        self.ids, self.copies = np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64)
        self.units = _units(raw, len(self.ids), dtype)
        self.rough = self.units.astype(np.float32)
        along = self.units @ axes
        rest = np.sqrt(np.maximum(0, 1 - (along[:, :SHORT] ** 2).sum(1, keepdims=True)))
        self.short = np.concatenate([along[:, :SHORT], rest], 1).astype(np.float32)
        self.at = range(0, len(self.ids), BLOCK)
        self.low = np.stack([along[k : k + BLOCK, :DIMS].min(0) for k in self.at])
        self.high = np.stack([along[k : k + BLOCK, :DIMS].max(0) for k in self.at])


def _links(a: _Interval, p: slice, b: _Interval, q: slice, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): the pairs of a block of a and one of b that reach the cosine, counted from the blocks' starts."""
    width = a.units.shape[1]
    slack = max(1e-4, width * 2.5e-7)  # over the error of a float32 product of unit vectors
    if width > SHORT + 1:
        # No cosine is above the product of the short parts and of the lengths of the rest.
        may = a.short[p] @ b.short[q].T >= cosine - slack
        if np.count_nonzero(may) * 64 <= may.size:
            some = np.flatnonzero(may.any(1))
            i, j = np.nonzero(may[some])
            i = some[i]
            on = _exact(a.units[p], b.units[q], i, j, cosine)
            return i[on], j[on]
    rough = a.rough[p] @ b.rough[q].T
    i, j = np.nonzero(rough >= cosine - slack)
    on = rough[i, j] >= cosine + slack
    near = np.flatnonzero(~on)
    on[near] = _exact(a.units[p], b.units[q], i[near], j[near], cosine)
    return i[on], j[on]


def _met(a: _Interval, b: _Interval, same: bool, eps: float, cosine: float) -> pa.RecordBatch:
    """(class_id, n, hung) of the classes that link to another one in a pair of intervals, of which both may be the same."""
    begin, blocks = (0, 0) if same else (len(a.ids), len(a.at))
    ids, copies = (a.ids, a.copies) if same else (np.concatenate([a.ids, b.ids]), np.concatenate([a.copies, b.copies]))
    pairs = _block_pairs(a.low, a.high, eps) if same else _block_pairs(np.concatenate([a.low, b.low]), np.concatenate([a.high, b.high]), eps)
    n, hung = np.zeros(len(ids)), [(np.zeros(0, np.int64),) * 2]
    for x, y in pairs.tolist() if same else [(x, y) for x, y in pairs.tolist() if x < blocks <= y]:
        p, q = a.at[x], b.at[y - blocks]
        i, j = _links(a, slice(p, p + BLOCK), b, slice(q, q + BLOCK), cosine)
        i, j = i + p, j + q + begin
        if same and x == y:
            i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        n += np.bincount(i, weights=copies[j], minlength=len(ids)) + np.bincount(j, weights=copies[i], minlength=len(ids))
        # Of a block pair's links those of a forest are kept.
        root = _forest(len(ids), i, j)
        on = np.flatnonzero(root != np.arange(len(ids)))
        hung.append((on, root[on]))
    root = _forest(len(ids), *[np.concatenate(x) for x in zip(*hung, strict=True)])
    on = n > 0
    return pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(n[on].astype(np.int64)), pa.array(ids[root][on])], ["class_id", "n", "hung"])


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding)."""
    eps = float(np.sqrt(2 - 2 * cosine)) + 1e-9
    of, dtype = ("float", "float32") if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else ("double", "float64")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            width = pc.min_max(pc.list_value_length(lists))
            if batch.num_rows and not lists.null_count and width["min"].as_py() == width["max"].as_py() > 0 and not lists.flatten().null_count:
                v = lists.flatten().to_numpy().reshape(batch.num_rows, -1)
                raw = [x.tobytes() if on else None for x, on in zip(v, np.isfinite(v).all(1) & v.any(1), strict=True)]
            else:
                made = [None if v is None or None in v else np.array(v, dtype) for v in lists.to_pylist()]
                raw = [v.tobytes() if _usable(v) else None for v in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["vec_id", "raw"])

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{of}>")).mapInArrow(packed, "vec_id long, raw binary")
    # A class is an equal vector, named by a hash.
    rows = rows.select("vec_id", F.when(F.col("raw").isNotNull(), F.xxhash64("raw")).alias("class_id"), "raw")
    classes = keep(rows.where("raw is not null").groupBy("class_id", "raw").agg(F.count("*").alias("copies"), F.min("vec_id").alias("rep")), "classes")
    forget_shuffles(vectors.sparkSession)
    rows = keep(rows.select("vec_id", "class_id"), "rows")
    size = np.dtype(dtype).itemsize
    parts = []
    for width in [r[0] for r in classes.select((F.length("raw") / size).cast("int").alias("w")).distinct().collect()]:
        parts.append(_join(classes.where(F.length("raw") == size * width), width, dtype, eps, cosine))
    if parts:
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        # n: copies of the other classes that a class links to; hung: a link of the forest.
        n = found.groupBy("class_id").agg(F.sum("n").alias("others"))
        label = components(found.select("class_id", "hung"), "class_id", "hung").select(F.col("node").alias("class_id"), "component")
        per = keep(classes.select("class_id", "copies", "rep").join(n, "class_id", "left").join(label, "class_id", "left").select("class_id", "rep", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "class_id").alias("component")), "per_class")
        least = per.groupBy("component").agg(F.min("rep").alias("component_id"))
        per = per.join(least, "component").select("class_id", "n_links", "component_id")
        out = rows.join(per, "class_id", "left")
    else:
        out = rows.withColumn("n_links", F.lit(None).cast("long")).withColumn("component_id", F.lit(None).cast("long"))
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _intervals(classes: DataFrame, axes: np.ndarray, dtype: str, eps: float) -> DataFrame:
    """(number, low, high, ids, copies, raws): intervals of up to WIDE classes in the epsilon grid order, with the corners of their boxes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if got and sum(b.num_rows for b in got):
            t = pa.Table.from_batches(got)
            for k in range(0, t.num_rows, WIDE):
                part = t.slice(k, WIDE)
                raw = b"".join(part.column("raw").to_pylist())
                box = _units(raw, part.num_rows, dtype) @ axes[:, :DIMS]
                number = (TaskContext.get().partitionId() << 32) + k
                ids, copies = (np.array(part.column(c)).astype(np.int64).tobytes() for c in ("class_id", "copies"))
                yield pa.RecordBatch.from_pydict({"number": pa.array([number]), "low": pa.array([box.min(0).tolist()], pa.list_(pa.float64())), "high": pa.array([box.max(0).tolist()], pa.list_(pa.float64())), "ids": pa.array([ids], pa.binary()), "copies": pa.array([copies], pa.binary()), "raws": pa.array([raw], pa.binary())})

    placed = _order(classes, axes, dtype, eps)
    dealt = placed.repartitionByRange(max(1, -(-classes.count() // WIDE)), "cell", "class_id").sortWithinPartitions("cell", "class_id")
    return keep(dealt.select("class_id", "copies", "raw").mapInArrow(pack, "number long, low array<double>, high array<double>, ids binary, copies binary, raws binary"), "intervals")


def _apart(a: str, b: str) -> Column:
    """The squared distance of two boxes."""
    over = lambda x, y: F.zip_with(f"{x}.low", f"{y}.high", lambda lo, hi: F.greatest(lo - hi, F.lit(0.0)))
    return F.aggregate(F.zip_with(over(a, b), over(b, a), lambda x, y: x * x + y * y), F.lit(0.0), lambda s, x: s + x)


def _pairs(intervals: DataFrame, eps: float) -> DataFrame:
    """Each pair of intervals whose boxes come within eps, and each interval with itself: a Cartesian product of the table's partitions, which shuffles nothing."""
    a, b = intervals.alias("a"), intervals.alias("b")
    x, y = F.col("a.number"), F.col("b.number")
    # A pair is met once, as (a, b) or (b, a) by its hash, so that all tasks have work.
    once = (x == y) | ((x < y) == (F.pmod(F.xxhash64(F.least(x, y), F.greatest(x, y)), F.lit(2)) == 0))
    met = a.join(b.hint("shuffle_replicate_nl"), once & (_apart("a", "b") <= eps * eps))
    return met.select((x == y).alias("same"), *[F.col(f"{t}.{c}").alias(f"{c}_{t}") for t in "ab" for c in ("raws", "ids", "copies")])


def _join(classes: DataFrame, width: int, dtype: str, eps: float, cosine: float) -> DataFrame:
    """(class_id, n, hung): for each class and pair of intervals where it links, the copies that it links to there, and its root in the pair's forest."""
    some = classes.orderBy("class_id").limit(SAMPLE).toPandas()["raw"]  # directions only prune: any sample gives right results
    axes = _directions(_units(b"".join(some), len(some), dtype)) if len(some) else np.eye(width)
    spark = classes.sparkSession
    intervals = _intervals(classes, axes, dtype, eps)
    forget_shuffles(spark)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same, *both = (c[k].as_py() for c in batch.columns)
                a = _Interval(*both[:3], axes, dtype)
                yield _met(a, a if same else _Interval(*both[3:], axes, dtype), same, eps, cosine)

    conf, name = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, str(PAIRS))
    try:
        return keep(_pairs(intervals, eps).mapInArrow(compare, "class_id long, n long, hung long"), "found")
    finally:
        conf.set(name, before)
