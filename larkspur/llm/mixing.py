"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

A document of s words has a rate of at most LIMIT copies. Among all rates whose
words meet each source's target, the one of least bounded relative entropy is
exponentially tilted: rate = LIMIT * e^t / (1 + e^t), t = lambda * s / (mean s).
The dual is convex in one lambda a source; Newton steps, guarded by a bracket,
solve it. Each step is one grouped sum over the (source, size) histogram, to
which all documents are pre-aggregated, so a hot source costs one partial sum in
each task. Rates are rounded into whole copies along running sums of the rates,
in order of size, so that the words taken stay within about a document of the
target. Running sums are built from blocks: a source's size bins (at most 128),
a bin's hash blocks (1024), and a block's rows; no window holds a source.

Defined cases: null text has size 0; a null source is a source, ordered last; a
source or table without words has target 0 and takes nothing; equal rows get
equal treatment up to which of them is first; no rows give no rows. A caller's
own columns never clash, as only doc_id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.rows import unwrapped, wrapped
from larkspur.session import keep

LIMIT, SHARE, WEIGHTS = 2.0, 1.5, (3, 1, 2)
BINS_A_DOUBLING, BLOCKS, OFFSETS, MAX_STEPS = 4, 1024, 16, 80
#: Rows of a source table below which it is broadcast (under 100 bytes a row); above, it is joined by key.
BROADCAST_ROWS = 50_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def targets(sizes: DataFrame) -> DataFrame:
    """(sid, source, source_size, target) from (source, source_size): 150 % of all words by weight, none over twice its source's size."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    level = Window.orderBy("ratio", "sid")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.col("sid") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    t = sizes.select(F.row_number().over(by_name).alias("sid"), "source", "source_size").withColumn("weight", weight).withColumn("top", LIMIT * F.col("source_size")).withColumn("ratio", F.col("top") / F.col("weight"))
    # Water filling: a source's target is the lesser of its top and weight * level; the level is that of the first source that it doesn't fill.
    everything = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("below", F.sum("top").over(level) - F.col("top")).withColumn("rest", F.sum("weight").over(everything) - F.sum("weight").over(level) + F.col("weight"))
    t = t.withColumn("level", (SHARE * F.sum("source_size").over(everything) - F.col("below")) / F.col("rest"))
    t = t.withColumn("fill", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(everything)["level"])
    return t.select("sid", "source", "source_size", F.least("top", F.coalesce(F.col("weight") * F.col("fill"), F.col("top"))).alias("target"))


def _rate(lam: Column, x: Column) -> Column:
    z = F.greatest(F.least(lam * x, F.lit(700.0)), F.lit(-700.0))
    return LIMIT / (1 + F.exp(-z))


def tilts(histogram: DataFrame, sources: DataFrame, count: int) -> DataFrame:
    """(sid, lam, scale): the solved dual; lam is null where the target is all that there is (every rate is LIMIT)."""
    n = histogram.groupBy("sid").agg(F.sum("n").alias("docs"))
    full = F.col("target") >= LIMIT * F.col("source_size") * (1 - 1e-12)
    state = sources.join(n, "sid").select("sid", "target", (F.greatest(F.col("source_size"), F.lit(1)) / F.col("docs")).alias("scale"), full.alias("full"), F.when(~full, F.log(F.col("target") / (LIMIT * F.col("source_size") - F.col("target")))).alias("lam"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), full.alias("met"))
    state = keep(state.coalesce(1) if count <= BROADCAST_ROWS else state, "tilts")
    for _ in range(MAX_STEPS):
        if state.where("not met").isEmpty():
            break
        x = F.col("size") / F.col("scale")
        rate = _rate(F.col("lam"), x)
        slope = rate * (1 - rate / LIMIT) * x * F.col("size")
        sums = histogram.join(_small(state.where("not met").select("sid", "lam", "scale"), count), "sid").groupBy("sid").agg(F.sum(F.col("n") * rate * F.col("size")).alias("got"), F.sum(F.col("n") * slope).alias("slope"))
        g = F.col("got") - F.col("target")
        step = state.join(sums, "sid", "left").withColumn("met2", F.col("met") | (F.abs(g) <= 1e-9 * F.col("target"))).withColumn("lo2", F.when(g < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi2", F.when(g > 0, F.col("lam")).otherwise(F.col("hi")))
        newton = F.col("lam") - g / F.when(F.col("slope") > 0, F.col("slope"))
        middle = F.sinh((F.asinh("lo2") + F.asinh("hi2")) / 2)
        step = step.withColumn("next", F.when(F.col("met2"), F.col("lam")).when((newton > F.col("lo2")) & (newton < F.col("hi2")), newton).otherwise(middle))
        state = keep(step.select("sid", "target", "scale", "full", F.col("next").alias("lam"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), F.col("met2").alias("met")).coalesce(1), "tilts")
    return state.select("sid", "lam", "scale")


def mix(docs: DataFrame) -> DataFrame:
    """Every row of docs as (doc_id, row_key, size, source_size, target, rate, copies, taken); row_key hashes doc_id and text."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("row_key"))
    base = keep(base, "sizes")
    by_size = keep(base.groupBy("source", "size").agg(F.count("*").alias("n")), "by_size")
    sources = keep(targets(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))), "targets")
    count = sources.count()
    histogram = keep(by_size.join(_small(sources.select(F.col("source").alias("own"), "sid"), count), F.col("source").eqNullSafe(F.col("own"))).select("sid", "size", "n"), "histogram")
    tilt = tilts(histogram, sources, count)
    facts = keep(sources.join(tilt, "sid").coalesce(1), "facts") if count <= BROADCAST_ROWS else keep(sources.join(tilt, "sid"), "facts")
    rated = base.join(_small(facts.withColumnRenamed("source", "own"), count), F.col("source").eqNullSafe(F.col("own"))).drop("own", "source")
    rated = rated.withColumn("rate", F.when(F.col("target") <= 0, F.lit(0.0)).when(F.col("lam").isNull(), F.lit(LIMIT)).otherwise(_rate(F.col("lam"), F.col("size") / F.col("scale"))))
    rated = rated.withColumn("bin", F.when(F.col("size") > 0, F.floor(BINS_A_DOUBLING * F.log2(F.col("size").cast("double"))) + 1).otherwise(0).cast("int")).withColumn("block", F.pmod("row_key", F.lit(BLOCKS)).cast("int"))

    blocks = keep(rated.groupBy("sid", "bin", "block").agg(F.sum("rate").alias("sum")), "blocks")
    starts = lambda by, at: _running(blocks.groupBy(*by, at).agg(F.sum("sum").alias("sum")), by, at)
    at_bin = starts(["sid"], "bin").withColumnRenamed("start", "bin_start")
    at_block = starts(["sid", "bin"], "block").join(at_bin, ["sid", "bin"]).select("sid", "bin", "block", (F.col("start") + F.col("bin_start")).alias("start"))

    rows = Window.partitionBy("sid", "bin", "block").orderBy("row_key", "doc_id")
    within = rated.select("doc_id", "row_key", "size", "source_size", "target", "rate", "sid", "bin", "block", F.sum("rate").over(rows.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.coalesce(F.sum("rate").over(rows.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    placed = keep(within.join(at_block, ["sid", "bin", "block"]).drop("bin", "block"), "placed")

    copies = lambda offset: F.least(F.floor(F.col("start") + F.col("upto") + offset) - F.floor(F.col("start") + F.col("before") + offset), F.lit(int(LIMIT)))
    # Of a few offsets of the running sums, each source takes the one whose words come nearest.
    tries = [F.sum(copies(F.lit(k / OFFSETS)) * F.col("size")).alias(f"o{k}") for k in range(OFFSETS)]
    got = placed.groupBy("sid", "target").agg(*tries)
    gaps = [F.struct(F.abs(F.col(f"o{k}") - F.col("target")).alias("gap"), F.lit(k / OFFSETS).alias("offset")) for k in range(OFFSETS)]
    offset = keep(got.select("sid", F.array_min(F.array(*gaps))["offset"].alias("offset")).coalesce(1), "offsets")
    out = placed.join(_small(offset, count), "sid").withColumn("copies", copies(F.col("offset")).cast("int"))
    return out.select("doc_id", "row_key", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _running(sums: DataFrame, by: list[str], at: str) -> DataFrame:
    """(*by, at, start): what the rows of lower `at` in the same group add up to. A group has a bounded number of rows."""
    listed = sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(at, "sum"))).alias("a"))
    steps = F.aggregate("a", F.array(F.lit(0.0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["sum"])))
    return listed.select(*by, F.arrays_zip(F.col(f"a.{at}").alias(at), steps.alias("start")).alias("z")).select(*by, F.explode("z").alias("e")).where(f"e.{at} is not null").select(*by, f"e.{at}", "e.start")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it (none to LIMIT times); columns and their order stay."""
    taken = mix(docs).select("row_key", F.col("doc_id").alias("own_id"), "copies").groupBy("row_key", "own_id").agg(F.sum("copies").alias("all_copies"), F.count("*").alias("rows"))
    # Equal rows share a key: together they get the copies of all of them.
    ranked = wrapped(docs, own_key=F.xxhash64("doc_id", "text"))
    first = Window.partitionBy("own_key", "own_id").orderBy(F.lit(0))
    ranked = ranked.withColumn("own_rank", F.row_number().over(first))
    joined = ranked.join(taken.withColumnRenamed("own_id", "its_id"), (F.col("own_key") == F.col("row_key")) & F.col("own_id").eqNullSafe(F.col("its_id")))
    times = (F.floor(F.col("all_copies") * F.col("own_rank") / F.col("rows")) - F.floor(F.col("all_copies") * (F.col("own_rank") - 1) / F.col("rows"))).cast("int")
    return unwrapped(joined.where(times > 0).withColumn("own_copy", F.explode(F.sequence(F.lit(1), times))), docs.columns)
