"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

Texts are lower-cased and split at ASCII white space; words are hashed. A seed
is the hash of the words that one of MASKS selects from a window of SPAN words:
words at its zeros may differ. For an item of under WINDOW words, that window is
the whole item, and its runs of consecutive words are seeds too, so long as one
is bound to be left whole by the substitutions that OVERLAP allows: no overlap of
such an item is missed, however few its words. Test items' seeds are joined with the documents'
seeds, and each hit is verified on its diagonal: among the windows of
min(WINDOW, item length) words of the item that hold the hit, the best share of
equal words must reach OVERLAP. So substitutions are tolerated, insertions end an
overlap, and a passage of an item counts as well as the whole.

Documents are not shuffled: within a row, places whose two words (a window's last
in every mask, a run's first) are no pair of an item's, then seeds that no item has, are passed
over by bitmaps (literals of at most 2^23 bits, which more seeds fill further; false positives only cost time).
What is left carries its own surroundings into a join with the items' seeds,
which are broadcast only below BROADCAST_ROWS rows and joined by key beyond.

Defined cases: an item of fewer than 5 words matches verbatim only; a null or empty text matches nothing; equal items each get their row; rows that
share a doc_id are one document; a null doc_id is a document of its own name; texts of any length are
read whole; columns but doc_id, item_id and text are not read, whatever their names, and
clean_documents returns them as they are; no items or no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.rows import unwrapped, wrapped
from larkspur.session import keep

MASKS = ("110101011", "111001011", "101100111")
SPAN, WINDOW, OVERLAP = 9, 25, 0.8
BROADCAST_ROWS, MOST_BITS = 200_000, 1 << 23
_BLANK = " \t\n\x0b\f\r"


def word_hashes(text: Column) -> Column:
    trimmed = F.btrim(F.lower(text), F.lit(_BLANK))
    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(trimmed, "[ \\t-\\r]+"), lambda w: F.xxhash64(w)))


def _seed(h: Column, at: Column, mask: int) -> Column:
    return F.xxhash64(*[F.get(h, at + k) for k, c in enumerate(MASKS[mask]) if c == "1"], F.lit(mask))


def _run(h: Column, at: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(h, at + k) for k in range(length)], F.lit(len(MASKS) + length))


def _bitmap(values: DataFrame) -> tuple[Column, int]:
    """A literal bitmap of the one column's values modulo its size: 16 to 32 bits a value, up to MOST_BITS; beyond, more false positives pass."""
    n = values.distinct().count()
    bits = min(MOST_BITS, 1 << max(12, (16 * n).bit_length()))
    own = values.columns[0]
    words = values.select(F.pmod(own, F.lit(bits)).alias("b")).distinct().groupBy(F.shiftright("b", 6).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 64).cast("int"))).alias("v"))
    found = {r["w"]: r["v"] for r in words.collect()}  # at most MOST_BITS / 64 rows
    return F.split(F.lit(",".join(str(found.get(k, 0)) for k in range(bits // 64))), ",").cast("array<bigint>"), bits


def _in(bitmap: tuple[Column, int], value: Column) -> Column:
    words, bits = bitmap
    b = F.pmod(value, F.lit(bits))
    return F.getbit(F.get(words, F.shiftright(b, 6).cast("int")), (b % 64).cast("int")) == 1


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, overlap, hits): documents that hold a passage of an item."""
    tokens = keep(items.select(F.col("item_id").cast("long"), word_hashes(F.col("text").cast("string")).alias("item")).where(F.size("item") >= 1), "items")
    n = F.size("item")
    windows = tokens.where(n >= SPAN).select("item_id", F.explode(F.sequence(F.lit(0), n - SPAN)).alias("q"), "item")
    spaced = windows.select("item_id", "q", F.explode(F.array(*[_seed(F.col("item"), F.col("q"), k) for k in range(len(MASKS))])).alias("seed"))
    # An item of n < WINDOW words with m substitutions has a run of n / (m + 1) equal words at least.
    short = tokens.where(n < WINDOW).withColumn("run", F.floor(n / (F.floor(n * (1 - OVERLAP) + 1e-9) + 1)).cast("int"))
    lengths = sorted(r["run"] for r in short.select("run").distinct().collect())  # a handful
    runs = short.select("item_id", "item", "run", F.explode(F.sequence(F.lit(0), n - F.col("run"))).alias("q"))
    run_seed = F.coalesce(*[F.when(F.col("run") == r, _run(F.col("item"), F.col("q"), r)) for r in lengths], F.lit(None).cast("long"))
    seeds = keep(spaced.unionByName(runs.select("item_id", "q", run_seed.alias("seed"))), "seeds")
    pair = lambda h, at: F.get(h, at).bitwiseXOR(F.shiftleft(F.get(h, at + 1), 1))
    adjacent = tokens.where(n >= 2).select(F.explode(F.transform(F.sequence(F.lit(0), n - 2), lambda k: pair(F.col("item"), k))).alias("w"))
    paired, sown = _bitmap(adjacent), _bitmap(seeds.select("seed"))
    alone = _bitmap(tokens.where(n == 1).select(F.get("item", F.lit(0)).alias("w"))) if 1 in lengths else None

    small = seeds.count() <= BROADCAST_ROWS
    h = F.col("h")
    rows = docs.select(F.col("doc_id").cast("long"), word_hashes(F.col("text").cast("string")).alias("h"))
    # No filter stands on these arrays: one would be pushed down with its own copy of them, word by word.
    # A pair of an item's begins each run and ends each mask's window.
    places = F.when(F.size("h") >= 1, F.sequence(F.lit(0), F.size("h") - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.select("doc_id", "h", F.filter(places, lambda p: _in(paired, pair(h, p)) if alone is None else F.coalesce(_in(paired, pair(h, p)), F.lit(False)) | _in(alone, F.get(h, p))).alias("starts"))

    def sowing(p: Column) -> Column:
        first = p - (SPAN - 2)
        own = [F.struct(first.alias("p"), F.when((first >= 0) & (p + 1 < F.size(h)), _seed(h, first, k)).alias("seed")) for k in range(len(MASKS))]
        own += [F.struct(p.alias("p"), F.when(p + r <= F.size(h), _run(h, p, r)).alias("seed")) for r in lengths]
        return F.filter(F.array(*own), lambda s: s["seed"].isNotNull() & _in(sown, s["seed"]))

    sowed = F.flatten(F.transform("starts", sowing))
    reach = WINDOW - 1
    near = F.transform(sowed, lambda s: F.struct(s["seed"].alias("seed"), F.transform(F.sequence(F.lit(-reach), F.lit(WINDOW - 1)), lambda k: F.when(s["p"] + k >= 0, F.get(h, s["p"] + k))).alias("around")))
    found = rows.select("doc_id", F.explode_outer(near).alias("n")).select("doc_id", "n.seed", "n.around")

    hits = found.join(F.broadcast(seeds) if small else seeds, "seed")
    hits = hits.join(F.broadcast(tokens) if small else tokens, "item_id")
    long = F.least(F.size("item"), F.lit(WINDOW))
    # Window starts on the diagonal, from the hit: within the item, and holding the hit.
    first = F.when(F.size("item") <= WINDOW, -F.col("q")).otherwise(F.greatest(-F.col("q"), SPAN - long))
    last = F.least(F.lit(0), F.size("item") - F.col("q") - long)
    equal = lambda k: F.coalesce((F.get("around", k + reach) == F.get("item", F.col("q") + k)).cast("int"), F.lit(0))
    # A running count of equal words makes each window two look-ups.
    ahead = F.aggregate(F.sequence(first, last + long - 1), F.array(F.lit(0)), lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) + equal(k))))
    hits = hits.select("doc_id", "item_id", "q", "item", long.alias("long"), (last - first).alias("shifts"), ahead.alias("ahead"))
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.col("shifts")), lambda s: F.get("ahead", s + F.col("long")) - F.get("ahead", s)))
    verified = hits.select("doc_id", "item_id", (best / F.col("long")).alias("overlap"))
    # The threshold stands on the groups: on the rows it would move into the join, with its own copy of every window's count.
    groups = verified.groupBy("doc_id", "item_id").agg(F.max("overlap").alias("overlap"), F.count_if(F.col("overlap") >= OVERLAP).alias("hits"))
    return groups.where(F.col("overlap") >= OVERLAP)


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the documents that hold a passage of an item; a null doc_id is kept."""
    leaked = keep(overlaps(docs, items).select(F.col("doc_id").alias("leaked_id")).distinct(), "leaked")
    small = leaked.count() <= BROADCAST_ROWS
    own = wrapped(docs)
    return unwrapped(own.join(F.broadcast(leaked) if small else leaked, F.col("own_id") == F.col("leaked_id"), "left_anti"), docs.columns)
