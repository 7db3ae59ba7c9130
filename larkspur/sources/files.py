"""Source trees as rows: listings, scans with an outcome for every entry, manifests, and snapshots that read each file once.

Spark's binaryFile source lists a tree and reads its files in parallel; a listing alone reads no content. Links
come as a table (path, target), as a version control's tree lists them, since readers of a store follow links unseen.
Paths are relative to the tree's root, with / between parts.

Defined cases: an entry below an excluded name is passed over with it, as one row for the highest such name; a link that leads
to itself is ELOOP, one that leads nowhere ENOENT, one to a directory of the tree is already-visited, as real directories
are met first; a link to a file is that file under the link's name; a file that goes away between listing and reading is unreadable;
an empty tree gives no rows. Spark's file sources list neither empty files nor names that begin with a dot or an underscore: such files are missing here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.session import keep

_c = F.col
#: What scans read, and what searches and comparisons pass over.
EXTENSIONS = (".js", ".jsx", ".ts", ".tsx", ".json", ".md", ".xml")
SOURCE_EXTENSIONS = (".js", ".jsx", ".ts", ".tsx")
SEARCH_SKIPS = (".png", ".jpg", ".jpeg", ".gif", ".ico", ".zip", ".rar", ".7z", ".gz", ".pdf", ".docx", ".xlsx", ".pptx", ".pack")
COMPARE_SKIPS = (".png", ".jpg", ".jpeg", ".gif", ".zip", ".rar", ".7z", ".pack")
KEPT = "kept"


def write_tree(rows: DataFrame, root: str) -> None:
    """Write each row (path, text) as a file below root, a line end after its text; listing() finds it under its path."""
    rows.select("path", F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("path").text(root)


def packed(rows: DataFrame) -> DataFrame:
    """(path, length, content) of each row (path, text) as a file of a tree in one kept table, a line end after its text; a listing of it reads no content.

    The form for trees of many small files: a file system makes, commits and lists each of them by itself.
    """
    content = F.encode(F.concat(F.coalesce("text", F.lit("")), F.lit("\n")), "UTF-8")
    return keep(rows.select("path", content.alias("content")).select("path", F.length("content").cast("long").alias("length"), "content"), "pack")


def _relative(path: Column, root: str) -> Column:
    """A file's path below root; files of write_tree have the folder's name for theirs."""
    below = F.regexp_replace(F.substring_index(path, f"{root.rstrip('/').split('://')[-1]}/", -1), "/+", "/")
    named = F.regexp_extract(below, r"^path=([^/]+)/part-[^/]*$", 1)
    return F.when(named != "", F.url_decode(F.replace(named, F.lit("+"), F.lit("%2B")))).otherwise(below)


def _read(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).load(root)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of every file below root; no content is read."""
    return _read(spark, root).select(_relative(_c("path"), root).alias("path"), "length")


def extension(path: Column) -> Column:
    """The lower-cased last extension with its dot; a name that begins with its only dot has none."""
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"^.+(\.[^.]*)$", 1))


def resolve(base: Column, path: Column) -> Column:
    """path from the folder base, without . and .. parts; a path that begins with / is one from the root."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(base, F.lit("/"), path))
    step = lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def directories(files: DataFrame) -> DataFrame:
    """Every directory above a file."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return files.where("path like '%/%'").select(F.explode(above).alias("path")).distinct()


def followed(links: DataFrame, files: DataFrame) -> DataFrame:
    """(path, real, end) of every link: the file or directory that its chain of links ends at, or ENOENT or ELOOP. A step of all open chains a round."""
    step = links.select(_c("path").alias("at"), resolve(folder(_c("path")), _c("target")).alias("next"))
    step = keep(step, "links")
    kinds = keep(files.select(_c("path").alias("next"), F.lit("file").alias("end")).unionByName(directories(files).select(_c("path").alias("next"), F.lit("directory").alias("end"))), "kinds")
    open_, done = step.select(_c("at").alias("path"), "next", F.array("at").alias("seen")), []
    while True:
        met = open_.join(kinds, "next", "left").join(step.select(_c("at").alias("next"), _c("next").alias("on")), "next", "left")
        end = F.when(F.array_contains("seen", _c("next")), "ELOOP").when(_c("end").isNotNull(), _c("end")).when(_c("on").isNull(), "ENOENT")
        met = keep(met.select("path", "next", "on", "seen", end.alias("end")), "followed")
        done.append(met.where("end is not null").select("path", F.when(_c("end").isin("file", "directory"), _c("next")).alias("real"), "end"))
        going = met.where("end is null")
        if going.isEmpty():
            return reduce(DataFrame.unionByName, done)
        open_ = going.select("path", _c("on").alias("next"), F.concat("seen", F.array("next")).alias("seen"))


def scan(files: DataFrame, links: DataFrame | None = None, extensions: tuple[str, ...] = EXTENSIONS, skips: tuple[str, ...] = (), excluded_names: tuple[str, ...] = (), excluded_patterns: tuple[str, ...] = (), follow: bool = False) -> DataFrame:
    """(path, real, outcome): KEPT files, and why every other entry is passed over. extensions: the only ones that are kept (none: all but skips)."""
    entries = files.select("path", F.lit("file").alias("kind"), _c("path").alias("real"), F.lit("file").alias("end"))
    if links is not None:
        ends = followed(links, files) if follow else links.select("path", F.lit(None).cast("string").alias("real"), F.lit("symlink-policy").alias("end"))
        entries = entries.unionByName(ends.select("path", F.lit("link").alias("kind"), "real", "end"))
    parts = F.split("path", "/")
    stop = F.array_min(F.filter(F.transform(parts, lambda x, k: F.when(x.isin(*excluded_names), k + 1)), lambda k: k.isNotNull())) if excluded_names else F.lit(None).cast("int")
    wanted = extension(_c("path")).isin(*extensions) if extensions else ~extension(_c("path")).isin(*skips)
    for p in excluded_patterns:
        wanted = wanted & ~_c("path").rlike(p)
    found = entries.withColumn("stop", stop)
    outcome = F.when(_c("stop").isNotNull(), "directory-exclusion").when(_c("end") == "directory", "already-visited").when(_c("end") != "file", _c("end")).when(wanted, KEPT).otherwise("extension-or-exclusion")
    at = F.when(_c("stop").isNotNull(), F.array_join(F.slice(parts, F.lit(1), F.coalesce("stop", F.lit(1))), "/")).otherwise(_c("path"))
    return found.select(at.alias("path"), F.when(outcome == KEPT, _c("real")).alias("real"), outcome.alias("outcome")).distinct()


def manifest(lines: DataFrame, base: str) -> DataFrame:
    """(path) of each line (value) that is neither blank nor a comment, resolved from base."""
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    return lines.select(line.alias("line")).where("line <> '' and not startswith(line, '#')").select(resolve(F.lit(base), _c("line")).alias("path"))


def snapshots(spark: SparkSession, root: str | None, wanted: DataFrame, listed: DataFrame | None = None, pack: DataFrame | None = None) -> DataFrame:
    """(path, outcome, bytes, lines, source_hash) of each distinct path of wanted: ok, missing, not-a-file or unreadable.

    Each file of the tree, below root or in a pack, is read once, in the scan; only its numbers and its hash go on, never its content.
    """
    if listed is None:
        listed = listing(spark, root) if pack is None else pack.select("path", "length")
    read = _read(spark, root).select(_relative(_c("path"), root).alias("path"), "content") if pack is None else pack
    contents = read.select("path", F.length("content").cast("long").alias("bytes"), F.size(F.split(_c("content").cast("string"), "\r?\n")).cast("long").alias("lines"), F.sha2("content", 256).alias("source_hash"))
    kinds = listed.select("path", F.lit("file").alias("kind")).unionByName(directories(listed).select("path", F.lit("directory").alias("kind")))
    met = wanted.select("path").distinct().join(kinds, "path", "left").join(contents, "path", "left")
    outcome = F.when(_c("kind").isNull(), "missing").when(_c("kind") == "directory", "not-a-file").when(_c("source_hash").isNull(), "unreadable").otherwise("ok")
    return met.select("path", outcome.alias("outcome"), "bytes", "lines", "source_hash")
