"""Sessions, table reading and lineage cuts that every part of the engine shares."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(cpus: str = "8", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("larkspur")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, only where that is unset on a local master (tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='larkspur-')}"
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def keep(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives lost executors, and is read by column."""
    path = f"{shared_dir(df.sparkSession)}/larkspur/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def keep_by(df: DataFrame, key: str, parts: int, name: str = "cut", dealt: bool = False) -> DataFrame:
    """keep, dealt by key in `parts` buckets: joins by columns with the key, and windows by them, of tables kept alike shuffle nothing.

    A table in such buckets isn't dealt again; dealt: nor is df, a union of such tables, of which each task's rows are those of one bucket.
    """
    spark = df.sparkSession
    path, own = f"{shared_dir(spark)}/larkspur/{name}-{uuid.uuid4().hex}", f"{name}_{uuid.uuid4().hex}"
    shares = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(shares, "true")
    # Rows of one key lie in one bucket: a join by more columns than the key may use the buckets.
    spark.conf.set(shares, "false")
    try:
        (df if dealt else df.repartition(parts, key)).write.option("compression", "zstd").option("path", path).bucketBy(parts, key).saveAsTable(own)
    finally:
        spark.conf.set(shares, before)
    return spark.table(own)


def discard(*tables: DataFrame) -> None:
    """Delete kept tables that nothing reads any more, and forget their shuffles."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        forget_shuffles(tables[0].sparkSession)


def forget_shuffles(spark: SparkSession) -> None:
    """Let the driver collect what it no longer refers to: the files of shuffles that only kept tables came from go with it."""
    gc.collect()
    spark._jvm.System.gc()


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts stay a few MB, so that Python workers fit beside small heaps."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def give_back() -> None:
    """Return a Python worker's freed memory to the system: workers live on between tasks, beside the executor's heap."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass
