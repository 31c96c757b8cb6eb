"""What the operators share: tables, shared folders, written intermediates and global positions."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table of that name, by Spark's own reader, so that any path Spark knows works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset one of our own, but only if all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = held.get() if held.isDefined() else f"file://{tempfile.mkdtemp(prefix='loom-')}"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder in the shared root; it goes when the driver's JVM ends."""
    path = f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def written(df: DataFrame, label: str = "step", group: int | None = None) -> DataFrame:
    """df as a Parquet table in a shared folder: lineage ends there, and lost executors lose none of it.

    Zstandard keeps it small, and unlike the usual codec holds no direct buffers until the next collection of garbage.
    Row groups are of `group` bytes, or of the usual size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark, label)}/table"
    out = df.write.option("compression", "zstd")
    (out.option("parquet.block.size", group) if group else out).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more; tables that were not written stay as they are."""
    for df in tables:
        path = getattr(df, "_written", None)
        if path:
            spark = df.sparkSession
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def released(run: Callable) -> Callable:
    """run over a task's batches, after which what it used goes back to the system: a worker that is kept holds little until its next task."""

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return whole


@contextmanager
def small_reads(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it lasts, rows are read from Parquet and given to Python so many at once: long ones fill a task's memory otherwise."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)))
    try:
        with small_batches(spark, rows):
            yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While it lasts, Python is given so many rows at once: batches of texts are held on both sides of the pipe."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def positioned(df: DataFrame, keys: list[Column], name: str = "pos") -> DataFrame:
    """df with its rows' places, from 0 and gapless, in the order of keys.

    Rows are range-partitioned and sorted, never gathered in one task; only one count per partition
    comes to the driver. keys should tell rows apart: rows equal in all keys get their places in any order.
    """
    spark = df.sparkSession
    shared_root(spark)
    placed = df.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).checkpoint()
    counts = {r[0]: r[1] for r in placed.groupBy(F.spark_partition_id().alias("p")).count().collect()}
    starts, total = [0] * (max(counts, default=0) + 1), 0
    for p in range(len(starts)):
        starts[p], total = total, total + counts.get(p, 0)
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    start = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), F.spark_partition_id() + 1)
    return placed.withColumn(name, local + start)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for columns of our own that clash with none of df's."""
    held, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out
