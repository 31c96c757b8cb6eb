"""Intermediate tables that iterative operators cut their lineage with, in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir, which goes with the driver's JVM; where that is unset under a folder of our own, which only a local master may have."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif spark.sparkContext.master.startswith("local"):
            root = f"file://{tempfile.mkdtemp(prefix='loom-')}"
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def saved(df: DataFrame, label: str = "step") -> DataFrame:
    """df as a Parquet table in a shared folder: it is worked out once, and lost executors lose none of it."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it lasts, Python is given so many rows at once at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def numbered(df: DataFrame, *order: str, name: str = "corpus_pos", by: str | None = None) -> DataFrame:
    """df with its rows' places from 1, gapless, in the given order (within each value of `by`).

    Rows are dealt by range and sorted, so no task holds them all; a place is that within the part, and the number of
    rows in the parts before it, which are counted first (a row for each part and value). Rows equal in all of `order` get
    their places in any order.
    """
    keys = [by, *order] if by else list(order)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The number of a row in the written table tells its part and its place there.
    placed = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = saved(placed, "placed")
    part = F.shiftright("_at", 33)
    group = [part.alias("_part"), *([F.col(by)] if by else [])]
    counts = placed.groupBy(*group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    window = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = counts.withColumn("_before", F.coalesce(F.sum("_n").over(window), F.lit(0))).select("_part", *([F.col(by).alias("_by")] if by else []), "_first", "_before")
    same = (part == F.col("_part")) & (F.col(by).eqNullSafe(F.col("_by")) if by else F.lit(True))
    # Without `by` there is a head for each part, so rows stay where they are.
    rows = placed.join(heads if by else F.broadcast(heads), same)
    return rows.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_at", "_part", "_by", "_first", "_before")
