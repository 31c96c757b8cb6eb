"""Documents as a stream: profiles, anomalies and exact duplicates while files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import audit


def read_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string, source string, ts timestamp", files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def anomalies(stream: DataFrame) -> DataFrame:
    """The anomaly rules over each new document; no state."""
    return audit.anomalies(audit.build_documents(stream))


def first_seen(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """The stream without documents whose normalised text came before, as long as the watermark holds it."""
    keyed = stream.withColumn("fingerprint", T.content_hash(T.normalize_text(F.col("text"))))
    return keyed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["fingerprint"])


def counts_by_source(stream: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "source").agg(F.count("*").alias("n"), F.avg(F.char_length("text")).alias("mean_length"))
