"""Edge records as a stream: the same standard form as in batch, late and repeated records handled by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions.ids import fact_columns


def edge_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Raw edge records from Parquet files as they arrive in a folder (the schema is that of the files there)."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def merged_counts(raw: DataFrame, time: str = "observed_at", lateness: str = "30 days", window: str = "30 days") -> DataFrame:
    """``window_start, relation, n``: records per window and relation, each edge_id once.

    Records later than ``lateness`` behind the newest are left out; records
    without a time are in no window.  Works on a stream and on a table.
    """
    timed = raw.withColumn("__at", F.col(time).cast("timestamp")).filter("__at IS NOT NULL").withWatermark("__at", lateness)
    once = timed.dropDuplicatesWithinWatermark(["edge_id"]) if raw.isStreaming else timed.dropDuplicates(["edge_id"])
    facts = fact_columns(once).select("__at", F.col("relation_n").alias("relation"))
    return facts.groupBy(F.window("__at", window).alias("w"), "relation").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "relation", "n")
