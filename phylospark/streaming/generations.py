"""Event-time generations: users of an event stream by time bucket, as a stream or a batch.

The same transformation serves both: with a watermark, late events beyond it are dropped and finished buckets leave the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, folder: str, pattern: str, schema: StructType) -> DataFrame:
    """Parquet files of a folder, as they arrive."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def bucket_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(bucket, event_type, n, total) by event time."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    counts = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("bucket"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, first, last, n): runs of a user's events without a longer gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    counts = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("user_id", F.col("w.start").alias("first"), F.col("w.end").alias("last"), "n")
