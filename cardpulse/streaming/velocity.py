"""Velocity counts of a stream: an extension, as the batch features have no streaming counterpart.

Batch frames look back from every row; a stream keeps windows that slide by a step instead. A window's count and sum are final once the
watermark passes its end, so a late event within the watermark is counted and a later one is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import parse_time
from ..schema import raw_schema
from ..operators.clean import typed


def read_stream(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """Raw JSON transactions as they arrive in a folder, typed."""
    return typed(spark.readStream.schema(raw_schema()).option("pathGlobFilter", pattern).json(path))


def velocity(stream: DataFrame, length: str = "1 hour", step: str = "5 minutes", lateness: str = "24 hours") -> DataFrame:
    """(card_id, window_start, window_end, tx_count, amount_sum) of each card's sliding windows; also of a static DataFrame."""
    timed = stream.withColumn("event_time_ts", F.coalesce(F.timestamp_seconds("event_time_unix"), parse_time(F.col("event_time"))))
    if timed.isStreaming:
        timed = timed.withWatermark("event_time_ts", lateness)
    out = timed.groupBy("card_id", F.window("event_time_ts", length, step).alias("w")).agg(F.count("*").alias("tx_count"), F.sum("amount").alias("amount_sum"))
    return out.select("card_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "tx_count", "amount_sum")
