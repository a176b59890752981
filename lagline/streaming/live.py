"""Structured Streaming forms (an extension: the batch operators are the product).

Campaigns as session windows over positives, labels as they become known, and hourly
rates with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_campaigns(stream: DataFrame, gap: str, late: str = "1 day", entity: str = "entity_id", time: str = "event_time") -> DataFrame:
    """One row per closed campaign: entity, start, end of its last event plus the gap, size."""
    pos = stream.where("is_fraud").withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    got = pos.groupBy(F.session_window("__t", gap).alias("w"), entity).agg(F.count(F.lit(1)).alias("size"))
    return got.select(entity, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "size")


def live_rates(stream: DataFrame, width: str = "1 hour", late: str = "2 hours", time: str = "event_time") -> DataFrame:
    """Rows and positives per window of event time."""
    rows = stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    got = rows.groupBy(F.window("__t", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_fraud").alias("positives"))
    return got.select(F.col("w.start").alias("start"), "n", "positives")


def live_labels(events: DataFrame, reports: DataFrame, late: str = "1 day", longest: str = "365 days") -> DataFrame:
    """Events joined with their reports as these arrive: an outer stream-stream join bounded by the longest delay."""
    e = events.withColumn("event_at", F.col("event_time").cast("timestamp")).withWatermark("event_at", late)
    r = reports.select(F.col("entity_id").alias("r_entity"), F.col("event_time").alias("r_time"), F.col("reported_at").cast("timestamp").alias("known_at")).withWatermark("known_at", late)
    on = (F.col("entity_id") == F.col("r_entity")) & (F.col("event_time") == F.col("r_time")) & (F.col("known_at") >= F.col("event_at")) & (F.col("known_at") <= F.col("event_at") + F.expr(f"INTERVAL {longest}"))
    return e.join(r, on, "leftOuter").drop("r_entity", "r_time")
