"""Campaigns: runs of positives of one entity, each within a gap of the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import micros
from .splits import quantiles, range_bucket, running_total


def assign_campaigns(df: DataFrame, gap_us: int, rid: tuple[str, ...], entity: str = "entity_id", time: str = "event_time", label: str = "is_fraud") -> DataFrame:
    """df with campaign_id: dense from 0 in (entity, time) order on positives, null elsewhere.

    A campaign begins where the entity changes or more than the gap has passed. Dense ids
    need one order over all campaigns: a campaign's number is the campaigns of smaller
    entities (running totals by ranges of entities) plus its own place.
    """
    if gap_us < 0:
        raise ValueError("a gap must not be negative")
    us = micros(F.col(time))
    w = Window.partitionBy(entity).orderBy(us, *rid)
    pos = df.where(F.col(label))
    last = F.lag(us).over(w)
    pos = pos.withColumn("__new", (last.isNull() | (us - last > gap_us)).cast("long"))
    pos = pos.withColumn("__n", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = pos.groupBy(entity).agg(F.max("__n").alias("__many"))
    per = running_total(per, entity, {"__upto": "__many"}, range_bucket(per, entity))
    per = per.select(F.col(entity).alias("__e"), (F.col("__upto") - F.col("__many")).alias("__base"))
    pos = pos.join(per, pos[entity].eqNullSafe(per["__e"])).withColumn("campaign_id", (F.col("__base") + F.col("__n") - 1).cast("long"))
    rest = df.where(~F.coalesce(F.col(label), F.lit(False))).withColumn("campaign_id", F.lit(None).cast("long"))
    return pos.select(*df.columns, "campaign_id").unionByName(rest)


def campaign_sizes(df: DataFrame) -> DataFrame:
    return df.where("campaign_id is not null").groupBy("campaign_id").agg(F.count(F.lit(1)).alias("size"))


def campaign_summary(df: DataFrame) -> DataFrame:
    """n_campaigns, largest, median size: one row."""
    per = campaign_sizes(df).groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("size").rowsBetween(Window.unboundedPreceding, 0)  # distinct sizes: few
    run = per.withColumn("cum", F.sum("n").over(w))
    middle = quantiles(run, "size", [0.5])
    got = run.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_campaigns"), F.coalesce(F.max("size"), F.lit(0)).cast("long").alias("largest"))
    return got.crossJoin(F.broadcast(middle)).select("n_campaigns", "largest", F.coalesce("q0", F.lit(0.0)).alias("median_size"))
