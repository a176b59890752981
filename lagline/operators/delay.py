"""Reporting delays: one seeded lognormal draw per campaign, added to its last event."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import DAY_US, from_micros, micros
from .splits import quantiles, running_total


@dataclass(frozen=True)
class Delay:
    median_days: float = 7.0
    sigma: float = 1.0
    seed: int = 0
    max_delay_days: float | None = None

    def __post_init__(self):
        for name in ("median_days", "sigma", "max_delay_days"):
            x = getattr(self, name)
            if x is None and name == "max_delay_days":
                continue
            if not (math.isfinite(x) and x > 0):
                raise ValueError(f"{name} must be a positive number, got {x}")


#: Named regimes.
PRESETS = {"card": Delay(7.0, 1.0), "card-slow": Delay(15.0, 1.665, 0, 365.0), "aml": Delay(30.0, 1.0)}


def _micros(delay: Delay, rng: np.random.Generator, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        days = rng.lognormal(math.log(delay.median_days), delay.sigma, n)
    if delay.max_delay_days is not None:
        days = np.minimum(days, delay.max_delay_days)
    if not np.isfinite(days).all() or (days * DAY_US > np.iinfo(np.int64).max).any():
        raise ValueError("a drawn delay doesn't fit a timestamp; lower sigma or set max_delay_days")
    return (days * DAY_US).astype(np.int64)


def draw_micros(delay: Delay, n: int) -> np.ndarray:
    """Delays of campaigns 0 to n - 1, in whole microseconds (truncated)."""
    return _micros(delay, np.random.default_rng(delay.seed), n)


def draws(spark: SparkSession, delay: Delay, n: int) -> DataFrame:
    """(campaign_id, delay_us) of n campaigns; a longer draw extends a shorter one.

    The generator is one stream, so one task draws, a batch at a time; nothing passes through the driver.
    """

    def run(batches):
        rng = np.random.default_rng(delay.seed)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_micros(delay, rng, batch.num_rows))], names=["campaign_id", "delay_us"])

    return spark.range(0, n, 1, 1).mapInArrow(run, "campaign_id bigint, delay_us bigint")


def assign_reported_at(df: DataFrame, delay: Delay, column: str = "reported_at", time: str = "event_time") -> DataFrame:
    """df with the campaign's last event plus its delay; null where there's no campaign.

    The number of campaigns is the one thing fetched; the draw depends on it and the seed. Rows of campaigns
    alone are shuffled.
    """
    top = df.agg(F.max("campaign_id")).first()[0]
    drawn = draws(df.sparkSession, delay, 0 if top is None else top + 1).withColumnRenamed("delay_us", "__delay")
    end = F.max(micros(F.col(time))).over(Window.partitionBy("campaign_id"))
    held = df.where("campaign_id is not null").withColumn("__end", end).join(drawn, "campaign_id")
    held = held.select(*[F.col(f"`{c}`") for c in df.columns], from_micros(F.col("__end") + F.col("__delay")).alias(column))
    return held.unionByName(df.where("campaign_id is null").withColumn(column, F.lit(None).cast("timestamp_ntz")))


def censored_labels(reported: Column, label: Column, cutoff: Column) -> Column:
    """1 for positives reported by the cutoff, else 0; rows are kept."""
    return F.coalesce(label & (reported <= cutoff), F.lit(False)).cast("int")


def delay_summary(df: DataFrame, reported: str = "reported_at", time: str = "event_time", label: str = "is_fraud") -> DataFrame:
    """Median and mean realised delay in days over positives: one row."""
    days = (micros(F.col(reported)) - micros(F.col(time))) / float(DAY_US)
    per = df.where(F.col(label)).select(days.alias("days")).where("days is not null").groupBy("days").agg(F.count(F.lit(1)).alias("n"))
    # Whole days are the buckets: delays are spread over thousands.
    run = running_total(per, "days", {"cum": "n"}, F.floor("days"))
    mean = run.agg((F.sum(F.col("days") * F.col("n")) / F.sum("n")).alias("mean"))
    got = quantiles(run, "days", [0.5]).crossJoin(F.broadcast(mean))
    return got.select(F.coalesce("q0", F.lit(0.0)).alias("median_days"), F.coalesce("mean", F.lit(0.0)).alias("mean_days"))


def censoring(df: DataFrame, cutoffs: DataFrame, reported: str = "reported_at", time: str = "event_time", label: str = "is_fraud") -> DataFrame:
    """For each cutoff (a few rows): positives up to it, those unreported at it, and their share."""
    apart = cutoffs.select("cutoff").distinct()  # equal cutoffs would count a positive several times
    pos = df.where(F.col(label)).join(F.broadcast(apart), F.col(time) <= F.col("cutoff"))
    got = pos.groupBy("cutoff").agg(F.count(F.lit(1)).alias("known"), F.count_if(F.col(reported) > F.col("cutoff")).alias("unreported"))
    out = cutoffs.join(got, "cutoff", "left").na.fill(0, ["known", "unreported"])
    return out.withColumn("share", F.coalesce(F.try_divide("unreported", "known"), F.lit(0.0)))
