"""Aggregations and reports over prepared tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import round_scaled
from .splits import running_total


def table_stats(df: DataFrame, time: str = "event_time", entity: str = "entity_id", label: str = "is_fraud") -> DataFrame:
    """One row: rows, positives, rate, entities, first and last time."""
    y = F.col(label)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(y).alias("n_fraud"),
        F.coalesce(F.avg(y.cast("double")), F.lit(0.0)).alias("fraud_rate"),
        F.count_distinct(F.col(entity)).alias("n_entities"),
        F.min(time).alias("start"),
        F.max(time).alias("end"),
    )


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def rate_by(df: DataFrame, key: Column, name: str, label: Column) -> DataFrame:
    """Rows, positives and rate in percent of each key."""
    got = df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n"), F.count_if(label).alias("positives"))
    return got.withColumn("rate_pct", 100.0 * F.col("positives") / F.col("n"))


def monthly(df: DataFrame, time: str, label: Column) -> DataFrame:
    return rate_by(df, F.date_trunc("month", F.col(time)).cast("timestamp_ntz"), "month", label)


def hourly(df: DataFrame, time: str, label: Column) -> DataFrame:
    return rate_by(df, F.hour(time), "hour", label)


def zero_runs(months: DataFrame, min_months: int = 3) -> DataFrame:
    """Runs of months without a positive, after the first positive: first_month, last_month, n_months.

    A run counts if at least min_months - 1 times 31 days lie between its first and its last month;
    a month without rows isn't a month without positives, and so breaks nothing.
    Months are few: one window over all of them.
    """
    w = Window.orderBy("month")
    rows = months.withColumn("__seen", F.sum("positives").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__run", F.sum((F.col("positives") > 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.where("__seen > 0 and positives = 0").groupBy("__run").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.count(F.lit(1)).alias("n_months"))
    return runs.where(F.datediff("last_month", "first_month") / 31.0 >= min_months - 1).drop("__run")


def delay_ecdf(df: DataFrame, delay_days: Column, label: Column) -> DataFrame:
    """days, rows (with exactly that delay) and percent of delays up to it, by row rank."""
    per = df.where(label).groupBy(round_scaled(delay_days).alias("days")).agg(F.count(F.lit(1)).alias("n"))
    run = running_total(per, "days", {"cum": "n"}, F.floor("days"))
    total = run.agg(F.max("cum").alias("total"))
    return run.crossJoin(F.broadcast(total)).select("days", "n", (100.0 * F.col("cum") / F.col("total")).alias("pct"))


def seed_summary(scores: DataFrame, group: str, value: str) -> DataFrame:
    """Mean and population deviation over seeds of each group."""
    return scores.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def paired_delta(scores: DataFrame, seed: str, base: str, other: str) -> DataFrame:
    """One row: mean of other - base over seeds, its standard error, and how many seeds are lower."""
    d = F.col(other) - F.col(base)
    return scores.agg(F.count(d).alias("n"), F.avg(d).alias("delta"), (F.stddev_samp(d) / F.sqrt(F.count(d))).alias("se"), F.count_if(d < 0).alias("n_lower"))


def thinned_curve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A drawn curve's real vertices beside a grid that is dense near 0; x rises, from 0 to 1.

    A vertex stays if a grid point lies between it and its neighbour before or after it.
    """
    x, y = np.asarray(x), np.asarray(y)
    if not len(x):
        return x, y
    #: 800 geometric steps from 1e-8 to 0.01, 1,200 even ones from there to 1.
    grid = np.concatenate(([0.0], np.geomspace(1e-8, 1e-2, 800), np.linspace(1e-2, 1.0, 1200)[1:]))
    reached = np.searchsorted(grid, x, "right")  # grid points up to each vertex
    after = np.diff(reached, prepend=0) > 0
    keep = after | np.append(after[1:], reached[-1] < len(grid))
    return x[keep], y[keep]


def markdown_table(header: list[str], rows: list[list[str]]) -> str:
    rule = "|" + "---|" + "---:|" * (len(header) - 1)
    return "\n".join(["| " + " | ".join(header) + " |", rule, *("| " + " | ".join(r) + " |" for r in rows)])


def merge_seed_records(records: list[dict], unchecked=("seeds", "python")) -> dict:
    """One record with all seeds: every other field must agree, and no seed repeat."""
    if not records:
        raise FileNotFoundError("no records to merge")
    base = {k: v for k, v in records[0].items() if k not in unchecked}
    for r in records[1:]:
        if {k: v for k, v in r.items() if k not in unchecked} != base:
            raise ValueError("records differ outside their seeds")
    seeds = sorted((s for r in records for s in r["seeds"]), key=lambda s: s["seed"])
    if len({s["seed"] for s in seeds}) != len(seeds):
        raise ValueError("a seed repeats")
    if len({s.get("device") for s in seeds}) > 1:
        raise ValueError("seeds ran on different devices")
    return {**base, "seeds": seeds}
