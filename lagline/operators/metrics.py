"""Ranking metrics in plain SQL windows over distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .splits import range_bucket, running_total


def score_steps(df: DataFrame, score: str, label: Column) -> DataFrame:
    """(s, n, p, cn, cp): rows and positives of each score, and of all at least as high; scores from high to low.

    Work is by distinct scores, in ranges cut at scores of the smallest hashes, so crowded scores spread too.
    """
    per = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(label.cast("long")).alias("p"))
    per = per.withColumn("__down", -F.col("s"))
    return running_total(per, "__down", {"cn": "n", "cp": "p"}, range_bucket(per, "__down")).drop("__down")


def average_precision(df: DataFrame, score: str, label: Column) -> DataFrame:
    """One row: average_precision, the step sum of precision over recall; null without positives."""
    steps = score_steps(df, score, label)
    return steps.agg(F.try_divide(F.sum(F.col("p") * F.col("cp") / F.col("cn")), F.sum("p").cast("double")).alias("average_precision"))


def scores_at(df: DataFrame, score: str, label: Column, threshold: Column) -> DataFrame:
    """One row: precision, recall, f1 of score >= threshold; 0 where undefined."""
    hit = F.col(score) >= threshold
    got = df.agg(F.count_if(hit & label).alias("tp"), F.count_if(hit).alias("called"), F.count_if(label).alias("pos"))
    z = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return got.select(z(F.col("tp"), F.col("called")).alias("precision"), z(F.col("tp"), F.col("pos")).alias("recall"), z(2 * F.col("tp"), F.col("called") + F.col("pos")).alias("f1"))


def best_f1(df: DataFrame, score: str, label: Column) -> DataFrame:
    """One row: threshold and f1 where F1 is largest, the lowest such threshold; 0.5 and 0 without positives."""
    steps = score_steps(df, score, label)
    total = df.agg(F.count_if(label).alias("__pos"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("cp"), F.col("cn") + F.col("__pos")), F.lit(0.0))
    top = steps.crossJoin(F.broadcast(total)).withColumn("f1", f1).agg(F.max(F.struct("f1", (-F.col("s")).alias("low"), "__pos")).alias("x"))
    some = F.coalesce(F.col("x.__pos"), F.lit(0)) > 0
    return top.select(F.when(some, -F.col("x.low")).otherwise(0.5).alias("threshold"), F.when(some, F.col("x.f1")).otherwise(0.0).alias("f1"))


def roc_auc(df: DataFrame, score: str, label: Column) -> DataFrame:
    """One row: roc_auc, the share of (positive, negative) pairs in order, ties half; null without both."""
    s = score_steps(df, score, label)
    # A score's positives beat all negatives below it, and half of those at it.
    neg, cneg = F.col("n") - F.col("p"), F.col("cn") - F.col("cp")
    got = s.agg(F.sum(neg).alias("neg"), F.sum("p").alias("pos"), F.sum(F.col("p") * cneg.cast("double") - F.col("p") * neg / 2.0).alias("lost"))
    return got.select((1.0 - F.try_divide(F.col("lost"), (F.col("neg") * F.col("pos")).cast("double"))).alias("roc_auc"))
