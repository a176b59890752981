"""Lookup joins. Small sides are broadcast by Spark's own size check, never by a hint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .splits import range_bucket, running_total


class JoinContractError(ValueError):
    """A side doesn't keep what the join needs of it."""


def lookup(df: DataFrame, side: DataFrame, on: dict[str, str], drop: tuple[str, ...] = ()) -> DataFrame:
    """Left join on df column -> side column; the side's keys that aren't wanted are dropped."""
    s = side.select(*[F.col(f"`{c}`").alias(f"__k_{c}" if c in on.values() else c) for c in side.columns])
    cond = None
    for a, b in on.items():
        c = df[f"`{a}`"] == s[f"`__k_{b}`"]
        cond = c if cond is None else cond & c
    out = df.join(s, cond, "left")
    keep = [b for a, b in on.items() if a != b and b not in drop and b not in df.columns]
    out = out.withColumns({b: F.col(f"`__k_{b}`") for b in keep}) if keep else out
    return out.drop(*[f"__k_{b}" for b in on.values()])


def positional_key(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with its 0-based row number in the order of a file-position column, which must be distinct; ranges of it run on their own."""
    own = running_total(df.select(order, F.lit(1).alias("__one")), order, {"__upto": "__one"}, range_bucket(df, order))
    own = own.select(F.col(order).alias("__at"), (F.col("__upto") - 1).cast("long").alias(name))
    return df.join(own, df[order] == own["__at"]).drop("__at")


def attach_unique(df: DataFrame, side: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """df with side.value; raises unless side's keys are unique and hold every key of df.

    Membership is checked, not nulls: a matched value may be null.
    """
    if side.groupBy(key).count().where("count > 1").limit(1).count():
        raise JoinContractError(f"{key} isn't unique")
    lost = df.join(side.select(key), key, "left_anti").count()
    if lost:
        raise JoinContractError(f"{lost} row(s) have no match on {key}")
    return df.join(side.select(key, F.col(value).alias(name)), key, "left")


def unmatched(df: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """df's rows whose key isn't in side."""
    return df.join(side.select(key).distinct(), key, "left_anti")


def code_or(df: DataFrame, side: DataFrame, key: str, value: str, name: str, default) -> DataFrame:
    """df with the value looked up by key, default where there's none."""
    s = side.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    return df.join(s, df[key].eqNullSafe(s["__k"]), "left").withColumn(name, F.coalesce("__v", F.lit(default))).drop("__k", "__v")


def union_tagged(parts: dict[str, DataFrame], tag: str = "source_file") -> DataFrame:
    """All rows of all parts, with the part's name; columns are matched by name."""
    out = None
    for name, df in parts.items():
        one = df.withColumn(tag, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    return df.dropDuplicates([key])
