"""Bounded sequences per entity: complete chunks, and strictly-past histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import micros


def complete_chunks(df: DataFrame, rid: tuple[str, ...], item: Column, length: int = 10, stride: int | None = None, entity: str = "entity_id", time: str = "event_time") -> DataFrame:
    """One row per complete run of `length` rows, every `stride` rows of an entity: its last row's columns and rows (the items).

    The last row is the target. Incomplete tails give nothing: see dropped_rows.
    """
    stride = length if stride is None else stride
    if length < 1 or stride < 1:
        raise ValueError("length and stride must be positive")
    w = Window.partitionBy(entity).orderBy(micros(F.col(time)), *rid)
    k = F.row_number().over(w) - 1
    rows = df.withColumn("__k", k).withColumn("rows", F.collect_list(item).over(w.rowsBetween(-(length - 1), 0)))
    return rows.where((F.col("__k") >= length - 1) & ((F.col("__k") - (length - 1)) % stride == 0)).drop("__k")


def dropped_rows(df: DataFrame, length: int = 10, stride: int | None = None, entity: str = "entity_id") -> DataFrame:
    """One row: n_dropped, the rows that no complete chunk holds."""
    stride = length if stride is None else stride
    n = F.col("n")
    chunks = F.when(n < length, F.lit(0)).otherwise(F.floor((n - length) / stride) + 1)
    held = F.when(chunks == 0, F.lit(0)).otherwise(chunks * F.least(F.lit(stride), F.lit(length)) + F.greatest(F.lit(length - stride), F.lit(0)))
    per = df.groupBy(entity).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum(n - held), F.lit(0)).cast("long").alias("n_dropped"))


def past_histories(df: DataFrame, rid: tuple[str, ...], item: Column, length: int = 10, entity: str = "entity_id", time: str = "event_time") -> DataFrame:
    """df with history: up to length - 1 items strictly before the row's instant, then its own.

    The first row of an instant sees only earlier instants; the other rows of it take its view.
    """
    us = micros(F.col(time))
    w = Window.partitionBy(entity).orderBy(us, *rid)
    if length == 1:
        return df.withColumn("history", F.array(item))
    rows = df.withColumn("__prev", F.collect_list(item).over(w.rowsBetween(-(length - 1), -1)))
    same = Window.partitionBy(entity, us).orderBy(*rid)
    return rows.withColumn("history", F.concat(F.first("__prev").over(same), F.array(item))).drop("__prev")


def padded(history: Column, length: int, pad: Column) -> Column:
    """A history right-padded to length."""
    return F.concat(history, F.array_repeat(pad, F.greatest(F.lit(length) - F.size(history), F.lit(0)).cast("int")))
