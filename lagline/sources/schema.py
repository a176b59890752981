"""The canonical transaction table and its validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.splits import instants

REQUIRED = {"event_time": T.TimestampNTZType(), "entity_id": T.StringType(), "amount": T.DoubleType(), "is_fraud": T.BooleanType()}
CORE = ("event_time", "entity_id", "amount", "is_fraud", "split", "reported_at")
#: Times that a transaction can have.
EARLIEST, LATEST = "1990-01-01", "2050-01-01"


class SchemaError(ValueError):
    """A table isn't canonical."""


def order_columns(df: DataFrame) -> DataFrame:
    first = [c for c in CORE if c in df.columns]
    return df.select(*first, *[f"`{c}`" for c in df.columns if c not in first])


def violations(df: DataFrame) -> DataFrame:
    """One row of counts: n_rows, null_<column>, out_of_range, reported_on_clean, reported_early. One pass."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in REQUIRED]
    t = F.col("event_time")
    low, high = F.lit(EARLIEST).cast("timestamp_ntz"), F.lit(LATEST).cast("timestamp_ntz")
    aggs.append(F.count_if((t < low) | (t > high)).alias("out_of_range"))
    if "reported_at" in df.columns:
        r = F.col("reported_at")
        aggs.append(F.count_if(r.isNotNull() & ~F.col("is_fraud")).alias("reported_on_clean"))
        aggs.append(F.count_if(r < t).alias("reported_early"))
    return df.agg(*aggs)


def validate(df: DataFrame) -> None:
    """Raises SchemaError unless the table is canonical."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise SchemaError(f"missing column(s) {missing}")
    for c, kind in {**REQUIRED, **({"reported_at": T.TimestampNTZType()} if "reported_at" in df.columns else {})}.items():
        if df.schema[c].dataType != kind:
            raise SchemaError(f"{c} is {df.schema[c].dataType.simpleString()}, not {kind.simpleString()}")
    got = violations(df).first().asDict()
    if not got.pop("n_rows"):
        raise SchemaError("the table is empty")
    bad = {k: n for k, n in got.items() if n}
    if bad:
        raise SchemaError(f"rows that break the schema: {bad}")


def with_rid(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with rid: the row's number in the order of keys (a timestamp first).

    Rows that agree in all keys come in the order of a hash of the whole row, so that numbers don't change from run to
    run; rows that agree in everything are alike, and which of them comes first makes no difference.
    """
    run = instants(df, keys[0]).select(F.col("t").alias("__t"), (F.col("cum") - F.col("n")).alias("__before"))
    row = F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind])
    own = F.row_number().over(Window.partitionBy(keys[0]).orderBy(*keys[1:], row)) - 1
    return df.join(run, df[keys[0]] == run["__t"]).withColumn("rid", (F.col("__before") + own).cast("long")).drop("__t", "__before")
