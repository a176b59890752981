"""Adds synthetic campaign_id and reported_at columns to any transaction table (Parquet or CSV)."""

from __future__ import annotations

import argparse
import json
import re
import shutil
import sys
from dataclasses import asdict, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..operators.campaigns import assign_campaigns, campaign_summary
from ..operators.splits import instants, quantiles
from ..operators.delay import PRESETS, Delay, assign_reported_at, censoring, delay_summary
from ..sources.config import UNITS, duration_us
from ..sources.files import read_table, read_text_csv


class ToolError(ValueError):
    pass


def parse_regime(spec: str) -> tuple[str, Delay]:
    """'slow:15,1.665,365' as its column's suffix and delay."""
    name, colon, rest = spec.partition(":")
    numbers = rest.split(",")
    if not colon or not re.fullmatch(r"\w+", name) or len(numbers) not in (2, 3):
        raise ToolError(f"regime {spec!r} isn't NAME:MEDIAN,SIGMA[,CAP]")
    try:
        median, sigma, *cap = map(float, numbers)
        return name, Delay(median, sigma, 0, cap[0] if cap else None)
    except ValueError as e:
        raise ToolError(f"regime {spec!r}: {e}") from e


def to_time(df: DataFrame, column: str, origin: str | None, unit: str) -> tuple[Column, bool]:
    """The time column as TIMESTAMP_NTZ in UTC, and whether it carries a time zone."""
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    numeric = isinstance(kind, T.NumericType)
    if isinstance(kind, T.StringType):
        numeric = df.select(F.bool_and(c.rlike(r"^-?\d+(\.\d+)?$")).alias("n")).first()["n"] or False
    if numeric and origin is None:
        raise ToolError(f"{column!r} is numeric: give its origin")
    if not numeric and origin is not None:
        raise ToolError("an origin is for numeric times only")
    if numeric:
        if unit.lower() not in UNITS:
            raise ToolError(f"unknown unit {unit!r}")
        return S.offset_from(origin, c, UNITS[unit.lower()]), False
    if isinstance(kind, T.TimestampNTZType | T.DateType):
        return c.cast("timestamp_ntz"), False
    if isinstance(kind, T.TimestampType):
        return F.to_utc_timestamp(c, F.current_timezone()).cast("timestamp_ntz"), True
    zoned = df.select(F.count_if(c.rlike(r"(Z|[+-]\d\d:?\d\d)$")).alias("z")).first()["z"] > 0
    if zoned:
        return F.to_utc_timestamp(F.to_timestamp(c), F.current_timezone()).cast("timestamp_ntz"), True
    return c.cast("timestamp_ntz"), False


def add_delay(df: DataFrame, entity: str, time: str, fraud: str, regimes: dict[str, Delay], gap_us: int, origin: str | None = None, unit: str = "s") -> tuple[DataFrame, bool]:
    """df with rid, entity_id, event_time, is_fraud, campaign_id and a reported_at column per regime."""
    missing = [c for c in (entity, time, fraud) if c not in df.columns]
    if missing:
        raise ToolError(f"no column(s) {missing}")
    new = ["campaign_id", *regimes]
    clash = [c for c in new if c in df.columns]
    if clash:
        raise ToolError(f"column(s) {clash} are there already")
    at, aware = to_time(df, time, origin, unit)
    canon = df.select("__rid", F.col(f"`{entity}`").cast("string").alias("entity_id"), at.alias("event_time"), S.parse_label(F.col(f"`{fraud}`")).alias("is_fraud"), *[F.col(f"`{c}`").isNull().alias(f"__n{i}") for i, c in enumerate((entity, time, fraud))])
    bad = canon.agg(*[F.count_if(f"__n{i}").alias(c) for i, c in enumerate(("entity", "time", "label"))], F.count_if(F.col("is_fraud").isNull()).alias("unreadable label")).first().asDict()
    if any(bad.values()):
        raise ToolError(f"missing or unreadable values: { {k: v for k, v in bad.items() if v} }")
    canon = assign_campaigns(canon.drop("__n0", "__n1", "__n2"), gap_us, ("__rid",))
    for column, delay in regimes.items():
        canon = assign_reported_at(canon, delay, column)
    return canon, aware


def describe(canon: DataFrame, column: str, delay: Delay, cutoff: str | None) -> dict:
    """Realised delay, and the positives hidden at the cutoff or at time quantiles."""
    spark = canon.sparkSession
    out = {"column": column, **asdict(delay), **delay_summary(canon, column).first().asDict()}
    if cutoff is None:
        q = quantiles(instants(canon, "event_time"), "us", [0.5, 0.7, 0.8]).toDF("p50", "p70", "p80")
        cuts = q.select(F.explode(F.array(*[F.struct(F.lit(n).alias("at"), S.from_micros(F.floor(n).cast("long")).alias("cutoff")) for n in ("p50", "p70", "p80")])).alias("x")).select("x.*")
    else:
        cuts = spark.createDataFrame([("cutoff", cutoff)], "at string, c string").select("at", F.col("c").cast("timestamp_ntz").alias("cutoff"))
    out["censored"] = {r["at"]: {"cutoff": r["cutoff"].isoformat(), "known": r["known"], "unreported": r["unreported"], "share": r["share"]} for r in censoring(canon, cuts, column).collect()}
    return out


def run(spark: SparkSession, source: Path, dest: Path, entity: str, time: str, fraud: str, regimes: dict[str, Delay], gap: str = "1d", cutoff: str | None = None, origin: str | None = None, unit: str = "s") -> dict:
    """Reads source, writes dest and dest.json; CSV to CSV keeps every cell's text."""
    source, dest = Path(source), Path(dest)
    for p in (source, dest):
        if p.suffix.lower() not in (".csv", ".parquet", ".pq"):
            raise ToolError(f"unsupported format {p.suffix!r}")
    if source.resolve() == dest.resolve():
        raise ToolError("the output would overwrite the input")
    csv = lambda p: p.suffix.lower() == ".csv"
    # A file's splits are read in its order, so numbers rise with the place in it, and are the same in each read.
    # A folder's files have no order of their own: those are numbered within one partition.
    whole = source.is_dir()
    numbered = lambda d: (d.coalesce(1) if whole else d).withColumn("__rid", F.monotonically_increasing_id())
    df = numbered(read_table(spark, source, entity, time))
    canon, aware = add_delay(df, entity, time, fraud, regimes, duration_us(gap), origin, unit)
    if cutoff is not None and aware != bool(re.search(r"(Z|[+-]\d\d:?\d\d)$", cutoff)):
        raise ToolError(f"the times {'have' if aware else 'have no'} time zone; the cutoff must match")
    text = csv(source) and csv(dest)
    base = numbered(read_text_csv(spark, source)) if text else df
    out = base.join(canon.select("__rid", "campaign_id", *regimes), "__rid").orderBy("__rid").drop("__rid")
    tmp = dest.with_name(f".{dest.name}.tmp")
    shutil.rmtree(tmp, ignore_errors=True)
    writer = out.coalesce(1).write.mode("overwrite")
    writer.option("header", True).option("escape", '"').option("emptyValue", "").csv(f"file://{tmp.resolve()}") if csv(dest) else writer.parquet(f"file://{tmp.resolve()}")
    next(tmp.glob("part-*")).replace(dest)
    shutil.rmtree(tmp)
    sizes = campaign_summary(canon).first().asDict()
    card = {
        "note": "reported_at is synthetic; it is not observed reporting behaviour",
        "input": str(source),
        "output": str(dest),
        "columns": {"entity": entity, "time": time, "fraud": fraud},
        "campaign_gap": gap,
        "rows": canon.count(),
        "frauds": canon.where("is_fraud").count(),
        **sizes,
        "regimes": [describe(canon, c, d, cutoff) for c, d in regimes.items()],
    }
    dest.with_name(dest.name + ".json").write_text(json.dumps(card, indent=2, default=str) + "\n")
    return card


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("input", type=Path)
    p.add_argument("-o", "--output", type=Path)
    for name in ("--entity", "--time", "--fraud"):
        p.add_argument(name, required=True)
    p.add_argument("--time-origin")
    p.add_argument("--time-unit", default="s")
    p.add_argument("--preset", choices=sorted(PRESETS), default="card")
    for name in ("--median-days", "--sigma", "--max-delay-days"):
        p.add_argument(name, type=float)
    p.add_argument("--regime", action="append", default=[], metavar="NAME:MEDIAN,SIGMA[,CAP]")
    p.add_argument("--campaign-gap", default="1d")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--cutoff")
    a = p.parse_args(argv)
    try:
        over = {k: v for k, v in (("median_days", a.median_days), ("sigma", a.sigma)) if v is not None}
        if a.max_delay_days is not None:
            over["max_delay_days"] = a.max_delay_days or None
        regimes = {"reported_at": replace(PRESETS[a.preset], seed=a.seed, **over)}
        for spec in a.regime:
            name, delay = parse_regime(spec)
            if f"reported_at_{name}" in regimes:
                raise ToolError(f"regime {name!r} is given twice")
            regimes[f"reported_at_{name}"] = replace(delay, seed=a.seed)
        dest = a.output or a.input.with_name(f"{a.input.stem}.label_delay{a.input.suffix}")
        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        card = run(spark, a.input, dest, a.entity, a.time, a.fraud, regimes, a.campaign_gap, a.cutoff, a.time_origin, a.time_unit)
    except (ValueError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(json.dumps({k: card[k] for k in ("rows", "frauds", "n_campaigns", "largest")}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
