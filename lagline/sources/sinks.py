"""Sinks: whole-folder publication, feature tables under contract, cards and small CSVs."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import NULL_LEVEL
from .adapters import assert_no_excluded

KEYS = ("entity_id", "event_time", "reported_at", "is_fraud", "split")
OPTIONAL_KEYS = ("reported_at_slow",)
ARTIFACT = "artifact_"


class FeatureContractError(ValueError):
    pass


def check_names(names) -> None:
    """Each must be a bare file name."""
    for n in names:
        if not n or n in (".", "..") or n != Path(n).name:
            raise ValueError(f"{n!r} isn't a bare file name")


def uri(path: Path | str) -> str:
    """A path as Spark's file systems name it: a local one gets its scheme."""
    text = str(path)
    return text if "://" in text or text.startswith("file:") else f"file://{Path(text).resolve()}"


class _Files:
    """The file system of a path, whatever store it is, through Spark."""

    def __init__(self, spark: SparkSession, at: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(at).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, at: str) -> bool:
        return self._fs.exists(self._path(at))

    def remove(self, at: str) -> None:
        self._fs.delete(self._path(at), True)

    def rename(self, a: str, b: str) -> None:
        if not self._fs.rename(self._path(a), self._path(b)):
            raise OSError(f"{a} couldn't be renamed to {b}")

    def write(self, at: str, text: str) -> None:
        out = self._fs.create(self._path(at), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()


def publish(dest: Path | str, tables: dict[str, DataFrame], card: dict) -> Path | str:
    """Writes <name>.parquet of each table and dataset_card.json beside dest, then swaps the folder in; a failure leaves the old one.

    dest lies in any store that Spark writes to: executors write the tables, and Spark's file system renames.
    """
    check_names(tables)
    at, spark = uri(dest), SparkSession.active()
    files, mark = _Files(spark, at), uuid.uuid4().hex[:12]
    fresh, old = f"{at}.new-{mark}", f"{at}.old-{mark}"
    try:
        for name, df in tables.items():
            df.write.parquet(f"{fresh}/{name}.parquet")
        files.write(f"{fresh}/dataset_card.json", json.dumps(card, indent=2, default=str) + "\n")
        if files.exists(at):
            files.rename(at, old)
        try:
            files.rename(fresh, at)
        except BaseException:
            if files.exists(old) and not files.exists(at):
                files.rename(old, at)
            raise
    finally:
        files.remove(fresh)
        if files.exists(at):
            files.remove(old)
    return dest


def write_json(path: Path, record: dict) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    tmp = path.with_name(f".{path.name}.{os.getpid()}")
    tmp.write_text(json.dumps(record, indent=2, default=str) + "\n")
    tmp.replace(path)


def write_small_csv(df: DataFrame, path: str) -> None:
    """One CSV file of a small aggregate."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in KEYS and c not in OPTIONAL_KEYS]


def artifact_columns(df: DataFrame) -> list[str]:
    return [c for c in feature_columns(df) if c.startswith(ARTIFACT)]


def check_features(df: DataFrame, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """The table as it's to be stored: keys first, numbers as float (infinities refused), all else as text without nulls."""
    unknown = sorted(set(extra_keys) - set(OPTIONAL_KEYS))
    if unknown:
        raise FeatureContractError(f"unknown optional key(s) {unknown}")
    keys = [*KEYS, *extra_keys]
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise FeatureContractError(f"missing key(s) {missing}")
    if len(set(df.columns)) != len(df.columns):
        raise FeatureContractError("a column is there twice")
    names = [c for c in df.columns if c not in keys]
    stray = [c for c in names if c in OPTIONAL_KEYS]
    if stray:
        raise FeatureContractError(f"{stray} must be given as extra keys")
    assert_no_excluded(names)
    numeric = [c for c in names if isinstance(df.schema[c].dataType, T.NumericType | T.BooleanType)]
    inf = [F.count_if(F.abs(F.col(c).cast("double")) == float("inf")).alias(c) for c in numeric]
    bad = [c for c, n in df.agg(*inf).first().asDict().items() if n] if inf else []
    if bad:
        raise FeatureContractError(f"infinities in {bad}")
    out = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).cast("float").alias(c) if c in numeric else F.coalesce(F.col(c).cast("string"), F.lit(NULL_LEVEL)).alias(c) for c in names]
    return df.select(*keys, *out)


def write_features(df: DataFrame, dest: str, extra_keys: tuple[str, ...] = ()) -> None:
    check_features(df, extra_keys).write.mode("overwrite").parquet(dest)
