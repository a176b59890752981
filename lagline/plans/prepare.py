"""prepare: raw files -> canonical -> split -> campaigns -> delay -> published table and card."""

from __future__ import annotations

from dataclasses import asdict
from datetime import UTC, datetime
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports
from ..operators.campaigns import assign_campaigns, campaign_summary
from ..operators.delay import assign_reported_at, delay_summary
from ..operators.splits import check_split, cuts_by_share, temporal
from ..sources import adapters
from ..sources.config import Config
from ..sources.files import fetch
from ..sources.schema import order_columns, validate
from ..sources.sinks import publish


def drop_source_label(df: DataFrame, adapter: adapters.Adapter) -> tuple[DataFrame, str | None]:
    """df without the raw label, unless that is is_fraud or describes the label."""
    if adapter.label == "is_fraud" or adapter.label in adapter.label_descriptive:
        return df, None
    if adapter.label not in df.columns:
        raise ValueError(f"{adapter.name} names {adapter.label!r} as its label, which its table doesn't have")
    return df.drop(adapter.label), adapter.label




def canonical(spark: SparkSession, name: str, config: Config, raw: Path | None = None) -> tuple[DataFrame, str | None]:
    adapter = adapters.get(name)
    df = adapter.canonical(spark, raw or config.raw / adapter.raw_name, config.options(name))
    return drop_source_label(df, adapter)


def label_delay(df: DataFrame, name: str, config: Config) -> tuple[DataFrame, bool]:
    """df with split, campaign_id and reported_at; whether the split is the source's own."""
    own = adapters.get(name).split(df, config.options(name))
    df = temporal(df, config.ratios) if own is None else own
    df = df.withColumn("__row", F.xxhash64(*[f"`{c}`" for c in df.columns]))
    df = assign_campaigns(df, config.gap_for(name), ("__row",)).drop("__row")
    return assign_reported_at(df, config.delay_for(name)), own is not None


def prepare(spark: SparkSession, name: str, config: Config, *, force: bool = False) -> Path:
    """Fetches, prepares and publishes one dataset in <processed>/<name>."""
    adapter, options = adapters.get(name), config.options(name)
    raw = fetch(adapter.source, config.raw / adapter.raw_name, force=force)
    df, dropped = canonical(spark, name, config, raw)
    validate(df)
    df, own_split = label_delay(df, name, config)
    df = order_columns(df).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        validate(df)
        extra = adapter.auxiliary(spark, raw, options)
        card = describe(df, name, config, own_split, dropped) | {"auxiliary": {k: v.count() for k, v in extra.items()}}
        return publish(config.processed / name, {"data": df.orderBy("event_time", "entity_id"), **extra}, card)
    finally:
        df.unpersist()


def describe(df: DataFrame, name: str, config: Config, own_split: bool, dropped: str | None) -> dict:
    adapter, delay = adapters.get(name), config.delay_for(name)
    stats = reports.table_stats(df).first().asDict()
    sizes, late = campaign_summary(df).first().asDict(), delay_summary(df).first().asDict()
    split = {"strategy": f"supplied by the {name} source" if own_split else "temporal, cut on timestamp values", "counts": check_split(df)}
    if not own_split:
        a, b, _ = config.ratios
        cut = cuts_by_share(df, [a, a + b])
        split |= {"ratios": list(config.ratios), "train_end": cut[0].isoformat(), "val_end": cut[1].isoformat()}
    return {
        "name": name,
        "created_at": datetime.now(UTC).isoformat(),
        "source": {**asdict(adapter.source), "type": type(adapter.source).__name__, "url": adapter.source.url},
        "data_license": adapter.license,
        "commercial_use": adapter.commercial,
        **{k: stats[k] for k in ("n_rows", "n_fraud", "fraud_rate", "n_entities")},
        "time_range": {"start": stats["start"].isoformat(), "end": stats["end"].isoformat()},
        "split": split,
        "label_delay": {**asdict(delay), "distribution": "lognormal", "campaign_gap_us": config.gap_for(name), **sizes, "observed_median_days": late["median_days"], "observed_mean_days": late["mean_days"]},
        "column_mapping": adapter.mapping,
        "dropped_source_label": dropped,
        "label_descriptive_columns": list(adapter.label_descriptive),
        "options": config.options(name),
        "caveats": list(adapter.caveats),
    }
