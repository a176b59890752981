"""The studies: training tables (splits, censoring, encodings, sequences), boosted trees, batched prediction, and runs over seeds."""

from __future__ import annotations

import platform
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import encoders, metrics, sequences, splits
from ..operators.delay import censored_labels
from ..sources.sinks import ARTIFACT, feature_columns


class ExperimentError(ValueError):
    pass


REGIMES = ("temporal", "windows", "customers")
DELAYS = {"off": None, "on": "reported_at", "slow": "reported_at_slow"}


def _inputs(df: DataFrame, many: int) -> tuple[list[str], list[str]]:
    names = [c for c in feature_columns(df) if not c.startswith(ARTIFACT) and c != "rid"]
    if len(names) != many:
        raise ExperimentError(f"{many} inputs are expected, not {len(names)}")
    text = {c for c, t in df.dtypes if t == "string"}
    return [c for c in names if c not in text], [c for c in names if c in text]


def encode(df: DataFrame, numeric: list[str], categorical: list[str], train) -> DataFrame:
    """df with z_, missing_ and code_ columns, fitted on train rows."""
    out = encoders.standardize(df, numeric, train)
    for c in categorical:
        out = encoders.capped_codes(out, c, encoders.capped_vocabulary(df, c, train=train), f"code_{c}")
    return out


def check_parts(df: DataFrame, label: str = "is_fraud", every: bool = False) -> dict[str, tuple[int, int]]:
    """(rows, positives) of each part; raises if one is empty or an evaluation part has no positive."""
    got = {r["split"]: (r["n"], r["p"]) for r in df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label)).alias("p")).collect()}
    for k in splits.NAMES:
        if k not in got:
            raise ExperimentError(f"part {k!r} has no target rows")
        if (every or k != "train") and not got[k][1]:
            raise ExperimentError(f"part {k!r} has no positive targets")
    return got


def windows_study(df: DataFrame, regime: str, length: int = 10, stride: int = 5, many: int = 77) -> DataFrame:
    """Complete chunks of the study's population: target columns, split, rows (arrays of encoded structs)."""
    if regime not in REGIMES:
        raise ValueError(f"unknown regime {regime!r}")
    df = splits.study_population(df).drop("split")
    ends = sequences.complete_chunks(df, ("rid",), F.col("rid"), length, stride)
    if regime == "temporal":
        source = splits.by_order_statistics(df)
    elif regime == "customers":
        part = splits.by_customer(ends, ratios=splits.STUDY_RATIOS).select(F.col("entity_id").alias("__e"), "split").distinct()
        source = df.join(part, df["entity_id"] == part["__e"], "left").drop("__e")
    else:
        part = splits.by_window(ends, ratios=splits.STUDY_RATIOS).select(F.col("rid").alias("__r"), "split")
        source = df.join(part, df["rid"] == part["__r"], "left").drop("__r")
    train = F.coalesce(F.col("split") == "train", F.lit(False))
    source = encoders.causal_count(source, F.col("artifact_merchant_state"), train, "event_time", ("rid",), "__count").withColumns(encoders.rarity(F.col("__count"), F.col("merchant_is_foreign"))).drop("__count")
    numeric, categorical = _inputs(source, many)
    rows = encode(source, numeric, categorical, train)
    inputs = F.struct("rid", *[f"z_{c}" for c in numeric], *[f"missing_{c}" for c in numeric], *[f"code_{c}" for c in categorical])
    out = sequences.complete_chunks(rows, ("rid",), inputs, length, stride)
    return out.select("rid", "entity_id", "event_time", "is_fraud", "split", "rows")


def delay_study(df: DataFrame, delay: str, length: int = 10, many: int = 46) -> DataFrame:
    """Each transaction with its strictly-past history: split, y_true, y_fit (train labels censored at the train end)."""
    if delay not in DELAYS:
        raise ValueError(f"unknown delay {delay!r}")
    df = splits.by_quantiles(df.drop("split"))
    train = F.col("split") == "train"
    numeric, categorical = _inputs(df, many)
    rows = encode(df, numeric, categorical, train)
    inputs = F.struct("rid", *[f"z_{c}" for c in numeric], *[f"missing_{c}" for c in numeric], *[f"code_{c}" for c in categorical])
    rows = sequences.past_histories(rows, ("rid",), inputs, length)
    y = F.col("is_fraud").cast("int")
    fit = y
    if DELAYS[delay]:
        if DELAYS[delay] not in df.columns:
            raise ExperimentError(f"no column {DELAYS[delay]!r}")
        cut = df.where(train).agg(F.max("event_time").alias("__end"))
        rows = rows.crossJoin(F.broadcast(cut))
        fit = F.when(train, censored_labels(F.col(DELAYS[delay]), F.col("is_fraud"), F.col("__end"))).otherwise(y)
    return rows.select("rid", "entity_id", "event_time", "split", y.alias("y_true"), fit.alias("y_fit"), "history")


#: The tree study's sample seed, its rated columns, and its trees.
SAMPLE_SEED = 1729
RATED = ("artifact_merchant_state", "artifact_merchant_city", "artifact_merchant_name", "artifact_mcc", "artifact_error_type")
TREES = {"trees": 300, "depth": 6, "rate": 0.1, "rows": 0.8, "columns": 0.8}


def tree_matrix(df: DataFrame, train: Column, prefix: str = "x_") -> tuple[DataFrame, list[str]]:
    """df with an input column for every feature, artifacts included: numbers as they are, text as capped codes of train."""
    out, names = df, [c for c in feature_columns(df) if c != "rid"]
    text = {c for c, t in df.dtypes if t == "string"}
    for c in names:
        if c in text:
            out = encoders.capped_codes(out, c, encoders.capped_vocabulary(df, c, train=train), prefix + c)
        else:
            out = out.withColumn(prefix + c, F.col(f"`{c}`").cast("double"))
    return out, [prefix + c for c in names]


def engineered(df: DataFrame, train: Column, rid: tuple[str, ...] = ("rid",), rated: tuple[str, ...] = RATED, state: str = "artifact_merchant_state", time: str = "event_time", label: str = "is_fraud", prefix: str = "x_") -> tuple[DataFrame, list[str]]:
    """df (a stored table: it's read several times) with the rarity of a row's state among all train rows, and the smoothed chronological rate of each rated column."""
    counts = df.where(train).groupBy(encoders.keyed(F.col(state)).alias("__state")).agg(F.count(F.lit(1)).alias("__n"))
    out = df.join(counts, encoders.keyed(F.col(state)) == F.col("__state"), "left").drop("__state")
    rare = encoders.rarity(F.coalesce("__n", F.lit(0)), F.col("merchant_is_foreign"))
    names = dict(zip(("state_train_rarity", "state_unseen_in_train", "foreign_state_rarity"), rare.values(), strict=True))
    out = out.withColumns({prefix + n: c for n, c in names.items()}).drop("__n")
    # Each rate is made from the input, and not from the one before, so the plan grows with their number alone.
    slim = df.select(*rid, time, F.col(label).alias("__label"), train.alias("__train"), *rated)
    for c in rated:
        name = f"{prefix}causal_target_rate_{c}"
        rate = encoders.chronological_rate(slim.select(*rid, time, "__label", "__train", c), c, F.col("__label"), F.col("__train"), time, rid, name)
        out = out.join(rate.select(*rid, name), list(rid))
    return out, [prefix + n for n in names] + [f"{prefix}causal_target_rate_{c}" for c in rated]


def downsampling_study(df: DataFrame, many: int = 90) -> tuple[DataFrame, list[str]]:
    """The tree study's table, from a stored feature table: rid, split, y, sampled (all positives and as many negatives of train), and its inputs."""
    df = splits.by_order_statistics(splits.study_population(df.drop("split")))
    train = F.col("split") == "train"
    out, names = tree_matrix(df, train)
    extra, more = engineered(df, train)
    out = out.join(extra.select("rid", *more), "rid")
    if len(names + more) != many:
        raise ExperimentError(f"{many} inputs are expected, not {len(names + more)}")
    picked = splits.downsample(df.where(train).select("rid", "is_fraud"), "is_fraud", SAMPLE_SEED).select(F.col("rid").alias("__r"), F.lit(True).alias("sampled"))
    out = out.join(picked, out["rid"] == picked["__r"], "left")
    return out.select("rid", "split", F.col("is_fraud").cast("int").alias("y"), F.coalesce("sampled", F.lit(False)).alias("sampled"), *names, *more), names + more


def boosted_trees(train: DataFrame, features: list[str], label: str, trees: int = TREES["trees"], depth: int = TREES["depth"], rate: float = TREES["rate"], rows: float = TREES["rows"], columns: float = TREES["columns"], seed: int = 0, missing: float = -1e9):
    """A fitted gradient-boosted tree model as a function: df -> df with score, the probability of label 1.

    Positives weigh as much as the negatives together. A missing input counts as `missing`, below all others.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    y = F.col(label) == 1
    n = train.agg(F.count_if(y).alias("p"), F.count_if(~y).alias("n")).first()
    if not n["p"] or not n["n"]:
        raise ExperimentError("training rows of both labels are needed")
    x = {f"__x{k}": F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")), F.lit(missing)) for k, c in enumerate(features)}
    model = GBTClassifier(labelCol="__y", featuresCol="__x", weightCol="__w", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=rows, featureSubsetStrategy=str(columns), seed=seed)
    steps = Pipeline(stages=[VectorAssembler(inputCols=list(x), outputCol="__x"), model])
    fitted = steps.fit(train.select(*[c.alias(n) for n, c in x.items()], y.cast("double").alias("__y"), F.when(y, F.lit(n["n"] / n["p"])).otherwise(1.0).alias("__w")))

    def score(df: DataFrame) -> DataFrame:
        out = fitted.transform(df.withColumns(x))
        return out.select(*df.columns, vector_to_array("probability")[1].alias("score"))

    return score


def predict_batches(df: DataFrame, columns: list[str], predict: Callable[[pd.DataFrame], np.ndarray], batch: int = 1024, name: str = "score") -> DataFrame:
    """df with a Python model's scores, predicted for at most `batch` rows at a time in each task."""

    def run(frames):
        for pdf in frames:
            scores = [predict(pdf.iloc[a : a + batch][columns]) for a in range(0, len(pdf), batch)]
            yield pdf.assign(**{name: np.concatenate(scores).astype(float) if scores else np.empty(0)})

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def judged(df: DataFrame, threshold: float, label: str = "y_true", score: str = "score") -> dict[str, float]:
    """average_precision, precision, recall and f1 of a part at a threshold."""
    y = F.col(label) == 1
    return {**metrics.average_precision(df, score, y).first().asDict(), **metrics.scores_at(df, score, y, F.lit(threshold)).first().asDict()}


def run_seeds(table: DataFrame, seeds: tuple[int, ...], fit: Callable[[DataFrame, int], Callable[[DataFrame], DataFrame]], fit_label: str = "y_fit", label: str = "y_true") -> dict:
    """A record of one study over seeds: each fits on train, and scores val and test at the threshold that is best on val.

    fit gets the train rows (with fit_label) and a seed, and returns a function that adds `score`.
    table has split, label and fit_label. Every part must have rows, and val and test positives.
    """
    check_parts(table.withColumn("is_fraud", F.col(label) == 1))
    part = lambda k: table.where(F.col("split") == k)
    records = []
    for seed in seeds:
        began = time.monotonic()
        score = fit(part("train"), seed)
        took = round(time.monotonic() - began, 1)
        scored = {k: score(part(k)).persist(StorageLevel.MEMORY_AND_DISK) for k in ("val", "test")}
        try:
            threshold = metrics.best_f1(scored["val"], "score", F.col(label) == 1).first()["threshold"]
            records.append({"seed": seed, "fit_seconds": took, "threshold": threshold, "scores": {k: judged(df, threshold, label) for k, df in scored.items()}})
        finally:
            for df in scored.values():
                df.unpersist()
    return {"fit_label": fit_label, "seeds": records, "python": platform.python_version()}
