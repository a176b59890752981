"""Studies: tree inputs, boosted trees, batched prediction, runs over seeds, thinned curves, fitted encoders."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagline.operators import encoders, reports
from lagline.plans import experiment, feature_queries, features

T0 = dt.datetime(2016, 1, 1)


def table(spark, n=400):
    rows = [(i, "train" if i % 10 < 6 else "val" if i % 10 < 8 else "test", float(i % 37), None if i % 11 == 0 else float(i % 5), int((i % 37) > 25)) for i in range(n)]
    return spark.createDataFrame(rows, "rid long, split string, a double, b double, y_true int")


def test_boosted_trees_over_seeds(spark):
    df = table(spark).withColumn("y_fit", F.col("y_true"))
    seen = []

    def fit(train, seed):
        seen.append((seed, train.count()))
        return experiment.boosted_trees(train, ["a", "b"], "y_fit", trees=3, depth=2, seed=seed)

    record = experiment.run_seeds(df, (0, 1), fit)
    assert seen == [(0, 240), (1, 240)] and [r["seed"] for r in record["seeds"]] == [0, 1]
    for r in record["seeds"]:
        assert set(r["scores"]) == {"val", "test"} and r["scores"]["test"]["average_precision"] > 0.95 and r["scores"]["val"]["f1"] > 0.95
    with pytest.raises(experiment.ExperimentError):
        experiment.run_seeds(df.where("split <> 'val'"), (0,), fit)
    with pytest.raises(experiment.ExperimentError):
        experiment.boosted_trees(df.where("y_true = 0"), ["a"], "y_true")


def test_predicted_in_batches(spark):
    def predict(pdf):
        assert 0 < len(pdf) <= 16
        return pdf["a"].to_numpy() * 2

    df = table(spark, 100)
    got = experiment.predict_batches(df, ["a"], predict, batch=16)
    assert got.columns == [*df.columns, "score"] and all(r["score"] == 2 * r["a"] for r in got.collect())
    assert experiment.predict_batches(df.where("rid < 0"), ["a"], predict).count() == 0


def test_tree_study_has_ninety_inputs(spark, sf_dir, tmp_path):
    early = {**feature_queries.IBM, "event_time": "timestamp_ntz '2016-01-01' + (o_orderdate - timestamp_ntz '1992-01-01') / 10"}
    made = features.ibm_ccf(feature_queries.canonical(spark, sf_dir, early).where("rid < 600"))
    made.withColumn("rid", F.monotonically_increasing_id()).write.parquet(f"file://{tmp_path}/f.parquet")
    df = spark.read.parquet(f"file://{tmp_path}/f.parquet")
    out, names = experiment.downsampling_study(df)
    assert len(names) == 90 and names[-5:] == [f"x_causal_target_rate_{c}" for c in experiment.RATED]
    got = {r["split"]: r for r in out.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if("sampled").alias("s"), F.count_if(F.col("sampled") & (F.col("y") == 1)).alias("p")).collect()}
    assert set(got) == {"train", "val", "test"} and got["train"]["s"] == 2 * got["train"]["p"] > 0 and got["val"]["s"] == got["test"]["s"] == 0
    with pytest.raises(experiment.ExperimentError):
        experiment.downsampling_study(df.drop("age"))


def test_train_rarity(spark):
    rows = [(i, T0 + dt.timedelta(hours=i), i % 3 == 0, s, float(s == "IT")) for i, s in enumerate(["NY", "NY", "IT", "NY", None, "XX"])]
    df = spark.createDataFrame(rows, "rid long, event_time timestamp_ntz, is_fraud boolean, artifact_merchant_state string, merchant_is_foreign double")
    out, names = experiment.engineered(df, F.col("rid") < 5, rated=("artifact_merchant_state",))
    got = {r["rid"]: r for r in out.collect()}
    assert got[0][names[0]] == got[3][names[0]] == 1 / math.sqrt(4) and got[2][names[2]] == 1 / math.sqrt(2) and got[0][names[2]] == 0
    assert got[5][names[1]] == 1.0 and got[4][names[1]] == 0.0  # null is a value, seen once
    assert got[0][names[3]] == pytest.approx(1 / 1000) and got[5][names[3]] == pytest.approx(20 * (3 / 1005) / 20)


def test_fitted_encoder(spark):
    train = spark.createDataFrame([("b", 1.0), ("a", 3.0), (None, None), ("a", 5.0)], "c string, x double")
    e = encoders.Encoder(train, ("c",), ("x",))
    assert [r["level"] for r in e.categories("c").orderBy("code").collect()] == ["__null__", "a", "b", "__unseen__"]
    assert e.code_of("c", "b") == 2
    with pytest.raises(KeyError):
        e.code_of("c", "zz")
    new = spark.createDataFrame([("zz", None), (None, 2.0)], "c string, x double")
    assert [tuple(r) for r in e.transform(new).collect()] == [(3, None), (0, 2.0)]
    scaled = encoders.Encoder(train, ("c",), ("x",), scale=True).transform(new).collect()
    codes = np.array([2, 1, 0, 1])
    assert scaled[0]["c"] == pytest.approx((3 - codes.mean()) / codes.std(ddof=1)) and scaled[0]["x"] == 0.0
    assert scaled[1]["x"] == pytest.approx((2 - 3) / 2)
    flat = spark.createDataFrame([("a", 7.0)] * 3, "c string, x double")
    assert [tuple(r) for r in encoders.Encoder(flat, ("c",), ("x",), scale=True).transform(flat).collect()] == [(0.0, 0.0)] * 3


def test_thinned_curve():
    rng = np.random.default_rng(0)
    x = np.concatenate(([0.0], np.sort(rng.random(50_000)), [1.0]))
    y = np.sqrt(x)
    a, b = reports.thinned_curve(x, y)
    assert 1500 < len(a) < 4100 and a[0] == 0 and a[-1] == 1 and set(a) <= set(x) and np.allclose(b, np.sqrt(a))
    grid = np.concatenate((np.geomspace(1e-8, 1e-2, 800), np.linspace(1e-2, 1.0, 1200)))
    for t in grid[::97]:
        k = np.searchsorted(x, t)
        assert x[k] in a and x[max(k - 1, 0)] in a
    few = np.array([0.0, 0.5, 1.0])
    assert (reports.thinned_curve(few, few)[0] == few).all() and len(reports.thinned_curve([], [])[0]) == 0
