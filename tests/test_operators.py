"""Campaigns, delays, splits, sequences, encoders, metrics and reports: edge cases and golden values."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagline.functions import scalars as S
from lagline.operators import campaigns, delay, encoders, joins, metrics, reports, sequences, splits

DAY = S.DAY_US
T0 = dt.datetime(2020, 1, 1)


def frauds(spark, rows):
    data = [(i, e, T0 + dt.timedelta(days=d), y) for i, (e, d, y) in enumerate(rows)]
    return spark.createDataFrame(data, "rid long, entity_id string, event_time timestamp_ntz, is_fraud boolean")


def ids(df):
    return [r["campaign_id"] for r in df.orderBy("rid").collect()]


def test_campaigns_chain(spark):
    df = frauds(spark, [("a", 0, True), ("a", 5, True), ("a", 10, True), ("a", 11, False), ("b", 0, True), ("a", 18, True)])
    got = campaigns.assign_campaigns(df, 7 * DAY, ("rid",))
    assert ids(got) == [0, 0, 0, None, 2, 1]
    assert ids(campaigns.assign_campaigns(df, 8 * DAY, ("rid",)))[5] == 0
    assert ids(campaigns.assign_campaigns(df.where("not is_fraud"), DAY, ("rid",))) == [None]
    with pytest.raises(ValueError):
        campaigns.assign_campaigns(df, -1, ("rid",))


def test_delay(spark):
    df = campaigns.assign_campaigns(frauds(spark, [("a", 0, True), ("a", 1, True), ("b", 3, True), ("b", 3, False)]), DAY, ("rid",))
    got = [r["reported_at"] for r in delay.assign_reported_at(df, delay.Delay(7.0, 1.0, 0)).orderBy("rid").collect()]
    draw = delay.draw_micros(delay.Delay(7.0, 1.0, 0), 2)
    assert got[0] == got[1] == T0 + dt.timedelta(days=1, microseconds=int(draw[0]))
    assert got[2] == T0 + dt.timedelta(days=3, microseconds=int(draw[1])) and got[3] is None
    assert (delay.draw_micros(delay.Delay(), 5)[:3] == delay.draw_micros(delay.Delay(), 3)).all()
    capped = delay.draw_micros(delay.Delay(15.0, 1.665, 0, 10.0), 1000)
    assert capped.max() == 10 * DAY
    days = delay.draw_micros(delay.Delay(7.0, 1.0), 20_000) / DAY
    assert 6.7 < np.median(days) < 7.3 and days.mean() > np.median(days)
    for bad in ({"sigma": 0}, {"median_days": float("nan")}, {"max_delay_days": -1.0}):
        with pytest.raises(ValueError):
            delay.Delay(**bad)
    none = frauds(spark, [("a", 0, False)])
    assert delay.assign_reported_at(campaigns.assign_campaigns(none, DAY, ("rid",)), delay.Delay()).collect()[0]["reported_at"] is None


def test_censoring_keeps_rows(spark):
    t = lambda d: T0 + dt.timedelta(days=d)
    df = spark.createDataFrame([(True, t(1)), (True, t(9)), (False, None), (True, t(5))], "is_fraud boolean, reported_at timestamp_ntz")
    got = df.select(delay.censored_labels(F.col("reported_at"), F.col("is_fraud"), F.lit(t(5)).cast("timestamp_ntz")).alias("y")).collect()
    assert [r["y"] for r in got] == [1, 0, 0, 1]


def times(spark, values):
    return spark.createDataFrame([(i, T0 + dt.timedelta(hours=h)) for i, h in enumerate(values)], "rid long, event_time timestamp_ntz")


def sizes(df):
    n = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    return [n.get(k, 0) for k in splits.NAMES]


def test_splits(spark):
    df = times(spark, range(100))
    assert sizes(splits.temporal(df)) == [80, 10, 10]
    assert sizes(splits.by_order_statistics(df)) == [68, 16, 16]
    assert sizes(splits.by_position(df, ("rid",))) == [80, 10, 10]
    assert sizes(splits.by_quantiles(df)) == [80, 10, 10]
    tied = times(spark, [0] * 50 + [1] * 50)
    assert sizes(splits.temporal(tied)) == [100, 0, 0]  # an instant is never split
    assert sizes(splits.by_position(tied, ("rid",))) == [80, 10, 10]  # but by position it is
    with pytest.raises(ValueError):
        splits.check_order_statistics(tied.limit(3))
    with pytest.raises(ValueError):
        splits.check_order_statistics(tied)
    assert sizes(splits.by_window(times(spark, range(101)))) == [80, 10, 11]
    with pytest.warns(UserWarning):
        splits.check_split(splits.temporal(tied))
    for bad in ((0.5, 0.5, 0.5), (1.0, 0.0, 0.0)):
        with pytest.raises(ValueError):
            splits.check_ratios(bad)


def test_customers_are_balanced(spark):
    for n in (np.random.default_rng(0).integers(1, 200, 300), np.random.default_rng(1).integers(1, 12, 5000), np.array([1000, 1, 1, 1, 1, 1, 1, 1, 1, 1])):
        sizes_, counts = np.unique(n, return_counts=True)
        part = splits.assign_sizes(sizes_, counts)
        assert (part.sum(axis=1) == counts).all() and (part >= 0).all()
        many = part.sum(axis=0).tolist()
        assert many[:2] == [int(0.8 * len(n)), int(0.1 * len(n))]
        if len(n) > 10:
            assert np.allclose((part * sizes_[:, None]).sum(axis=0) / n.sum(), (0.8, 0.1, 0.1), atol=0.002)
    rows = [(f"c{k}", j) for k in range(60) for j in range(1 + k % 7)]
    df = spark.createDataFrame(rows, "entity_id string, j long")
    got = splits.by_customer(df).collect()
    assert len(got) == len(rows) and got and sorted(got) == sorted(splits.by_customer(df.repartition(5)).collect())
    kinds = {}
    for r in got:
        kinds.setdefault(r["entity_id"], set()).add(r["split"])
    assert all(len(k) == 1 for k in kinds.values())
    assert sorted(list(map(str, kinds.values())).count(str({k})) for k in splits.NAMES) == [6, 6, 48]


def test_quantiles_of_running_counts(spark):
    for values in ([5.0], [1.0, 1.0, 2.0], list(np.random.default_rng(2).integers(0, 30, 101).astype(float))):
        df = spark.createDataFrame([(float(v),) for v in values], "x double").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
        run = splits.running_total(df, "x", {"cum": "n"}, splits.range_bucket(df, "x", 4))
        got = splits.quantiles(run, "x", [0.0, 0.3, 0.5, 1.0]).first()
        assert np.allclose(list(got), np.quantile(values, [0.0, 0.3, 0.5, 1.0]))


def test_running_total_matches_plain(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), int(v)) for k, v in zip(np.unique(rng.integers(0, 10**9, 500)), rng.integers(0, 9, 500), strict=False)]
    got = splits.running_total(spark.createDataFrame(rows, "k long, v long"), "k", {"c": "v"}, F.shiftright("k", 26)).orderBy("k").collect()
    assert [r["c"] for r in got] == np.cumsum([v for _, v in rows]).tolist()


def test_sequences(spark):
    rows = [(i, "a", T0 + dt.timedelta(minutes=i)) for i in range(21)] + [(100 + i, "b", T0) for i in range(9)]
    df = spark.createDataFrame(rows, "rid long, entity_id string, event_time timestamp_ntz")
    got = sequences.complete_chunks(df, ("rid",), F.col("rid"), 10, 5).orderBy("rid").collect()
    assert [r["rid"] for r in got] == [9, 14, 19] and got[1]["rows"] == list(range(5, 15))
    assert sequences.dropped_rows(df, 10, 5).first()[0] == 10
    tie = spark.createDataFrame([(0, "a", T0), (1, "b", T0), (2, "a", T0 - dt.timedelta(1)), (3, "a", T0), (4, "b", T0 + dt.timedelta(1)), (5, "a", T0 + dt.timedelta(1))], df.schema)
    got = {r["rid"]: r["history"] for r in sequences.past_histories(tie, ("rid",), F.col("rid"), 10).collect()}
    assert got == {2: [2], 0: [2, 0], 3: [2, 3], 5: [2, 0, 3, 5], 1: [1], 4: [1, 4]}
    one = sequences.past_histories(tie, ("rid",), F.col("rid"), 1).first()
    assert one["history"] == [one["rid"]]


def test_encoders(spark):
    df = spark.createDataFrame([(v,) for v in ["a"] * 90 + ["b"] * 9 + [None]], "v string")
    got = [(r["level"], r["code"]) for r in encoders.capped_vocabulary(df, "v").orderBy("code").collect()]
    assert got == [("a", 0), ("b", 1)]  # the level that crosses the coverage is kept, later ones aren't
    out = encoders.capped_codes(df, "v", encoders.capped_vocabulary(df, "v"), "c").groupBy("v", "c").count().collect()
    assert {(r["v"], r["c"]) for r in out} == {("a", 0), ("b", 1), (None, 2)}
    t = spark.createDataFrame([(i, T0, "a", b) for i, b in enumerate([True, False, True, False])], "rid long, t timestamp_ntz, v string, train boolean")
    got = encoders.causal_count(t, F.col("v"), F.col("train"), "t", ("rid",), "n").orderBy("rid").collect()
    assert [r["n"] for r in got] == [0, 1, 1, 2]
    z = spark.createDataFrame([(1.0, True), (3.0, True), (None, True), (float("nan"), False), (5.0, False)], "x double, train boolean")
    got = [(r["z_x"], r["missing_x"]) for r in encoders.standardize(z, ["x"], F.col("train")).collect()]
    assert got == [(-1.0, 0), (1.0, 0), (0.0, 1), (0.0, 1), (3.0, 0)]


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.6), (1, 0.6), (1, 0.9)], "y int, s double")
    y = F.col("y") == 1
    got = metrics.scores_at(df, "s", y, F.lit(0.5)).first()
    assert got["precision"] == pytest.approx(2 / 3) and got["recall"] == 1.0 and got["f1"] == pytest.approx(0.8)
    assert metrics.average_precision(df, "s", y).first()[0] == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert metrics.roc_auc(df, "s", y).first()[0] == pytest.approx(0.875)
    assert tuple(metrics.best_f1(df, "s", y).first()) == (0.6, pytest.approx(0.8))
    none = df.withColumn("y", F.lit(0))
    assert metrics.average_precision(none, "s", y).first()[0] is None
    assert metrics.roc_auc(none, "s", y).first()[0] is None
    assert tuple(metrics.best_f1(none, "s", y).first()) == (0.5, 0.0)
    rng = np.random.default_rng(5)
    s, lab = rng.integers(0, 50, 2000) / 10, rng.random(2000) < 0.3
    big = spark.createDataFrame(list(zip(lab.astype(int).tolist(), s.tolist(), strict=True)), "y int, s double")
    pos, neg = s[lab], s[~lab]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert metrics.roc_auc(big, "s", y).first()[0] == pytest.approx(want)


def test_scalars(spark):
    df = spark.createDataFrame([(5499, "$1,234.50", 2.5), (5816, "x", -0.05), (3010, "$-3", 100.0), (0, None, None), (1499, "7", 0.0), (12345, "", 25.0)], "c int, m string, x double")
    got = df.select(S.mcc_group(F.col("c")).alias("g"), S.parse_money(F.col("m")).alias("m"), *[v.alias(k) for k, v in S.amount_shape(F.col("x")).items()]).collect()
    assert [r["g"] for r in got] == [54, 5815, 3000, 0, 1499, 12345]
    assert [r["m"] for r in got] == [1234.5, None, -3.0, None, 7.0, None]
    assert [r["amount_is_refund"] for r in got] == [0, 1, 0, 0, 0, 0]
    assert [r["amount_is_micro"] for r in got] == [0, 1, 0, 0, 0, 0]
    assert got[2]["amount_is_round_100"] == 1 and got[0]["amount_cents"] == 50
    km = df.limit(1).select(S.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("k"), S.haversine_km(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("n")).first()
    assert km["k"] == pytest.approx(np.pi * 6371.0088) and km["n"] is None
    assert df.limit(1).select(S.safe_ratio(F.lit(1), F.lit(0))).first()[0] == 0.0
    lab = spark.createDataFrame([("True",), (" 0 ",), ("1.0",), ("yes",)], "v string").select(S.parse_label(F.col("v")).alias("b")).collect()
    assert [r["b"] for r in lab] == [True, False, True, None]


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, None)], "k int, w string")
    with pytest.raises(joins.JoinContractError):
        joins.attach_unique(a, b, "k", "w", "w")
    with pytest.raises(joins.JoinContractError):
        joins.attach_unique(a, b.union(b), "k", "w", "w")
    assert joins.attach_unique(a.where("k = 1"), b, "k", "w", "w").first()["w"] is None  # matched, and null


def test_reports(spark):
    month = lambda m, p: (dt.datetime(2020, m, 1), p)
    rows = [month(1, 0), month(2, 1), month(3, 0), month(4, 0), month(5, 1), month(7, 0), month(8, 0), month(9, 0)]
    got = reports.zero_runs(spark.createDataFrame(rows, "month timestamp_ntz, positives long")).collect()
    assert [(r["first_month"].month, r["last_month"].month, r["n_months"]) for r in got] == [(7, 9, 3)]
    rec = {"a": 1, "seeds": [{"seed": 0, "device": "x"}], "python": "3"}
    assert len(reports.merge_seed_records([rec, {**rec, "seeds": [{"seed": 1, "device": "x"}], "python": "4"}])["seeds"]) == 2
    for bad in ({**rec}, {**rec, "a": 2}):
        with pytest.raises(ValueError):
            reports.merge_seed_records([rec, bad])
    assert reports.markdown_table(["", "A"], [["x", "1"]]).splitlines()[1] == "|---|---:|"
