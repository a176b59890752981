"""Hand-computed histories, ties, brute force, and no look-ahead."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagline.operators.history import History, with_sweeps

T0 = dt.datetime(2020, 3, 1, 12)
H = History("entity_id", "event_time", ("rid",))


def frame(spark, rows):
    """rows: (entity, hours, amount, value)."""
    data = [(i, e, T0 + dt.timedelta(hours=h), float(a), v) for i, (e, h, a, v) in enumerate(rows)]
    return spark.createDataFrame(data, "rid long, entity_id string, event_time timestamp_ntz, amount double, value string")


def column(df, c):
    return [r["x"] for r in df.withColumn("x", c).orderBy("rid").collect()]


def test_windows(spark):
    df = frame(spark, [("a", 0, 1, "x"), ("a", 1, 2, "x"), ("a", 2, 4, "y")])
    assert column(df, H.rolling_count("24h")) == [0, 1, 2]
    assert column(df, H.rolling_sum(F.col("amount"), "24h")) == [0.0, 1.0, 3.0]
    assert column(df, H.rolling_mean(F.col("amount"), "24h")) == [None, 1.0, 1.5]
    assert column(df, H.rolling_zscore(F.col("amount"), "24h"))[:2] == [0.0, 0.0]
    far = frame(spark, [("a", 0, 1, "x"), ("a", 1, 1, "x"), ("a", 49, 1, "x")])
    assert column(far, H.rolling_count("24h")) == [0, 1, 0]
    edge = frame(spark, [("a", 0, 1, "x"), ("a", 24, 1, "x")])
    assert column(edge, H.rolling_count("24h")) == [0, 1]
    with pytest.raises(ValueError):
        H.rolling_count("2h")


def test_prior(spark):
    df = frame(spark, [("a", 0, 10, "x"), ("a", 1, 20, "x"), ("a", 2, 900, "y"), ("a", 3, 5, "z")])
    assert column(df, H.prior_mean(F.col("amount")))[:3] == [0.0, 10.0, 15.0]
    assert column(df, H.prior_max(F.col("amount")))[:3] == [None, 10.0, 20.0]
    got = H.with_prior_distinct(df, d=F.col("value")).orderBy("rid").collect()
    assert [r["d"] for r in got] == [0, 1, 1, 2]
    assert column(df, H.first_occurrence(F.col("value"))) == [1.0, 0.0, 1.0, 1.0]
    assert column(df, H.gap_seconds()) == [None, 3600.0, 3600.0, 3600.0]
    assert column(df, H.gap_since_same(F.col("value"))) == [None, 3600.0, None, None]


def test_ties(spark):
    """Windows leave out the whole instant; row statistics follow rid."""
    df = frame(spark, [("a", 0, 1, "x")] * 3)
    assert column(df, H.rolling_count("24h")) == [0, 0, 0]
    assert column(df, H.rolling_distinct(F.col("value"), "24h")) == [0, 0, 0]
    assert column(df, H.ordinal()) == [0, 1, 2]


def test_null_is_a_value(spark):
    df = frame(spark, [("a", 0, 1, None), ("a", 1, 1, None), ("a", 2, 1, "x"), ("a", 3, 1, "x")])
    assert column(df, H.rolling_distinct(F.col("value"), "24h")) == [0, 1, 1, 2]
    assert column(df, H.first_occurrence(F.col("value"))) == [1.0, 0.0, 1.0, 0.0]


def test_sweeps_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(str(rng.integers(3)), int(rng.integers(0, 200)), 1, None if rng.random() < 0.1 else str(rng.integers(5))) for _ in range(400)]
    df = frame(spark, rows)
    want_n, want_d = [], []
    for e, h, _, _ in rows:
        past = [v for f, g, _, v in rows if f == e and h - 24 <= g < h]
        want_n.append(len(past))
        want_d.append(len({str(v) for v in past}))
    for by_day in (False, True):
        out = with_sweeps(df, H, {"d": (F.col("value"), "24h"), "n": (None, "24h")}, by_day)
        assert out.columns == [*df.columns, "d", "n"]
        got = {r["rid"]: (r["n"], r["d"]) for r in out.collect()}
        assert [got[i] for i in range(len(rows))] == list(zip(want_n, want_d, strict=True))
    assert column(df, H.rolling_count("24h")) == want_n
    assert column(df, H.rolling_distinct(F.col("value"), "24h")) == want_d


def test_no_lookahead(spark):
    rows = [("a", h, h, "x" if h % 3 else "y") for h in range(20)]
    cols = lambda df: df.select("rid", H.rolling_sum(F.col("amount"), "7d").alias("s"), H.prior_mean(F.col("amount")).alias("m"), H.rolling_zscore(F.col("amount"), "7d").alias("z")).orderBy("rid").collect()
    a = cols(frame(spark, rows))
    b = cols(frame(spark, rows[:-1] + [("a", 19, 9999, "q")]))
    assert a[:-1] == b[:-1] and a[-1][:3] == b[-1][:3]  # the last row's own value is in its z-score only
