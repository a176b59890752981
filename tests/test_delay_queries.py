"""The queries over reporting delays against their SQL, on tables made for it."""

import datetime as dt

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import same

from lagline.operators.delay import draw_micros
from lagline.plans import queries as Q

T0 = dt.datetime(2000, 1, 1)
DAY = dt.timedelta(days=1)
#: A delay of whole microseconds that ends in half a millionth of a day, and whose double lies below that half.
HALF = 5_610_106_526_400


def made(tmp_path, rows):
    """A folder with orders (customer, time, urgent), and DuckDB over it."""
    cust, at, urgent = zip(*rows)
    n = len(rows)
    cols = {"o_orderkey": range(n), "o_custkey": cust, "o_orderstatus": ["O"] * n, "o_totalprice": [1.0] * n, "o_orderdate": pa.array(at, pa.timestamp("us")), "o_orderpriority": ["1-URGENT" if u else "5-LOW" for u in urgent]}
    pq.write_table(pa.table(cols), tmp_path / "orders.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    return str(tmp_path), con


def halved():
    """A campaign of three events: the middle delay is HALF."""
    first = dt.timedelta(microseconds=int(draw_micros(Q.DEFAULT, 1)[0]))
    middle = T0 + first - dt.timedelta(microseconds=HALF)
    return [(1, T0, True), (1, middle, True), (1, middle - DAY, True)]


def test_ecdf_rounds_as_sql(spark, tmp_path):
    d, con = made(tmp_path, halved())
    same(Q.delay_ecdf(spark, d).toPandas(), con.sql(Q.ORACLE["delay_ecdf"]).df())


def hidden():
    """640 positives up to one instant, at which 323 of them are unreported; later rows, so that all quantiles asked for are that instant."""
    early = [(i, T0 - 400 * DAY, True) for i in range(317)]
    return early + [(317 + i, T0, True) for i in range(323)] + [(i, T0 + 9 * DAY, False) for i in range(100)]


def test_share_at_equal_quantiles(spark, tmp_path):
    d, con = made(tmp_path, hidden())
    got = Q.censored_share(spark, d).toPandas()
    assert set(got["known"]) == {640} and set(got["unreported"]) == {323}
    same(got, con.sql(Q.ORACLE["censored_share"]).df())


def test_hidden_share_rounds_as_sql(spark, tmp_path):
    d, con = made(tmp_path, hidden())
    same(Q.censored_train_positives(spark, d).toPandas(), con.sql(Q.ORACLE["censored_train_positives"]).df())


def test_realised_delay_rounds_as_sql(spark, tmp_path):
    d, con = made(tmp_path, halved())
    same(Q.realised_delay(spark, d).toPandas(), con.sql(Q.ORACLE["realised_delay"]).df())


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    """More campaigns than the SQL lists draws for."""
    return made(tmp_path_factory.mktemp("many"), [(i, T0 + (i % 1500) * DAY, i % 8 > 0) for i in range(7_200)])


@pytest.mark.parametrize("name", ["reported_at_default", "reported_at_slow_capped", "censored_labels_at_cutoff", "censored_share", "realised_delay", "censored_train_positives", "delay_ecdf"])
def test_beyond_the_listed_draws(spark, many, name):
    """Every campaign has its delay: the query agrees with its SQL once that lists a draw for each."""
    d, con = many
    sql = Q.ORACLE[name]
    for delay in (Q.DEFAULT, Q.SLOW):
        sql = sql.replace(Q._values(delay), Q._values(delay, 6_300))
    assert sql != Q.ORACLE[name]
    same(Q.QUERIES[name](spark, d).toPandas(), con.sql(sql).df())
