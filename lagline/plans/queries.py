"""The registered queries of the engine's own operators, each with its SQL.

Bindings: E events (user_id, ts, value), O orders (o_custkey, o_orderdate, o_totalprice),
L lineitem (l_suppkey to l_partkey, l_shipdate, l_extendedprice), D documents with labels.
Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import campaigns, encoders, joins, metrics, reports, sequences, splits
from ..operators.delay import Delay, assign_reported_at, censored_labels, censoring, delay_summary, draw_micros
from ..operators.history import History, window_us, with_sweeps
from ..sources import sinks
from ..sources.schema import violations, with_rid

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def r6(c: Column) -> Column:
    return F.round(c, 6)


EVENTS = History("user_id", "ts", ("event_id",))
ORDERS = History("o_custkey", "o_orderdate", ("o_orderkey",))
L_RID = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
SENDER = History("l_suppkey", "l_shipdate", L_RID)
RECEIVER = History("l_partkey", "l_shipdate", L_RID)
GAP_DAYS = 180
GAP_US = GAP_DAYS * S.DAY_US


def urgent() -> Column:
    return F.col("o_orderpriority") == "1-URGENT"


def error() -> Column:
    return F.col("event_type") == "error"


def past(window: str, by: str = "user_id", us: str = "epoch_us(ts)") -> str:
    return f"(PARTITION BY {by} ORDER BY {us} RANGE BETWEEN {window_us(window)} PRECEDING AND 1 PRECEDING)"


def events(spark, sf_dir):
    return table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 h trailing count, sum and z-score, and the gap, of each event."""
    x = F.col("value")
    rows = events(spark, sf_dir).withColumn("gap_seconds", EVENTS.gap_seconds())
    return rows.select("event_id", "user_id", r6("gap_seconds").alias("gap_seconds"), EVENTS.rolling_count("24h").alias("n_24h"), r6(EVENTS.rolling_sum(x, "24h")).alias("sum_24h"), r6(EVENTS.rolling_zscore(x, "24h")).alias("z_24h"))


QUERIES["flagship_velocity"] = flagship
_Z = "coalesce(CASE WHEN stddev_samp(value) OVER {w} > 0 THEN (value - avg(value) OVER {w}) / stddev_samp(value) OVER {w} END, 0.0)"
ORACLE["flagship_velocity"] = f"""
SELECT event_id, user_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id)) / 1e6, 6) AS gap_seconds,
  count(*) OVER {past("24h")} AS n_24h, round(coalesce(sum(value) OVER {past("24h")}, 0.0), 6) AS sum_24h, round({_Z.format(w=past("24h"))}, 6) AS z_24h
FROM events"""

# Time windows.


@query("SELECT event_id, " + ", ".join(f"count(*) OVER {past(w)} AS n_{w}" for w in ("1h", "24h", "7d", "30d")) + " FROM events")
def trailing_count_1h_24h_7d_30d(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", *[EVENTS.rolling_count(w).alias(f"n_{w}") for w in ("1h", "24h", "7d", "30d")])


@query("SELECT event_id, " + ", ".join(f"round(coalesce(sum(value) OVER {past(w)}, 0.0), 6) AS sum_{w}, round(avg(value) OVER {past(w)}, 6) AS mean_{w}" for w in ("24h", "7d")) + " FROM events")
def trailing_sum_mean_24h_7d(spark, sf_dir):
    x = F.col("value")
    cols = [c for w in ("24h", "7d") for c in (r6(EVENTS.rolling_sum(x, w)).alias(f"sum_{w}"), r6(EVENTS.rolling_mean(x, w)).alias(f"mean_{w}"))]
    return events(spark, sf_dir).select("event_id", *cols)


@query(f"SELECT event_id, round({_Z.format(w=past('7d'))}, 6) AS z_7d FROM events")
def trailing_zscore_7d(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", r6(EVENTS.rolling_zscore(F.col("value"), "7d")).alias("z_7d"))


_LPAST = past("30d", "l_suppkey", "epoch_us(l_shipdate)")
_LCOLS = ", ".join(L_RID[:5])


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) OVER {_LPAST} AS n_30d FROM lineitem")
def trailing_count_ties(spark, sf_dir):
    """Over an entity whose rows share days."""
    return table(spark, sf_dir, "lineitem", *L_RID[:5]).select(*L_RID[:4], SENDER.rolling_count("30d").alias("n_30d"))


@query(ORACLE["trailing_count_ties"])
def trailing_count_by_day(spark, sf_dir):
    """By the sweep in two levels, days and within them: the form for entities too large for a task."""
    rows = table(spark, sf_dir, "lineitem", *L_RID[:5])
    return with_sweeps(rows, SENDER, {"n_30d": (None, "30d")}, by_day=True).select(*L_RID[:4], "n_30d")


@query(f"SELECT event_id, count(DISTINCT coalesce(event_type, '~na')) OVER {past('7d')} AS d_7d FROM events")
def trailing_distinct_7d(spark, sf_dir):
    rows = events(spark, sf_dir).repartition("user_id")
    return with_sweeps(rows, EVENTS, {"d_7d": (F.col("event_type"), "7d")}).select("event_id", "d_7d")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(DISTINCT l_partkey) OVER {_LPAST} AS d_30d FROM lineitem")
def trailing_distinct_30d_ties(spark, sf_dir):
    """By the sweep: the form for entities of any size."""
    rows = table(spark, sf_dir, "lineitem", *L_RID).repartition("l_suppkey")
    return with_sweeps(rows, SENDER, {"d_30d": (F.col("l_partkey"), "30d")}).select(*L_RID[:4], "d_30d")


# Rows before.

_OW = "PARTITION BY o_custkey ORDER BY epoch_us(o_orderdate), o_orderkey"


@query(
    f"""SELECT o_orderkey, row_number() OVER ({_OW}) - 1 AS ordinal,
  round(coalesce(sum(o_totalprice) OVER ({_OW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / nullif(row_number() OVER ({_OW}) - 1, 0), 0.0), 6) AS prior_mean,
  max(o_totalprice) OVER ({_OW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_max FROM orders"""
)
def entity_ordinal_prior_mean_max(spark, sf_dir):
    x = F.col("o_totalprice")
    return orders(spark, sf_dir).select("o_orderkey", ORDERS.ordinal().alias("ordinal"), r6(ORDERS.prior_mean(x)).alias("prior_mean"), ORDERS.prior_max(x).alias("prior_max"))


@query(
    f"""WITH f AS (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY epoch_us(o_orderdate), o_orderkey) = 1 AS BIGINT) AS f FROM orders)
SELECT o_orderkey, CAST(coalesce(sum(f) OVER ({_OW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior_distinct FROM f"""
)
def prior_distinct(spark, sf_dir):
    return ORDERS.with_prior_distinct(orders(spark, sf_dir), prior_distinct=F.col("o_orderstatus")).select("o_orderkey", "prior_distinct")


_EK = "PARTITION BY user_id, event_type ORDER BY epoch_us(ts), event_id"


@query(f"SELECT event_id, CAST(row_number() OVER ({_EK}) = 1 AS DOUBLE) AS first_type FROM events")
def first_occurrence(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", EVENTS.first_occurrence(F.col("event_type")).alias("first_type"))


@query(f"SELECT event_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER ({_EK})) / 1e6, 6) AS secs FROM events")
def gap_since_same(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", r6(EVENTS.gap_since_same(F.col("event_type"))).alias("secs"))


@query(f"SELECT o_orderkey, (epoch_us(o_orderdate) - lag(epoch_us(o_orderdate)) OVER ({_OW})) / 1e6 AS secs FROM orders")
def gap_seconds(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", ORDERS.gap_seconds().alias("secs"))


@query(
    f"""SELECT event_id, round(coalesce(count(*) OVER {past("1h")} / nullif(count(*) OVER {past("24h")}, 0), 0.0), 6) AS burst_1h_24h,
  round(coalesce(count(*) OVER {past("24h")} / nullif(count(*) OVER {past("7d")}, 0), 0.0), 6) AS burst_24h_7d FROM events"""
)
def burst_ratios(spark, sf_dir):
    n = EVENTS.rolling_count
    return events(spark, sf_dir).select("event_id", r6(S.safe_ratio(n("1h"), n("24h"))).alias("burst_1h_24h"), r6(S.safe_ratio(n("24h"), n("7d"))).alias("burst_24h_7d"))


_RPAST = past("30d", "l_partkey", "epoch_us(l_shipdate)")


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) OVER {_LPAST} AS out_n, count(DISTINCT l_partkey) OVER {_LPAST} AS out_receivers,
  count(*) OVER {_RPAST} AS in_n, round(coalesce(sum(l_extendedprice) OVER {_RPAST}, 0.0), 4) AS in_amount, count(DISTINCT l_suppkey) OVER {_RPAST} AS in_senders,
  CAST(row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY epoch_us(l_shipdate), {", ".join(L_RID)}) = 1 AS DOUBLE) AS first_sender FROM lineitem"""
)
def fan_in_fan_out(spark, sf_dir):
    """Two histories over one table: of the sender and of the receiver."""
    rows = table(spark, sf_dir, "lineitem", *L_RID).repartition("l_suppkey")
    rows = with_sweeps(rows, SENDER, {"out_n": (None, "30d"), "out_receivers": (F.col("l_partkey"), "30d")}).repartition("l_partkey")
    rows = with_sweeps(rows, RECEIVER, {"in_n": (None, "30d"), "in_senders": (F.col("l_suppkey"), "30d")})
    return rows.select(
        *L_RID[:4],
        "out_n",
        "out_receivers",
        "in_n",
        F.round(RECEIVER.rolling_sum(F.col("l_extendedprice"), "30d"), 4).alias("in_amount"),
        "in_senders",
        RECEIVER.first_occurrence(F.col("l_suppkey")).alias("first_sender"),
    )


# Scalars.


@query(
    """SELECT event_id, CAST(hour(ts) AS DOUBLE) AS hour, CAST(minute(ts) AS DOUBLE) AS minute, CAST(isodow(ts) - 1 AS DOUBLE) AS weekday, CAST(day(ts) AS DOUBLE) AS day,
  CAST(month(ts) AS DOUBLE) AS month, CAST(isodow(ts) >= 6 AS DOUBLE) AS is_weekend, round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos FROM events"""
)
def clock_features(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", *[(r6(c) if "_" in n and n != "is_weekend" else c).alias(n) for n, c in S.clock_features(F.col("ts")).items()])


@query(
    """SELECT o_orderkey, x AS amount, round(sign(x) * ln(1 + abs(x)), 6) AS amount_log1p, CAST(x < 0 AS DOUBLE) AS amount_is_refund,
  CAST(CAST(round_even(abs(x) * 100, 0) AS BIGINT) % 100 AS DOUBLE) AS amount_cents, CAST(abs(x) % 10 = 0 AND abs(x) > 0 AS DOUBLE) AS amount_is_round_10,
  CAST(abs(x) % 100 = 0 AND abs(x) > 0 AS DOUBLE) AS amount_is_round_100, CAST(abs(x) > 0 AND abs(x) < 0.10 AS DOUBLE) AS amount_is_micro
FROM (SELECT o_orderkey, o_totalprice AS x FROM orders)"""
)
def amount_shape(spark, sf_dir):
    shape = S.amount_shape(F.col("o_totalprice"))
    return orders(spark, sf_dir).select("o_orderkey", *[(r6(c) if n == "amount_log1p" else c).alias(n) for n, c in shape.items()])


@query("SELECT c_custkey, round(sign(c_acctbal) * ln(1 + abs(c_acctbal)), 6) AS x FROM customer")
def signed_log1p(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", r6(S.signed_log1p(F.col("c_acctbal"))).alias("x"))


@query("SELECT c_custkey, try_cast(regexp_replace('$' || CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR), '[$,]', '', 'g') AS DOUBLE) AS money, try_cast(regexp_replace(c_name, '[$,]', '', 'g') AS DOUBLE) AS no_money FROM customer")
def parse_money(spark, sf_dir):
    text = F.concat(F.lit("$"), F.format_number("c_acctbal", 2))
    return table(spark, sf_dir, "customer").select("c_custkey", S.parse_money(text).alias("money"), S.parse_money(F.col("c_name")).alias("no_money"))


@query(
    """SELECT event_id, round(2 * 6371.0088 * asin(sqrt(least(greatest(pow(sin((p2 - p1) / 2), 2) + cos(p1) * cos(p2) * pow(sin((l2 - l1) / 2), 2), 0.0), 1.0))), 6) AS km
FROM (SELECT event_id, radians(user_id % 180 - 90.0) AS p1, radians(event_id % 360 - 180.0) AS l1, radians(event_id % 170 - 85.0) AS p2, radians(user_id % 350 - 175.0) AS l2 FROM events)"""
)
def haversine(spark, sf_dir):
    u, e = F.col("user_id"), F.col("event_id")
    return events(spark, sf_dir).select("event_id", r6(S.haversine_km(u % 180 - 90.0, e % 360 - 180.0, e % 170 - 85.0, u % 350 - 175.0)).alias("km"))


@query(
    """SELECT DISTINCT c AS code, CAST(CASE WHEN c <= 0 THEN 0 WHEN c BETWEEN 3000 AND 3299 THEN 3000 WHEN c BETWEEN 3300 AND 3499 THEN 3300 WHEN c BETWEEN 3500 AND 3999 THEN 3500
  WHEN c BETWEEN 5815 AND 5818 THEN 5815 WHEN c IN (5169, 5172) THEN 5169 WHEN c IN (5139, 5137) THEN 5139 WHEN c IN (5111, 5044, 5021) THEN 5111
  WHEN c IN (5099, 5085, 5039, 5074) THEN 5099 WHEN c IN (5045, 5065, 5072) THEN 5045 WHEN c IN (5192, 5122, 5094, 5047, 5013, 5051, 5046) THEN c
  WHEN c = 1499 THEN c WHEN c BETWEEN 5700 AND 7999 THEN c // CAST(pow(10, length(CAST(c AS VARCHAR)) - 3) AS BIGINT) ELSE c // CAST(pow(10, length(CAST(c AS VARCHAR)) - 2) AS BIGINT) END AS BIGINT) AS grp
FROM (SELECT (l_orderkey * 7 + l_partkey) % 9990 + 10 AS c FROM lineitem)"""
)
def mcc_group_map(spark, sf_dir):
    code = ((F.col("l_orderkey") * 7 + F.col("l_partkey")) % 9990 + 10).alias("code")
    return table(spark, sf_dir, "lineitem").select(code).distinct().select("code", S.mcc_group(F.col("code")).alias("grp"))


@query("SELECT o_orderkey, CAST(o_orderpriority = '1-URGENT' AS BOOLEAN) AS label, CAST(epoch_us(o_orderdate) AS BIGINT) AS us, datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) * 1.0 AS days FROM orders")
def parse_label_and_time(spark, sf_dir):
    text = F.when(urgent(), F.lit(" True")).otherwise(F.lit("0.0"))
    at = F.col("o_orderdate")
    return orders(spark, sf_dir).select("o_orderkey", S.parse_label(text).alias("label"), S.micros(at).alias("us"), S.days_between(at, F.lit("1992-01-01").cast("timestamp_ntz")).alias("days"))


# Campaigns, delays and censoring.


def canonical_orders(spark, sf_dir) -> DataFrame:
    return orders(spark, sf_dir).select("o_orderkey", F.col("o_orderdate").alias("event_time"), F.lpad(F.col("o_custkey").cast("string"), 12, "0").alias("entity_id"), F.col("o_totalprice").alias("amount"), urgent().alias("is_fraud"))


_CANON = "SELECT o_orderkey, o_orderdate AS event_time, lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS entity_id, o_totalprice AS amount, o_orderpriority = '1-URGENT' AS is_fraud FROM orders"
_CAMP = f"""c AS ({_CANON}), s AS (SELECT *, CASE WHEN lag(event_time) OVER w IS NULL OR epoch_us(event_time) - lag(epoch_us(event_time)) OVER w > {GAP_US} THEN 1 ELSE 0 END AS f
  FROM c WHERE is_fraud WINDOW w AS (PARTITION BY entity_id ORDER BY event_time, o_orderkey)),
k AS (SELECT o_orderkey, CAST(sum(f) OVER (ORDER BY entity_id, event_time, o_orderkey) - 1 AS BIGINT) AS campaign_id FROM s)"""


def order_campaigns(spark, sf_dir) -> DataFrame:
    return campaigns.assign_campaigns(canonical_orders(spark, sf_dir), GAP_US, ("o_orderkey",))


@query(f"WITH {_CAMP} SELECT c.o_orderkey, campaign_id FROM c LEFT JOIN k USING (o_orderkey)")
def campaigns_gap(spark, sf_dir):
    return order_campaigns(spark, sf_dir).select("o_orderkey", "campaign_id")


@query(f"WITH {_CAMP}, z AS (SELECT count(*) AS n FROM k GROUP BY campaign_id) SELECT count(*) AS n_campaigns, CAST(max(n) AS BIGINT) AS largest, CAST(median(n) AS DOUBLE) AS median_size FROM z")
def campaign_sizes(spark, sf_dir):
    return campaigns.campaign_summary(order_campaigns(spark, sf_dir))


DEFAULT, SLOW = Delay(7.0, 1.0), Delay(15.0, 1.665, 0, 365.0)
#: Draws for up to so many campaigns, which the tables up to sf0.01 have; beyond, the SQL has no delay. A shorter draw is a prefix of it.
_DRAWN = 6_000


def _values(delay: Delay, n: int = _DRAWN) -> str:
    return "SELECT unnest(range(0, {n})) AS campaign_id, unnest([{v}]) AS d".format(n=n, v=", ".join(map(str, draw_micros(delay, n).tolist())))


def _reported(delay: Delay) -> str:
    return f"""WITH {_CAMP}, v AS ({_values(delay)}), e AS (SELECT campaign_id, max(epoch_us(event_time)) AS last FROM c JOIN k USING (o_orderkey) GROUP BY 1),
r AS (SELECT c.*, campaign_id, make_timestamp(last + d) AS reported_at FROM c LEFT JOIN k USING (o_orderkey) LEFT JOIN e USING (campaign_id) LEFT JOIN v USING (campaign_id))"""


def reported(spark, sf_dir, delay: Delay) -> DataFrame:
    return assign_reported_at(order_campaigns(spark, sf_dir), delay)


@query(_reported(DEFAULT) + " SELECT o_orderkey, reported_at FROM r")
def reported_at_default(spark, sf_dir):
    return reported(spark, sf_dir, DEFAULT).select("o_orderkey", "reported_at")


@query(_reported(SLOW) + " SELECT o_orderkey, reported_at FROM r")
def reported_at_slow_capped(spark, sf_dir):
    return reported(spark, sf_dir, SLOW).select("o_orderkey", "reported_at")


CUTOFF = "1997-06-30"


@query(_reported(SLOW) + f" SELECT o_orderkey, CAST(coalesce(is_fraud AND reported_at <= TIMESTAMP '{CUTOFF}', false) AS INTEGER) AS label FROM r")
def censored_labels_at_cutoff(spark, sf_dir):
    cut = F.lit(CUTOFF).cast("timestamp_ntz")
    return reported(spark, sf_dir, SLOW).select("o_orderkey", censored_labels(F.col("reported_at"), F.col("is_fraud"), cut).alias("label"))


@query(
    _reported(SLOW)
    + """, t AS (SELECT unnest([0.5, 0.7, 0.8]) AS p, unnest([quantile_cont(epoch_us(event_time), 0.5), quantile_cont(epoch_us(event_time), 0.7), quantile_cont(epoch_us(event_time), 0.8)]) AS c FROM r)
SELECT CAST(p AS DOUBLE) AS p, count(*) FILTER (epoch_us(event_time) <= c) AS known, count(*) FILTER (epoch_us(event_time) <= c AND epoch_us(reported_at) > c) AS unreported,
  round(count(*) FILTER (epoch_us(event_time) <= c AND epoch_us(reported_at) > c) / count(*) FILTER (epoch_us(event_time) <= c), 6) AS share FROM r, t WHERE is_fraud GROUP BY p"""
)
def censored_share(spark, sf_dir):
    """At interpolated time quantiles, as a report without a cutoff has them."""
    rows = reported(spark, sf_dir, SLOW)
    q = splits.quantiles(splits.instants(rows, "event_time"), "us", [0.5, 0.7, 0.8])
    cuts = q.select(F.explode(F.array(*[F.struct(F.lit(p).alias("p"), S.from_micros(F.floor(f"q{i}").cast("long")).alias("cutoff")) for i, p in enumerate((0.5, 0.7, 0.8))])).alias("x")).select("x.*")
    return censoring(rows, cuts).select("p", "known", "unreported", S.round_scaled(F.col("share")).alias("share"))


@query(_reported(DEFAULT) + " SELECT round(median((epoch_us(reported_at) - epoch_us(event_time)) / 86400e6), 6) AS median_days, round(avg((epoch_us(reported_at) - epoch_us(event_time)) / 86400e6), 6) AS mean_days FROM r WHERE is_fraud")
def realised_delay(spark, sf_dir):
    return delay_summary(reported(spark, sf_dir, DEFAULT)).select(*[S.round_scaled(F.col(c)).alias(c) for c in ("median_days", "mean_days")])


@query(
    _reported(SLOW)
    + """, f AS (SELECT event_time, sum(count(*)) OVER (ORDER BY event_time) / sum(count(*)) OVER () AS s FROM r GROUP BY 1), x AS (SELECT min(event_time) AS cut FROM f WHERE s >= 0.8)
SELECT count(*) AS positives, count(*) FILTER (reported_at > cut) AS hidden, round(count(*) FILTER (reported_at > cut) / count(*), 6) AS share FROM r, x WHERE is_fraud AND event_time <= cut"""
)
def censored_train_positives(spark, sf_dir):
    """Split, campaigns, delay and censoring together: train positives hidden at the train end."""
    rows = reported(spark, sf_dir, SLOW)
    (end,) = splits.cuts_by_share(canonical_orders(spark, sf_dir), [0.8])
    cutoff = spark.range(1).select(splits.instant(end).alias("cutoff"))
    return censoring(rows, cutoff).select(F.col("known").alias("positives"), F.col("unreported").alias("hidden"), S.round_scaled(F.col("share")).alias("share"))


# Splits.


def _parts(cond1: str, cond2: str) -> str:
    return f"CASE WHEN {cond1} THEN 'train' WHEN {cond2} THEN 'val' ELSE 'test' END AS split"


_SHARE = "f AS (SELECT {t} AS t, sum(count(*)) OVER (ORDER BY {t}) / sum(count(*)) OVER () AS s FROM {x} GROUP BY 1)"


@query(f"WITH {_SHARE.format(t='ts', x='events')}, x AS (SELECT min(t) FILTER (s >= 0.8) AS a, min(t) FILTER (s >= 0.9) AS b FROM f) SELECT event_id, {_parts('ts <= a', 'ts <= b')} FROM events, x")
def split_temporal_80_10_10(spark, sf_dir):
    return splits.temporal(events(spark, sf_dir), time="ts").select("event_id", "split")


@query(f"WITH x AS (SELECT quantile_cont(epoch_us(ts), 0.8) AS a, quantile_cont(epoch_us(ts), 0.9) AS b FROM events) SELECT event_id, {_parts('epoch_us(ts) < a', 'epoch_us(ts) < b')} FROM events, x")
def split_standard_quantile(spark, sf_dir):
    return splits.by_quantiles(events(spark, sf_dir), time="ts").select("event_id", "split")


@query(f"WITH o AS (SELECT o_orderdate AS t, row_number() OVER (ORDER BY o_orderdate) - 1 AS k, count(*) OVER () AS n FROM orders), x AS (SELECT min(t) FILTER (k = floor(0.68 * n)) AS a, min(t) FILTER (k = floor(0.84 * n)) AS b FROM o) SELECT o_orderkey, {_parts('o_orderdate < a', 'o_orderdate < b')} FROM orders, x")
def split_68_16_16(spark, sf_dir):
    return splits.by_order_statistics(orders(spark, sf_dir), time="o_orderdate").select("o_orderkey", "split")


@query(f"WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders) SELECT o_orderkey, {_parts('k < floor(0.8 * n)', 'k < floor(0.9 * n)')} FROM o")
def split_positional(spark, sf_dir):
    return splits.by_position(orders(spark, sf_dir), ("o_orderkey",), time="o_orderdate").select("o_orderkey", "split")


@query(f"WITH {_SHARE.format(t='o_orderdate', x='''orders WHERE o_orderstatus <> 'F' ''')}, x AS (SELECT min(t) AS a FROM f WHERE s >= 0.9) SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'test' WHEN o_orderdate <= a THEN 'train' ELSE 'val' END AS split FROM orders, x")
def split_preserve_upstream(spark, sf_dir):
    return splits.keep_upstream_test(orders(spark, sf_dir), F.col("o_orderstatus") == "F", time="o_orderdate").select("o_orderkey", "split")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'")
def time_filter(spark, sf_dir):
    return table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").where(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))


# Joins and set operations.


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def lookup_joins_left(spark, sf_dir):
    out = joins.lookup(table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), {"c_nationkey": "n_nationkey"})
    return joins.lookup(out, table(spark, sf_dir, "region"), {"n_regionkey": "r_regionkey"}).select("c_custkey", "n_name", "r_name")


@query("SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS pos, s_name FROM supplier")
def positional_key(spark, sf_dir):
    return joins.positional_key(table(spark, sf_dir, "supplier"), "s_suppkey", "pos").select("pos", "s_name")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def membership_guard(spark, sf_dir):
    side = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return joins.unmatched(orders(spark, sf_dir), side, "o_custkey").select("o_orderkey")


@query("SELECT o_orderkey, c_acctbal AS balance FROM orders JOIN customer ON o_custkey = c_custkey")
def attach_unique_key(spark, sf_dir):
    side = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return joins.attach_unique(orders(spark, sf_dir), side, "o_custkey", "c_acctbal", "balance").select("o_orderkey", "balance")


@query("SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE -1 END AS INTEGER) AS code FROM orders")
def lookup_or_default(spark, sf_dir):
    side = spark.createDataFrame([("O", 0), ("P", 1)], "k string, v int").withColumnRenamed("k", "o_orderstatus")
    return joins.code_or(orders(spark, sf_dir), side, "o_orderstatus", "v", "code", -1).select("o_orderkey", "code")


@query("SELECT o_orderkey, source_file FROM (SELECT o_orderkey, 'early' AS source_file FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' UNION ALL SELECT o_orderkey, 'late' FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01')")
def union_tagged_sources(spark, sf_dir):
    o, cut = orders(spark, sf_dir), F.lit("1995-01-01").cast("timestamp_ntz")
    return joins.union_tagged({"early": o.where(F.col("o_orderdate") < cut), "late": o.where(F.col("o_orderdate") >= cut)}).select("o_orderkey", "source_file")


@query("SELECT DISTINCT o_custkey, o_custkey % 10 AS grp FROM orders")
def one_per_key(spark, sf_dir):
    return joins.one_per_key(orders(spark, sf_dir).select("o_custkey", (F.col("o_custkey") % 10).alias("grp")), "o_custkey")


# Aggregations and reports.


@query("SELECT count(*) AS n_rows, count(*) FILTER (event_type = 'error') AS n_fraud, round(avg(CAST(event_type = 'error' AS INTEGER)), 6) AS fraud_rate, count(DISTINCT user_id) AS n_entities, min(ts) AS \"start\", max(ts) AS \"end\" FROM events")
def dataset_card_stats(spark, sf_dir):
    got = reports.table_stats(events(spark, sf_dir).withColumn("label", error()), "ts", "user_id", "label")
    return got.withColumn("fraud_rate", r6("fraud_rate"))


@query(ORACLE["split_temporal_80_10_10"].replace("SELECT event_id, CASE", "SELECT split, count(*) AS n FROM (SELECT CASE") + ") GROUP BY split")
def split_counts(spark, sf_dir):
    return reports.split_counts(splits.temporal(events(spark, sf_dir), time="ts"))


@query("SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS positives, round(100.0 * count(*) FILTER (o_orderpriority = '1-URGENT') / count(*), 6) AS rate_pct FROM orders GROUP BY 1")
def monthly_rate(spark, sf_dir):
    return reports.monthly(orders(spark, sf_dir), "o_orderdate", urgent()).withColumn("rate_pct", r6("rate_pct"))


@query("SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n, count(*) FILTER (event_type = 'error') AS positives, round(100.0 * count(*) FILTER (event_type = 'error') / count(*), 6) AS rate_pct FROM events GROUP BY 1")
def hourly_rate(spark, sf_dir):
    return reports.hourly(events(spark, sf_dir), "ts", error()).withColumn("rate_pct", r6("rate_pct"))


@query("SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS positives, round(100.0 * count(*) FILTER (o_orderpriority = '1-URGENT') / count(*), 6) AS rate_pct FROM orders GROUP BY 1 ORDER BY rate_pct DESC, status")
def category_rate(spark, sf_dir):
    return reports.rate_by(orders(spark, sf_dir), F.col("o_orderstatus"), "status", urgent()).withColumn("rate_pct", r6("rate_pct")).orderBy(F.desc("rate_pct"), "status")


@query(_reported(DEFAULT) + """, g AS (SELECT round((epoch_us(reported_at) - epoch_us(event_time)) / 86400e6, 6) AS days, count(*) AS n FROM r WHERE is_fraud GROUP BY 1)
SELECT days, n, round(100.0 * sum(n) OVER (ORDER BY days) / sum(n) OVER (), 6) AS pct FROM g""")
def delay_ecdf(spark, sf_dir):
    days = (S.micros(F.col("reported_at")) - S.micros(F.col("event_time"))) / float(S.DAY_US)
    return reports.delay_ecdf(reported(spark, sf_dir, DEFAULT), days, F.col("is_fraud")).withColumn("pct", S.round_scaled(F.col("pct")))


_RARE = "o_totalprice > 400000 AND month(o_orderdate) IN (2, 9)"


@query(
    f"""WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, count(*) FILTER ({_RARE}) AS p FROM orders GROUP BY 1),
r AS (SELECT month, p, sum(p) OVER w AS seen, sum(CAST(p > 0 AS INTEGER)) OVER w AS run FROM m WINDOW w AS (ORDER BY month))
SELECT CAST(min(month) AS TIMESTAMP) AS first_month, CAST(max(month) AS TIMESTAMP) AS last_month, count(*) AS n_months FROM r WHERE seen > 0 AND p = 0 GROUP BY run HAVING datediff('day', min(month), max(month)) / 31.0 >= 2"""
)
def zero_runs(spark, sf_dir):
    rare = (F.col("o_totalprice") > 400_000) & F.month("o_orderdate").isin(2, 9)
    return reports.zero_runs(reports.monthly(orders(spark, sf_dir), "o_orderdate", rare))


@query("SELECT event_type AS grp, count(*) AS n, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS sd FROM (SELECT event_type, user_id % 10 AS seed, avg(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1")
def seed_summary(spark, sf_dir):
    per = events(spark, sf_dir).groupBy(F.col("event_type").alias("grp"), (F.col("user_id") % 10).alias("seed")).agg(F.avg("value").alias("m"))
    return reports.seed_summary(per, "grp", "m").select("grp", "n", r6("mean").alias("mean"), r6("sd").alias("sd"))


@query(
    """WITH p AS (SELECT user_id % 10 AS seed, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'error') AS b FROM events GROUP BY 1)
SELECT count(b - a) AS n, round(avg(b - a), 6) AS delta, round(stddev_samp(b - a) / sqrt(count(b - a)), 6) AS se, count(*) FILTER (b - a < 0) AS n_lower FROM p"""
)
def paired_delta(spark, sf_dir):
    per = events(spark, sf_dir).groupBy((F.col("user_id") % 10).alias("seed")).agg(F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("a"), F.avg(F.when(error(), F.col("value"))).alias("b"))
    return reports.paired_delta(per, "seed", "a", "b").select("n", r6("delta").alias("delta"), r6("se").alias("se"), "n_lower")


# Encoders and chronological encodings.

_TRAIN = "ts <= (SELECT min(t) FROM f WHERE s >= 0.8)"
_WITHF = "WITH " + _SHARE.format(t="ts", x="events")


def train_events(spark, sf_dir) -> DataFrame:
    return splits.temporal(events(spark, sf_dir), time="ts").withColumn("train", F.col("split") == "train")


@query(
    f"""{_WITHF}, t AS (SELECT *, {_TRAIN} AS train FROM events),
k AS (SELECT event_id, CAST(coalesce(sum(CAST(train AS INTEGER)) OVER (PARTITION BY event_type ORDER BY epoch_us(ts), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n FROM t)
SELECT event_id, n, round(1.0 / sqrt(n + 1.0), 6) AS rarity, CAST(n = 0 AS DOUBLE) AS unseen FROM k"""
)
def causal_count_rarity(spark, sf_dir):
    rows = encoders.causal_count(train_events(spark, sf_dir), F.col("event_type"), F.col("train"), "ts", ("event_id",), "n")
    r = encoders.rarity(F.col("n"), F.lit(0.0))
    return rows.select("event_id", "n", r6(r["rarity"]).alias("rarity"), r["unseen"].alias("unseen"))


_CASE = "(CASE WHEN train THEN CAST(event_type = 'error' AS BIGINT) ELSE 0 END)"


@query(
    f"""{_WITHF}, t AS (SELECT *, {_TRAIN} AS train, user_id % 7 AS k FROM events), y AS (SELECT *, {_CASE} AS y, CAST(train AS BIGINT) AS w FROM t),
z AS (SELECT *, coalesce(sum(y) OVER g, 0) AS gy, coalesce(sum(w) OVER g, 0) AS gw, coalesce(sum(y) OVER c, 0) AS cy, coalesce(sum(w) OVER c, 0) AS cw,
  sum(y) OVER () AS ay, sum(w) OVER () AS aw, sum(y) OVER (PARTITION BY k) AS ty, sum(w) OVER (PARTITION BY k) AS tw FROM y
  WINDOW g AS (ORDER BY epoch_us(ts), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), c AS (PARTITION BY k ORDER BY epoch_us(ts), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, round(CASE WHEN train THEN (cy + 20 * ((gy + 1) / (gw + 1000))) / (cw + 20) ELSE (ty + 20 * ((ay + 1) / (aw + 1000))) / (tw + 20) END, 6) AS rate FROM z"""
)
def target_rate_chronological(spark, sf_dir):
    rows = train_events(spark, sf_dir).withColumn("k", F.col("user_id") % 7)
    return encoders.chronological_rate(rows, "k", error(), F.col("train"), "ts", ("event_id",), "rate").select("event_id", r6("rate").alias("rate"))


@query(
    """WITH c AS (SELECT coalesce(source, '~na') AS level, count(*) AS n FROM documents GROUP BY 1), o AS (SELECT level, n, row_number() OVER w - 1 AS code,
  coalesce(sum(n / (SELECT sum(n) FROM c)) OVER (ORDER BY n DESC, level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c WINDOW w AS (ORDER BY n DESC, level))
SELECT level, n, CAST(code AS INTEGER) AS code FROM o WHERE before < 0.9 AND code < 256"""
)
def capped_vocabulary(spark, sf_dir):
    return encoders.capped_vocabulary(table(spark, sf_dir, "documents", "source"), "source", coverage=0.9)


@query(
    """WITH c AS (SELECT coalesce(source, '~na') AS level, count(*) AS n FROM documents GROUP BY 1), o AS (SELECT level, n, row_number() OVER (ORDER BY n DESC, level) - 1 AS code,
  coalesce(sum(n / (SELECT sum(n) FROM c)) OVER (ORDER BY n DESC, level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c), v AS (SELECT * FROM o WHERE before < 0.9 AND code < 256)
SELECT doc_id, CAST(coalesce(code, (SELECT count(*) FROM v)) AS INTEGER) AS code FROM documents LEFT JOIN v ON coalesce(source, '~na') = level"""
)
def capped_codes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "source")
    return encoders.capped_codes(docs, "source", encoders.capped_vocabulary(docs, "source", coverage=0.9), "code").select("doc_id", "code")


@query(
    f"""{_WITHF}, v AS (SELECT level, row_number() OVER (ORDER BY level) - 1 AS code FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS level FROM events WHERE {_TRAIN}))
SELECT event_id, CAST(coalesce(code, (SELECT count(*) FROM v)) AS INTEGER) AS code FROM events LEFT JOIN v ON CAST(user_id AS VARCHAR) = level"""
)
def ordinal_encode(spark, sf_dir):
    rows = train_events(spark, sf_dir)
    vocabulary = encoders.sorted_vocabulary(rows, "user_id", F.col("train"))
    return encoders.ordinal_codes(rows, "user_id", vocabulary, "code").select("event_id", "code")


@query(f"{_WITHF}, m AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events WHERE {_TRAIN}) SELECT event_id, round((value - m) / s, 6) AS z_value, CAST(value IS NULL AS INTEGER) AS missing_value FROM events, m")
def standardize_train_only(spark, sf_dir):
    out = encoders.standardize(train_events(spark, sf_dir), ["value"], F.col("train"))
    return out.select("event_id", r6("z_value").alias("z_value"), "missing_value")


# Sequences.


@query(
    """WITH k AS (SELECT event_id, row_number() OVER w - 1 AS k, list(event_id) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS l FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts), event_id))
SELECT event_id, array_to_string(l, ',') AS chunk FROM k WHERE k >= 9 AND (k - 9) % 5 = 0"""
)
def complete_chunks_len10_stride5(spark, sf_dir):
    out = sequences.complete_chunks(events(spark, sf_dir), ("event_id",), F.col("event_id"), 10, 5, "user_id", "ts")
    return out.select("event_id", F.array_join(F.col("rows").cast("array<string>"), ",").alias("chunk"))


@query("WITH n AS (SELECT count(*) AS n FROM events GROUP BY user_id) SELECT CAST(sum(CASE WHEN n < 10 THEN n ELSE (n - 10) % 5 END) AS BIGINT) AS n_dropped FROM n")
def chunk_rows_dropped(spark, sf_dir):
    return sequences.dropped_rows(events(spark, sf_dir), 10, 5, "user_id")


@query(
    f"""SELECT a.o_orderkey, array_to_string(list_concat(coalesce((SELECT list(x ORDER BY t, x) FROM (SELECT o_orderkey AS x, o_orderdate AS t FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderdate < a.o_orderdate ORDER BY t DESC, x DESC LIMIT 9)), []), [a.o_orderkey]), ',') AS history FROM orders a"""
)
def strict_past_history_len10(spark, sf_dir):
    out = sequences.past_histories(orders(spark, sf_dir), ("o_orderkey",), F.col("o_orderkey"), 10, "o_custkey", "o_orderdate")
    return out.select("o_orderkey", F.array_join(F.col("history").cast("array<string>"), ",").alias("history"))


# Seeded draws: ranks of md5 over the seed and the key. The balance by customers is a search, which no SQL repeats.


def _drawn(seed: int, key: str, frm: str) -> str:
    return f"(SELECT *, row_number() OVER (ORDER BY md5('{seed}-' || {key}), {key}) - 1 AS k, count(*) OVER () AS n FROM {frm})"


@query(f"SELECT o_orderkey, {_parts('k < floor(0.8 * n)', 'k < floor(0.8 * n) + floor(0.1 * n)')} FROM {_drawn(splits.SPLIT_SEED, 'o_orderkey', 'orders')}")
def iid_window_split(spark, sf_dir):
    return splits.by_window(orders(spark, sf_dir), keys=("o_orderkey",)).select("o_orderkey", "split")


@query()
def iid_customer_split(spark, sf_dir):
    return splits.by_customer(orders(spark, sf_dir), entity="o_custkey").select("o_orderkey", "o_custkey", "split")


@query(
    f"""SELECT o_orderkey, true AS label FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey, false
FROM {_drawn(1729, 'o_orderkey', "(SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT')")} WHERE k < (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT')"""
)
def downsample_1to1(spark, sf_dir):
    return splits.downsample(orders(spark, sf_dir).withColumn("label", urgent()), "label", keys=("o_orderkey",)).select("o_orderkey", "label")


# Metrics.


def scored(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select((F.col("n_chars") / 1000).alias("s"), (F.col("quality") == 1).alias("y"))


_SCORED = "x AS (SELECT n_chars / 1000 AS s, quality = 1 AS y FROM documents JOIN labels USING (doc_id))"
_STEPS = f"{_SCORED}, g AS (SELECT s, count(*) AS n, count(*) FILTER (y) AS p FROM x GROUP BY s), c AS (SELECT *, sum(n) OVER (ORDER BY s DESC) AS cn, sum(p) OVER (ORDER BY s DESC) AS cp FROM g)"


@query(f"WITH {_STEPS} SELECT round(sum(p * cp / cn) / sum(p), 6) AS average_precision FROM c")
def average_precision(spark, sf_dir):
    return metrics.average_precision(scored(spark, sf_dir), "s", F.col("y")).select(r6("average_precision").alias("average_precision"))


@query(f"WITH {_SCORED}, k AS (SELECT count(*) FILTER (y AND s >= 1) AS tp, count(*) FILTER (s >= 1) AS c, count(*) FILTER (y) AS p FROM x) SELECT round(tp / c, 6) AS \"precision\", round(tp / p, 6) AS recall, round(2 * tp / (c + p), 6) AS f1 FROM k")
def score_at_threshold(spark, sf_dir):
    return metrics.scores_at(scored(spark, sf_dir), "s", F.col("y"), F.lit(1.0)).select(*[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {_STEPS}, f AS (SELECT s, 2.0 * cp / (cn + (SELECT sum(p) FROM g)) AS f1 FROM c) SELECT s AS threshold, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, s LIMIT 1")
def best_f1_threshold(spark, sf_dir):
    return metrics.best_f1(scored(spark, sf_dir), "s", F.col("y")).select("threshold", r6("f1").alias("f1"))


@query(f"WITH {_STEPS} SELECT round(1.0 - sum(p * (cn - cp) - p * (n - p) / 2.0) / (sum(p) * sum(n - p)), 6) AS roc_auc FROM c")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(scored(spark, sf_dir), "s", F.col("y")).select(r6("roc_auc").alias("roc_auc"))


# Validation.


@query(
    """SELECT count(*) AS n_rows, count(*) FILTER (ts IS NULL) AS null_event_time, count(*) FILTER (u IS NULL) AS null_entity_id, count(*) FILTER (value IS NULL) AS null_amount,
  CAST(0 AS BIGINT) AS null_is_fraud, CAST(0 AS BIGINT) AS out_of_range FROM (SELECT *, CASE WHEN user_id % 13 <> 0 THEN user_id END AS u FROM events)"""
)
def validate_canonical_violations(spark, sf_dir):
    u = F.when(F.col("user_id") % 13 != 0, F.col("user_id").cast("string"))
    return violations(events(spark, sf_dir).select(F.col("ts").alias("event_time"), u.alias("entity_id"), F.col("value").alias("amount"), error().alias("is_fraud")))


@query("SELECT o_orderdate AS event_time, CAST(o_custkey AS VARCHAR) AS entity_id, o_totalprice AS amount, o_orderpriority = '1-URGENT' AS is_fraud, o_orderstatus, o_orderkey FROM orders")
def canonical_projection(spark, sf_dir):
    from ..sources.adapters import core

    o = orders(spark, sf_dir)
    return core(o, F.col("o_orderdate"), F.col("o_custkey"), F.col("o_totalprice"), urgent()).drop("o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")


# Scalars and projections of the raw files.


@query(
    """SELECT o_orderkey, CAST(replace('$' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '$', '') AS DOUBLE) AS money, trim(CAST(chr(39) || o_orderstatus || chr(39) AS VARCHAR), chr(39)) AS bare,
  strptime(CAST(1990 + o_orderkey % 9 AS VARCHAR) || '-' || CAST(o_orderkey % 12 + 1 AS VARCHAR) || '-' || CAST(o_orderkey % 28 + 1 AS VARCHAR) || ' ' || CAST(o_orderkey % 24 AS VARCHAR) || ':05', '%Y-%m-%d %H:%M') AS at,
  TIMESTAMP '2023-01-01' + INTERVAL 1 HOUR * (o_orderkey % 1000) AS later FROM orders"""
)
def raw_text_scalars(spark, sf_dir):
    k = F.col("o_orderkey")
    money = F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    quoted = F.concat(F.lit("'"), F.col("o_orderstatus"), F.lit("'"))
    at = S.assemble_minute(1990 + k % 9, k % 12 + 1, k % 28 + 1, F.concat((k % 24).cast("string"), F.lit(":05")))
    return orders(spark, sf_dir).select("o_orderkey", S.parse_money_strict(money).alias("money"), S.strip_quotes(quoted).alias("bare"), at.alias("at"), S.offset_from("2023-01-01", k % 1000, 3_600_000_000).alias("later"))


@query(
    """SELECT event_id, CASE WHEN a IS NULL OR d IS NULL THEN 'txn_' || CAST(event_id AS VARCHAR) ELSE CAST(user_id AS VARCHAR) || '_' || CAST(a AS VARCHAR) || '.0_' || CAST(CAST(round_even(s / 86400.0 - d, 0) AS BIGINT) AS VARCHAR) || '.0' END AS uid
FROM (SELECT event_id, user_id, CASE WHEN user_id % 7 > 0 THEN user_id % 300 END AS a, CASE WHEN event_id % 5 > 0 THEN event_id % 40 + 100 END AS d, event_id * 50 % 5000000 AS s FROM events)"""
)
def account_uid(spark, sf_dir):
    u, e = F.col("user_id"), F.col("event_id")
    address, age = F.when(u % 7 > 0, u % 300).cast("double"), F.when(e % 5 > 0, e % 40 + 100).cast("double")
    return events(spark, sf_dir).select("event_id", S.account_uid(u, address, e * 50 % 5_000_000, age, e).alias("uid"))


@query(
    """SELECT o_orderkey, CAST(coalesce(length(st) <> 2, false) AS DOUBLE) AS foreign_state, CAST(coalesce(st = st2, false) AS DOUBLE) AS same_state, my AS opened, round((year(o_orderdate) - 1990) * 365.25, 6) AS pin_days,
  CAST(coalesce(o_totalprice >= 9000 AND o_totalprice < 100000, false) AS DOUBLE) AS inside, st || '->' || o_orderstatus AS pair
FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'NY' WHEN 1 THEN 'Italy' END AS st, CASE WHEN o_orderkey % 2 = 0 THEN 'NY' END AS st2,
  CASE WHEN o_orderkey % 15 BETWEEN 1 AND 12 THEN make_timestamp(2001, o_orderkey % 15, 1, 0, 0, 0) END AS my FROM orders)"""
)
def context_scalars(spark, sf_dir):
    k = F.col("o_orderkey")
    state = F.when(k % 3 == 0, F.lit("NY")).when(k % 3 == 1, F.lit("Italy"))
    opened = S.month_year(F.concat(F.lpad((k % 15).cast("string"), 2, "0"), F.lit("/2001")))
    years = S.years_apart_days(F.col("o_orderdate"), F.lit(1990))
    return orders(spark, sf_dir).select(
        "o_orderkey", S.is_foreign(state).alias("foreign_state"), S.same(state, F.when(k % 2 == 0, F.lit("NY"))).alias("same_state"), opened.alias("opened"), r6(years).alias("pin_days"), S.in_range(F.col("o_totalprice"), 9000, 100_000).alias("inside"), S.pair_key(state, F.col("o_orderstatus")).alias("pair")
    )


def _feature_table(spark, sf_dir) -> DataFrame:
    o = orders(spark, sf_dir)
    t = F.col("o_orderdate")
    return o.select(F.col("o_custkey").cast("string").alias("entity_id"), t.alias("event_time"), F.when(urgent(), t).alias("reported_at"), urgent().alias("is_fraud"), F.lit("train").alias("split"), F.col("o_totalprice").alias("price"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).alias("status"), F.col("o_orderkey").alias("artifact_key"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS entity_id, o_orderdate AS event_time, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate END AS reported_at, o_orderpriority = '1-URGENT' AS is_fraud, 'train' AS split, CAST(o_totalprice AS FLOAT) AS price, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus ELSE '~na' END AS status, CAST(o_orderkey AS FLOAT) AS artifact_key FROM orders")
def feature_contract(spark, sf_dir):
    """A feature table as it's stored: keys first, numbers as float, text without nulls."""
    return sinks.check_features(_feature_table(spark, sf_dir))


@query("SELECT unnest(['artifact_key', 'price', 'status']) AS feature, unnest([true, false, false]) AS artifact")
def feature_and_artifact_columns(spark, sf_dir):
    df = _feature_table(spark, sf_dir)
    made = [(c, c in sinks.artifact_columns(df)) for c in sinks.feature_columns(df)]
    return spark.createDataFrame(made, "feature string, artifact boolean")


@query("SELECT event_id, user_id % 3 AS grp FROM events ORDER BY ts, event_id")
def stable_time_order(spark, sf_dir):
    """Rows in time order by an explicit number, as a sink writes them."""
    rows = with_rid(events(spark, sf_dir), ["ts", "event_id"])
    return rows.orderBy("rid").select("event_id", (F.col("user_id") % 3).alias("grp"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS rid FROM events")
def row_numbers(spark, sf_dir):
    return with_rid(events(spark, sf_dir), ["ts", "event_id"]).select("event_id", "rid")


# Fitted encoder, tree matrix, runs over seeds.


@query(
    """WITH v AS (SELECT level, row_number() OVER (ORDER BY level) - 1 AS code FROM (SELECT DISTINCT coalesce(o_orderstatus, '__null__') AS level FROM orders WHERE o_orderkey % 10 < 8)),
e AS (SELECT o_orderkey, o_totalprice AS x, CAST(coalesce(code, (SELECT count(*) FROM v)) AS INTEGER) AS c FROM orders LEFT JOIN v ON level = CASE WHEN o_orderkey % 50 = 9 THEN 'new' ELSE o_orderstatus END),
m AS (SELECT avg(x) AS mx, stddev_samp(x) AS sx, avg(c) AS mc, stddev_samp(c) AS sc FROM e WHERE o_orderkey % 10 < 8) SELECT o_orderkey, round((x - mx) / sx, 6) AS x, round((c - mc) / sc, 6) AS c FROM e, m"""
)
def encoder_codes_scaled(spark, sf_dir):
    k = F.col("o_orderkey")
    status = F.when(k % 50 == 9, F.lit("new")).otherwise(F.col("o_orderstatus"))
    rows = orders(spark, sf_dir).select("o_orderkey", F.col("o_totalprice").alias("x"), status.alias("c"))
    out = encoders.Encoder(rows.where(k % 10 < 8), ("c",), ("x",), scale=True).transform(rows)
    return out.select("o_orderkey", r6("x").alias("x"), r6("c").alias("c"))


_CODED = "(SELECT level, row_number() OVER (ORDER BY n DESC, level) - 1 AS code FROM (SELECT coalesce({c}, '~na') AS level, count(*) AS n FROM orders WHERE o_orderkey % 10 < 8 GROUP BY 1))"


@query(f"SELECT o_orderkey, o_totalprice AS x_price, CAST(coalesce(code, 5) AS INTEGER) AS x_priority FROM orders LEFT JOIN {_CODED.format(c='o_orderpriority')} ON level = o_orderpriority")
def tree_matrix(spark, sf_dir):
    from .experiment import tree_matrix

    rows = orders(spark, sf_dir).select(F.col("o_orderkey").alias("rid"), F.lit("").alias("entity_id"), F.col("o_orderdate").alias("event_time"), urgent().alias("is_fraud"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    out, names = tree_matrix(rows, F.col("rid") % 10 < 8)
    return out.select(F.col("rid").alias("o_orderkey"), *names)


_STUDY = """y AS (SELECT o_orderkey, o_custkey, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS y, CASE WHEN o_orderkey % 10 < 7 THEN 'train' WHEN o_orderkey % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM orders),
s AS (SELECT unnest([0, 1, 2]) AS seed), f AS (SELECT seed, o_custkey % (31 + seed) AS g, avg(y) AS score FROM y, s WHERE split = 'train' GROUP BY ALL),
p AS (SELECT s.seed, split, y, score FROM y, s JOIN f ON f.seed = s.seed AND g = o_custkey % (31 + s.seed) WHERE split <> 'train'),
c AS (SELECT seed, split, score, sum(n) OVER w AS cn, sum(p) OVER w AS cp, p, n FROM (SELECT seed, split, score, count(*) AS n, sum(y) AS p FROM p GROUP BY ALL) WINDOW w AS (PARTITION BY seed, split ORDER BY score DESC)),
t AS (SELECT seed, split, sum(p) AS pos, sum(p * cp / cn) / sum(p) AS ap FROM c GROUP BY ALL),
b AS (SELECT seed, arg_max(score, (2.0 * cp / (cn + pos), -score)) AS threshold FROM c JOIN t USING (seed, split) WHERE split = 'val' GROUP BY seed),
h AS (SELECT seed, split, count(*) FILTER (score >= threshold AND y = 1) AS tp, count(*) FILTER (score >= threshold) AS called, sum(y) AS pos FROM p JOIN b USING (seed) GROUP BY ALL)"""


@query(f"WITH {_STUDY} SELECT CAST(seed AS BIGINT) AS seed, split AS part, round(threshold, 6) AS threshold, round(ap, 6) AS average_precision, round(tp / called, 6) AS \"precision\", round(tp / h.pos, 6) AS recall, round(2 * tp / (called + h.pos), 6) AS f1 FROM h JOIN t USING (seed, split) JOIN b USING (seed)")
def study_over_seeds(spark, sf_dir):
    """A study end to end with a model that SQL can repeat: the train rate of a group of customers, which the seed picks."""
    from .experiment import run_seeds

    k = F.col("o_orderkey") % 10
    split = F.when(k < 7, F.lit("train")).when(k < 8, F.lit("val")).otherwise(F.lit("test"))
    table = orders(spark, sf_dir).select("o_custkey", urgent().cast("int").alias("y_true"), split.alias("split"))

    def fit(train, seed):
        group = lambda df: df.withColumn("g", F.col("o_custkey") % (31 + seed))
        rates = group(train).groupBy("g").agg(F.avg("y_true").alias("score"))
        return lambda df: group(df).join(rates, "g")

    record = run_seeds(table, (0, 1, 2), fit)
    names = ("average_precision", "precision", "recall", "f1")
    rows = [(r["seed"], part, round(r["threshold"], 6), *(round(got[n], 6) for n in names)) for r in record["seeds"] for part, got in r["scores"].items()]
    return spark.createDataFrame(rows, "seed long, part string, threshold double, " + ", ".join(f"{n} double" for n in names))


def _feature_sets() -> None:
    from . import feature_queries

    QUERIES.update(feature_queries.QUERIES)
    ORACLE.update(feature_queries.ORACLE)


_feature_sets()
