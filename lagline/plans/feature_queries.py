"""The three feature sets over canonical tables made from orders, each held against SQL of its own.

A table's columns are expressions that Spark and the SQL's engine read alike. Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import window_us
from . import features

KEYS = {
    "rid": "o_orderkey",
    "entity_id": "lpad(CAST(o_custkey % 151 AS STRING), 4, '0')",
    "event_time": "o_orderdate",
    "is_fraud": "o_orderpriority = '1-URGENT'",
    "split": "CASE WHEN o_orderkey % 10 < 8 THEN 'train' ELSE 'test' END",
    "reported_at": "CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate END",
}
_CENTS = "CAST(CAST(floor(o_totalprice / 1000) - 20 AS DECIMAL(18,2)) + CAST(0.25 AS DECIMAL(18,2)) AS STRING)"
_STATE = "CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Italy' ELSE substr('NYCATXFLWA', CAST(2 * (o_orderkey % 5) + 1 AS INT), 2) END"

IBM = KEYS | {
    "Amount": f"'$' || {_CENTS}",
    "Errors?": "CASE WHEN o_orderkey % 11 = 0 THEN 'Bad PIN' END",
    "Merchant Name": "'m' || CAST(o_orderkey % 23 AS STRING)",
    "MCC": "CAST((o_orderkey * 7) % 9990 + 10 AS INT)",
    "Merchant State": _STATE,
    "Merchant City": "CASE WHEN o_orderkey % 5 = 0 THEN 'ONLINE' ELSE 'city' || CAST(o_orderkey % 4 AS STRING) END",
    "Use Chip": "CASE WHEN o_orderstatus = 'O' THEN 'Chip' ELSE 'Swipe' END",
    "Card": "CAST(o_orderkey % 3 AS INT)",
    "Card Brand": "CASE WHEN o_custkey % 2 = 0 THEN 'Visa' ELSE 'Amex' END",
    "Card Type": "CASE WHEN o_custkey % 3 = 0 THEN 'Debit' ELSE 'Credit' END",
    "Has Chip": "CASE WHEN o_custkey % 4 = 0 THEN 'NO' ELSE 'YES' END",
    "Card on Dark Web": "CASE WHEN o_custkey % 9 = 0 THEN 'Yes' ELSE 'No' END",
    "Cards Issued": "CAST(o_custkey % 3 AS INT)",
    "Acct Open Date": "lpad(CAST(o_custkey % 12 + 1 AS STRING), 2, '0') || '/' || CAST(1980 + o_custkey % 10 AS STRING)",
    "Expires": "CASE WHEN o_custkey % 13 = 0 THEN 'soon' ELSE lpad(CAST(o_custkey % 12 + 1 AS STRING), 2, '0') || '/2005' END",
    "Year PIN last Changed": "CAST(1985 + o_custkey % 8 AS INT)",
    "Current Age": "CAST(20 + o_custkey % 60 AS INT)",
    "Gender": "CASE WHEN o_custkey % 2 = 0 THEN 'Female' END",
    "FICO Score": "CAST(500 + o_custkey % 300 AS INT)",
    "Num Credit Cards": "CAST(o_custkey % 5 AS INT)",
    "Credit Limit": "'$' || CAST(o_custkey % 20 * 997 AS STRING)",
    "Total Debt": "'$' || CAST(o_custkey % 50 * 100 AS STRING)",
    "Yearly Income - Person": "'$' || CAST(o_custkey % 30 * 1000 AS STRING)",
    "Per Capita Income - Zipcode": "'$' || CAST(o_custkey % 40 * 500 AS STRING)",
    "Retirement Age": "CAST(60 + o_custkey % 9 AS INT)",
    "Zip": "CAST(10000 + o_custkey % 90 AS STRING)",
    "State": "substr('NYCATXFLWA', CAST(2 * (o_custkey % 5) + 1 AS INT), 2)",
    "City": "'city' || CAST(o_custkey % 4 AS STRING)",
}
SPARKOV = KEYS | {
    "reported_at_slow": "CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate END",
    "amt": "CAST(floor(o_totalprice / 1000) AS DOUBLE) + 0.25",
    "merchant": "'m' || CAST(o_orderkey % 23 AS STRING)",
    "category": "o_orderpriority",
    "lat": "CAST(o_custkey % 80 AS DOUBLE)",
    "long": "CAST(o_custkey % 170 AS DOUBLE)",
    "merch_lat": "CAST(o_orderkey % 85 AS DOUBLE)",
    "merch_long": "CAST(o_orderkey % 175 AS DOUBLE)",
    "job": "CASE WHEN o_custkey % 3 > 0 THEN 'job' || CAST(o_custkey % 3 AS STRING) END",
    "gender": "CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'M' END",
    "dob": "CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE CAST(1930 + o_custkey % 60 AS STRING) || '-03-0' || CAST(1 + o_custkey % 9 AS STRING) END",
    "city_pop": "CASE WHEN o_custkey % 19 > 0 THEN CAST(o_custkey * 10 AS INT) END",
    "state": "substr('NYCATXFLWA', CAST(2 * (o_custkey % 5) + 1 AS INT), 2)",
    "city": "'city' || CAST(o_custkey % 4 AS STRING)",
    "zip": "CAST(10000 + o_custkey % 90 AS INT)",
}
SAML = KEYS | {
    "Amount": "CAST(floor(o_totalprice / 40) AS DOUBLE) + 0.25",
    "Receiver_account": "'r' || CAST(o_orderkey % 97 AS STRING)",
    "Receiver_bank_location": "CASE o_orderkey % 5 WHEN 0 THEN 'UK' WHEN 1 THEN 'Spain' WHEN 2 THEN NULL ELSE 'Italy' END",
    "Sender_bank_location": "CASE WHEN o_custkey % 4 = 0 THEN 'Italy' ELSE 'UK' END",
    "Payment_type": "o_orderpriority",
    "Payment_currency": "CASE WHEN o_custkey % 4 = 0 THEN 'Euro' ELSE 'Pound' END",
    "Received_currency": "CASE o_orderstatus WHEN 'O' THEN 'Euro' WHEN 'P' THEN NULL ELSE 'Pound' END",
}


def canonical(spark: SparkSession, sf_dir: str, columns: dict[str, str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(*[F.expr(e).alias(n) for n, e in columns.items()])


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# The SQL. Each part is name -> expression over the table's columns, us and size; r_ is by row order, t_ by time.


def _rows(*keys: str, entity: str = "entity_id") -> str:
    return f"PARTITION BY {', '.join([entity, *(_key(k) for k in keys)])} ORDER BY us, rid"


def _key(value: str) -> str:
    return f"coalesce(CAST({value} AS VARCHAR), '~na')"


def _trail(window: str, entity: str = "entity_id") -> str:
    return f"(PARTITION BY {entity} ORDER BY us RANGE BETWEEN {window_us(window)} PRECEDING AND 1 PRECEDING)"


def _before(entity: str = "entity_id") -> str:
    return f"({_rows(entity=entity)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _ratio(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"


def _flag(cond: str) -> str:
    return f"CAST(coalesce({cond}, false) AS DOUBLE)"


def _ordinal(entity: str = "entity_id") -> str:
    return f"(row_number() OVER ({_rows(entity=entity)}) - 1)"


def _prior_mean(x: str, entity: str = "entity_id") -> str:
    return f"coalesce(sum({x}) OVER {_before(entity)} / nullif({_ordinal(entity)}, 0), 0.0)"


def _first(value: str, entity: str = "entity_id") -> str:
    return f"CAST(row_number() OVER ({_rows(value, entity=entity)}) = 1 AS DOUBLE)"


def _gap(value: str | None = None, entity: str = "entity_id") -> str:
    return f"(us - lag(us) OVER ({_rows(*([value] if value else []), entity=entity)})) / 1e6"


def _distinct(value: str, window: str, entity: str = "entity_id") -> str:
    return f"count(DISTINCT {_key(value)}) OVER {_trail(window, entity)}"


def _money(column: str) -> str:
    return f"try_cast(regexp_replace({column}, '[$,]', '', 'g') AS DOUBLE)"


def _month(column: str) -> str:
    return f"CASE WHEN regexp_full_match({column}, '(0[1-9]|1[0-2])/[0-9]{{4}}') THEN CAST(substr({column}, 4, 4) || '-' || substr({column}, 1, 2) || '-01' AS TIMESTAMP) END"


def _days(later: str, earlier: str) -> str:
    return f"(epoch_us({later}) - epoch_us({earlier})) / 86400e6"


def _common(amount: str) -> dict[str, str]:
    """size stands for the amount's absolute value."""
    z = _trail("7d")
    counts = {w: f"count(*) OVER {_trail(w)}" for w in ("1h", "24h", "7d", "30d")}
    sums = {w: f"coalesce(sum(size) OVER {_trail(w)}, 0.0)" for w in ("24h", "7d", "30d")}
    out = {"seconds_since_prev_txn": _gap(), "entity_txn_ordinal": _ordinal()}
    out |= {f"txn_count_{w}": c for w, c in counts.items()} | {f"amount_sum_{w}": c for w, c in sums.items()}
    out |= {"amount_mean_7d": f"avg(size) OVER {z}", "amount_zscore_vs_7d": f"coalesce(CASE WHEN stddev_samp(size) OVER {z} > 0 THEN (size - avg(size) OVER {z}) / stddev_samp(size) OVER {z} END, 0.0)"}
    t = "event_time"
    out |= {"hour": f"CAST(hour({t}) AS DOUBLE)", "minute": f"CAST(minute({t}) AS DOUBLE)", "weekday": f"CAST(isodow({t}) - 1 AS DOUBLE)", "day": f"CAST(day({t}) AS DOUBLE)", "month": f"CAST(month({t}) AS DOUBLE)", "is_weekend": f"CAST(isodow({t}) >= 6 AS DOUBLE)"}
    out |= {f"hour_{f}": f"{f}(2 * pi() * hour({t}) / 24)" for f in ("sin", "cos")}
    x = "coalesce(size, 0.0)"
    out |= {
        "amount": amount,
        "amount_log1p": f"sign({amount}) * ln(1 + abs({amount}))",
        "amount_is_refund": _flag(f"{amount} < 0"),
        "amount_cents": f"CAST(CAST(round_even({x} * 100, 0) AS BIGINT) % 100 AS DOUBLE)",
        "amount_is_round_10": _flag(f"{x} % 10 = 0 AND {x} > 0"),
        "amount_is_round_100": _flag(f"{x} % 100 = 0 AND {x} > 0"),
        "amount_is_micro": _flag(f"{x} > 0 AND {x} < 0.10"),
    }
    out |= {
        "burst_1h_over_24h": _ratio(counts["1h"], counts["24h"]),
        "burst_24h_over_7d": _ratio(counts["24h"], counts["7d"]),
        "amount_24h_over_7d": _ratio(sums["24h"], sums["7d"]),
        "amount_over_entity_mean": _ratio("size", _prior_mean("size")),
        "amount_over_entity_max": _ratio("size", f"max(size) OVER {_before()}"),
    }
    return out


def _sql(columns: dict[str, str], amount: str, parts: dict[str, str], firsts: dict[str, tuple[str, str]], keys: tuple[str, ...] = features.KEYS, more: str = "") -> str:
    """parts over the table; firsts: name -> (value, entity) of lifetime distinct counts, which add up first flags."""
    made = ", ".join(f'{e} AS "{n}"' for n, e in columns.items())
    flags = ", ".join(f"CAST({_first(v, e)} AS BIGINT) AS __f_{n}" for n, (v, e) in firsts.items())
    counts = {n: f"CAST(coalesce(sum(__f_{n}) OVER {_before(e)}, 0) AS BIGINT)" for n, (_, e) in firsts.items()}
    every = _common("__amount") | parts | counts
    named = ", ".join(f'round({e}, 6) AS "{n}"' if n not in _WHOLE and not n.startswith(_PLAIN) else f'{e} AS "{n}"' for n, e in every.items())
    return f"""WITH a AS (SELECT {made} FROM orders), b AS (SELECT *, epoch_us(event_time) AS us, {amount} AS __amount, abs({amount}) AS size{more} FROM a),
c AS (SELECT *, {flags} FROM b) SELECT {', '.join(keys)}, {named} FROM c"""


#: Counts and texts, which aren't rounded.
_PLAIN = ("artifact_", "txn_count", "distinct_", "prior_distinct", "receiver_in_count", "receiver_distinct", "receiver_prior", "payment_", "received_")
_WHOLE = ("entity_txn_ordinal", "receiver_txn_ordinal", "mcc_group", "use_chip", "card_brand", "card_type", "gender", "category", "job", "mcc_group")

_MCC = """CAST(CASE WHEN c <= 0 THEN 0 WHEN c BETWEEN 3000 AND 3299 THEN 3000 WHEN c BETWEEN 3300 AND 3499 THEN 3300 WHEN c BETWEEN 3500 AND 3999 THEN 3500
  WHEN c BETWEEN 5815 AND 5818 THEN 5815 WHEN c IN (5169, 5172) THEN 5169 WHEN c IN (5139, 5137) THEN 5139 WHEN c IN (5111, 5044, 5021) THEN 5111
  WHEN c IN (5099, 5085, 5039, 5074) THEN 5099 WHEN c IN (5045, 5065, 5072) THEN 5045 WHEN c IN (5192, 5122, 5094, 5047, 5013, 5051, 5046) THEN c
  WHEN c = 1499 THEN c WHEN c BETWEEN 5700 AND 7999 THEN c // CAST(pow(10, length(CAST(c AS VARCHAR)) - 3) AS BIGINT) ELSE c // CAST(pow(10, length(CAST(c AS VARCHAR)) - 2) AS BIGINT) END AS VARCHAR)"""


def _ibm_sql() -> str:
    q = lambda n: f'"{n}"'
    same = lambda a, b: _flag(f"{a} = {b}")
    number = lambda n: f"try_cast({q(n)} AS DOUBLE)"
    state, city, merchant, mcc, channel, card = map(q, ("Merchant State", "Merchant City", "Merchant Name", "MCC", "Use Chip", "Card"))
    foreign = _flag(f"length({state}) <> 2")
    errored = 'CAST("Errors?" IS NOT NULL AS DOUBLE)'
    contexts = {"merchant": merchant, "mcc": mcc, "state": state, "city": city, "channel": channel, "card": card}
    parts = {f"errors_{w}": f"coalesce(sum({errored}) OVER {_trail(w)}, 0.0)" for w in ("1h", "24h", "7d")}
    parts |= {"distinct_merchants_24h": _distinct(merchant, "24h")}
    parts |= {f"first_{n}_for_entity": _first(v) for n, v in contexts.items()}
    parts |= {"first_foreign_for_entity": f"{_first('__foreign')} * __foreign"}
    parts |= {f"secs_since_same_{n}": _gap(contexts[n]) for n in ("merchant", "mcc", "state", "channel", "card")}
    parts |= {"same_state": same(q("State"), state), "same_city": same(q("City"), city), "merchant_is_online": same(city, "'ONLINE'"), "merchant_state_missing": f"CAST({state} IS NULL AS DOUBLE)", "merchant_is_foreign": "__foreign"}
    parts |= {"mcc_group": _MCC.replace("c BETWEEN", f"{mcc} BETWEEN").replace("c IN", f"{mcc} IN").replace("c <=", f"{mcc} <=").replace("c = 1499", f"{mcc} = 1499").replace("THEN c ", f"THEN {mcc} ").replace("THEN c\n", f"THEN {mcc}\n").replace("CAST(c ", f"CAST({mcc} ").replace("ELSE c //", f"ELSE {mcc} //"), "use_chip": channel}
    parts |= {"card_brand": q("Card Brand"), "card_type": q("Card Type"), "has_chip": same(q("Has Chip"), "'YES'"), "card_on_dark_web": same(q("Card on Dark Web"), "'Yes'"), "cards_issued": number("Cards Issued")}
    parts |= {"days_since_acct_open": _days("event_time", f"({_month(q('Acct Open Date'))})"), "days_to_expiry": _days(f"({_month(q('Expires'))})", "event_time"), "days_since_pin_change": '(year(event_time) - "Year PIN last Changed") * 365.25'}
    parts |= {"age": number("Current Age"), "gender": q("Gender"), "fico": number("FICO Score"), "num_cards": number("Num Credit Cards")}
    money = {"credit_limit": _money(q("Credit Limit")), "total_debt": _money(q("Total Debt")), "income_person": _money(q("Yearly Income - Person")), "income_zip": _money(q("Per Capita Income - Zipcode"))}
    parts |= money | {"years_to_retirement": f"{number('Retirement Age')} - {number('Current Age')}", "debt_to_income": _ratio(money["total_debt"], money["income_person"]), "amount_over_credit_limit": _ratio("size", money["credit_limit"])}
    parts |= {f"artifact_{n}": q(c) for n, c in {"merchant_name": "Merchant Name", "merchant_state": "Merchant State", "merchant_city": "Merchant City", "zip": "Zip", "customer_state": "State"}.items()}
    parts |= {"artifact_mcc": f"CAST({mcc} AS VARCHAR)", "artifact_error_type": "coalesce(\"Errors?\", 'No Error')", "artifact_error_on_row": errored}
    return _sql(IBM, _money('"Amount"'), parts, {"prior_distinct_merchants": (merchant, "entity_id")}, more=f", {foreign} AS __foreign")


def _sparkov_sql() -> str:
    p1, p2, l1, l2 = "radians(lat)", "radians(merch_lat)", 'radians("long")', "radians(merch_long)"
    far = f"2 * 6371.0088 * asin(sqrt(least(greatest(pow(sin(({p2} - {p1}) / 2), 2) + cos({p1}) * cos({p2}) * pow(sin(({l2} - {l1}) / 2), 2), 0.0), 1.0)))"
    parts = {"distance_from_home_km": "__far", "distance_over_entity_mean": _ratio("__far", _prior_mean("__far")), "distance_over_entity_max": _ratio("__far", f"max(__far) OVER {_before()}")}
    parts |= {"distinct_merchants_24h": _distinct("merchant", "24h"), "distinct_categories_7d": _distinct("category", "7d")}
    for v in ("merchant", "category"):
        parts |= {f"first_{v}_for_entity": _first(v), f"secs_since_same_{v}": _gap(v)}
    parts |= {"category": "category", "job": "job", "gender": "gender", "age_at_txn": f"{_days('event_time', 'try_cast(dob AS TIMESTAMP)')} / 365.25", "city_pop_log": "ln(1 + coalesce(city_pop, 0.0))"}
    parts |= {"artifact_merchant": "merchant", "artifact_customer_state": "state", "artifact_customer_city": "city", "artifact_zip": "CAST(zip AS VARCHAR)"}
    return _sql(SPARKOV, "amt", parts, {"prior_distinct_merchants": ("merchant", "entity_id")}, (*features.KEYS, "reported_at_slow"), f", {far} AS __far")


def _saml_sql() -> str:
    into = '"Receiver_account"'
    receiver, country, home, kind, paid, got = map('"{}"'.format, ("Receiver_account", "Receiver_bank_location", "Sender_bank_location", "Payment_type", "Payment_currency", "Received_currency"))
    firsts = {"receiver": receiver, "receiver_country": country, "payment_type": kind, "currency_pair": f"{paid} || '->' || {got}"}
    parts = {"amount_just_under_10k": _flag("size >= 9000 AND size < 10000")}
    parts |= {"distinct_receivers_24h": _distinct(receiver, "24h"), "distinct_receivers_7d": _distinct(receiver, "7d"), "distinct_receiver_countries_7d": _distinct(country, "7d")}
    parts |= {"new_receiver_rate_7d": _ratio(_distinct(receiver, "7d"), f"count(*) OVER {_trail('7d')}")}
    parts |= {f"first_{n}_for_entity": _first(v) for n, v in firsts.items()}
    parts |= {f"secs_since_same_{n}": _gap(firsts[n]) for n in ("receiver", "receiver_country", "payment_type")}
    counted = f"count(*) OVER {_trail('7d', into)}"
    parts |= {"receiver_txn_ordinal": _ordinal(into), "secs_since_receiver_last_paid": _gap(entity=into), "receiver_in_count_24h": f"count(*) OVER {_trail('24h', into)}", "receiver_in_count_7d": counted}
    parts |= {"receiver_in_amount_7d": f"coalesce(sum(size) OVER {_trail('7d', into)}, 0.0)", "receiver_distinct_senders_7d": _distinct("entity_id", "7d", into), "first_sender_for_receiver": _first("entity_id", into)}
    parts |= {"receiver_amount_over_mean": _ratio("size", _prior_mean("size", into)), "receiver_sender_concentration_7d": _ratio(_distinct("entity_id", "7d", into), counted)}
    parts |= {"is_cross_border": _flag(f"{home} <> {country}"), "is_currency_conversion": _flag(f"{paid} <> {got}"), "same_currency": _flag(f"{paid} = {got}")}
    parts |= {"payment_type": kind, "payment_currency": paid, "received_currency": got, "artifact_sender_bank_location": home, "artifact_receiver_bank_location": country, "artifact_receiver_account": receiver}
    return _sql(SAML, '"Amount"', parts, {"prior_distinct_receivers": (receiver, "entity_id"), "receiver_prior_distinct_senders": ("entity_id", into)})


def features_ibm_ccf(spark, sf_dir):
    return rounded(features.ibm_ccf(canonical(spark, sf_dir, IBM)))


def features_sparkov(spark, sf_dir):
    return rounded(features.sparkov(canonical(spark, sf_dir, SPARKOV)))


def features_saml_d(spark, sf_dir):
    return rounded(features.saml_d(canonical(spark, sf_dir, SAML)))


QUERIES = {f.__name__: f for f in (features_ibm_ccf, features_sparkov, features_saml_d)}
ORACLE = {"features_ibm_ccf": _ibm_sql(), "features_sparkov": _sparkov_sql(), "features_saml_d": _saml_sql()}
