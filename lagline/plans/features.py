"""Feature sets: blocks of past-only features, and three named compositions.

Each build takes a canonical table with rid and returns keys and features. Columns are
added in the order rows -> time ranges -> keyed rows, so windows of an entity share one
exchange and as few sorts as can be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.history import History, with_sweeps
from ..operators.joins import attach_unique
from ..sources.sinks import KEYS


def text(name: str) -> Column:
    return F.col(f"`{name}`").cast("string")


def number(name: str) -> Column:
    return F.col(f"`{name}`").cast("string").try_cast("double")


def baseline(h: History, size: Column) -> dict[str, Column]:
    return {"seconds_since_prev_txn": h.gap_seconds(), "__mean": h.prior_mean(size), "__max": h.prior_max(size), "entity_txn_ordinal": h.ordinal()}


def velocity(h: History, size: Column) -> dict[str, Column]:
    out = {f"txn_count_{w}": h.rolling_count(w) for w in ("1h", "24h", "7d", "30d")}
    out |= {f"amount_sum_{w}": h.rolling_sum(size, w) for w in ("24h", "7d", "30d")}
    return out | {"amount_mean_7d": h.rolling_mean(size, "7d"), "amount_zscore_vs_7d": h.rolling_zscore(size, "7d")}


class _Build:
    """Collects named feature columns in their order over one table."""

    def __init__(self, df: DataFrame):
        # Features stand under f_ until done, so that none clashes with a source column.
        self.keys = KEYS + tuple(c for c in ("reported_at_slow",) if c in df.columns)
        self.df, self.order = df, []

    def add(self, features: dict[str, Column]) -> None:
        self.order += [n for n in features if not n.startswith("__")]
        self.df = self.df.withColumns({f"f_{n}": c for n, c in features.items()})

    def sweep(self, h: History, **values: tuple[Column, str]) -> None:
        """Trailing distinct counts: name=(value, window)."""
        self.order += list(values)
        self.df = with_sweeps(self.df, h, {f"f_{n}": v for n, v in values.items()})

    def use(self, name: str) -> Column:
        return F.col(f"f_{name}")

    def done(self) -> DataFrame:
        return self.df.select(*self.keys, *[self.use(n).alias(n) for n in self.order])


def _ratio_names(b: _Build, size: Column) -> dict[str, Column]:
    u = b.use
    return {
        "burst_1h_over_24h": S.safe_ratio(u("txn_count_1h"), u("txn_count_24h")),
        "burst_24h_over_7d": S.safe_ratio(u("txn_count_24h"), u("txn_count_7d")),
        "amount_24h_over_7d": S.safe_ratio(u("amount_sum_24h"), u("amount_sum_7d")),
        "amount_over_entity_mean": S.safe_ratio(size, u("__mean")),
        "amount_over_entity_max": S.safe_ratio(size, u("__max")),
    }


def _common(b: _Build, h: History, amount: Column) -> Column:
    size = F.abs(amount)
    b.add(baseline(h, size))
    b.add(velocity(h, size))
    b.add(S.clock_features(F.col("event_time")))
    b.add(S.amount_shape(amount))
    b.add(_ratio_names(b, size))
    return size


def _distinct(b: _Build, h: History, **values: Column) -> None:
    """Lifetime distinct counts, by first flags."""
    flags = {f"__first_{n}": h.first_occurrence(v).cast("long") for n, v in values.items()}
    b.add(flags)
    b.add({n: F.coalesce(F.sum(b.use(f"__first_{n}")).over(h._past()), F.lit(0)).cast("long") for n in values})


def ibm_ccf(df: DataFrame) -> DataFrame:
    """82 features, 8 of them artifacts."""
    b, h = _Build(df), History("entity_id", "event_time", ("rid",))
    size = _common(b, h, S.parse_money(F.col("Amount")))
    errored = F.col("`Errors?`").isNotNull().cast("double")
    merchant, mcc, state, city, channel = (text(c) for c in ("Merchant Name", "MCC", "Merchant State", "Merchant City", "Use Chip"))
    foreign = S.is_foreign(state)
    b.add({f"errors_{w}": h.rolling_sum(errored, w) for w in ("1h", "24h", "7d")})
    b.sweep(h, distinct_merchants_24h=(merchant, "24h"))
    contexts = {"merchant": merchant, "mcc": mcc, "state": state, "city": city, "channel": channel, "card": text("Card")}
    b.add({f"first_{n}_for_entity": h.first_occurrence(v) for n, v in contexts.items()})
    b.add({"first_foreign_for_entity": h.first_occurrence(foreign) * foreign})
    b.add({f"secs_since_same_{n}": h.gap_since_same(contexts[n]) for n in ("merchant", "mcc", "state", "channel", "card")})
    _distinct(b, h, prior_distinct_merchants=merchant)
    b.add({"same_state": S.same(text("State"), state), "same_city": S.same(text("City"), city), "merchant_is_online": S.same(city, F.lit("ONLINE")), "merchant_state_missing": state.isNull().cast("double"), "merchant_is_foreign": foreign})
    b.add({"mcc_group": S.mcc_group(F.col("MCC")).cast("string"), "use_chip": channel})
    time = F.col("event_time")
    b.add(
        {
            "card_brand": text("Card Brand"),
            "card_type": text("Card Type"),
            "has_chip": S.same(text("Has Chip"), F.lit("YES")),
            "card_on_dark_web": S.same(text("Card on Dark Web"), F.lit("Yes")),
            "cards_issued": number("Cards Issued"),
            "days_since_acct_open": S.days_between(time, S.month_year(text("Acct Open Date"))),
            "days_to_expiry": S.days_between(S.month_year(text("Expires")), time),
            "days_since_pin_change": S.years_apart_days(time, F.col("`Year PIN last Changed`")),
        }
    )
    b.add({"age": number("Current Age"), "gender": text("Gender"), "fico": number("FICO Score"), "num_cards": number("Num Credit Cards")})
    b.add({n: S.parse_money(F.col(f"`{c}`")) for n, c in {"credit_limit": "Credit Limit", "total_debt": "Total Debt", "income_person": "Yearly Income - Person", "income_zip": "Per Capita Income - Zipcode"}.items()})
    b.add({"years_to_retirement": number("Retirement Age") - b.use("age"), "debt_to_income": S.safe_ratio(b.use("total_debt"), b.use("income_person")), "amount_over_credit_limit": S.safe_ratio(size, b.use("credit_limit"))})
    b.add(
        {
            "artifact_merchant_name": merchant,
            "artifact_merchant_state": state,
            "artifact_merchant_city": city,
            "artifact_zip": text("Zip"),
            "artifact_customer_state": text("State"),
            "artifact_mcc": mcc,
            "artifact_error_type": F.coalesce(text("Errors?"), F.lit("No Error")),
            "artifact_error_on_row": errored,
        }
    )
    return b.done()


def attach_slow(df: DataFrame, slow: DataFrame) -> DataFrame:
    """df with the slow preparation's reported_at, row by row."""
    return attach_unique(df, slow, "trans_num", "reported_at", "reported_at_slow")


def sparkov(df: DataFrame) -> DataFrame:
    """50 features, 4 of them artifacts."""
    b, h = _Build(df), History("entity_id", "event_time", ("rid",))
    _common(b, h, number("amt"))
    merchant, category = text("merchant"), text("category")
    far = S.haversine_km(*[F.col(c).cast("double") for c in ("lat", "long", "merch_lat", "merch_long")])
    b.add({"distance_from_home_km": far})
    b.add({"__far_mean": h.prior_mean(b.use("distance_from_home_km")), "__far_max": h.prior_max(b.use("distance_from_home_km"))})
    b.add({"distance_over_entity_mean": S.safe_ratio(b.use("distance_from_home_km"), b.use("__far_mean")), "distance_over_entity_max": S.safe_ratio(b.use("distance_from_home_km"), b.use("__far_max"))})
    b.sweep(h, distinct_merchants_24h=(merchant, "24h"), distinct_categories_7d=(category, "7d"))
    for n, v in (("merchant", merchant), ("category", category)):
        b.add({f"first_{n}_for_entity": h.first_occurrence(v), f"secs_since_same_{n}": h.gap_since_same(v)})
    _distinct(b, h, prior_distinct_merchants=merchant)
    born = F.col("dob").cast("string").try_cast("timestamp_ntz")
    b.add({"category": category, "job": text("job"), "gender": text("gender"), "age_at_txn": S.days_between(F.col("event_time"), born) / 365.25, "city_pop_log": F.log1p(F.coalesce(number("city_pop"), F.lit(0.0)))})
    b.add({"artifact_merchant": merchant, "artifact_customer_state": text("state"), "artifact_customer_city": text("city"), "artifact_zip": text("zip")})
    return b.done()


#: The reporting threshold, and the share below it that counts as just under.
THRESHOLD, JUST_UNDER = 10_000.0, 0.10


def saml_d(df: DataFrame) -> DataFrame:
    """63 features, 3 of them artifacts; two histories, of the sender and of the receiver."""
    b, out = _Build(df), History("entity_id", "event_time", ("rid",))
    into = History("Receiver_account", "event_time", ("rid",))
    size = _common(b, out, number("Amount"))
    receiver, country, home = text("Receiver_account"), text("Receiver_bank_location"), text("Sender_bank_location")
    kind, paid, got = text("Payment_type"), text("Payment_currency"), text("Received_currency")
    b.add({"amount_just_under_10k": S.in_range(size, THRESHOLD * (1 - JUST_UNDER), THRESHOLD)})
    b.sweep(out, distinct_receivers_24h=(receiver, "24h"), distinct_receivers_7d=(receiver, "7d"), distinct_receiver_countries_7d=(country, "7d"))
    b.add({"new_receiver_rate_7d": S.safe_ratio(b.use("distinct_receivers_7d"), b.use("txn_count_7d"))})
    firsts = {"receiver": receiver, "receiver_country": country, "payment_type": kind, "currency_pair": S.pair_key(paid, got)}
    b.add({f"first_{n}_for_entity": out.first_occurrence(v) for n, v in firsts.items()})
    b.add({f"secs_since_same_{n}": out.gap_since_same(firsts[n]) for n in ("receiver", "receiver_country", "payment_type")})
    _distinct(b, out, prior_distinct_receivers=receiver)
    # The receiver's side.
    sender = F.col("entity_id")
    b.add({"receiver_txn_ordinal": into.ordinal(), "__in_mean": into.prior_mean(size), "secs_since_receiver_last_paid": into.gap_seconds()})
    b.add({"receiver_in_count_24h": into.rolling_count("24h"), "receiver_in_count_7d": into.rolling_count("7d"), "receiver_in_amount_7d": into.rolling_sum(size, "7d")})
    b.sweep(into, receiver_distinct_senders_7d=(sender, "7d"))
    b.add({"first_sender_for_receiver": into.first_occurrence(sender)})
    b.add({"receiver_prior_distinct_senders": F.coalesce(F.sum(b.use("first_sender_for_receiver")).over(into._past()), F.lit(0.0)).cast("long")})
    b.add({"receiver_amount_over_mean": S.safe_ratio(size, b.use("__in_mean")), "receiver_sender_concentration_7d": S.safe_ratio(b.use("receiver_distinct_senders_7d"), b.use("receiver_in_count_7d"))})
    differ = lambda x, y: F.coalesce(x != y, F.lit(False)).cast("double")
    b.add({"is_cross_border": differ(home, country), "is_currency_conversion": differ(paid, got), "same_currency": S.same(paid, got)})
    b.add({"payment_type": kind, "payment_currency": paid, "received_currency": got})
    b.add({"artifact_sender_bank_location": home, "artifact_receiver_bank_location": country, "artifact_receiver_account": receiver})
    return b.done()


SETS = {"ibm_ccf": ibm_ccf, "sparkov": sparkov, "saml_d": saml_d}
