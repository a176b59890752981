"""Scalar column functions.

Null stands for a value that doesn't exist (an empty history, an unparsable text);
NaN never arises. Every division and lenient cast uses the try_ forms, so nothing
raises under ANSI.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for null wherever null counts as a value.
NULL_LEVEL = "~na"
DAY_US = 86_400_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def from_micros(us: Column) -> Column:
    """The TIMESTAMP_NTZ of microseconds since 1970."""
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01").cast("timestamp_ntz"))


def keyed(value: Column) -> Column:
    """A grouping key in which null is a value of its own."""
    return F.coalesce(value.cast("string"), F.lit(NULL_LEVEL))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where that doesn't exist."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def round_scaled(x: Column, places: int = 6) -> Column:
    """A double to so many places as SQL rounds it: scaled, to the nearest whole number (halves away from 0), scaled back.

    F.round goes by the shortest decimal digits instead, which differs where those end in a half that the double isn't.
    """
    return F.round(x * 10.0**places) / 10.0**places


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0088) -> Column:
    """Great-circle distance; the half-chord is clipped to [0, 1]."""
    a, b = F.radians(lat1), F.radians(lat2)
    chord = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    inside = F.when(chord.isNotNull(), F.least(F.greatest(chord, F.lit(0.0)), F.lit(1.0)))
    return 2 * radius * F.asin(F.sqrt(inside))


def days_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / float(DAY_US)


def clock_features(ts: Column) -> dict[str, Column]:
    """Cyclical clock parts, Monday = 0; never the date itself."""
    hour, day = F.hour(ts).cast("double"), F.weekday(ts).cast("double")
    angle = hour * (2 * math.pi / 24)
    return {
        "hour": hour,
        "minute": F.minute(ts).cast("double"),
        "weekday": day,
        "day": F.dayofmonth(ts).cast("double"),
        "month": F.month(ts).cast("double"),
        "is_weekend": (day >= 5).cast("double"),
        "hour_sin": F.sin(angle),
        "hour_cos": F.cos(angle),
    }


def amount_shape(amount: Column) -> dict[str, Column]:
    """The amount and the shape of the number; cents round half to even."""
    raw = amount.cast("double")
    size = F.coalesce(F.abs(raw), F.lit(0.0))
    flag = lambda c: c.cast("double")
    return {
        "amount": raw,
        "amount_log1p": signed_log1p(raw),
        "amount_is_refund": flag(F.coalesce(raw, F.lit(0.0)) < 0),
        "amount_cents": flag(F.rint(size * 100).cast("long") % 100),
        "amount_is_round_10": flag((size % 10 == 0) & (size > 0)),
        "amount_is_round_100": flag((size % 100 == 0) & (size > 0)),
        "amount_is_micro": flag((size > 0) & (size < 0.10)),
    }


def parse_money(text: Column) -> Column:
    """'$1,234.50' as 1234.5; null where that isn't a number."""
    return F.regexp_replace(text.cast("string"), r"[$,]", "").try_cast("double")


def parse_money_strict(text: Column) -> Column:
    """'$-25.00' as -25.0; raises where that isn't a number."""
    return F.regexp_replace(text.cast("string"), r"\$", "").cast("double")


def strip_quotes(text: Column) -> Column:
    return F.btrim(text, F.lit("'"))


def assemble_minute(year: Column, month: Column, day: Column, clock: Column) -> Column:
    """A timestamp from Year, Month, Day and H:MM."""
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    text = F.concat(year.cast("string"), F.lit("-"), pad(month, 2), F.lit("-"), pad(day, 2), F.lit(" "), pad(clock, 5))
    return F.to_timestamp_ntz(text, F.lit("yyyy-MM-dd HH:mm"))


def offset_from(start: str, amount: Column, unit_us: int) -> Column:
    """start plus a number of units, as a timestamp."""
    return from_micros(micros(F.lit(start).cast("timestamp_ntz")) + F.rint(amount.cast("double") * unit_us).cast("long"))


def account_uid(card: Column, address: Column, seconds: Column, age_days: Column, row_id: Column) -> Column:
    """card_address_startday of a derived account; one of its own per row where a part is missing."""
    start = F.rint(seconds.cast("double") / 86_400 - age_days)
    plain = lambda c: F.concat(F.rint(c).cast("decimal(38,0)").cast("string"), F.lit(".0"))  # noqa: E731  315.0, never 3.15E2
    start = F.when(start == 0, F.when(F.signum(seconds.cast("double") / 86_400 - age_days) < 0, F.lit("-0.0")).otherwise(F.lit("0.0"))).otherwise(plain(start))
    whole = F.when(address == F.rint(address), plain(address)).otherwise(address.cast("string"))
    return F.when(address.isNull() | age_days.isNull(), F.concat(F.lit("txn_"), row_id.cast("string"))).otherwise(F.concat_ws("_", card.cast("string"), whole, start))


#: Merchant codes of 5000 to 5599 that stand for one trade.
MCC_MERGED = {
    5169: (5169, 5172),
    5139: (5139, 5137),
    5111: (5111, 5044, 5021),
    5099: (5099, 5085, 5039, 5074),
    5045: (5045, 5065, 5072),
}
#: Codes of that range that stay themselves.
MCC_KEPT = (5192, 5122, 5094, 5047, 5013, 5051, 5046)
#: Brand ranges [from, to), each a group under its first code.
MCC_BRANDS = ((3000, 3300), (3300, 3500), (3500, 4000))


def mcc_group(code: Column) -> Column:
    """A merchant category code's group: 0 for none, leading digits in most ranges."""
    c = code.try_cast("double").cast("long")
    lead = lambda n: F.substring(c.cast("string"), 1, n).cast("long")
    # A code of fewer digits than asked for is padded, as its leading digits are a scale.
    two, three = F.when(c < 10, c * 10).otherwise(lead(2)), F.when(c < 10, c * 100).when(c < 100, c * 10).otherwise(lead(3))
    out = F.when(c.isNull() | (c <= 0), F.lit(0))
    for low, high in MCC_BRANDS:
        out = out.when((c >= low) & (c < high), F.lit(low))
    out = out.when((c >= 5815) & (c <= 5818), F.lit(5815))
    for group, codes in MCC_MERGED.items():
        out = out.when(c.isin(*codes), F.lit(group))
    out = out.when(c.isin(*MCC_KEPT), c)
    out = out.when((c >= 5700) & (c < 8000), three)
    return out.when((c == 1499) | (c >= 10_000), c).otherwise(two).cast("long")


def is_foreign(state: Column) -> Column:
    """A merchant state that is given and not a two-letter code."""
    return F.coalesce(F.length(state) != 2, F.lit(False)).cast("double")


def same(a: Column, b: Column) -> Column:
    """1 where both are given and equal; null is equal to nothing."""
    return F.coalesce(a == b, F.lit(False)).cast("double")


def month_year(text: Column) -> Column:
    """'MM/YYYY' as its first day; null where it isn't."""
    ok = F.when(text.rlike(r"^(0[1-9]|1[0-2])/\d{4}$"), text)
    return F.to_timestamp_ntz(F.concat(F.substring(ok, 4, 4), F.lit("-"), F.substring(ok, 1, 2), F.lit("-01")), F.lit("yyyy-MM-dd"))


def years_apart_days(ts: Column, year: Column) -> Column:
    return (F.year(ts) - year.cast("string").try_cast("double")) * 365.25


def in_range(x: Column, low: float, high: float) -> Column:
    """low <= x < high; null is outside."""
    return F.coalesce((x >= low) & (x < high), F.lit(False)).cast("double")


def pair_key(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit("->"), b)


#: Texts of a label.
LABEL_TEXT = {"true": True, "false": False, "1": True, "0": False, "1.0": True, "0.0": False}


def parse_label(value: Column) -> Column:
    """0/1, booleans or their texts as a boolean; null for anything else."""
    text = F.lower(F.trim(value.cast("string")))
    yes = [k for k, v in LABEL_TEXT.items() if v]
    return F.when(text.isin(*yes), F.lit(True)).when(text.isin(*[k for k in LABEL_TEXT if k not in yes]), F.lit(False))
