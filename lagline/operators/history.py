"""Past-only histories of an entity.

Two rules for ties, both kept:

* time windows are [t - W, t): the left edge is in, and every row at t is out;
* row statistics (ordinal, prior_*, first_occurrence, gaps) follow (time, rid), so
  an earlier row of the same instant is past.

Each method gives a Column; put as many as needed into one select. Row frames share the
sort of (entity, time, rid) with time frames over (entity, time), if they're named
first. A trailing count is the difference of two growing frames, and costs the same however many
rows a window holds. So does with_sweeps, the form for trailing distinct counts: each value
enters and leaves, and one growing frame adds up the changes. Sums, means and z-scores
slide, which costs rows times window, as differences of growing sums would lose digits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import DAY_US, keyed, micros

#: Window names and their lengths in hours.
WINDOWS = {"1h": 1, "24h": 24, "7d": 168, "30d": 720}
HOUR_US = 3_600_000_000


def window_us(name: str) -> int:
    if name not in WINDOWS:
        raise ValueError(f"unknown window {name!r}; known are {', '.join(WINDOWS)}")
    return WINDOWS[name] * HOUR_US


@dataclass(frozen=True)
class History:
    """Columns over the table's rows, by entity and time; rid (columns) orders rows of an instant."""

    entity: str
    time: str
    rid: tuple[str, ...]

    @property
    def us(self) -> Column:
        return micros(F.col(self.time))

    def rows(self, *keys: Column):
        return Window.partitionBy(self.entity, *keys).orderBy(self.us, *self.rid)

    def _past(self, *keys: Column):
        return self.rows(*keys).rowsBetween(Window.unboundedPreceding, -1)

    def range(self, window: str):
        return Window.partitionBy(self.entity).orderBy(self.us).rangeBetween(-window_us(window), -1)

    # Time windows.
    def rolling_count(self, window: str) -> Column:
        """Rows before the instant, less those before the window."""
        grow = Window.partitionBy(self.entity).orderBy(self.us)
        before = lambda us: F.count(F.lit(1)).over(grow.rangeBetween(Window.unboundedPreceding, -us))
        return before(1) - before(window_us(window) + 1)

    def rolling_sum(self, value: Column, window: str) -> Column:
        return F.coalesce(F.sum(value.cast("double")).over(self.range(window)), F.lit(0.0))

    def rolling_mean(self, value: Column, window: str) -> Column:
        return F.avg(value.cast("double")).over(self.range(window))

    def rolling_zscore(self, value: Column, window: str) -> Column:
        """(value - mean) / sample deviation of the window; 0 where that doesn't exist."""
        x, w = value.cast("double"), self.range(window)
        return F.coalesce(F.try_divide(x - F.avg(x).over(w), F.stddev_samp(x).over(w)), F.lit(0.0))

    def rolling_distinct(self, value: Column, window: str) -> Column:
        """Distinct values in the window, null being one. Holds a window's values per row: see with_sweeps."""
        return F.size(F.collect_set(keyed(value)).over(self.range(window))).cast("long")

    # Rows before.
    def ordinal(self) -> Column:
        return (F.row_number().over(self.rows()) - 1).cast("long")

    def prior_mean(self, value: Column) -> Column:
        """Sum of the earlier values over the number of earlier rows; 0 without any."""
        total = F.sum(value.cast("double")).over(self._past())
        return F.coalesce(F.try_divide(total, self.ordinal().cast("double")), F.lit(0.0))

    def prior_max(self, value: Column) -> Column:
        """Largest earlier value, nulls passed over; null without any."""
        return F.max(value).over(self._past())

    def first_occurrence(self, value: Column) -> Column:
        return (F.row_number().over(self.rows(keyed(value))) == 1).cast("double")

    def with_prior_distinct(self, df: DataFrame, **values: Column) -> DataFrame:
        """Adds, for each name=value, the number of distinct values in earlier rows."""
        flags = {f"__first_{k}": self.first_occurrence(v).cast("long") for k, v in values.items()}
        counts = {k: F.coalesce(F.sum(f"__first_{k}").over(self._past()), F.lit(0)).cast("long") for k in values}
        return df.withColumns(flags).withColumns(counts).drop(*flags)

    def gap_seconds(self) -> Column:
        return (self.us - F.lag(self.us).over(self.rows())) / 1e6

    def gap_since_same(self, value: Column) -> Column:
        return (self.us - F.lag(self.us).over(self.rows(keyed(value)))) / 1e6


def with_sweeps(df: DataFrame, h: History, specs: dict[str, tuple[Column | None, str]], by_day: bool = False) -> DataFrame:
    """df with trailing counts: name -> (value, window) counts distinct values, (None, window) rows. Linear, whatever a window holds.

    A value is held for observers in (t, min(next row with it, t + W)]: it enters with its row at t and leaves by
    an event of its own, and the count at t is the sum of all changes strictly before t. Rows and events of an
    entity share one exchange if df lies by entity. by_day is for entities that are too large for a task:
    changes are summed by (entity, day), and run within a day on top of that.
    """
    t, row = h.us, F.struct(*[F.col(f"`{c}`") for c in df.columns if c != h.entity])
    ends = {}
    for k, (value, window) in enumerate(specs.values()):
        end = t + window_us(window)
        if value is not None:
            again = F.lead(t).over(Window.partitionBy(h.entity, keyed(value)).orderBy(t, *h.rid))
            end = F.least(F.coalesce(again, end), end)
        ends[f"__until{k}"] = end
    rows = df.select(h.entity, t.alias("__t"), row.alias("__row"), *[c.alias(n) for n, c in ends.items()])
    n = range(len(specs))
    event = [F.struct(F.col("__t").alias("t"), F.col("__row").alias("row"), *[F.lit(1).alias(f"d{k}") for k in n])]
    event += [F.struct(F.col(f"__until{j}").alias("t"), F.when(F.lit(False), F.col("__row")).alias("row"), *[F.lit(-1 if j == k else 0).alias(f"d{k}") for k in n]) for j in n]
    events = rows.select(h.entity, F.explode(F.array(*event)).alias("x")).select(h.entity, "x.*")
    before = Window.partitionBy(h.entity, *(["__day"] if by_day else [])).orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    total = {name: F.coalesce(F.sum(f"d{k}").over(before), F.lit(0)).cast("long") for k, name in enumerate(specs)}
    if by_day:
        events = events.withColumn("__day", F.floor(F.col("t") / DAY_US))
        days = events.groupBy(h.entity, "__day").agg(*[F.sum(f"d{k}").alias(f"s{k}") for k in n])
        earlier = Window.partitionBy(h.entity).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
        days = days.select(F.col(h.entity).alias("__e"), F.col("__day").alias("__d"), *[F.coalesce(F.sum(f"s{k}").over(earlier), F.lit(0)).alias(f"b{k}") for k in n])
        events = events.join(days, events[h.entity].eqNullSafe(days["__e"]) & (events["__day"] == days["__d"]))
        total = {name: c + F.col(f"b{k}") for k, (name, c) in enumerate(total.items())}
    out = events.withColumns({f"__n{k}": c for k, c in enumerate(total.values())}).where("row is not null")
    own = [F.col(h.entity) if c == h.entity else F.col(f"row.`{c}`") for c in df.columns]
    return out.select(*own, *[F.col(f"__n{k}").alias(name) for k, name in enumerate(specs)])
