"""Splitters. Four temporal rules coexist on purpose; each keeps its own boundary.

* by values: a part ends at the first timestamp whose cumulative share reaches the target (<=)
* by quantiles: interpolated times (<)
* by order statistics: the k-th time (<), ties go to the later part
* by position: rows in (time, rid) order, which may split ties
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

NAMES = ("train", "val", "test")
#: The seed of the fixed random splits, the ratios of the three-way study, and its population's end.
SPLIT_SEED = 20260806
STUDY_RATIOS = (0.68, 0.16, 0.16)
STUDY_END = "2017-11-19 12:06:00"


def check_ratios(ratios) -> tuple[float, float, float]:
    if len(ratios) != 3 or any(r <= 0 for r in ratios) or not math.isclose(sum(ratios), 1.0, abs_tol=1e-9):
        raise ValueError(f"three positive ratios that sum to 1 are needed, got {ratios}")
    return tuple(float(r) for r in ratios)


def running_total(per: DataFrame, order: str, values: dict[str, str], bucket: Column) -> DataFrame:
    """per with inclusive running sums (name -> column) by order, in two levels.

    bucket rises with order and has a bounded number of values (days, the top bits of a
    hash): buckets are summed first, then each runs on its own, so that no task sees the whole
    table. Both levels read the same exchange of per.
    """
    rows = per.withColumn("__b", bucket)
    sums = rows.groupBy("__b").agg(*[F.sum(c).alias(f"__s_{n}") for n, c in values.items()])
    w = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__b", *[F.coalesce(F.sum(f"__s_{n}").over(w), F.lit(0)).alias(f"__base_{n}") for n in values])
    own = Window.partitionBy("__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(sums, "__b").withColumns({n: F.col(f"__base_{n}") + F.sum(c).over(own) for n, c in values.items()})
    return out.drop("__b", *[f"__base_{n}" for n in values])


def range_bucket(per: DataFrame, column: str, many: int = 128) -> Column:
    """A bucket for running totals in the order of any column of distinct values: at most many + 1 of them, null first.

    The cuts are the values of the smallest hashes, so buckets are about even however the values lie. One
    small job fetches them.
    """
    c = F.col(column)
    cuts = sorted(r[0] for r in per.select(c.alias("c")).where("c is not null").orderBy(F.xxhash64("c"), "c").limit(many).collect())
    if not cuts:
        return F.lit(0)
    kind = per.schema[column].dataType
    return F.when(c.isNull(), F.lit(-1)).otherwise(F.size(F.filter(F.array(*[F.lit(x).cast(kind) for x in cuts]), lambda x: x <= c)))


def quantiles(run: DataFrame, value: str, at: list[float], cum: str = "cum") -> DataFrame:
    """One row, q0 to qn: linearly interpolated quantiles of value (a number), from its rows' running count; null without rows.

    Ranks are exact, and no task holds the distinct values.
    """
    total = run.agg(F.max(cum).alias("__total"))
    met = run.crossJoin(F.broadcast(total))
    place = [F.lit(q) * (F.col("__total") - 1) for q in at]
    held = lambda rank: F.min(F.when(F.col(cum) > rank, F.col(value).cast("double")))
    aggs = [x.alias(f"{n}{i}") for i, h in enumerate(place) for n, x in (("lo", held(F.floor(h))), ("hi", held(F.ceil(h))), ("part", F.max(h - F.floor(h))))]
    return met.agg(*aggs).select(*[(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"part{i}")).alias(f"q{i}") for i in range(len(at))])


def day_of(us: str) -> Column:
    """A bucket for running totals over microseconds: at most 366 a year of data."""
    return F.floor(F.col(us) / S.DAY_US)


def hash_bucket(h: str) -> Column:
    """A bucket for running totals over hashes in hex: 256 of them."""
    return F.substring(h, 1, 2)


def instants(df: DataFrame, time: str) -> DataFrame:
    """(t, n, us, cum): rows of each instant, and of all instants up to it."""
    per = df.groupBy(F.col(time).alias("t")).agg(F.count(F.lit(1)).alias("n")).withColumn("us", S.micros(F.col("t")))
    return running_total(per, "us", {"cum": "n"}, day_of("us"))


def instant(t) -> Column:
    """A fetched timestamp as a literal; null if there's none."""
    return F.lit(None if t is None else str(t)).cast("timestamp_ntz")


def cuts_by_share(df: DataFrame, fractions: list[float], time: str = "event_time") -> list:
    """For each fraction, the first timestamp whose cumulative share of rows is at least it. One job.

    Works on distinct timestamps. The share is a running sum over the total, never a
    percentile function, which differs where a fraction falls on a float boundary.
    """
    run = instants(df, time)
    total = run.agg(F.max("cum").alias("total"))
    met = run.crossJoin(F.broadcast(total))
    return list(met.agg(*[F.min(F.when(F.col("cum") / F.col("total") >= f, F.col("t"))) for f in fractions]).first())


def _label(first: Column, second: Column) -> Column:
    return F.when(first, F.lit("train")).when(second, F.lit("val")).otherwise(F.lit("test"))


def temporal(df: DataFrame, ratios=(0.8, 0.1, 0.1), time: str = "event_time") -> DataFrame:
    """df with split, cut on timestamp values (<=)."""
    a, b, _ = check_ratios(ratios)
    first, second = map(instant, cuts_by_share(df, [a, a + b], time))
    return df.withColumn("split", _label(F.col(time) <= first, F.col(time) <= second))


def keep_upstream_test(df: DataFrame, is_test: Column, val_fraction: float = 0.1, time: str = "event_time") -> DataFrame:
    """df with split: given test rows stay test, val is the last val_fraction of the others."""
    (cut,) = map(instant, cuts_by_share(df.where(~is_test), [1.0 - val_fraction], time))
    return df.withColumn("split", F.when(is_test, F.lit("test")).when(F.col(time) <= cut, F.lit("train")).otherwise(F.lit("val")))


def by_quantiles(df: DataFrame, at=(0.8, 0.9), time: str = "event_time") -> DataFrame:
    """df with split, cut on linearly interpolated time quantiles (<)."""
    us = S.micros(F.col(time))
    first, second = (F.lit(q) for q in quantiles(instants(df, time), "us", list(at)).first())
    return df.withColumn("split", _label(us < first, us < second))


def cuts_by_rank(df: DataFrame, fractions: list[float], time: str = "event_time") -> tuple[list, int, object]:
    """For each fraction the time of 0-based rank int(fraction * n); also n and the first time. One job."""
    run = instants(df, time)
    met = run.crossJoin(F.broadcast(run.agg(F.max("cum").alias("total"))))
    row = met.agg(F.max("total"), F.min("t"), *[F.min(F.when(F.col("cum") > F.floor(F.lit(f) * F.col("total")), F.col("t"))) for f in fractions]).first()
    return list(row[2:]), row[0] or 0, row[1]


def by_order_statistics(df: DataFrame, fractions=(0.68, 0.84), time: str = "event_time") -> DataFrame:
    """df with split; rows tied at a cut go to the later part."""
    first, second = map(instant, cuts_by_rank(df, list(fractions), time)[0])
    return df.withColumn("split", _label(F.col(time) < first, F.col(time) < second))


def check_order_statistics(df: DataFrame, fractions=(0.68, 0.84), time: str = "event_time") -> None:
    """Raises if by_order_statistics would leave a part empty."""
    (first, second), n, low = cuts_by_rank(df, list(fractions), time)
    if n < 4:
        raise ValueError("at least four rows are needed")
    if first == low or first == second:
        raise ValueError("tied timestamps leave a part empty")


def by_position(df: DataFrame, rid: tuple[str, ...], fractions=(0.8, 0.9), time: str = "event_time") -> DataFrame:
    """df with split by the row's place in (time, rid) order.

    Places come from the running count of earlier instants plus the place within the instant.
    """
    run = instants(df, time)
    total = run.agg(F.max("cum").alias("__total"))
    before = run.select(F.col("t").alias("__t"), (F.col("cum") - F.col("n")).alias("__before"))
    place = F.col("__before") + F.row_number().over(Window.partitionBy(time).orderBy(*rid)) - 1
    rows = df.join(before, df[time] == before["__t"]).crossJoin(F.broadcast(total)).withColumn("__p", place)
    cut = [F.floor(F.lit(f) * F.col("__total")) for f in fractions]
    return rows.withColumn("split", _label(F.col("__p") < cut[0], F.col("__p") < cut[1])).drop("__t", "__before", "__total", "__p")


def study_population(df: DataFrame, time: str = "event_time") -> DataFrame:
    """Rows strictly before the study's end."""
    return df.where(F.col(time) < F.lit(STUDY_END).cast("timestamp_ntz"))


def assign_sizes(sizes: np.ndarray, counts: np.ndarray, ratios=(0.8, 0.1, 0.1), repairs: int = 200) -> np.ndarray:
    """How many customers of each size go to each part: balanced on rows, with fixed numbers of customers.

    Largest first, each to the part that then misses its row targets least (in relative
    squares) and has room; then up to `repairs` times the swap of two customers that lowers the
    miss most. Customers of one size are alike, so the table has a row per distinct size; of a size
    with many customers, all but a few per part are dealt at once, in proportion to the room.
    """
    ratios = np.array(check_ratios(ratios))
    n, rows = int(counts.sum()), float((sizes * counts).sum())
    want = np.maximum(ratios * rows, 1e-9)
    room = np.array([int(ratios[0] * n), int(ratios[1] * n), 0])
    room[2] = n - room.sum()
    have, part = np.zeros(3), np.zeros((len(sizes), 3), np.int64)
    miss = lambda h: (((h - want) / want) ** 2).sum(axis=-1)
    for i in np.argsort(-sizes, kind="stable"):
        left = int(counts[i])
        if left > 64:
            lot = np.minimum((left - 32) * room // max(room.sum(), 1), room)
            part[i], room, have, left = part[i] + lot, room - lot, have + lot * sizes[i], left - int(lot.sum())
        for _ in range(left):
            k = int(np.argmin(np.where(room > 0, miss(have + np.eye(3) * sizes[i]), np.inf)))
            part[i, k], room[k], have[k] = part[i, k] + 1, room[k] - 1, have[k] + sizes[i]
    for _ in range(repairs):
        now, best = miss(have), None
        for a, b in ((0, 1), (0, 2), (1, 2)):
            # Moving x from a to b and y back changes the rows by y - x: for each x, the sizes beside the best y.
            x, y = np.unique(sizes[part[:, a] > 0]), np.unique(sizes[part[:, b] > 0])
            if not len(x) or not len(y):
                continue
            u, v = (have - want)[a] / want[a] ** 2, (have - want)[b] / want[b] ** 2
            step = (v - u) / (1 / want[a] ** 2 + 1 / want[b] ** 2)  # the change of a's rows that would be best
            at = np.clip(np.searchsorted(y, x + step)[:, None] + np.array([-1, 0]), 0, len(y) - 1)
            move = y[at] - x[:, None]
            after = np.broadcast_to(have, (*move.shape, 3)).copy()
            after[..., a] += move
            after[..., b] -= move
            cost = miss(after)
            i, j = np.unravel_index(int(cost.argmin()), cost.shape)
            if best is None or cost[i, j] < best[0]:
                best = (cost[i, j], a, b, x[i], y[at[i, j]])
        if best is None or best[0] >= now - 1e-15:
            break
        _, a, b, x, y = best
        for size, source, target in ((x, a, b), (y, b, a)):
            i = int(np.flatnonzero(sizes == size)[0])
            part[i, source], part[i, target] = part[i, source] - 1, part[i, target] + 1
            have[source], have[target] = have[source] - size, have[target] + size
    return part


def by_customer(df: DataFrame, seed: int = SPLIT_SEED, ratios=(0.8, 0.1, 0.1), entity: str = "entity_id") -> DataFrame:
    """df with split; each entity is whole.

    The driver holds a row per distinct size (of n rows there are at most sqrt(2 n)), not per entity: it says how many
    entities of a size go to each part, and a seeded hash picks which.
    """
    per = df.groupBy(entity).agg(F.count(F.lit(1)).alias("__n"))
    kinds = per.groupBy("__n").agg(F.count(F.lit(1)).alias("many")).orderBy("__n").collect()
    sizes = np.array([r["__n"] for r in kinds], np.int64)
    part = assign_sizes(sizes, np.array([r["many"] for r in kinds], np.int64), ratios) if kinds else np.zeros((0, 3), np.int64)
    cuts = df.sparkSession.createDataFrame([(int(n), int(p[0]), int(p[0] + p[1])) for n, p in zip(sizes, part, strict=True)], "__size long, __first long, __second long")
    named = per.withColumn("__h", F.md5(F.concat_ws("-", F.lit(str(seed)), F.coalesce(F.col(entity).cast("string"), F.lit(""))))).withColumn("__b", hash_bucket("__h"))
    # The place among entities of a size: those in lower buckets, and then in its own.
    below = named.groupBy("__n", "__b").agg(F.count(F.lit(1)).alias("__k"))
    lower = Window.partitionBy("__n").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    below = below.select("__n", "__b", F.coalesce(F.sum("__k").over(lower), F.lit(0)).alias("__base"))
    own = F.row_number().over(Window.partitionBy("__n", "__b").orderBy("__h", entity)) - 1
    named = named.join(below, ["__n", "__b"]).withColumn("__p", F.col("__base") + own).join(cuts, F.col("__n") == F.col("__size"))
    named = named.select(F.col(entity).alias("__e"), _label(F.col("__p") < F.col("__first"), F.col("__p") < F.col("__second")).alias("split"))
    return df.join(named, df[entity].eqNullSafe(named["__e"]), "left").drop("__e")


def _hash_place(df: DataFrame, seed: int, keys: tuple[str, ...]) -> DataFrame:
    """df with __p, its 0-based place in the order of a seeded hash of the keys, and __total."""
    df = df.withColumn("__h", F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])))
    run = running_total(df.groupBy("__h").agg(F.count(F.lit(1)).alias("__n")), "__h", {"__cum": "__n"}, hash_bucket("__h"))
    total = run.agg(F.max("__cum").alias("__total"))
    place = F.col("__cum") - F.col("__n") + F.row_number().over(Window.partitionBy("__h").orderBy(*keys)) - 1
    return df.join(run, "__h").crossJoin(F.broadcast(total)).withColumn("__p", place).drop("__h", "__n", "__cum")


def by_window(df: DataFrame, seed: int = SPLIT_SEED, ratios=(0.8, 0.1, 0.1), keys: tuple[str, ...] = ("rid",)) -> DataFrame:
    """df with split: exact shares int(r0 * n), int(r1 * n), the rest, by the rank of a seeded hash of the keys."""
    a, b, _ = check_ratios(ratios)
    first = F.floor(F.lit(a) * F.col("__total"))
    second = first + F.floor(F.lit(b) * F.col("__total"))
    return _hash_place(df, seed, keys).withColumn("split", _label(F.col("__p") < first, F.col("__p") < second)).drop("__total", "__p")


def downsample(df: DataFrame, label: str, seed: int = 1729, keys: tuple[str, ...] = ("rid",)) -> DataFrame:
    """All positives and as many negatives, those of the smallest seeded hashes; a short side is kept whole."""
    pos, neg = df.where(F.col(label)), df.where(~F.coalesce(F.col(label), F.lit(False)))
    n = pos.count()
    return pos.unionByName(_hash_place(neg, seed, keys).where(F.col("__p") < n).drop("__p", "__total"))


def check_split(df: DataFrame, label: str | None = None) -> dict[str, int]:
    """Rows of each part; warns on an empty one, raises if an evaluation part has no positive (with label)."""
    aggs = [F.count(F.lit(1)).alias("n"), (F.count_if(F.col(label)) if label else F.lit(1)).alias("pos")]
    got = {r["split"]: r for r in df.groupBy("split").agg(*aggs).collect()}
    for k in NAMES:
        if k not in got:
            warnings.warn(f"split {k!r} is empty", stacklevel=2)
        elif label and k != "train" and got[k]["pos"] == 0:
            raise ValueError(f"split {k!r} has no positive")
    return {k: got[k]["n"] if k in got else 0 for k in NAMES}
