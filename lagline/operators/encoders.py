"""Train-only encoders and chronological encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import keyed, micros
from .splits import day_of, range_bucket, running_total

#: Share of the rows and number of levels that a capped vocabulary keeps.
COVERAGE, MAX_LEVELS = 0.99, 256
#: Strength of a category's prior; rows and positives behind the global prior.
ALPHA, PRIOR_ROWS, PRIOR_POSITIVES = 20.0, 1000, 1


def capped_vocabulary(df: DataFrame, column: str, coverage: float = COVERAGE, max_levels: int = MAX_LEVELS, train: Column | None = None) -> DataFrame:
    """(level, n, code): the most frequent levels while the share before a level is below coverage, at most max_levels.

    Equal counts are ordered by value. Candidates are the max_levels most frequent,
    taken before anything is ordered as a whole.
    """
    rows = df if train is None else df.where(train)
    counts = rows.groupBy(keyed(F.col(column)).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("__total"))
    head = counts.orderBy(F.desc("n"), "level").limit(max_levels).crossJoin(F.broadcast(total))
    w = Window.orderBy(F.desc("n"), "level")
    before = F.coalesce(F.sum(F.col("n") / F.col("__total")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return head.withColumn("__before", before).withColumn("code", F.row_number().over(w) - 1).where(F.col("__before") < coverage).select("level", "n", "code")


def capped_codes(df: DataFrame, column: str, vocabulary: DataFrame, name: str) -> DataFrame:
    """df with the level's code; any other value gets the code after the last."""
    v = vocabulary.select(F.col("level").alias("__level"), F.col("code").alias("__code"))
    rare = vocabulary.agg(F.count(F.lit(1)).cast("int").alias("__rare"))
    out = df.join(F.broadcast(v), keyed(F.col(column)) == F.col("__level"), "left").crossJoin(F.broadcast(rare))
    return out.withColumn(name, F.coalesce("__code", "__rare").cast("int")).drop("__level", "__code", "__rare")


def sorted_vocabulary(df: DataFrame, column: str, train: Column | None = None, null_level: str = "__null__") -> DataFrame:
    """(level, code): all train levels by value; the code after the last is for unseen ones."""
    rows = df if train is None else df.where(train)
    levels = rows.select(F.coalesce(F.col(column).cast("string"), F.lit(null_level)).alias("level")).distinct().withColumn("__one", F.lit(1))
    run = running_total(levels, "level", {"__upto": "__one"}, range_bucket(levels, "level"))
    return run.select("level", (F.col("__upto") - 1).cast("int").alias("code"))


def ordinal_codes(df: DataFrame, column: str, vocabulary: DataFrame, name: str, null_level: str = "__null__") -> DataFrame:
    """df with the level's code by an ordinary join: the vocabulary is unbounded."""
    v = vocabulary.select(F.col("level").alias("__level"), F.col("code").alias("__code"))
    unseen = vocabulary.agg(F.count(F.lit(1)).cast("int").alias("__unseen"))
    out = df.join(v, F.coalesce(F.col(column).cast("string"), F.lit(null_level)) == F.col("__level"), "left").crossJoin(F.broadcast(unseen))
    return out.withColumn(name, F.coalesce("__code", "__unseen").cast("int")).drop("__level", "__code", "__unseen")


def moments(df: DataFrame, columns: list[str], train: Column, population: bool = True) -> DataFrame:
    """One row: mean_c and sd_c of train values; a missing or zero deviation is 1, a missing mean 0."""
    sd = F.stddev_pop if population else F.stddev_samp
    out = []
    for c in columns:
        x = F.when(train & ~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        out.append(F.coalesce(F.avg(x), F.lit(0.0)).alias(f"mean_{c}"))
        s = sd(x)
        out.append(F.when(s > 0, s).otherwise(F.lit(1.0)).alias(f"sd_{c}"))
    return df.agg(*out)


def standardize(df: DataFrame, columns: list[str], train: Column, population: bool = True) -> DataFrame:
    """df with z_c (0 where missing) and missing_c, by train moments."""
    m = moments(df, columns, train, population)
    out = df.crossJoin(F.broadcast(m))
    for c in columns:
        x = F.col(c).cast("double")
        out = out.withColumns({f"z_{c}": F.coalesce((F.nanvl(x, F.lit(None).cast("double")) - F.col(f"mean_{c}")) / F.col(f"sd_{c}"), F.lit(0.0)), f"missing_{c}": (x.isNull() | F.isnan(x)).cast("int")})
    return out.drop(*m.columns)


def _before(rows: DataFrame, key: str, rid: tuple[str, ...], sums: dict[str, str]) -> DataFrame:
    """rows with, for each name -> column, its sum over the key's earlier rows, in (__us, rid) order.

    In two levels, (key, day) and rows within it, so a frequent value is dealt over its days.
    """
    rows = rows.withColumn("__day", day_of("__us"))
    days = rows.groupBy(key, "__day").agg(*[F.sum(c).alias(f"__s_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(key).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(key, "__day", *[F.coalesce(F.sum(f"__s_{n}").over(earlier), F.lit(0)).alias(f"__b_{n}") for n in sums])
    own = Window.partitionBy(key, "__day").orderBy("__us", *rid).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(days, [key, "__day"])
    out = out.withColumns({n: F.col(f"__b_{n}") + F.coalesce(F.sum(c).over(own), F.lit(0)) for n, c in sums.items()})
    return out.drop("__day", *[f"__b_{n}" for n in sums])


def causal_count(df: DataFrame, value: Column, train: Column, time: str, rid: tuple[str, ...], name: str) -> DataFrame:
    """df with the number of earlier train rows with the same value, in row order; null counts as a value."""
    rows = df.withColumns({"__key": keyed(value), "__us": micros(F.col(time)), "__w": F.coalesce(train, F.lit(False)).cast("long")})
    out = _before(rows, "__key", rid, {"__n": "__w"})
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.col("__n").cast("long").alias(name))


def rarity(count: Column, foreign: Column) -> dict[str, Column]:
    """Rarity of a value by its causal count, whether it's unseen, and rarity where foreign."""
    r = 1.0 / F.sqrt(count + 1.0)
    return {"rarity": r, "unseen": (count == 0).cast("double"), "rarity_foreign": r * foreign}


def chronological_rate(df: DataFrame, column: str, label: Column, train: Column, time: str, rid: tuple[str, ...], name: str) -> DataFrame:
    """df with a smoothed target rate: of earlier train rows on train rows, of all train rows elsewhere.

    The global prior before a row is a running sum over all train rows: sums by instant
    run in two levels, and rows of an instant run within it.
    """
    us = micros(F.col(time))
    rows = df.withColumns({"__y": F.when(train, label.cast("long")).otherwise(0), "__w": train.cast("long"), "__us": us, "__key": keyed(F.col(column))})
    per = rows.groupBy("__us").agg(F.sum("__y").alias("__sy"), F.sum("__w").alias("__sw"))
    per = running_total(per, "__us", {"__cy": "__sy", "__cw": "__sw"}, day_of("__us"))
    every = per.agg(F.max("__cy").alias("__ally"), F.max("__cw").alias("__allw"))
    per = per.select(F.col("__us").alias("__t"), (F.col("__cy") - F.col("__sy")).alias("__by"), (F.col("__cw") - F.col("__sw")).alias("__bw"))
    inst = Window.partitionBy("__us").orderBy(*rid).rowsBetween(Window.unboundedPreceding, -1)
    z = lambda c: F.coalesce(c, F.lit(0))
    whole_key = rows.groupBy("__key").agg(F.sum("__y").alias("__ty"), F.sum("__w").alias("__tw"))
    rows = _before(rows, "__key", rid, {"__ky": "__y", "__kw": "__w"}).join(whole_key, "__key")
    rows = rows.withColumns({"__py": z(F.sum("__y").over(inst)), "__pw": z(F.sum("__w").over(inst))})
    rows = rows.join(per, rows["__us"] == per["__t"]).crossJoin(F.broadcast(every))
    prior = lambda y, n: (y + F.lit(PRIOR_POSITIVES)) / (n + F.lit(PRIOR_ROWS))
    past = (F.col("__ky") + ALPHA * prior(F.col("__by") + F.col("__py"), F.col("__bw") + F.col("__pw"))) / (F.col("__kw") + ALPHA)
    whole = (F.col("__ty") + ALPHA * prior(F.col("__ally"), F.col("__allw"))) / (F.col("__tw") + ALPHA)
    return rows.withColumn(name, F.when(F.col("__w") == 1, past).otherwise(whole)).select(*df.columns, name)


UNSEEN = "__unseen__"


class Encoder:
    """Ordinal codes fitted on train rows, and with scale the encoded columns standardised by train's sample moments.

    A column's categories are a table (level, code), of any size, with `__unseen__` as the last code; null is the
    level `__null__`. Moments are one row, which the fit fetches. A missing value stands at the mean.
    """

    def __init__(self, train: DataFrame, categorical: tuple[str, ...] = (), numeric: tuple[str, ...] = (), scale: bool = False):
        self.levels = {c: sorted_vocabulary(train, c) for c in categorical}
        self.numeric = tuple(numeric)
        self.moments: dict[str, tuple[float, float]] = {}
        if scale:
            names = [*categorical, *numeric]
            got = moments(self._coded(train), names, F.lit(True), population=False).first()
            self.moments = {c: (got[f"mean_{c}"], got[f"sd_{c}"]) for c in names}

    def categories(self, column: str) -> DataFrame:
        """(level, code), the unseen one last."""
        known = self.levels[column]
        last = known.agg(F.lit(UNSEEN).alias("level"), F.count(F.lit(1)).cast("int").alias("code"))
        return known.unionByName(last)

    def code_of(self, column: str, value: str) -> int:
        row = self.categories(column).where(F.col("level") == value).first()
        if row is None:
            raise KeyError(f"{value!r} isn't a category of {column}")
        return row["code"]

    def _coded(self, df: DataFrame) -> DataFrame:
        out = df
        for c, levels in self.levels.items():
            out = ordinal_codes(out, c, levels, f"__code_{c}")
        return out.select(*[F.col(f"__code_{c}").alias(c) if c in self.levels else F.col(f"`{c}`") for c in df.columns])

    def transform(self, df: DataFrame) -> DataFrame:
        """df with its columns encoded in place."""
        out = self._coded(df)
        scaled = {}
        for c, (mean, sd) in self.moments.items():
            x = F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
            scaled[c] = (F.coalesce(x, F.lit(mean)) - mean) / sd
        return out.withColumns(scaled) if scaled else out
