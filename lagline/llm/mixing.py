"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its share of all words, at most `most` times what it has, the
excess going to the others by weight. A document's copies are target / source size:
a whole number, and a fraction to be rounded. Rounding is pivotal: two documents of a source
with fractional copies meet, words move from one to the other, at random in
one of two directions and without bias, until one of them has whole copies; the other
goes on. So a source's words stay at the target, but for one document.

The pairs form a reduction tree. Documents are dealt by their ids, and not by how the
input lies, into leaves of about `leaf` documents; a leaf hands on the one document left
over, and each level joins up to `leaf` leftovers of the level below, until a source
has one, which a last draw rounds. Every draw hashes those
who meet (their ids and texts), so reruns agree under any partitioning, and rows without an id spread like
others. Larger documents meet first, so that the one left over is small.

Defined results: null text has size 0, takes nothing. A null source is a source, the
last. A source without words has target 0. Rows that repeat an id are documents of
their own, told apart by their texts; equal rows by count. Columns other than those named are ignored (plan)
or carried through (apply), where a column `copies` of the input makes the added one `copies_`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._arrow import splitmix
from ._store import ship, written

SPACES = r"[\x20\x09-\x0D]+"


def row_hash(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def n_words(text):
    """Words between white space: splitting costs a fifth of what counting matches does."""
    parts = F.split(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "^" + SPACES, ""), SPACES, -1)
    return (F.size(parts) - (F.element_at(parts, -1) == "").cast("int")).cast("long")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """row (a hash of id and text), doc_id, source, size; the text stays behind."""
    return docs.select(
        row_hash(id_col, text_col).alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        n_words(F.col(text_col)).alias("size"),
    )


def targets(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, docs, source_size, target: one row per source.

    Water-filling in closed form: with sources by cap / weight, a source is capped as
    long as its own ratio is below the level that the rest would get.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")
    per = per.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(most))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    free = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / free).withColumn("full", F.col("cap") / F.col("weight") < F.col("level"))
    # The level that holds is that of the first source below its cap; if none is, all are capped.
    open_ = F.when(~F.col("full"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("source").isNull().alias("z"), F.col("source").alias("s"), F.col("level").alias("level")))
    level = F.min(open_).over(every)["level"]
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap").cast("double"), F.col("weight") * level))
    return per.select("source", "docs", "source_size", target.cast("double").alias("target"))


def _unit(a: np.ndarray, b: int, seed: int) -> float:
    return splitmix(splitmix(int(a) & ((1 << 64) - 1)) ^ splitmix((int(b) & ((1 << 64) - 1)) + seed)) / 2.0**64


def pivotal(doc: np.ndarray, size: np.ndarray, p: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """p with all but one entry rounded to 0 or 1, and the row of that one (or -1). sum(p * size) is kept."""
    p = p.copy()
    hold = -1
    for j in range(len(p)):
        if not 0.0 < p[j] < 1.0:
            continue
        if hold < 0:
            hold = j
            continue
        a, b = p[hold] * size[hold], p[j] * size[j]
        ra, rb = size[hold] - a, size[j] - b  # what each has room for
        up, down = min(ra, b), min(a, rb)  # words to move to hold; from hold
        to_hold = _unit(doc[hold], doc[j], seed) * (up + down) < down
        if to_hold:
            done_hold, done_j = ra <= b, b <= ra
            p[hold] = 1.0 if done_hold else (a + up) / size[hold]
            p[j] = 0.0 if done_j else (b - up) / size[j]
        else:
            done_hold, done_j = a <= rb, rb <= a
            p[hold] = 0.0 if done_hold else (a - down) / size[hold]
            p[j] = 1.0 if done_j else (b + down) / size[j]
        hold = -1 if done_hold and done_j else j if done_hold else hold
    return p, hold


_COLUMNS = "row bigint, doc_id bigint, source string, size bigint, source_size bigint, target double, whole bigint, p double, leaves bigint, node bigint, open boolean"
_NAMES = [c.split()[0] for c in _COLUMNS.split(", ")]


def _level(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "row"], ascending=[False, True], kind="stable").reset_index(drop=True)
        pdf["p"], hold = pivotal(pdf["row"].to_numpy(np.int64), pdf["size"].to_numpy(np.float64), pdf["p"].to_numpy(), seed)
        pdf["open"] = False
        if hold >= 0:
            pdf.loc[hold, "open"] = True
        return pdf[_NAMES]

    return run


def plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, leaf: int = 2_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: row (a hash of id and text), doc_id, source, size, source_size, target, copies, taken."""
    spark = docs.sparkSession
    ship(spark)
    rows = written(sizes(docs, id_col, text_col, source_col), "sizes")
    per = written(targets(rows, weights, most), "targets")
    largest = per.agg(F.max("docs")).first()[0] or 0
    met = rows.join(per, rows["source"].eqNullSafe(per["source"])).select(rows["*"], "source_size", "target", "docs")
    x = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # Copies within a rounding error of a whole number are whole.
    whole = F.when(F.abs(x - F.round(x)) < 1e-12, F.round(x)).otherwise(F.floor(x)).cast("long")
    part = F.when(F.col("size") == 0, F.lit(0.0)).otherwise(F.greatest(x - whole, F.lit(0.0)))
    met = met.withColumns({"whole": whole, "p": part, "leaves": F.ceil(F.col("docs") / leaf).cast("long")})
    todo = met.withColumn("node", F.pmod(F.xxhash64("row"), "leaves")).drop("docs")
    done, level, leaves = None, 0, -(-largest // leaf)
    while True:
        out = written(todo.groupBy("source", "node").applyInPandas(_level(seed + 1000 * level), _COLUMNS), f"level{level}")
        left, settled = out.where("open"), out.where("not open")
        done = settled if done is None else done.unionByName(settled)
        if leaves <= 1:
            break
        level, leaves = level + 1, -(-leaves // leaf)
        todo = left.drop("open").withColumn("leaves", F.ceil(F.col("leaves") / leaf).cast("long")).withColumn("node", F.pmod("node", "leaves"))
    draw = F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    done = done.unionByName(left.withColumn("p", (draw < F.col("p")).cast("double")))
    copies = F.col("whole") + F.col("p").cast("long")
    return done.select("row", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs with all their columns and `copies`: the rows that the mix takes at least once.

    Decisions, a few bytes a row, meet their rows by id and a hash of the text; equal rows take theirs in turn.
    """
    made = plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    keys = ["__row", "__id", "__source"]
    safe_id = lambda c: F.coalesce(c.cast("long"), F.lit(-(1 << 63)))
    safe_source = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    right = made.groupBy(F.col("row").alias("__row"), safe_id(F.col("doc_id")).alias("__id"), safe_source(F.col("source")).alias("__source")).agg(F.count(F.lit(1)).alias("__many"), F.sum("copies").alias("__total")).where("__total > 0")
    right = written(right, "taken")
    left = docs.withColumns({"__row": row_hash(id_col, text_col), "__id": safe_id(F.col(id_col)), "__source": safe_source(F.col(source_col))})
    met = left.join(right, keys)
    name = "copies"
    while name in docs.columns:
        name += "_"
    out = [F.col(f"`{c}`") for c in docs.columns]
    once = met.where("__many = 1").select(*out, F.col("__total").cast("long").alias(name))
    # Of equal rows, which are all of one size, the first ones take one copy more if the total isn't a multiple.
    rest = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map" not in kind])
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(rest))
    each = F.floor(F.col("__total") / F.col("__many")) + F.when(F.col("__nth") <= F.col("__total") % F.col("__many"), 1).otherwise(0)
    several = met.where("__many > 1").withColumn("__nth", nth).withColumn("__c", each.cast("long")).where("__c > 0")
    return once.unionByName(several.select(*out, F.col("__c").alias(name)))
