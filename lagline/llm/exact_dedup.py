"""Exact dedup, JVM-side only: a heavy-hitter split of the texts' digests.

A Misra-Gries pass (`freqItems`: at most 1 / support counters a task, merged) finds a
superset of the digests that make up more than `support` of the rows. These are
counted exactly, and the true repeats among them, with the id that stays, are
broadcast: at most 1 / support rows. Their other rows are settled map-side and never
shuffled; one row of each, and all other digests, are grouped by an ordinary shuffle,
in which no group exceeds `support` of the rows.

Defined results: null text counts as empty, so null and '' are equal. Of equal texts
the row with the largest id stays; a null id loses to any other. Of rows that repeat
text and id, one stays. An empty table gives an empty result. Columns other than id
and text are ignored (mark) or carried through (drop).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import without, written


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def heavy(rows: DataFrame, support: float) -> DataFrame:
    """Verified frequent digests: text_sha256, top_id, copies. At most 1 / support rows."""
    found = rows.stat.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    return rows.join(F.broadcast(found), "text_sha256").groupBy("text_sha256").agg(F.max("doc_id").alias("top_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


def mark(docs: DataFrame, support: float = 0.001, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    # The texts are read once: what follows works on their digests.
    rows = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(F.col(text_col)).alias("text_sha256")), "digests")
    met = rows.join(F.broadcast(heavy(rows, support)), "text_sha256", "left")
    stays = F.col("copies").isNull() | F.col("doc_id").eqNullSafe(F.col("top_id"))
    gone = met.where(~stays).select("doc_id", F.col("top_id").alias("keep_id"), F.col("copies").alias("group_size"), F.lit(False).alias("kept"), "text_sha256")
    same = Window.partitionBy("text_sha256")
    rest = met.where(stays).select(
        "doc_id",
        F.max("doc_id").over(same).alias("keep_id"),
        F.coalesce("copies", F.count(F.lit(1)).over(same)).alias("group_size"),
        (F.row_number().over(same.orderBy(F.col("doc_id").desc_nulls_last())) == 1).alias("kept"),
        "text_sha256",
    )
    return rest.unionByName(gone)


def drop(docs: DataFrame, support: float = 0.001, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all their columns, one row of each text.

    The decisions are made on digests. A bitmap of the rows that go (of a bounded size) is
    broadcast, and only rows that it may name are shuffled.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    marks = mark(docs, support, id_col, text_col).groupBy(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("__id"), F.col("text_sha256").alias("__sha"))
    judged = marks.agg(F.count(F.lit(1)).alias("copies"), F.bool_or("kept").alias("kept")).where("not kept or copies > 1")
    judged = written(judged.withColumn("__key", F.xxhash64("__id", "__sha")), "judged")
    rows = docs.withColumns({"__id": key, "__sha": digest(F.col(text_col))}).withColumn("__key", F.xxhash64("__id", "__sha"))
    return without(rows, "__key", judged, ["__id", "__sha"]).select(*docs.columns)
