"""Quality classifier: importance resampling by hashed n-gram models.

Two generative models over hashed word n-grams (orders 1 and 2, `buckets` counts each):
one of the target, texts labelled good, and one of the raw corpus, all its texts. A
document's log importance weight is the log ratio of its probability under the two.
Documents are drawn without replacement in proportion to their weights by Gumbel
top-k: add standard Gumbel noise, drawn from the id and a hash of the row, to the log weight, and take the k largest.
The weights of whole texts span thousands of nats, so at `temperature` 1 noise hardly matters: a higher one (the log
weight is divided by it) draws more evenly, and `by_length` weighs by the mean log ratio of an n-gram instead of the sum.

The raw model counts every document. The target model is fitted on at most
`most_labelled` labelled documents (those of the smallest id hashes), whose ids are broadcast. Both
models are arrays of bounded size; texts aren't shuffled.

Top-k is exact and has no global sort: counts by two levels of key intervals find the
interval of the k-th key; only that interval is ranked.

Defined results: null text counts as empty; a text without words has weight 0. k counts
all rows (`share` of them, rounded up). Ties in the key go to the smaller id. Repeated
rows are documents of their own. Without labelled texts every weight is 0. Rows without an id
are drawn by their hashes, each on its own. Columns other than those named are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._arrow import SPACE, hashed_words, mix, roll, text_buffer, windows_of
from ._store import ship, written


def grams(words: np.ndarray, first: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all 1- and 2-grams, and the document of each."""
    one = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at, two, _ = windows_of(first, 2)
    g = np.concatenate((mix(words), roll(words, 2)[at] if len(at) else np.empty(0, np.uint64)))
    return (g % np.uint64(buckets)).astype(np.int64), np.concatenate((one, two))


def _count(buckets: int):
    def run(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            good = batch.column(0).to_numpy(zero_copy_only=False)
            buf, offs = text_buffer(batch.column(1))
            for a, _, words, first in hashed_words(buf, offs, SPACE, True):
                g, doc = grams(words, first, buckets)
                raw += np.bincount(g, minlength=buckets)
                target += np.bincount(g[good[a + doc]], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    return run


def _weigh(ratio):
    def run(batches):
        log = ratio.value
        for batch in batches:
            buf, offs = text_buffer(batch.column(2))
            out, mean = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for a, b, words, first in hashed_words(buf, offs, SPACE, True):
                g, doc = grams(words, first, len(log))
                many = np.bincount(doc, minlength=b - a)
                out[a:b] = np.bincount(doc, weights=log[g], minlength=b - a)
                mean[a:b] = out[a:b] / np.maximum(many, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(mean), pa.array(out)], names=["row", "doc_id", "score", "log_weight"])

    return run


def log_ratio(docs: DataFrame, good_ids: DataFrame, buckets: int = 1 << 16, most_labelled: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw), with half a count added to each bucket."""
    ship(docs.sparkSession)
    pick = good_ids.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    pick = pick.withColumn("good", F.lit(True))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(pick), "doc_id", "left").select(F.coalesce("good", F.lit(False)).alias("good"), "text")
    got = rows.mapInArrow(_count(buckets), "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.full(buckets, 0.5), np.full(buckets, 0.5)
    raw[got["bucket"]] += got["raw"].to_numpy(float)
    target[got["bucket"]] += got["target"].to_numpy(float)
    if not len(got) or got["target"].sum() == 0:
        return np.zeros(buckets)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def score(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: row (a hash of id and text), doc_id, score (mean log ratio per n-gram), log_weight (their sum)."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(ratio)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.xxhash64(F.col(id_col).cast("long"), text).alias("row"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.mapInArrow(_weigh(sent), "row bigint, doc_id bigint, score double, log_weight double")


def _interval(rows: DataFrame, level, k: int) -> tuple[int | None, int]:
    """The interval (of those named by level) that holds the k-th largest key, and how many rows are above it."""
    above = 0
    for r in rows.groupBy(level.alias("at")).count().orderBy(F.desc("at")).collect():
        if above + r["count"] >= k:
            return r["at"], above
        above += r["count"]
    return None, above


def gumbel_top_k(scored: DataFrame, share: float = 0.75, seed: int = 11, temperature: float = 1.0, by_length: bool = False) -> DataFrame:
    """Adds key and selected: the `share` of the rows with the largest key, exactly.

    The driver sees counts of at most 2,048 intervals at each level.
    """
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    named = [c for c in ("doc_id", "row") if c in scored.columns]
    u = (F.pmod(F.xxhash64(*named, F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)
    weight = F.col("score" if by_length else "log_weight") / F.lit(float(temperature))
    keyed = written(scored.withColumn("key", weight - F.log(-F.log(u))), "keys")
    k = math.ceil(share * keyed.count())
    if k <= 0:
        return keyed.withColumn("selected", F.lit(False))
    wide = F.asinh("key") * 48  # rises with the key; +-1,000 holds any weight
    coarse = F.floor(wide).cast("long")
    top, above = _interval(keyed, coarse, k)
    fine = F.floor((wide - F.lit(float(top))) * 1024).cast("long")
    edge, more = _interval(keyed.where(coarse == top), fine, k - above)
    in_edge = (coarse == top) & (fine == edge)
    ranked = keyed.where(in_edge).withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("key"), F.asc_nulls_first("doc_id"))))
    rest = keyed.where(~in_edge).withColumn("selected", (coarse > top) | ((coarse == top) & (fine > edge)))
    return rest.unionByName(ranked.withColumn("selected", F.col("r") <= k - above - more).drop("r"))


def resample(docs: DataFrame, good_ids: DataFrame, share: float = 0.75, temperature: float = 1.0, by_length: bool = False, **options) -> DataFrame:
    """One row per row of docs: doc_id, score, log_weight, key, selected."""
    return gumbel_top_k(score(docs, log_ratio(docs, good_ids, **options)), share, temperature=temperature, by_length=by_length).drop("row")
