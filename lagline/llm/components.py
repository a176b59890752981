"""Connected components.

A few edges (at most `FEW`, which is counted first) are united in one task. More are worked on
by alternating large-star and small-star steps: edges stay a distributed table throughout, and each
step only takes minima by node and joins them back, so a hub's edges are never gathered; a skewed
join is split by AQE.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import ship, written

#: Edges that one task unites: some 100 MB of its memory at most, for nodes of 16 bytes.
FEW = 250_000


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def unite(edges) -> dict:
    """Each node on an edge -> the smallest node that it reaches."""
    up = {}

    def top(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(up)}


def _united(batches):
    pairs, kind = [], None
    for batch in batches:
        kind = batch.schema.field(0).type
        pairs += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
    if pairs:
        roots = unite(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(list(roots), kind), pa.array(list(roots.values()), kind)], names=["u", "root"])


def components(edges: DataFrame, most_rounds: int = 60, few: int = FEW) -> DataFrame:
    """edges (u, v) of any orderable type -> (u, root): each node on an edge, with the smallest node that it reaches.

    Self-loops, repeats and either direction are fine; an empty table gives an empty one.
    """
    ship(edges.sparkSession)
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    if now.count() <= few:
        kind = now.schema["u"].dataType.simpleString()
        return now.coalesce(1).mapInArrow(_united, f"u {kind}, root {kind}")
    now = written(now.distinct(), "edges")
    state = _state(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        now = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state, before = _state(now), state
        if state == before:
            break
    else:
        raise RuntimeError("components: no fixed point")
    roots = now.groupBy("u").agg(F.min("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("u"), "root").distinct())
