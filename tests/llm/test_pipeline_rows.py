"""corpus_pipeline.run over awkward tables, and whether its stages keep rows apart that share an id or have none."""

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(spark, tmp_path):
    def put(rows, more=()):
        docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], SCHEMA)
        docs = docs.withColumns({c: F.lit("clash") for c in more})
        docs.write.parquet(f"file://{tmp_path}/documents.parquet")
        items = spark.createDataFrame([(1, " ".join(f"bench{k}" for k in range(14))), (2, None)], "item_id long, text string")
        items.write.parquet(f"file://{tmp_path}/benchmark.parquet")
        return f"file://{tmp_path}"

    return put


def prose(rng, words=80):
    return " ".join(f"{rng.choice(['ba', 'de', 'ki', 'lo', 'mu'])}{rng.choice(['n', 'r', 's'])}{rng.choice('aeiou')}{rng.randint(0, 0) or ''}{rng.choice(['x', 'y', 'z', 'w'])}{rng.choice('bcdfgh')}" for _ in range(words))


def test_awkward_rows(spark, folder):
    import corpus_pipeline

    rng = random.Random(5)
    first, second, third = prose(rng), prose(rng), prose(rng)
    rows = [
        (1, first, "en", "a"),
        (1, second, "en", "a"),  # one id, two texts: both stay
        (None, third, None, None),
        (None, prose(rng), "de", "b"),  # no id, another text: both stay
        (2, None, "en", "a"),
        (3, "", None, "b"),
        (4, "½ ² 12", "en", "a"),
        (5, first, "de", "b"),  # an exact copy with a larger id stays instead of row 1
        (5, first, "de", "b"),
        (6, second.replace(second.split()[40], "changed"), "en", None),  # a near copy of 1's second text
        (7, "so " + " ".join(f"BENCH{k}" for k in range(12)) + " ends", "en", "a"),
        (8, prose(rng, 20_000), "en", "b"),
    ]
    more = ("key", "row", "id", "copies", "kept", "tile", "cls", "bucket", "payload", "__x")
    sf = folder(rows, more)
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), *more, "copies_"]
    got = out.collect()
    assert {r["key"] for r in got} <= {"clash"} and all(1 <= r["copies_"] <= 3 for r in got)
    kept = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), *more], name
    texts = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in kept.collect())
    assert texts == sorted([(1, second), (-1, third), (-1, rows[3][1]), (5, first), (8, rows[11][1])])


def test_empty_table(spark, folder):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, folder([])).count() == 0


def test_every_text_null(spark, folder):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, folder([(1, None, None, None), (None, None, "en", "a"), (1, None, None, None)])).count() == 0
