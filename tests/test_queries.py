"""Every registered query of the engine against its SQL, on the smallest tables."""

import pytest
from conftest import same

from lagline.plans.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLE:
        same(got, duck.sql(ORACLE[name]).df())
    else:
        assert len(got)


def test_entry_lists_all(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_seeded_splits(spark, sf_dir):
    got = QUERIES["iid_window_split"](spark, sf_dir).toPandas()
    n = got["split"].value_counts()
    assert n["train"] == int(0.8 * len(got)) and n["val"] == int(0.1 * len(got))
    got = QUERIES["iid_customer_split"](spark, sf_dir).toPandas()
    assert (got.groupby("o_custkey")["split"].nunique() == 1).all()
    share = got["split"].value_counts(normalize=True)
    assert abs(share["train"] - 0.8) < 0.02
    got = QUERIES["downsample_1to1"](spark, sf_dir).toPandas()
    assert got["label"].sum() * 2 == len(got)
