"""Every query with a SQL twin gives the same rows on the smallest data."""

import pytest
from oracle import compare, connect

from riskweave.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
# Model fits are slow on any data; test_training covers them on small tables.
SLOW = {"cv_oof", "cv_oof_trees", "grid_search", "random_search", "refit_all", "clean_dataset", "logreg_train"}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    assert compare(spark, con, SF_DIR, name, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    result = entry.entry(spark)
    assert result.columns[0] == "SK_ID_CURR"
