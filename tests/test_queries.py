"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_module
from compare import compare, duck
from wellspan.plans.catalog import ENTRIES

SF_DIR = "/root/testdata/sf0.001"
# queries of the text operators, if there are any, have tests of their own
QUERIES = {k: e.run for k, e in ENTRIES.items()}
SQL = {k: v for k, v in entry_module.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


# a minute or more each, whatever the size of the tables; their parts have tests in test_forecast and test_jobs
SLOW = {"grid_select_score", "refit_forecast_index", "gbt_walk_forward"} if not os.environ.get("SLOW_QUERIES") else set()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in SQL:
        assert compare(df, con, SQL[name]) == []
    else:
        assert len(df.columns) == len(set(df.columns)) and df.count() > 0


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and {"station", "scale", "kind", "peak"} <= set(df.columns)


def test_every_sql_belongs_to_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
