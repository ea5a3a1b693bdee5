"""Every query that has SQL gives the SQL's rows, over whole tables."""

import os

import pytest

import compare
from depotlens.plans import catalogue, problems

pytestmark = pytest.mark.skipif(not os.path.isdir(compare.FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return compare.connection()


@pytest.mark.parametrize("module, name", [(m, n) for m in (catalogue, problems) for n in m.SQL])
def test_same_as_sql(spark, con, module, name):
    compare.same(spark, con, module.QUERIES[name], module.SQL[name])


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.SQL])
def test_runs_without_sql(spark, name):
    assert catalogue.QUERIES[name](spark, compare.FOLDER).count() >= 0


def test_entry_lists_everything(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert {"p2_found", "p4_found", "store_dedup_stats"} <= set(e.queries())
    assert e.entry(spark).count() > 0
