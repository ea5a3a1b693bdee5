"""The registered queries run over whole tables and agree with their SQL where there is some."""

import os

import pytest

import compare
from depotlens.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(compare.FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return compare.connection()


@pytest.mark.parametrize("name", list(queries.SQL))
def test_same_as_sql(spark, con, name):
    compare.same(spark, con, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.SQL])
def test_runs_without_sql(spark, name):
    assert queries.QUERIES[name](spark, compare.FOLDER).count() > 0
