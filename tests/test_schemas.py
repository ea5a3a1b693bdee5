import os

import pytest

import compare
from depotlens import schemas

pytestmark = pytest.mark.skipif(not os.path.isdir(compare.FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", schemas.names())
def test_tables_are_as_declared(spark, name):
    assert schemas.deviations(spark.read.parquet(f"{compare.FOLDER}/{name}.parquet"), name) == []


def test_deviations(spark):
    df = spark.createDataFrame([], "checksum string, length int, more int")
    assert schemas.deviations(df, "shared_chunk") == ["checksum", "label"]
