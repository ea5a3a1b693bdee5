"""Runs registered queries beside their SQL on the same Parquet files."""

import datetime
import math
import os

import duckdb

FOLDER = os.environ.get("DEPOT_TEST_DIR", "/root/testdata/sf0.001")


def connection(folder=FOLDER):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(folder):
        p = os.path.join(folder, f)
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return con


def plain(v):
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v).hex()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([repr([plain(r[i]) for i in order]) for r in data])


def same(spark, con, query, sql, folder=FOLDER):
    df = query(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    assert got == rows(names, result.fetchall())
