import pytest
from pyspark.sql import functions as F

from depotlens.functions import columns as c
from depotlens.operators import delta, prefix_sum, storage
from depotlens.operators import querying as q


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "Ann", 30, "x"), (2, "bob", None, "y"), (3, "Cid", 25, "x"), (4, None, 30, None)], "id int, name string, age int, team string")


@pytest.mark.parametrize("spec, ids", [
    (None, [1, 2, 3, 4]), ({}, [1, 2, 3, 4]), ({"age": {"eq": 30}}, [1, 4]), ({"age": {"eq": None}}, [2]), ({"name": {"neq": None}}, [1, 2, 3]), ({"age": {"gte": 25, "lt": 30}}, [3]),
    ({"or": [{"name": {"contains": "i"}}, {"and": [{"team": {"in": ["y"]}}]}]}, [2, 3]), ({"not": {"age": {"gt": 26}}}, [3]), ({"name": {"startsWith": "A"}}, [1]), ({"name": {"endsWith": "b"}}, [2]),
    ({"team": {"nin": ["x"]}}, [2]), ({"age": {"lte": 25}}, [3]), ({"team": {"neq": "x"}}, [2, 4]),
])
def test_filters(people, spec, ids):
    assert sorted(r.id for r in people.where(q.predicate(spec)).collect()) == ids


def test_unknown_operator():
    with pytest.raises(ValueError):
        q.predicate({"a": {"like": 1}})


def test_pages_walk_the_whole_table(spark):
    df = spark.range(103).select("id", (F.col("id") % 5).alias("k"))
    order, after, seen = [{"k": "DESC"}, {"id": "ASC"}], None, []
    while True:
        page = q.keyset_page(df, order, 10, after).orderBy("page_row").collect()
        seen += [(r.k, r.id) for r in page]
        if not page or not page[0].has_next:
            break
        after = {"k": page[-1].k, "id": page[-1].id}
    assert seen == sorted(((i % 5, i) for i in range(103)), key=lambda x: (-x[0], x[1]))
    assert [r.id for r in q.offset_page(df.select("id"), [{"id": "ASC"}], 0, 3).collect()] == [0, 1, 2]
    assert [r.id for r in q.offset_page(df.select("id"), [{"id": "DESC"}], 2, 3).collect()] == [99, 98, 97]


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(100).select("id", F.lit("x").alias("a"), F.lit("y").alias("b")).write.parquet(str(tmp_path / "t"))
    df = q.select_fields(spark.read.parquet(str(tmp_path / "t")).where(q.predicate({"id": {"gt": 90}})), ["id"])
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThan(id,90)" in plan and "ReadSchema: struct<id:bigint>" in plan


def test_sets(spark):
    a = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string")
    b = spark.createDataFrame([(2, "new"), (3, "new")], "k int, v string")
    assert {(r.k, r.v) for r in q.union_first(a, b, ["k"]).collect()} == {(1, "old"), (2, "old"), (3, "new")}
    assert {(r.k, r.v) for r in q.upsert(a, b, ["k"]).collect()} == {(1, "old"), (2, "new"), (3, "new")}
    assert {(r.k, r.v) for r in q.upsert(a, b, ["k"], keep=["v"]).collect()} == {(1, "old"), (2, "old"), (3, "new")}
    assert q.exactly_one(a.where("k = 1")).count() == 1
    with pytest.raises(Exception, match="more than one row"):
        q.exactly_one(a).collect()
    assert {r.v for r in q.first_of(a.union(b), [F.lit(1)], [F.col("k").desc(), F.col("v")]).collect()} == {"new"}
    assert [r["rank"] for r in q.top_per_group(a.union(b), ["v"], [F.col("k").desc()], 1).collect()] == [1, 1]


def test_running_sums_and_batches(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"), F.col("id").alias("v"), F.floor(F.col("id") / 50).alias("b"))
    got = {r.id: r.s for r in prefix_sum.running_sum(df, ["g"], "b", ["id"], "v", "s").collect()}
    assert got == {i: sum(range(i % 3, i, 3)) for i in range(1000)}
    assert {r.id: r.batch for r in q.batches(df, F.col("b"), ["id"], 70).collect()} == {i: i // 70 for i in range(1000)}


def one(spark, column, schema, *values):
    return [r[0] for r in spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema).select(column).collect()]


def test_scalar_functions(spark):
    p, n = F.col("p"), F.col("n")
    assert one(spark, c.normal_path(p), "p string", "\\\\a\\b", "/x", None) == ["a/b", "x", None]
    assert one(spark, c.format_id(p), "p string", "a.ZIP", "a.tar.gz", "dir.zip/file", "x.zst", "none") == ["zip", "gzip", "file", "zstd", "file"]
    assert one(spark, c.bytes_human(n), "n bigint", 0, 1, 1023, 1024, 1536, 5 << 20, 3 << 40, 1 << 60) == ["0 Mb", "1 byte", "1023 byte", "1 Kb", "1.5 Kb", "5 Mb", "3 Tb", "1 Eb"]
    assert one(spark, c.power_of_two_at_least(n), "n bigint", 0, 1, 2, 3, 1024, 1025) == [1, 1, 2, 4, 1024, 2048]
    assert one(spark, c.url_path(p), "p string", "a b/ü?") == ["a%20b/%C3%BC%3F"]
    assert one(spark, c.tenant_slug(p, "depot.example"), "p string", "Team-1.depot.example:443", "depot.example", "a.b.depot.example", "x.other") == ["team-1", None, None, None]
    assert one(spark, c.locator_parts(p)["entry"], "p string", "zip|a.zip|in|ner", "zip|a") == ["in|ner", None]
    assert one(spark, c.revision_version(p), "p string", "tags/rel-42/", "tags/rel") == ["1.0.42", None]
    assert one(spark, c.is_secret(p), "p string", "Db:PassWord", "apiKEY", "name") == [True, True, False]
    assert one(spark, c.base64url_text(p), "p string", "aGk_", "aGVsbG8") == ["hi?", "hello"]
    assert one(spark, c.json_or_raw(p), "p string", '{"b": 1}', "no json") == ['{"b":1}', "no json"]
    natural = sorted(["v10", "V2", "v1.10", "v1.9"], key=lambda s: one(spark, c.natural_key(p), "p string", s)[0])
    assert natural == ["v1.9", "v1.10", "V2", "v10"]
    long = ["a99", "a0123456789012", "a1234567890123", "a1234567890124", "a" + "9" * 40, "a1" + "0" * 40]
    assert sorted(reversed(long), key=lambda s: one(spark, c.natural_key(p), "p string", s)[0]) == long
    assert one(spark, c.natural_key(p), "p string", "x007") == one(spark, c.natural_key(p), "p string", "X7")
    keep = [x for x in ["src/a.cs", "SRC/b/c.cs", "x/.git/h", "src/t.tmp"] if one(spark, c.glob_match(p, ["src/**"], ["**.tm?"]), "p string", x)[0]]
    assert keep == ["src/a.cs", "SRC/b/c.cs"]


def test_hash_order(spark):
    import random
    import struct

    digests = [random.Random(i).randbytes(32) for i in range(40)] + [bytes(31) + b"\x01", b"\x01" + bytes(31)]
    got = [bytes(r[0]) for r in spark.createDataFrame([(d,) for d in digests], "d binary").orderBy(c.order_key(F.col("d"))).collect()]
    assert got == sorted(digests, key=lambda d: struct.unpack("<4Q", d))


def test_multiset_delta(spark):
    schema = "pair int, component int, idx bigint, chunk_id bigint"
    base = spark.createDataFrame([(1, 1, 0, 7), (1, 1, 1, 7), (1, 1, 2, 8)], schema)
    target = spark.createDataFrame([(1, 1, 0, 7), (1, 1, 1, 9), (1, 1, 2, 7), (1, 1, 3, 7), (1, 2, 0, 8)], schema)
    lengths = spark.createDataFrame([(7, 10), (8, 5)], "chunk_id bigint, length bigint")
    kept = spark.createDataFrame([(1, 3, 0, 7)], schema)
    sized = lambda x: x.join(lengths, "chunk_id", "left")
    got = sorted((r.component, r.idx, r.byte_offset, r.source) for r in delta.delta_chunks(sized(base.union(kept)), sized(target.union(kept))).collect())
    assert got == [(1, 0, 0, "existing"), (1, 1, 10, "new"), (1, 2, 10, "existing"), (1, 3, 20, "new")]  # none of the new file 2 and the kept file 3


def test_storage(spark, tmp_path):
    e = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 7)], "k string, gen int, v int")
    assert {(r.k, r.v) for r in storage.newest(e, "k", "gen", ["v"]).collect()} == {("a", 6), ("b", 7)}
    assert {(r.k, r.v) for r in storage.rebuild(e, "k", ["gen"], ["v"]).collect()} == {("a", 5), ("b", 7)}
    assert [r.k for r in storage.insert_new(spark.createDataFrame([("a",)], "k string"), e, "k", ["gen"]).collect()] == ["b"]
    out = str(tmp_path / "t")
    storage.replace_partitions(spark.createDataFrame([(1, "x"), (2, "x")], "tag int, v string"), out, ["tag"])
    storage.replace_partitions(spark.createDataFrame([(2, "y")], "tag int, v string"), out, ["tag"])
    assert {(r.tag, r.v) for r in spark.read.parquet(out).collect()} == {(1, "x"), (2, "y")}
    assert spark.range(1).select(storage.compaction_level(F.lit(4096 * 16)), storage.compaction_level(F.lit(5))).first()[:] == (1, 0)


def test_figures_beyond_a_bigint(spark):
    from depotlens.plans.relational import chunk_figures

    big = spark.range(40).select(F.lit(1 << 40).alias("length"))
    r = chunk_figures(big.union(spark.range(40).select(F.lit(3 << 40))), "length").first()
    assert (r.chunk_count, r.logical_bytes, r.avg_length, r.deviation, r.least, r.most) == (80, 160 << 40, 2 << 40, 1 << 40, 1 << 40, 3 << 40)
    assert chunk_figures(big.limit(0), "length").first().chunk_count == 0
