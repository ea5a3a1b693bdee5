"""Operators of packs, the tiered index, incremental chunks, lookups, pages and session states, each against a plain version."""

import datetime
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from depotlens.functions import chunking, codecs
from depotlens.functions import columns as c
from depotlens.operators import index_store, metrics, storage
from depotlens.operators import querying as q
from depotlens.sources import packs
from depotlens.streaming import ingest


def blobs(spark, n=60, seed=1):
    rnd = random.Random(seed)
    rows = [(i, rnd.randbytes(rnd.randrange(0, 3000))) for i in range(n)] + [(n, None)]
    return rows, spark.createDataFrame(rows, "k int, content binary").repartition(3)


def test_packs_rotate_and_give_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packs, "RANGE_BYTES", 4096)  # a file is read by many tasks
    rows, df = blobs(spark)
    folder = f"file://{tmp_path}/p"
    index = packs.write_packs(df, "k", "content", folder, rotate=8000)
    files = list((tmp_path / "p").glob("*.pack"))
    assert len(files) > 5 and all(f.stat().st_size <= 8000 for f in files)
    want = {k: v for k, v in rows if v is not None}
    assert {r.key: bytes(r.content) for r in packs.read_entries(index).collect()} == want
    assert sorted(bytes(r.content) for r in packs.scan_packs(spark, folder).collect()) == sorted(want.values())
    headers = {(r.file.split("/")[-1], r.byte_offset, r.stored_length, r.length) for r in packs.pack_headers(spark, folder).collect()}
    assert headers == {(r.file.split("/")[-1], r.byte_offset, r.stored_length, r.length) for r in index.collect()}
    asked = spark.createDataFrame([(3,), (3,), (7,), (999,)], "k int")
    assert {r.key: bytes(r.content) for r in packs.bulk_get(asked, index, "k").collect()} == {3: want[3], 7: want[7]}
    kept = packs.rewrite_packs(index, f"file://{tmp_path}/q", lambda x: F.octet_length(x) > 1000)
    assert {r.key for r in kept.collect()} == {k for k, v in want.items() if len(v) > 1000}
    rebuilt = packs.rebuild_index(spark, f"file://{tmp_path}/q", lambda x: F.sha2(x, 256))
    assert rebuilt.count() == len({v for v in want.values() if len(v) > 1000})
    assert packs.write_packs(df.limit(0), "k", "content", f"file://{tmp_path}/none").count() == 0
    assert packs.row_count(spark, str(tmp_path / "p")).first().rows == len(want)


def test_damaged_packs_are_errors(spark, tmp_path):
    _, df = blobs(spark, 4)
    folder = f"file://{tmp_path}/p"
    index = packs.write_packs(df.coalesce(1), "k", "content", folder)
    file = next((tmp_path / "p").glob("*.pack"))
    data = file.read_bytes()
    file.write_bytes(data[:-5])
    for plan in (packs.scan_packs(spark, folder), packs.read_entries(index)):
        with pytest.raises(Exception, match="cut off"):
            plan.collect()
    file.write_bytes(data[:40] + bytes([data[40] ^ 1]) + data[41:])
    with pytest.raises(Exception, match="mismatch"):
        packs.read_entries(index).collect()


def test_index_through_its_tiers(spark, tmp_path, monkeypatch):
    for name, value in (("FLUSH", 20), ("FAN_IN", 2)):
        monkeypatch.setattr(index_store, name, value)
    rnd = random.Random(4)
    pool = [rnd.randbytes(32) for _ in range(40)]
    newest = {}
    for generation in range(1, 8):
        rows = [(rnd.choice(pool), rnd.randrange(100)) for _ in range(14)] + [(None, 1)]
        index = index_store.PackIndex(spark, str(tmp_path / "i"), "v int")  # opened anew each time
        index.add(spark.createDataFrame(rows, "checksum binary, v int"))
        best = {}
        for k, v in rows:
            if k is not None:
                best[k] = max(v, best.get(k, -1))
        newest |= {k: (generation, v) for k, v in best.items()}
    assert index.runs and len(index.levels) > 1
    assert {bytes(r.checksum): (r.generation, r.v) for r in index.entries().collect()} == newest
    asked = spark.createDataFrame([(k,) for k in pool[:25]] + [(None,), (b"none",), (pool[0],)], "checksum binary")
    assert {bytes(r.checksum): (r.generation, r.v) for r in index.find(asked).collect()} == {k: v for k, v in newest.items() if k in pool[:25]}


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**30), st.integers(0, 6000), st.lists(st.integers(1, 900), min_size=1, max_size=30))
def test_chunks_do_not_depend_on_the_pieces(seed, n, steps):
    data, sizes = random.Random(seed).randbytes(n), (64, 256, 1024)
    chunker, got, at, i = chunking.StreamingChunker(*sizes), [], 0, 0
    while at < n:
        got += chunker.append(data[at : at + steps[i % len(steps)]])
        at, i = at + steps[i % len(steps)], i + 1
    got += chunker.finish()
    assert [a + z for _, a, z, _ in got] == chunking.cut_points(data, *sizes)
    assert all(chunking.DIGESTS["sha256"](data[a : a + z]) == h for _, a, z, h in got)
    known = {h for _, _, _, h in got[::2]}
    again = chunking.StreamingChunker(*sizes, known=set(known))
    fresh = again.append(data) + again.finish()
    assert {h for _, _, _, h in fresh} == {h for _, _, _, h in got} - known


def test_digests_are_injected(spark):
    _, df = blobs(spark, 5)
    for digest in ("blake2b", lambda b: b[:4]):
        out = chunking.chunk_blobs(df, "k", "content", [(64, 256, 1024)], digest).first()
        assert len(out.checksum) == (32 if digest == "blake2b" else 4)
    maps = chunking.chunk_blobs(df, "k", "content", [(64, 256, 1024)]).withColumnRenamed("key", "k")
    loaded = chunking.load_chunks(df, maps, "k", "content")
    assert loaded.agg(F.sum(F.octet_length("data"))).first()[0] == df.agg(F.sum(F.octet_length("content"))).first()[0]
    for wrong, what in ((maps.withColumn("length", F.col("length") + 5000), "beyond"), (maps.withColumn("checksum", F.lit(b"x")), "another checksum")):
        with pytest.raises(Exception, match=what):
            chunking.load_chunks(df, wrong, "k", "content").collect()


def test_batches_of_records():
    h = [bytes([i]) * 32 for i in range(5)]
    for sent in ([], [(h[0], 0, [])], [(h[0], 7, [h[1], h[2], h[1]]), (h[3], 1 << 40, [h[2]]), (h[4], 0, [])]):
        assert codecs.decode_batch(codecs.encode_batch(sent)) == sent
    with pytest.raises(codecs.FormatError):
        codecs.decode_batch(codecs.encode_batch([(h[0], 1, [h[1]])]) + b"x")


def test_lookup_that_fails(spark):
    found = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    rows = spark.createDataFrame([("a", 9), ("b", 8), ("a", 7)], "k string, v2 int")
    assert sorted((r.k, r.v) for r in q.lookup_or_fail(rows, found, ["k"], "v").collect() if r.k == "a") == [("a", 1), ("a", 1)]
    with pytest.raises(Exception, match="no chunk: zz"):
        q.lookup_or_fail(rows.union(spark.createDataFrame([("zz", 1)], rows.schema)), found, ["k"], "v", "chunk").collect()


def test_connection(spark):
    df = spark.range(30).select("id", (F.col("id") % 3).alias("g"))
    first = q.connection(df, [{"id": "ASC"}], 4, where=F.col("g") == 1).orderBy("page_row").collect()
    assert [r.id for r in first] == [1, 4, 7, 10] and all((r.has_next, r.has_previous, r.total_count, r.unfiltered_count) == (True, False, 10, 30) for r in first)
    assert first[0].cursor == first[3].start_cursor and first[3].cursor == first[0].end_cursor
    last = q.connection(df, [{"id": "ASC"}], 4, {"id": 22}, F.col("g") == 1).collect()
    assert sorted(r.id for r in last) == [25, 28] and not last[0].has_next and last[0].has_previous
    assert q.connection(df, [{"id": "ASC"}], 4, {"id": 99}).count() == 0


def test_versions_names_and_masks(spark):
    one = lambda e: spark.range(1).select(e).first()[0]
    assert one(c.revision_version(F.lit("/t/a-17/"), True)) == "1.0.17" and one(c.revision_version(F.lit("/t/a"))) is None
    with pytest.raises(Exception, match="no revision"):
        one(c.revision_version(F.lit("/t/a"), True))
    assert [one(c.release_file_name(F.lit(p), F.lit("bin"))) for p in ("bin/x/y", "bin", "a/bin/y")] == ["x/y", "bin", "a/bin/y"]
    assert one(c.path_prefixes(F.lit("a/b/c"))) == ["a", "a/b", "a/b/c"]
    assert [one(c.masked(F.lit(n), F.lit(v))) for n, v in (("a:apiKey", "x"), ("a:apiKey", ""), ("a:name", "x"))] == ["***", "", "x"]


def test_content_store(spark, tmp_path):
    store = storage.ContentStore(spark, str(tmp_path / "s"), digits=1)
    df = spark.createDataFrame([(b"a",), (b"b",), (b"a",), (None,), (b"",)], "content binary")
    ids = df.where("content is not null").select(F.sha2("content", 256).alias("content_id")).distinct()
    assert store.get(ids).count() == 0
    store.put(df)
    store.put(df)
    assert sorted(bytes(r.content) for r in store.get(ids).collect()) == [b"", b"a", b"b"]
    store.delete(ids.where(F.col("content_id") == F.sha2(F.lit(b"a"), 256)))
    assert sorted(bytes(r.content) for r in store.get(ids).collect()) == [b"", b"b"]
    store.delete(ids)
    assert store.get(ids).count() == 0


def test_session_states_over_many_triggers(spark, tmp_path):
    start = datetime.datetime(2025, 1, 1)
    minutes = {"a": [0, 10, 39, 70, 71], "b": [5, None, 34], "c": [None]}
    rows = [(i, s, None if t is None else start + datetime.timedelta(minutes=t)) for i, (s, t) in enumerate((s, t) for s, ts in minutes.items() for t in ts)]
    for i, row in enumerate(rows):  # a file, and a trigger, for each upload
        spark.createDataFrame([row], "request_id bigint, session_id string, sent_at timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"f{i}"))
    seen = ingest.Progress()
    spark.streams.addListener(seen)
    try:
        stream = ingest.read_uploads(spark, str(tmp_path / "in" / "*"), "request_id bigint, session_id string, sent_at timestamp", max_files=4)
        got = {r.request_id: (r.outcome, r.state) for r in ingest.run_to_table(ingest.session_outcomes(stream), "outcomes").collect()}
    finally:
        spark.streams.removeListener(seen)
    assert [got[i][0] for i in range(9)] == ["accepted", "accepted", "accepted", "late", "late", "accepted", "invalid", "accepted", "invalid"]
    assert got[4][1] == ingest.EXPIRED and got[7][1] == ingest.IN_PROGRESS and got[8][1] == ingest.CREATED


def test_uniques_of_a_session(spark, tmp_path):
    spark.createDataFrame([("a", b"1"), ("a", b"1"), ("b", b"1"), ("a", None)], "session_id string, checksum binary").write.parquet(str(tmp_path / "in"))
    stream = ingest.read_uploads(spark, str(tmp_path / "in"), "session_id string, checksum binary")
    assert sorted((r.session_id, bytes(r.checksum)) for r in ingest.run_to_table(ingest.unique_in_session(stream), "u").collect()) == [("a", b"1"), ("b", b"1")]


def test_logical_sizes_prefer_the_explicit_length(spark):
    chunks = lambda *n: [(bytes([i]), x) for i, x in enumerate(n)]
    rows = [("s", b"f", 10, chunks(3, 4)), ("s", b"f", None, None), ("s", b"g", None, None), ("t", b"h", None, chunks(5, None)), ("t", None, 9, None)]
    df = spark.createDataFrame(rows, "store_id string, digest binary, file_size bigint, chunks array<struct<checksum binary, length int>>")
    got = {r.store_id: (r.total_logical_bytes, r.unique_file_bytes, r.file_definitions, r.referenced_chunk_bytes) for r in metrics.logical_sizes(df).collect()}
    assert got == {"s": (17, 10, 2, 7), "t": (5, 5, 1, 5)}
