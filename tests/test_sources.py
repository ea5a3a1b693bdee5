import io
import tarfile
import zipfile

import pytest
import zstandard
from pyspark.sql import functions as F

from depotlens.functions import chunking, codecs
from depotlens.sources import files, packs
from depotlens.streaming import ingest


def test_folder_scan(spark, tmp_path):
    for p in ("app/a.bin", "app/.git/config", "lib/b.bin", "c.bin"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"12345")
    assert {(r.path, r.component, r.length) for r in files.scan_folder(spark, str(tmp_path), {"app": "App", "lib": "Lib"}).collect()} == {("app/a.bin", "App", 5), ("lib/b.bin", "Lib", 5)}
    assert files.scan_folder(spark, str(tmp_path)).count() == 3
    (tmp_path / "x.pack").write_bytes(b"1")
    assert {(r.kind, r.files) for r in files.storage_scan(spark, str(tmp_path)).collect()} == {("pack", 1), ("other", 3)}


def test_component_maps(spark, tmp_path):
    p = tmp_path / "map.txt"
    p.write_text("# comment\n\nsrc\\app : App\nbad line\n/lib/:Lib:x\n")
    assert {(r.folder, r.name) for r in files.component_map(spark, str(p)).collect()} == {("src/app", "App"), ("lib", "Lib:x")}
    with pytest.raises(Exception, match="bad line"):
        files.component_map(spark, str(p), strict=True).collect()


def test_listings(spark):
    xml = '<lists><list path="u"><entry kind="file"><name>a/b.txt</name><size>12</size><commit revision="7"><author>me</author><date>2025-01-01T00:00:00Z</date></commit></entry><entry kind="dir"><name>d</name><commit revision="8"/></entry></list></lists>'
    rows = spark.createDataFrame([(xml,)], "x string").select(F.explode(files.listing_entries(F.col("x"))).alias("e")).select("e.*").collect()
    assert [(r.kind, r.name, r["size"], r.revision) for r in rows] == [("file", "a/b.txt", 12, 7), ("dir", "d", None, 8)]
    log = '<log><logentry revision="9"><author>me</author><date>2025-01-01T00:00:00Z</date><msg>done</msg></logentry></log>'
    assert spark.createDataFrame([(log,)], "x string").select(files.log_entries(F.col("x"))[0]["message"]).first()[0] == "done"


def test_archives(spark):
    def make(entries):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n, d in entries:
                z.writestr(n, d)
        return out.getvalue()

    rows = [("a.zip", make([("x/", b""), ("x/a.txt", b"hello"), ("empty", b"")])), ("b.jar", make([("m", b"1")])), ("c.zip", make([("e", b"")])), ("d.zip", b"no archive"), ("n.zip", None)]
    df = spark.createDataFrame(rows, "file string, data binary")
    entries = files.archive_entries(df, "file", "data", with_content=True)
    assert {(r.archive, r.entry_path, r.length, r.is_dir) for r in entries.collect()} == {("a.zip", "x/", 0, True), ("a.zip", "x/a.txt", 5, False), ("a.zip", "empty", 0, False), ("b.jar", "m", 1, False), ("c.zip", "e", 0, False)}
    assert bytes(entries.where("entry_path = 'x/a.txt'").first().content) == b"hello"
    plans = {r.archive: (r.byte_perfect, r.store_opaque, r.reconstruction, r.selected) for r in files.plan_archives(df, entries, "file").collect()}
    assert plans == {"a.zip": (False, False, "semantic", 1), "b.jar": (True, True, "none", 0), "c.zip": (False, True, "none", 0), "d.zip": (False, True, "none", 0), "n.zip": (False, True, "none", 0)}
    assert "a.zip!/x/a.txt" in {r.logical_path for r in files.logical_entries(entries).collect()}
    assert files.recipe([("a\\b", False)]) == b'{"Entries":[{"FullName":"a/b","IsDirectory":false}]}'


def test_tar_streams(spark):
    df = spark.createDataFrame([(1, "b/x", b"22"), (1, "a", b"1"), (2, "c", b"")], "r int, p string, d binary")
    got = {r["group"]: bytes(r.tar_zst) for r in files.tar_stream(df, "r", "p", "d").collect()}
    tar = tarfile.open(fileobj=io.BytesIO(zstandard.ZstdDecompressor().decompress(got[1], max_output_size=1 << 20)))
    assert [(m.name, m.size) for m in tar.getmembers()] == [("a", 1), ("b/x", 2)] and len(got) == 2


def test_packs(spark, tmp_path):
    (tmp_path / "0").mkdir()
    (tmp_path / "0" / "one.pack").write_bytes(b"".join(map(codecs.encode_pack_entry, [b"a", b"bb" * 100])))
    (tmp_path / "two.pack").write_bytes(codecs.encode_pack_entry(b"c"))
    spark.dataSource.register(files.PackSource)
    by_source = {(r.byte_offset, bytes(r.content)) for r in spark.read.format("pack").load(str(tmp_path)).collect()}
    by_scan = {(r.byte_offset, bytes(r.content)) for r in packs.scan_packs(spark, str(tmp_path)).collect()}
    assert by_source == by_scan and {x for _, x in by_scan} == {b"a", b"bb" * 100, b"c"}
    packed = files.pack_entries(spark.createDataFrame([(1, b"xyz"), (2, None)], "i int, d binary"), "d").collect()
    assert codecs.read_pack_entry(bytes(packed[0].entry)) == b"xyz" and packed[1].entry is None


def test_chunking_in_spark(spark):
    import random

    data = random.Random(1).randbytes(30_000)
    df = spark.createDataFrame([(1, data), (2, data), (3, b""), (4, None)], "k int, d binary")
    chunks = chunking.chunk_blobs(df, "k", "d", [(64, 256, 2048)])
    assert chunks.where("key = 1").count() == len(chunking.cut_points(data, 64, 256, 2048)) and chunks.where("key > 2").count() == 0
    known = chunks.where("key = 1 and chunk_index < 5").select("checksum")
    assert chunking.new_chunks(chunks, known).count() == chunks.where("key = 1").count() - 5
    for target in ("dedupe", "throughput", "balanced"):
        advice = chunking.advice(df, "k", "d", target, [256, 512, 1024]).collect()
        assert len(advice) == 3 and sum(r.recommended for r in advice) == 1
    assert all(r.dedup_ratio == 2.0 for r in chunking.advice(df, "k", "d", "chunk_count", [256, 512]).collect())


SCHEMA = "request_id bigint, session_id string, checksum binary, data_length int, sent_at timestamp"


@pytest.fixture
def uploads(spark, tmp_path):
    rows = [(1, "s", b"a", 10, "2025-01-01 00:00:00"), (2, "s", b"a", 10, "2025-01-01 00:10:00"), (3, "s", b"b", 5, "2025-01-01 00:35:00"), (4, "s", b"c", 1, "2025-01-01 02:00:00"), (5, "t", b"a", None, "2025-01-01 00:05:00"), (6, "t", None, 3, "2025-01-01 00:06:00")]
    df = spark.createDataFrame(rows, "request_id bigint, session_id string, checksum binary, data_length int, sent string").withColumn("sent_at", F.to_timestamp("sent")).drop("sent")
    for i in range(3):
        df.where(F.col("request_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), df


def test_streams_agree_with_batches(spark, uploads):
    folder, df = uploads
    read = lambda: ingest.read_uploads(spark, folder, SCHEMA)
    metered = {(r.session_id, r.chunks_total, r.metered_bytes) for r in ingest.run_to_table(ingest.metered(read()), "metered", "complete").collect()}
    assert metered == {("s", 4, 26), ("t", 2, 3)}
    unique = {(r.session_id, bytes(r.checksum)) for r in ingest.run_to_table(ingest.unique_uploads(read()), "unique_rows").collect()}
    assert unique == {("s", b"a"), ("s", b"b"), ("s", b"c"), ("t", b"a")}
    windows = sorted((r.session_id, r.uploads) for r in ingest.run_to_table(ingest.sessions(read()), "windows", "complete").collect())
    assert windows == [("s", 1), ("s", 3), ("t", 2)]


def test_repeated_batches_write_once(spark, uploads, tmp_path):
    folder, _ = uploads
    store = str(tmp_path / "store")
    for attempt in ("one", "two"):  # the second run starts without the first one's progress
        ingest.append_new(ingest.read_uploads(spark, folder, SCHEMA, max_files=1), store, str(tmp_path / attempt)).awaitTermination()
    got = sorted(bytes(r.checksum) for r in spark.read.parquet(store).collect())
    assert got == [b"a", b"b", b"c"]
