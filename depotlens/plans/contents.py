"""Catalogue queries over contents: chunking, codecs, packs, archives and streams; checked by invariants where SQL cannot follow."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens.functions import chunking, codecs
from depotlens.operators import delta
from depotlens.session import Workspace
from depotlens.sources import files
from depotlens.sources.tables import table
from depotlens.streaming import ingest

QUERIES, SQL = {}, {}

#: Sizes for texts, which are short.
SIZES = (256, 1024, 8192)


def _query(text: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = text
        return f

    return register


def _blobs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.encode("text", "UTF-8").alias("content")).where("content is not null")


@_query(None)
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every text."""
    return chunking.chunk_blobs(_blobs(spark, d), "doc_id", "content", [SIZES]).drop("average").withColumnRenamed("key", "doc_id")


@_query("""SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) total, true AS count_fits, true AS gapless FROM documents WHERE text IS NOT NULL AND text <> ''""")
def chunk_partition_check(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of a text cover it without gaps, and are as many as the sizes allow."""
    c = chunk_documents(spark, d).groupBy("doc_id").agg(F.sum("length").alias("total"), F.count("*").alias("n"), F.max(F.col("byte_offset") + F.col("length")).alias("end"))
    least, _, most = SIZES
    fits = (F.col("n") >= F.ceil(F.col("total") / most)) & (F.col("n") <= F.floor(F.col("total") / least) + 1)
    return c.select("doc_id", "total", fits.alias("count_fits"), (F.col("end") == F.col("total")).alias("gapless"))


@_query(None)
def chunk_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of texts by how often they are stored, counted and unique bytes."""
    c = chunk_documents(spark, d).groupBy("checksum").agg(F.count("*").alias("uses"), F.max("length").alias("length"))
    return c.groupBy(F.least("uses", F.lit(10)).alias("uses")).agg(F.count("*").alias("chunks"), F.sum("length").alias("unique_bytes"))


@_query(None)
def chunk_advice(spark: SparkSession, d: str) -> DataFrame:
    """Chunk size that repeats most, among sizes for texts."""
    return chunking.advice(_blobs(spark, d), "doc_id", "content", averages=[512, 1024, 2048, 4096, 8192])


@_query("SELECT doc_id, sha256(text) content_id FROM documents WHERE text IS NOT NULL AND text <> ''")
def reassembled_documents(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut into chunks and put together again; their digests must be the texts'."""
    parts = chunk_documents(spark, d).join(_blobs(spark, d), "doc_id")
    parts = parts.withColumn("part", F.substring(F.col("content"), (F.col("byte_offset") + 1).cast("int"), F.col("length")))
    return delta.reassemble(parts, "doc_id", "chunk_index", "part").select("doc_id", F.sha2("content", 256).alias("content_id"))


@_query("SELECT upload_id, len(missing_chunk_checksums) hashes, true AS same FROM upload_plan WHERE missing_chunk_checksums IS NOT NULL AND len(list_filter(missing_chunk_checksums, lambda x: x IS NULL OR octet_length(x) <> 32)) = 0")
def record_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """File records and hash lists written and read again."""
    lists = table(spark, d, "upload_plan", "upload_id", "missing_chunk_checksums").where("missing_chunk_checksums is not null and not exists(missing_chunk_checksums, x -> x is null or octet_length(x) <> 32)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, same = [], []
            for hashes in b.column("missing_chunk_checksums").to_pylist():
                got = codecs.decode_record(codecs.encode_record(bytes(32), len(hashes), hashes))
                counts.append(len(got[2]))
                same.append(got == (bytes(32), len(hashes), hashes))
            yield pa.RecordBatch.from_arrays([b.column("upload_id"), pa.array(counts, pa.int64()), pa.array(same)], names=["upload_id", "hashes", "same"])

    return lists.mapInArrow(run, "upload_id bigint, hashes bigint, same boolean")


@_query("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) length FROM documents WHERE text IS NOT NULL")
def pack_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Texts packed and read again."""
    packed = files.pack_entries(_blobs(spark, d), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [codecs.read_pack_entry(x) for x in b.column("entry").to_pylist()]
            if out != b.column("content").to_pylist():
                raise codecs.FormatError("a packed text came back changed")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in out], pa.int64())], names=["doc_id", "length"])

    return packed.mapInArrow(run, "doc_id bigint, length bigint")


@_query("SELECT target_release_id release_id, count(*) artifacts, CAST(sum(file_size) AS BIGINT) bytes FROM delta_file WHERE file_size IS NOT NULL AND new_hash IS NOT NULL GROUP BY 1")
def package_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Release packages built from file lists, decoded again and summed."""
    f = table(spark, d, "delta_file", "target_release_id", "path", "new_hash", "file_size").where("file_size is not null and new_hash is not null")
    lists = f.groupBy(F.col("target_release_id").alias("release_id")).agg(F.collect_list(F.struct("path", "new_hash", "file_size")).alias("files"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, sums = [], []
            for rid, rows in zip(b.column("release_id").to_pylist(), b.column("files").to_pylist()):
                p = codecs.Package("1.0", rid, "", artifacts=[codecs.Artifact(r["path"], content_hash=r["new_hash"], length=r["file_size"]) for r in rows])
                got = codecs.decode_package(codecs.encode_package(p)).artifacts
                counts.append(len(got))
                sums.append(sum(a.length for a in got))
            yield pa.RecordBatch.from_arrays([b.column("release_id"), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], names=["release_id", "artifacts", "bytes"])

    return lists.mapInArrow(run, "release_id string, artifacts bigint, bytes bigint")


def _arriving(spark: SparkSession, d: str) -> DataFrame:
    return ingest.read_uploads(spark, f"{d}/upload_chunk_request.parquet*", table(spark, d, "upload_chunk_request").schema)


@_query("SELECT session_id, count(*) chunks_total, CAST(sum(data_length) AS BIGINT) metered_bytes FROM upload_chunk_request GROUP BY 1")
def stream_metering(spark: SparkSession, d: str) -> DataFrame:
    """Metering by a stream over the uploads, run to its end."""
    uploads = _arriving(spark, d)
    return ingest.run_to_table(ingest.metered(uploads), "metering", "complete")


@_query("SELECT checksum, min(request_id) request_id FROM upload_chunk_request WHERE checksum IS NOT NULL GROUP BY 1")
def stream_append_new(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written by the idempotent batch sink, with the request that brought each."""
    at = Workspace(spark).path("stream")
    uploads = _arriving(spark, d)
    ingest.append_new(uploads, f"{at}/store", f"{at}/progress").awaitTermination()
    return spark.read.parquet(f"{at}/store").select("checksum", "request_id")
