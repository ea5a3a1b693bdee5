"""Packs on a shared file system: written with rotation, walked by their headers, read in ranges, rewritten by a filter.

A pack is never held whole: headers are walked by seeking, contents are read entry by entry in ranges of a file, and a large pack is read
by many tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlens.functions import codecs
from depotlens.functions.arrow import SLICE_BYTES, slices

#: A pack is closed once it has this many bytes.
ROTATE_BYTES = 4 << 30
#: Bytes of a pack that one task reads.
RANGE_BYTES = 64 << 20


def filesystem(path: str):
    """The Arrow file system of a path or URI, and the path in it."""
    import pyarrow.fs as pf

    uri = path.replace("s3a://", "s3://")
    return pf.FileSystem.from_uri("file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def write_packs(rows: DataFrame, key: str, content: str, folder: str, rotate: int = ROTATE_BYTES) -> DataFrame:
    """Packs a binary column below ``folder``, a new file whenever one has ``rotate`` bytes; gives the index, a written table
    (key, file, byte_offset, stored_length, length).  Null contents are left out.  Files that a failed attempt left are in no index."""
    run_id = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        context = TaskContext.get()
        stem, number, out, at, done = f"{run_id}-{context.partitionId():06d}-{context.taskAttemptId()}", 0, None, 0, []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal out, at, number, done
            if out is not None:
                out.close()
                keys, offsets, stored, lengths = zip(*done)
                name = f"{folder.rstrip('/')}/{stem}-{number}.pack"
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array([name] * len(done)), pa.array(offsets, pa.int64()), pa.array(stored, pa.int32()), pa.array(lengths, pa.int64())], names=["key", "file", "byte_offset", "stored_length", "length"])
                out, at, number, done = None, 0, number + 1, []

        for b in slices(batches, "content"):
            for i, data in enumerate(b.column("content").to_pylist()):
                entry = codecs.encode_pack_entry(data)
                if at and at + len(entry) > rotate:
                    yield from close()
                if out is None:
                    out = fs.open_output_stream(f"{root.rstrip('/')}/{stem}-{number}.pack")
                out.write(entry)
                done.append((b.column("key").slice(i, 1), at, len(entry), len(data)))
                at += len(entry)
        yield from close()

    source = rows.select(F.col(key).alias("key"), F.col(content).alias("content")).where("content is not null")
    schema = T.StructType([T.StructField("key", source.schema["key"].dataType), T.StructField("file", T.StringType()), T.StructField("byte_offset", T.LongType()), T.StructField("stored_length", T.IntegerType()), T.StructField("length", T.LongType())])
    source.mapInArrow(run, schema).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/index-{run_id}")
    return rows.sparkSession.read.schema(schema).parquet(f"{folder.rstrip('/')}/index-{run_id}")


def pack_headers(spark: SparkSession, folder: str) -> DataFrame:
    """(file, byte_offset, stored_length, length) of every entry of the packs below a folder, from headers alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("path").to_pylist():
                fs, path = filesystem(name)
                with fs.open_input_file(path) as f:
                    rows = list(codecs.walk_pack(f.read_at, f.size()))
                cols = list(zip(*rows)) if rows else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())], names=["file", "byte_offset", "stored_length", "length"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pack").load(folder).select("path")
    return files.repartition("path").mapInArrow(run, "file string, byte_offset bigint, stored_length int, length bigint")


def read_entries(entries: DataFrame, check: bool = True) -> DataFrame:
    """Appends ``content`` to rows with file, byte_offset and stored_length; magic, version, checksum and length are checked, and an entry that
    ends early is an error.  Entries are read in order of their place, a range of a file in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for b in batches:
            held, start, size = [], 0, 0
            for i, (file, at, n) in enumerate(zip(*(b.column(c).to_pylist() for c in ("file", "byte_offset", "stored_length")))):
                if file != name:
                    fs, path = filesystem(file)
                    name, f = file, fs.open_input_file(path)
                held.append(codecs.read_pack_entry(f.read_at(n, at), 0, check))
                size += len(held[-1])
                if size > SLICE_BYTES or i + 1 == b.num_rows:
                    part = b.slice(start, len(held))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], names=[*b.schema.names, "content"])
                    held, start, size = [], i + 1, 0

    ranges = entries.repartition("file", F.floor(F.col("byte_offset") / RANGE_BYTES)).sortWithinPartitions("file", "byte_offset")
    return ranges.mapInArrow(run, T.StructType([*entries.schema.fields, T.StructField("content", T.BinaryType())]))


def scan_packs(spark: SparkSession, folder: str, check: bool = True) -> DataFrame:
    """(file, byte_offset, stored_length, length, content) of all entries; a pack of any size spreads over tasks."""
    return read_entries(pack_headers(spark, folder), check)


def bulk_get(keys: DataFrame, index: DataFrame, key: str = "key", check: bool = True) -> DataFrame:
    """Contents of many keys: keys joined to their place, read where they lie.  Unknown keys give no row."""
    return read_entries(index.join(keys.select(F.col(key).alias("key")).distinct(), "key", "left_semi"), check)


def rebuild_index(spark: SparkSession, folder: str, key: Callable[[Column], Column]) -> DataFrame:
    """Index from the packs alone: ``key`` makes the key of a content; its first occurrence by place wins."""
    found = scan_packs(spark, folder).select(key(F.col("content")).alias("key"), "file", "byte_offset", "stored_length", "length")
    first = found.groupBy("key").agg(F.min(F.struct("file", "byte_offset", "stored_length", "length")).alias("e"))
    return first.select("key", "e.*")


def rewrite_packs(index: DataFrame, folder: str, keep: Callable[[Column], Column], rotate: int = ROTATE_BYTES) -> DataFrame:
    """New packs with the entries whose content ``keep`` holds for; gives their index.  The old packs stay until the caller drops them."""
    return write_packs(read_entries(index).where(keep(F.col("content"))), "key", "content", folder, rotate)


def row_count(spark: SparkSession, folder: str) -> DataFrame:
    """(files, rows) of the Parquet files below a folder, from their footers alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for b in batches:
            counts = []
            for name in b.column("path").to_pylist():
                fs, path = filesystem(name)
                with fs.open_input_file(path) as f:
                    counts.append(pq.ParquetFile(f).metadata.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], names=["n"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder).select("path")
    return files.mapInArrow(run, "n bigint").agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
