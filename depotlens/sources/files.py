"""File-shaped sources and sinks: folder scans, component maps, version-control listings, archives, packs, tar streams."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from depotlens.functions import codecs
from depotlens.functions.arrow import slices
from depotlens.functions.columns import format_id, member_selected
from depotlens.sources import packs


def scan_folder(spark: SparkSession, root: str, components: dict[str, str] | None = None) -> DataFrame:
    """Metadata of all files below a folder: (path, component, length, modified); version-control folders are left out, and, as in all
    of Spark's file listings, names that begin with a dot or an underscore.

    ``components`` maps relative folders to component names; without it all files are `default`.  Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    base = root.rstrip("/").removeprefix("file://")
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/+", "/"), f"^{base}/", "")
    files = files.select(relative.alias("path"), "length", "modified").where(~F.col("path").rlike(r"(^|/)\.(svn|git|hg)/"))
    if components is None:
        return files.select("path", F.lit("default").alias("component"), "length", "modified")
    component = F.lit(None).cast("string")
    for folder, name in sorted(components.items(), key=lambda x: len(x[0])):
        component = F.when(F.col("path").startswith(folder.strip("/") + "/"), name).otherwise(component)
    return files.select("path", component.alias("component"), "length", "modified").where("component is not null")


def storage_scan(spark: SparkSession, root: str) -> DataFrame:
    """Files and bytes of a store by kind, from names and sizes alone."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    kind = F.when(F.col("path").endswith(".pack"), "pack").when(F.col("path").endswith(".idx") | F.col("path").endswith(".log"), "index").when(F.col("path").endswith(".rdef"), "package").otherwise("other")
    return f.groupBy(kind.alias("kind")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def component_map(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Lines `folder:name` of a text file; blank lines and those starting with # are skipped.  Other lines are dropped, or, when
    strict, an error.  Longest folder first is the order of matching."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '#')")
    parts = F.split("line", ":", 2)
    good = (F.size(parts) == 2) & (F.trim(parts[0]) != "") & (F.trim(parts[1]) != "")
    if strict:
        lines = lines.where(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("bad line: "), F.col("line"))).cast("boolean")))
    return lines.where(good).select(F.regexp_replace(F.translate(F.trim(parts[0]), "\\", "/"), "^/+|/+$", "").alias("folder"), F.trim(parts[1]).alias("name"))


_LIST = "ARRAY<STRUCT<_kind: STRING, name: STRING, size: BIGINT, commit: STRUCT<_revision: BIGINT, author: STRING, date: TIMESTAMP>>>"


def listing_entries(xml: Column) -> Column:
    """Entries of a version-control listing document: an array of structs (kind, name, size, revision, author, date)."""
    doc = F.from_xml(xml, f"list STRUCT<entry: {_LIST}>")
    return F.transform(doc["list"]["entry"], lambda e: F.struct(e["_kind"].alias("kind"), e["name"].alias("name"), e["size"].alias("size"), e["commit"]["_revision"].alias("revision"), e["commit"]["author"].alias("author"), e["commit"]["date"].alias("date")))


def log_entries(xml: Column) -> Column:
    doc = F.from_xml(xml, "logentry ARRAY<STRUCT<_revision: BIGINT, author: STRING, date: TIMESTAMP, msg: STRING>>")
    return F.transform(doc["logentry"], lambda e: F.struct(e["_revision"].alias("revision"), e["author"].alias("author"), e["date"].alias("date"), e["msg"].alias("message")))


# ---- archives

_ENTRIES = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("entry_index", T.IntegerType()), T.StructField("entry_path", T.StringType()), T.StructField("length", T.LongType()), T.StructField("compressed_length", T.LongType()), T.StructField("is_dir", T.BooleanType()), T.StructField("content", T.BinaryType()),
])


def archive_entries(archives: DataFrame, name: str, content: str, with_content: bool = False) -> DataFrame:
    """Entries of zip archives held in a binary column; what is no archive has none.  Member bytes only when asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "data"):
            rows = []
            for archive, data in zip(b.column("archive").to_pylist(), b.column("data").to_pylist()):
                try:
                    z = zipfile.ZipFile(io.BytesIO(data))
                except zipfile.BadZipFile:
                    continue
                rows += [(archive, i, e.filename, e.file_size, e.compress_size, e.is_dir(), z.read(e) if with_content and not e.is_dir() else None) for i, e in enumerate(z.infolist())]
            columns = list(zip(*rows)) if rows else [[]] * len(_ENTRIES)
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=_ENTRIES.names)

    return archives.select(F.col(name).alias("archive"), F.col(content).alias("data")).where("data is not null").mapInArrow(run, _ENTRIES)


#: Handler of each format; formats that are not named here go to `file`.
HANDLERS = {"zip": "archive", "jar": "archive", "apk": "archive", "nupkg": "archive"}


def handler_of(kind: Column) -> Column:
    out = F.lit("file")
    for name, handler in HANDLERS.items():
        out = F.when(kind == name, handler).otherwise(out)
    return out


def plan_archives(archives: DataFrame, entries: DataFrame, name: str) -> DataFrame:
    """How each archive is stored: (archive, byte_perfect, store_opaque, reconstruction, selected).

    apk, jar and nupkg must come back byte by byte and stay whole; others are taken apart if any member is worth it."""
    chosen = entries.where(member_selected(F.col("entry_path"), F.col("length"), F.col("is_dir"))).groupBy("archive").agg(F.count("*").alias("selected"))
    a = archives.select(F.col(name).alias("archive")).distinct().join(chosen, "archive", "left")
    perfect = format_id(F.col("archive")).isin("apk", "jar", "nupkg")
    selected = F.when(perfect, 0).otherwise(F.coalesce("selected", F.lit(0)))
    return a.select("archive", perfect.alias("byte_perfect"), (selected == 0).alias("store_opaque"), F.when(selected == 0, "none").otherwise("semantic").alias("reconstruction"), selected.cast("bigint").alias("selected"))


def recipe(entries: list[tuple[str, bool]]) -> bytes:
    """What is needed to rebuild an archive's structure."""
    return json.dumps({"Entries": [{"FullName": p.replace("\\", "/"), "IsDirectory": d} for p, d in entries]}, separators=(",", ":")).encode()


def logical_entries(entries: DataFrame) -> DataFrame:
    """Members under their logical path, `archive!/entry`."""
    return entries.where("not is_dir").select(F.concat_ws("!/", "archive", "entry_path").alias("logical_path"), "length")


#: Bytes of one part of a compressed tar.
TAR_PART_BYTES = 8 << 20


def tar_stream(files: DataFrame, group: str, path: str, content: str, mtime: int = 0) -> DataFrame:
    """(group, part_no, tar_zst): a zstd-compressed tar of each group's files in order of path, in parts that follow each other.

    Files are sorted where they meet and streamed into the archive, so a task holds one file and one part, whatever the size of a group."""
    source = files.select(F.col(group).alias("group"), F.col(path).alias("path"), F.col(content).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        key, out, part, held = None, None, 0, b""

        def give() -> pa.RecordBatch:
            nonlocal part, held
            row = pa.RecordBatch.from_arrays([key, pa.array([part], pa.int32()), pa.array([held], pa.binary())], names=["group", "part_no", "tar_zst"])
            part, held = part + 1, b""
            return row

        def end() -> pa.RecordBatch:
            nonlocal held
            held += out.compress(bytes(2 * tarfile.BLOCKSIZE)) + out.flush()
            return give()

        for b in slices(batches, "content"):
            for i, (g, p, data) in enumerate(zip(b.column("group").to_pylist(), b.column("path").to_pylist(), b.column("content").to_pylist())):
                if out is None or g != key[0].as_py():
                    if out is not None:
                        yield end()
                    key, out, part = b.column("group").slice(i, 1), zstandard.ZstdCompressor().compressobj(), 0
                info = tarfile.TarInfo(p)
                info.size, info.mtime = len(data), mtime
                held += out.compress(info.tobuf(tarfile.USTAR_FORMAT) + data + bytes(-len(data) % tarfile.BLOCKSIZE))
                if len(held) >= TAR_PART_BYTES:
                    yield give()
        if out is not None:
            yield end()

    ordered = source.where("content is not null").repartition("group").sortWithinPartitions("group", "path")
    return ordered.mapInArrow(run, T.StructType([T.StructField("group", source.schema["group"].dataType), T.StructField("part_no", T.IntegerType()), T.StructField("tar_zst", T.BinaryType())]))


# ---- packs


class PackSource(DataSource):
    """`spark.read.format("pack").option("check", "true").load(folder)`: entries of *.pack files, one partition a file."""

    @classmethod
    def name(cls) -> str:
        return "pack"

    def schema(self) -> str:
        return "file string, byte_offset bigint, stored_length int, content binary"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PackReader(self.options)


class PackReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.check = options["path"], options.get("check", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        import pyarrow.fs as pf

        fs, root = packs.filesystem(self.folder)
        scheme = self.folder.split("://")[0] + "://" if "://" in self.folder else ""
        return [InputPartition(scheme + f.path) for f in sorted(fs.get_file_info(pf.FileSelector(root, recursive=True)), key=lambda f: f.path) if f.path.endswith(".pack")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, path = packs.filesystem(partition.value)
        with fs.open_input_file(path) as f:
            for at, size, _ in codecs.walk_pack(f.read_at, f.size()):
                yield partition.value.removeprefix("file://"), at, size, codecs.read_pack_entry(f.read_at(size, at), 0, self.check)


def pack_entries(rows: DataFrame, content: str) -> DataFrame:
    """Appends ``entry``: the packed form of a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, content):
            packed = [None if x is None else codecs.encode_pack_entry(x) for x in b.column(content).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(packed, pa.binary())], names=[*b.schema.names, "entry"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("entry", T.BinaryType())]))
