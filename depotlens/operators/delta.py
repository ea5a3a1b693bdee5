"""Upload plans and delta manifests between two releases, over ordered chunk lists."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlens.functions.arrow import slices


def upload_plan(files: DataFrame, known: DataFrame) -> DataFrame:
    """One source for each chunk that the store misses: (chunk_id, release_id, component, idx), the first in file order.

    An aggregate, combined before the shuffle; the anti join then meets one row a chunk."""
    first = files.groupBy("chunk_id").agg(F.min(F.struct("release_id", "component", "idx")).alias("s"))
    return first.join(known.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "s.release_id", "s.component", "s.idx")


def file_signatures(files: DataFrame) -> DataFrame:
    """(release_id, component, signature, chunk_count) of ordered chunk lists; equal lists have equal signatures."""
    pairs = F.array_sort(F.collect_list(F.struct("idx", "chunk_id")))
    return files.groupBy("release_id", "component").agg(F.sha2(F.array_join(F.transform(pairs, lambda p: p["chunk_id"].cast("string")), ","), 256).alias("signature"), F.count("*").alias("chunk_count"))


def delta_files(base: DataFrame, target: DataFrame) -> DataFrame:
    """Status of every target file against the base: `new`, `keep` or `modified`.

    Both sides: pair, component, signature, chunk_count; one row for each pair and component.  Files only in the base are not reported."""
    o = base.select("pair", "component", F.col("signature").alias("old"))
    t = target.join(o, ["pair", "component"], "left")
    status = F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("signature"), "keep").otherwise("modified")
    return t.select("pair", "component", status.alias("status"), "chunk_count")


def delta_chunks(base: DataFrame, target: DataFrame) -> DataFrame:
    """Origin and offset of every chunk of the target's modified files; new and kept files have no references.

    Rows: pair, component, idx, chunk_id, length.  Matching is by multiset: the n-th use of a chunk in a target file is `existing` if the base
    file uses it n times.  Offsets run over the file; chunks of unknown length count 0."""
    lists = lambda x: file_signatures(x.select("pair", "component", "idx", "chunk_id").withColumnRenamed("pair", "release_id")).withColumnRenamed("release_id", "pair")
    modified = delta_files(lists(base), lists(target)).where("status = 'modified'").select("pair", "component")
    used = base.groupBy("pair", "component", "chunk_id").agg(F.count("*").alias("in_base"))
    nth = F.row_number().over(Window.partitionBy("pair", "component", "chunk_id").orderBy("idx"))
    before = Window.partitionBy("pair", "component").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    t = target.join(modified, ["pair", "component"], "left_semi").withColumn("length", F.coalesce("length", F.lit(0)))
    t = t.withColumns({"nth": nth, "byte_offset": F.coalesce(F.sum("length").over(before), F.lit(0))})
    j = t.join(used, ["pair", "component", "chunk_id"], "left")
    source = F.when(F.col("nth") <= F.coalesce("in_base", F.lit(0)), "existing").otherwise("new")
    return j.select("pair", "component", "idx", "chunk_id", "byte_offset", "length", source.alias("source"))


def manifest_path(pair: str, component: str, name: str) -> Column:
    """Path of a file in a manifest: without its component when the target has only one."""
    w = Window.partitionBy(pair)
    single = F.min(component).over(w).eqNullSafe(F.max(component).over(w))
    return F.when(single, F.col(name)).otherwise(F.concat_ws("/", component, name))


def reassemble(parts: DataFrame, key: str, idx: str, data: str) -> DataFrame:
    """(key, content): the bytes of each item's parts in order.  Parts are sorted where they meet and joined once; an item has to fit a row,
    as everywhere in a DataFrame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []
        done = lambda keys, out: pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(out, pa.binary())], names=[key, "content"])
        for b in slices(batches, "data"):
            keys, out = [], []
            for i, (k, d) in enumerate(zip(b.column("key").to_pylist(), b.column("data").to_pylist())):
                if name is None or k != name[0]:
                    if name is not None:
                        keys.append(name[1])
                        out.append(b"".join(held))
                    name, held = (k, b.column("key").slice(i, 1)), []
                held.append(d or b"")
            if keys:
                yield done(keys, out)
        if name is not None:
            yield done([name[1]], [b"".join(held)])

    source = parts.select(F.col(key).alias("key"), F.col(idx).alias("idx"), F.col(data).alias("data"))
    kind = source.schema["key"].dataType
    ordered = source.repartition("key").sortWithinPartitions("key", "idx").select("key", "data")
    return ordered.mapInArrow(run, T.StructType([T.StructField(key, kind), T.StructField("content", T.BinaryType())]))
