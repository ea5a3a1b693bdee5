"""What changed between full snapshots: a range-partitioned two-pointer merge.

Snapshots are kept: each list is written once, range-partitioned and sorted by (snapshot, key), so a later delivery reads its own list and
that of its base, a few row groups, and no others.  The rows of a comparison go through one range partitioning on (comparison, key), so
that a range is a contiguous stretch of one comparison's keys and a large snapshot spreads over as many ranges as it needs.  Within a range rows arrive sorted by (comparison, key, side) and one pass with two pointers, base and
target, emits the typed changes.  State is one key group, whatever the size of the snapshots.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlens.session import Workspace, exists, get_text, names, put_text

#: Releases up to this many are named in the filter that reaches the scan; more are joined.
NAMED_RELEASES = 500
#: Bytes of a row group of a kept list.
LIST_GRANULE = 1 << 20
#: Rows of the release graph (some 150 bytes each) that may be broadcast.
SMALL_GRAPH = 200_000
#: Sides in the order in which the merge meets them.
BASE, TARGET = 0, 1


def newest_first(delivered: str, tie: str) -> list[Column]:
    """Order in which the superseding delivery of a key comes first; a null time is the oldest, ties go to the larger id."""
    return [F.col(delivered).desc_nulls_last(), F.col(tie).desc_nulls_last()]


def _merge(pair: Sequence[str], key: str, digest: str) -> callable:
    """The streaming merge over Arrow batches sorted by (pair, key, side, newest first)."""
    names = [*pair, key]

    def changed(batch: pa.Table) -> pa.Array:
        """For each row after the first: does it begin another key group?"""
        flags = None
        for n in names:
            c = batch[n].combine_chunks()
            f = pc.fill_null(pc.not_equal(c[1:], c[:-1]), True)
            flags = f if flags is None else pc.or_(flags, f)
        return flags

    def emit(t: pa.Table) -> pa.RecordBatch:
        """t holds whole key groups."""
        n = t.num_rows
        new_key = pa.concat_arrays([pa.array([True]), changed(t)]) if n > 1 else pa.array([True] * n)
        side = t["side"].combine_chunks()
        new_side = pa.concat_arrays([pa.array([True]), pc.not_equal(side[1:], side[:-1])]) if n > 1 else pa.array([True] * n)
        # Only the first, newest row of a side counts.
        t = t.filter(pc.or_(new_key, new_side))
        new_key = new_key.filter(pc.or_(new_key, new_side))
        n = t.num_rows
        side = t["side"].combine_chunks()
        next_new = pa.concat_arrays([new_key[1:], pa.array([True])])
        first_is_base = pc.and_(new_key, pc.equal(side, BASE))
        alone_base = pc.and_(first_is_base, next_new)
        alone_target = pc.and_(new_key, pc.equal(side, TARGET))
        second = pc.invert(new_key)  # a target row right after its base row
        d = t[digest].combine_chunks()
        before = pa.concat_arrays([d.slice(0, 1), d[:-1]]) if n else d
        equal = pc.fill_null(pc.equal(d, before), False)
        both_null = pc.and_(pc.is_null(d), pc.is_null(before))
        differs = pc.and_(second, pc.invert(pc.or_(equal, both_null)))
        kind = pc.if_else(alone_base, "removed", pc.if_else(alone_target, "added", pc.if_else(differs, "changed", None)))
        out = t.select(names).append_column("change_kind", kind).filter(pc.is_valid(kind))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            if held is not None:
                t = pa.concat_tables([held, t])
            # The last key group may go on in the next batch: keep it back, reduced to the rows that can still count.
            starts = pc.indices_nonzero(changed(t)) if t.num_rows > 1 else pa.array([], pa.uint64())
            cut = starts[-1].as_py() + 1 if len(starts) else 0
            if cut:
                yield from emit(t.slice(0, cut)).to_batches()
            held = t.slice(cut)
            if held.num_rows > 2:
                side = held["side"].combine_chunks()
                first = pa.concat_arrays([pa.array([True]), pc.not_equal(side[1:], side[:-1])])
                held = held.filter(first)
        if held is not None and held.num_rows:
            yield from emit(held).to_batches()

    return run


def diff_snapshots(rows: DataFrame, pair: Sequence[str], key: str, digest: str, newest: Sequence[Column], partitions: int | None = None) -> DataFrame:
    """Typed changes of keyed rows between the two sides of each comparison.

    ``rows`` has the columns of ``pair`` (what names a comparison), ``key``, ``digest`` (what is compared; any atomic
    type), ``side`` (BASE or TARGET) and whatever ``newest`` sorts by.  Result: pair columns, key, change_kind (added, removed,
    changed).  Of several rows of one side and key the first by ``newest`` counts; two null digests are equal, null and a value
    differ.  Null keys are no keys and are left out.  An empty side makes all of the other added or removed.
    """
    rows = rows.where(F.col(key).isNotNull())
    by = [F.col(c) for c in (*pair, key)]
    spread = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    ordered = spread.sortWithinPartitions(*by, F.col("side"), *newest).select(*pair, key, "side", digest)
    fields = {f.name: f for f in rows.schema.fields}
    schema = T.StructType([*[T.StructField(c, fields[c].dataType) for c in (*pair, key)], T.StructField("change_kind", T.StringType())])
    return ordered.mapInArrow(_merge(pair, key, digest), schema)


_LISTS = T.StructType([T.StructField("release", T.StringType()), T.StructField("path", T.StringType()), T.StructField("new_hash", T.BinaryType()), T.StructField("delivered_at", T.TimestampType()), T.StructField("delta_file_id", T.LongType())])
_HEADS = T.StructType([T.StructField("target_release_id", T.StringType()), T.StructField("base_release_id", T.StringType())])


class SnapshotStore:
    """Full lists of releases, kept sorted, and what changed between each release and its base.

    A batch of deliveries is written to folders of its own and takes part once its manifest is there.  A batch of a name that is there
    already is not written again.  Late rows of a release lie in another batch than its others; the newest delivery of a path counts.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or Workspace(spark).path("snapshots")

    def batches(self) -> list[str]:
        return [json.loads(get_text(self.spark, f"{self.path}/manifests/{n}"))["name"] for n in names(self.spark, f"{self.path}/manifests") if n.endswith(".json") and not n.startswith(".")]

    def _read(self, kind: str, schema: T.StructType, batches: Sequence[str]) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/{b}") for b in batches]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def add(self, delta: DataFrame, name: str) -> None:
        """Keeps the lists of a batch of delta files; see ``release_changes`` for its columns.

        Superseded deliveries are dropped by an aggregate, which combines before the shuffle, so a path delivered over and over moves once
        from each task."""
        if exists(self.spark, f"{self.path}/manifests/{name}.json"):
            return
        d = delta.select("target_release_id", "base_release_id", "path", "new_hash", "delivered_at", "delta_file_id").where(F.col("target_release_id").isNotNull())
        path = F.regexp_replace(F.translate("path", "\\", "/"), "^\\./", "")
        # Nulls are the smallest values of a struct: a null time is the oldest, ties go to the larger id.
        newest = F.max(F.struct("delivered_at", "delta_file_id", "new_hash")).alias("n")
        files = d.where("path is not null").groupBy(F.col("target_release_id").alias("release"), path.alias("path")).agg(newest).select("release", "path", "n.new_hash", "n.delivered_at", F.col("n.delta_file_id").cast("bigint").alias("delta_file_id"))
        kept = files.repartitionByRange(F.col("release"), F.col("path")).sortWithinPartitions("release", "path")
        kept.write.mode("overwrite").option("parquet.block.size", LIST_GRANULE).parquet(f"{self.path}/lists/{name}")
        d.groupBy("target_release_id").agg(F.max("base_release_id").alias("base_release_id")).write.mode("overwrite").parquet(f"{self.path}/heads/{name}")
        put_text(self.spark, f"{self.path}/manifests/{name}.json", json.dumps({"name": name}))

    def rows(self, name: str) -> DataFrame:
        """The two-sided rows of the comparisons that batch ``name`` takes part in, as target or as base: those of a release built on one of
        the batch are made again.  The release graph, a row or two for each release, is broadcast only up to SMALL_GRAPH rows."""
        work = Workspace(self.spark)
        all_heads = self._read("heads", _HEADS, self.batches())
        bases = all_heads.groupBy("target_release_id").agg(F.max("base_release_id").alias("base_release_id"))
        known = bases.select(F.col("target_release_id").alias("base_release_id"))
        edges = bases.where("base_release_id is not null").join(known, "base_release_id", "left_semi")
        if len(self.batches()) > 1:
            new = self._read("heads", _HEADS, [name])
            touched = [edges.join(new.select(F.col("target_release_id").alias(side)), side, "left_semi").select("target_release_id", "base_release_id") for side in ("target_release_id", "base_release_id")]
            edges = touched[0].unionByName(touched[1]).distinct()
        # A release plays the target once and the base once for each release built on it.
        pair = F.struct("base_release_id", "target_release_id")
        plays = F.array(F.struct(F.col("target_release_id").alias("release"), pair.alias("pair"), F.lit(TARGET).cast("byte").alias("side")), F.struct(F.col("base_release_id").alias("release"), pair.alias("pair"), F.lit(BASE).cast("byte").alias("side")))
        roles, _ = work.write(edges.select(F.inline(plays)).select("release", "pair.base_release_id", "pair.target_release_id", "side"), "roles")
        lists = self._read("lists", _LISTS, self.batches())
        count = roles.count()
        if count <= 2 * NAMED_RELEASES:
            lists = lists.where(F.col("release").isin([r[0] for r in roles.select("release").distinct().collect()]))
        return lists.join(F.broadcast(roles) if count <= SMALL_GRAPH else roles, "release").drop("release")

    def changes(self, name: str, partitions: int | None = None) -> DataFrame:
        """(base_release_id, target_release_id, path, change_kind) of the comparisons of ``rows``."""
        return diff_snapshots(self.rows(name), ["base_release_id", "target_release_id"], "path", "new_hash", newest_first("delivered_at", "delta_file_id"), partitions)


def release_changes(delta: DataFrame, partitions: int | None = None) -> DataFrame:
    """(base_release_id, target_release_id, path, change_kind) of all releases whose base was itself delivered.

    ``delta`` needs target_release_id, base_release_id, path, new_hash, delivered_at, delta_file_id; other columns are ignored.
    """
    store = SnapshotStore(delta.sparkSession)
    store.add(delta, "all")
    return store.changes("all", partitions)
