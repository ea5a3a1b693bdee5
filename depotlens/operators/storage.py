"""Index and pack maintenance on Parquet: lookup, insert, compaction, rebuild, re-bucketing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens.session import Workspace, delete, exists


def newest(entries: DataFrame, key: str, generation: str, values: Sequence[str]) -> DataFrame:
    """Merge of index segments: for each key the values of its highest generation (ties: the greatest values).

    An aggregate over (generation, values), so every segment is reduced before it moves."""
    g = entries.groupBy(key).agg(F.max(F.struct(generation, *values)).alias("e"))
    return g.select(key, F.col(f"e.{generation}").alias(generation), *[F.col(f"e.{v}").alias(v) for v in values])


def rebuild(records: DataFrame, key: str, position: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Index from packs: the first occurrence of each key by position wins."""
    g = records.groupBy(key).agg(F.min(F.struct(*position, *values)).alias("e"))
    return g.select(key, *[F.col(f"e.{v}").alias(v) for v in (*position, *values)])


def insert_new(stored: DataFrame, batch: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows of the batch to append: one for each key that is not stored yet, the first by order."""
    columns = [c for c in batch.columns if c not in (key, *order)]
    first = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order, *columns)).alias("e"))
    rows = first.select(key, *[F.col(f"e.{c}").alias(c) for c in (*order, *columns)])
    return rows.join(stored.select(key), key, "left_anti")


def compaction_level(entries: Column, flush: int = 4096, fan_in: int = 16, levels: int = 2) -> Column:
    """Level of a segment by its number of entries: flushed, then one level for each fan-in, at most ``levels``."""
    level = F.lit(0)
    for i in range(1, levels + 1):
        level = F.when(entries >= flush * fan_in**i, i).otherwise(level)
    return level.cast("int")


def misplaced(records: DataFrame, bucket: str, digest: str) -> DataFrame:
    """Records that lie in another bucket than their digest's prefix, with the bucket they belong to."""
    right = F.substring(F.lower(F.hex(digest)), 1, 3)
    return records.withColumn("right_bucket", right).where(F.col(bucket) != F.col("right_bucket"))


def rebucketed(records: DataFrame, bucket: str, digest: str) -> DataFrame:
    """All records in the bucket of their digest, with whether they moved; only ``moved`` ones have to be written again."""
    right = F.substring(F.lower(F.hex(digest)), 1, 3)
    return records.withColumns({"moved": ~F.col(bucket).eqNullSafe(right), bucket: right})


def write_index(entries: DataFrame, path: str, digest: str, buckets: int) -> None:
    """Segments sorted by digest within ranges of digests, so that a lookup reads the few row groups whose bounds hold it."""
    entries.repartitionByRange(buckets, F.col(digest)).sortWithinPartitions(digest).write.mode("overwrite").parquet(path)


def replace_partitions(new: DataFrame, path: str, by: Sequence[str]) -> None:
    """Delete-then-insert of whole partitions: only those that occur in ``new`` are replaced."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


class ContentStore:
    """Contents under their SHA-256, in folders by its first digits: put, get and delete touch only the folders of their digests."""

    _ROW = "content_id string, content binary, prefix string"

    def __init__(self, spark: SparkSession, path: str, digits: int = 3):
        self.spark, self.path, self.digits = spark, path, digits

    def _stored(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self._ROW)
        return self.spark.read.schema(self._ROW).parquet(self.path)

    def _keyed(self, ids: DataFrame) -> DataFrame:
        return ids.select("content_id").where("content_id is not null").distinct().withColumn("prefix", F.substring("content_id", 1, self.digits))

    def put(self, contents: DataFrame, content: str = "content") -> None:
        """Stores what is not there yet; repeated and null contents are stored once and not at all."""
        rows = contents.where(F.col(content).isNotNull()).select(F.sha2(content, 256).alias("content_id"), F.col(content).alias("content")).dropDuplicates(["content_id"])
        new = rows.withColumn("prefix", F.substring("content_id", 1, self.digits)).join(self._stored().select("content_id", "prefix"), ["content_id", "prefix"], "left_anti")
        new.repartition("prefix").write.mode("append").partitionBy("prefix").parquet(self.path)

    def get(self, ids: DataFrame) -> DataFrame:
        """(content_id, content) of the asked digests that are stored; folders of other prefixes are pruned when the plan runs."""
        return self._stored().join(self._keyed(ids), ["prefix", "content_id"], "left_semi").select("content_id", "content")

    def delete(self, ids: DataFrame) -> None:
        """Deletes digests; only the folders that hold one are written again."""
        work = Workspace(self.spark)
        gone, _ = work.write(self._keyed(ids), "gone")
        touched = self._stored().join(gone.select("prefix").distinct(), "prefix", "left_semi")
        left, path = work.write(touched.join(gone, ["prefix", "content_id"], "left_anti"), "left")
        # Folders that keep nothing are not among those written, so they are dropped: at most 16**digits names.
        empty = gone.select("prefix").distinct().join(left.select("prefix"), "prefix", "left_anti")
        left.repartition("prefix").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix").parquet(self.path)
        for r in empty.collect():
            delete(self.spark, f"{self.path}/prefix={r.prefix}")
        work.drop(path)
