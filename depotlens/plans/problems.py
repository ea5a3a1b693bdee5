"""Queries p2_ and p4_ over the depot's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens.operators import orphans, snapshot_diff
from depotlens.sources.tables import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.depot_orphans(*(table(spark, d, t) for t in ("delta_file", "checksum_length", "chunk", "svn_tag_file", "file_cache")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """References without a target in existence at their time: the cascade at depth 0."""
    direct = _orphans(spark, d).where("depth = 0")
    return direct.select(F.col("table_name").alias("ref_table"), orphans.month("at").alias("ref_month"), F.col("record_id").cast("bigint").alias("ref_id"), "ref_pos")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Per table and month: orphaned references, the records that hold them, and the records that inherit it."""
    found = orphans.dated(_orphans(spark, d), table(spark, d, "delta_file", "target_release_id", "created_at"), table(spark, d, "svn_tag_file", "tag_id", "scanned_at"))
    per_record = found.groupBy("table_name", "record_id", orphans.month("at").alias("month"), "orphan_kind").agg(F.count("*").alias("n"))
    direct = F.col("orphan_kind") == "direct"
    return per_record.groupBy("table_name", "month").agg(F.sum(F.when(direct, F.col("n")).otherwise(0)).alias("direct"), F.count_if(direct).alias("records"), F.count_if(~direct).alias("inherited"))


def p2_inherited(spark: SparkSession, d: str) -> DataFrame:
    """Records that hold an orphaned reference, and the releases and tags that hang on them."""
    return _orphans(spark, d).select("table_name", "record_id", "orphan_kind", "depth").distinct()


def p2_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Releases whose base was never delivered, the releases built on them, and the files of all of these."""
    delta = table(spark, d, "delta_file", "delta_file_id", "base_release_id", "target_release_id")
    release = delta.groupBy(F.col("target_release_id").alias("record_id")).agg(F.max("base_release_id").alias("base_release_id")).withColumn("own_key", F.col("record_id"))
    files = delta.select(F.col("delta_file_id").cast("string").alias("record_id"), "target_release_id")
    tables = {"release": release, "delta_file": files}
    keys = [orphans.ForeignKey("release", "base_release_id", "release", "own_key"), orphans.ForeignKey("delta_file", "target_release_id", "release", "own_key")]
    delivered = release.select(F.col("record_id").alias("base_release_id"))
    seeds = release.where("base_release_id is not null").join(delivered, "base_release_id", "left_anti").select(F.lit("release").alias("table_name"), "record_id")
    return orphans.cascade(spark, tables, keys, seeds)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Paths added, removed or changed between each release and its base."""
    return snapshot_diff.release_changes(table(spark, d, "delta_file"))


def p4_summary(spark: SparkSession, d: str) -> DataFrame:
    """Changes of each kind per release, aggregated before the rows move."""
    return p4_found(spark, d).groupBy("base_release_id", "target_release_id", "change_kind").agg(F.count("*").alias("paths"))


_P2 = """
WITH stored AS (SELECT chunk_store_id s, checksum c, created_at a, deleted_at b FROM chunk),
refs AS (
  SELECT 'delta_file' ref_table, delta_file_id ref_id, CAST(x.chunk_index AS BIGINT) ref_pos, created_at t, chunk_store_id s, x.checksum c
  FROM (SELECT delta_file_id, chunk_store_id, created_at, unnest(chunks) x FROM delta_file)
  UNION ALL SELECT 'checksum_length', entry_id, CAST(0 AS BIGINT), collected_at, chunk_store_id, checksum FROM checksum_length),
tags AS (SELECT id, scanned_at t, lower(regexp_replace(file_hash_hex, '^\\s+|\\s+$', '', 'g')) h FROM svn_tag_file),
cached AS (SELECT lower(regexp_replace(file_hash_hex, '^\\s+|\\s+$', '', 'g')) h, first_seen_at a, evicted_at b FROM file_cache),
found AS (
  SELECT ref_table, strftime(t, '%Y-%m') ref_month, ref_id, ref_pos FROM refs WHERE c IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM stored WHERE stored.s = refs.s AND stored.c = refs.c AND a <= t AND (b IS NULL OR t < b))
  UNION ALL SELECT 'svn_tag_file', strftime(t, '%Y-%m'), id, CAST(0 AS BIGINT) FROM tags WHERE h <> ''
    AND NOT EXISTS (SELECT 1 FROM cached WHERE cached.h = tags.h AND a <= t AND (b IS NULL OR t < b)))
"""

_P2_DOWN = _P2.replace("WITH stored", "WITH RECURSIVE stored") + """
, named AS (SELECT target_release_id r, max(base_release_id) b FROM delta_file WHERE target_release_id IS NOT NULL GROUP BY 1),
direct AS (SELECT DISTINCT ref_table, ref_id FROM found),
down AS (SELECT DISTINCT target_release_id r, 1 depth FROM delta_file JOIN direct ON ref_table = 'delta_file' AND ref_id = delta_file_id WHERE target_release_id IS NOT NULL
  UNION SELECT n.r, d.depth + 1 FROM down d JOIN named n ON n.b = d.r WHERE d.depth <= (SELECT count(*) FROM named)),
hanging AS (
  SELECT ref_table table_name, CAST(ref_id AS VARCHAR) record_id, 'direct' orphan_kind, 0 depth FROM direct
  UNION ALL SELECT 'release', r, 'inherited', min(depth) FROM down GROUP BY r
  UNION ALL SELECT DISTINCT 'svn_tag', CAST(tag_id AS VARCHAR), 'inherited', 1 FROM svn_tag_file JOIN direct ON ref_table = 'svn_tag_file' AND ref_id = id WHERE tag_id IS NOT NULL),
times AS (SELECT 'release' table_name, target_release_id record_id, min(created_at) t FROM delta_file GROUP BY 2
  UNION ALL SELECT 'svn_tag', CAST(tag_id AS VARCHAR), min(scanned_at) FROM svn_tag_file GROUP BY 2)
"""

_P4 = """
WITH named AS (SELECT target_release_id r, max(base_release_id) b FROM delta_file GROUP BY 1),
pairs AS (SELECT b, r FROM named WHERE b IN (SELECT r FROM named)),
files AS (SELECT target_release_id r, regexp_replace(replace(path, chr(92), '/'), '^\\./', '') path, new_hash,
    row_number() OVER (PARTITION BY target_release_id, regexp_replace(replace(path, chr(92), '/'), '^\\./', '') ORDER BY delivered_at DESC NULLS LAST, delta_file_id DESC) n
  FROM delta_file WHERE path IS NOT NULL),
list AS (SELECT r, path, new_hash FROM files WHERE n = 1),
found AS (
  SELECT p.b base_release_id, p.r target_release_id, t.path, CASE WHEN o.path IS NULL THEN 'added' ELSE 'changed' END change_kind
  FROM pairs p JOIN list t ON t.r = p.r LEFT JOIN list o ON o.r = p.b AND o.path = t.path WHERE o.path IS NULL OR o.new_hash IS DISTINCT FROM t.new_hash
  UNION ALL SELECT p.b, p.r, o.path, 'removed' FROM pairs p JOIN list o ON o.r = p.b LEFT JOIN list t ON t.r = p.r AND t.path = o.path WHERE t.path IS NULL)
"""

QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p2_inherited": p2_inherited, "p2_cascade": p2_cascade, "p4_found": p4_found, "p4_summary": p4_summary}

SQL = {
    "p2_found": _P2 + "SELECT * FROM found",
    "p2_inherited": _P2_DOWN + "SELECT * FROM hanging",
    "p2_report": _P2_DOWN + """, told AS (
  SELECT ref_table table_name, ref_month AS month, count(*) direct, count(DISTINCT ref_id) records, CAST(0 AS BIGINT) inherited FROM found GROUP BY 1, 2
  UNION ALL SELECT table_name, strftime(t, '%Y-%m'), 0, 0, count(*) FROM hanging JOIN times USING (table_name, record_id) WHERE depth > 0 GROUP BY 1, 2)
SELECT table_name, month, CAST(sum(direct) AS BIGINT) direct, CAST(sum(records) AS BIGINT) records, CAST(sum(inherited) AS BIGINT) inherited FROM told GROUP BY 1, 2""",
    "p2_cascade": """
WITH RECURSIVE named AS (SELECT target_release_id r, max(base_release_id) b FROM delta_file GROUP BY 1),
down AS (SELECT r, 0 depth FROM named WHERE b IS NOT NULL AND b NOT IN (SELECT r FROM named)
  UNION ALL SELECT n.r, d.depth + 1 FROM down d JOIN named n ON n.b = d.r)
SELECT 'release' table_name, r record_id, CASE WHEN depth = 0 THEN 'direct' ELSE 'inherited' END orphan_kind, depth FROM down
UNION ALL SELECT 'delta_file', CAST(f.delta_file_id AS VARCHAR), 'inherited', d.depth + 1 FROM down d JOIN delta_file f ON f.target_release_id = d.r""",
    "p4_found": _P4 + "SELECT * FROM found",
    "p4_summary": _P4 + "SELECT base_release_id, target_release_id, change_kind, count(*) paths FROM found GROUP BY 1, 2, 3",
}
