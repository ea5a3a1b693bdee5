"""Catalogue queries over the depot's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens.plans import artifacts, contents, depot, extras, relational
from depotlens.sources.tables import table


def store_dedup_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per source: texts, distinct contents, logical and unique bytes, ratio and bytes saved."""
    docs = table(spark, d, "documents", "source", "text").where("text is not null")
    blobs = docs.select("source", F.sha2("text", 256).alias("content_id"), F.octet_length("text").cast("bigint").alias("length"))
    unique = blobs.groupBy("source", "content_id").agg(F.count("*").alias("copies"), F.max("length").alias("length"))
    return unique.groupBy("source").agg(
        F.sum("copies").alias("blobs"), F.count("*").alias("unique_blobs"), F.sum(F.col("copies") * F.col("length")).alias("logical_bytes"), F.sum("length").alias("unique_bytes")
    ).withColumns({
        "dedup_ratio": F.when(F.col("unique_bytes") > 0, F.col("logical_bytes") / F.col("unique_bytes")).otherwise(1.0),
        "saved_bytes": F.greatest(F.lit(0).cast("bigint"), F.col("logical_bytes") - F.col("unique_bytes")),
    })


QUERIES = {"store_dedup_stats": store_dedup_stats, **relational.QUERIES, **artifacts.QUERIES, **contents.QUERIES, **extras.QUERIES, **depot.QUERIES}

SQL = {
    "store_dedup_stats": """
WITH u AS (SELECT source, sha256(text) id, count(*) copies, max(octet_length(encode(text))) length FROM documents WHERE text IS NOT NULL GROUP BY 1, 2),
g AS (SELECT source, CAST(sum(copies) AS BIGINT) blobs, count(*) unique_blobs, CAST(sum(copies * length) AS BIGINT) logical_bytes, CAST(sum(length) AS BIGINT) unique_bytes FROM u GROUP BY 1)
SELECT *, CASE WHEN unique_bytes > 0 THEN logical_bytes / unique_bytes ELSE 1.0 END dedup_ratio, greatest(0, logical_bytes - unique_bytes) saved_bytes FROM g""",
}
SQL |= relational.SQL | artifacts.SQL | contents.SQL | extras.SQL | depot.SQL
