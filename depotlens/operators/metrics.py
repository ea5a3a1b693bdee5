"""Derived figures of stores and releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.functions.columns import ratio, saved


def release_metrics(references: DataFrame, chunks: DataFrame) -> DataFrame:
    """Figures of each release: what it holds and what it brought that no earlier release had.

    ``references``: release_id, component, chunk_id; releases are ordered by id.  A chunk is new to the first release that uses it, found
    by one aggregate over chunks.
    """
    first = references.groupBy("chunk_id").agg(F.min("release_id").alias("first_release"))
    used = references.groupBy("release_id", "chunk_id").agg(F.count("*").alias("uses"))
    full = used.join(first, "chunk_id").join(chunks.select("chunk_id", "length", "compressed_length"), "chunk_id", "left")
    new = F.col("first_release") == F.col("release_id")
    length = F.coalesce("length", F.lit(0))
    m = full.groupBy("release_id").agg(
        F.count("*").alias("chunks_in_release"), F.count_if(new).alias("new_chunks"), F.sum(F.col("uses") * length).alias("logical_bytes"), F.sum(F.when(new, length).otherwise(0)).alias("new_bytes"),
        F.sum(F.when(new, F.coalesce("compressed_length", F.lit(0))).otherwise(0)).alias("new_compressed_bytes"),
    )
    return m.withColumns({
        "compression_ratio": ratio(F.col("new_bytes"), F.col("new_compressed_bytes")), "dedup_ratio": ratio(F.col("logical_bytes"), F.col("new_bytes")), "effective_ratio": ratio(F.col("logical_bytes"), F.col("new_compressed_bytes")),
        "compression_saved": saved(F.col("new_bytes"), F.col("new_compressed_bytes")), "dedup_saved": saved(F.col("logical_bytes"), F.col("new_bytes")),
        "new_data_percent": F.when(F.col("logical_bytes") > 0, F.col("new_bytes") / F.col("logical_bytes") * 100.0).otherwise(0.0),
    })


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def release_score(m: DataFrame) -> DataFrame:
    """Score 0 to 100 and tone of release metrics: weights 35 effective, 20 dedup, 15 compression, 20 little new data, 10 saved bytes."""
    logical = F.greatest("logical_bytes", F.lit(1))
    percent = F.col("new_data_percent")
    new_data = F.when(percent <= 1, clamp(percent)).otherwise(clamp(percent / 100))
    score = 100 * (
        0.35 * clamp((F.col("effective_ratio") - 1) / 3) + 0.20 * clamp((F.col("dedup_ratio") - 1) / 4) + 0.15 * clamp((F.col("compression_ratio") - 1) / 2) + 0.20 * (1 - new_data)
        + 0.10 * clamp(0.7 * (F.col("dedup_saved") / logical) + 0.3 * (F.col("compression_saved") / logical))
    )
    whole = F.floor(score + 0.5).cast("bigint")
    tone = F.when(whole >= 85, "excellent").when(whole >= 70, "good").when(whole >= 50, "mixed").otherwise("poor")
    return m.select("release_id", whole.alias("score"), tone.alias("tone"))


def store_snapshot(stored: DataFrame, references: DataFrame, files: DataFrame) -> DataFrame:
    """One row of figures for each store, all stores in one pass over each table.

    ``stored``: store_id, checksum, length, compressed_length (one row a chunk); ``references``: store_id, checksum, length;
    ``files``: store_id, digest, file_size, release_id.  Ratios with nothing below the line are 1.0, savings never negative.
    """
    c = stored.groupBy("store_id").agg(F.count("*").alias("chunk_count"), F.sum("length").alias("unique_bytes"), F.sum("compressed_length").alias("compressed_bytes"), F.avg("length").cast("bigint").alias("avg_chunk"), F.avg("compressed_length").cast("bigint").alias("avg_compressed"))
    r = references.where("checksum is not null").groupBy("store_id", "checksum").agg(F.max("length").alias("length")).groupBy("store_id").agg(F.count("*").alias("referenced_chunks"), F.sum(F.coalesce("length", F.lit(0)).cast("bigint")).alias("referenced_bytes"))
    per_digest = files.groupBy("store_id", "digest").agg(F.count("*").alias("n"), F.max("file_size").alias("size"), F.sum("file_size").alias("total"))
    f = per_digest.groupBy("store_id").agg(F.count("*").alias("unique_files"), F.sum("size").alias("unique_file_bytes"), F.sum("total").alias("logical_bytes"))
    n = files.groupBy("store_id").agg(F.countDistinct("release_id").alias("releases"))
    j = c.join(f, "store_id", "left").join(n, "store_id", "left").join(r, "store_id", "left").na.fill(0)
    return j.withColumns({
        "compression_ratio": ratio(F.col("unique_bytes"), F.col("compressed_bytes")), "dedup_ratio": ratio(F.col("logical_bytes"), F.col("unique_bytes")), "effective_ratio": ratio(F.col("logical_bytes"), F.col("compressed_bytes")),
        "compression_saved": saved(F.col("unique_bytes"), F.col("compressed_bytes")), "dedup_saved": saved(F.col("logical_bytes"), F.col("unique_bytes")),
    })


def logical_sizes(files: DataFrame) -> DataFrame:
    """(store_id, total_logical_bytes, unique_file_bytes, file_definitions, referenced_chunk_bytes).

    ``files``: store_id, digest, file_size, chunks (array of structs with checksum and length).  A file's length is the explicit one, else that of a
    definition of its digest (the sum of its chunks, null lengths left out), else 0.  Files are combined by store and digest before
    they meet the definitions; rows without a digest are no files."""
    named = files.where("digest is not null")
    definitions = named.where("chunks is not null").select("digest", F.aggregate("chunks", F.lit(None).cast("bigint"), lambda a, x: F.when(x["length"].isNull(), a).otherwise(F.coalesce(a, F.lit(0).cast("bigint")) + x["length"])).alias("n")).groupBy("digest").agg(F.max("n").alias("defined"))
    per = named.groupBy("store_id", "digest").agg(F.sum("file_size").alias("told"), F.max("file_size").alias("largest"), F.count_if(F.col("file_size").isNull()).alias("untold"))
    j = per.join(definitions, "digest", "left").withColumn("defined", F.coalesce("defined", F.lit(0)))
    total = F.coalesce("told", F.lit(0)) + F.col("untold") * F.col("defined")
    largest = F.greatest(F.col("largest"), F.when(F.col("untold") > 0, F.col("defined")))
    sizes = j.groupBy("store_id").agg(F.sum(total).alias("total_logical_bytes"), F.sum(largest).alias("unique_file_bytes"), F.count("*").alias("file_definitions"))
    chunks = files.select("store_id", F.explode("chunks").alias("x")).where("x.checksum is not null").groupBy("store_id", "x.checksum").agg(F.max("x.length").alias("l"))
    referenced = chunks.groupBy("store_id").agg(F.sum(F.coalesce("l", F.lit(0)).cast("bigint")).alias("referenced_chunk_bytes"))
    return sizes.join(referenced, "store_id", "left").withColumn("referenced_chunk_bytes", F.coalesce("referenced_chunk_bytes", F.lit(0)))
