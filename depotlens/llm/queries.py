"""Queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens.llm import dedup_index, encoding, mixing, quality, quotient, splitting
from depotlens.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Uploads that repeat an accepted one, and replies that counted wrongly."""
    return dedup_index.judge_uploads(table(spark, d, "upload_plan", "upload_id", "missing_chunk_checksums", "chunks_written_new"), table(spark, d, "shared_chunk"))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """New checksums of each upload that has some."""
    plans = table(spark, d, "upload_plan", "upload_id", "missing_chunk_checksums")
    return dedup_index.first_seen(plans, "upload_id", "missing_chunk_checksums", table(spark, d, "shared_chunk").select(F.col("checksum").alias("key")))[0].where("new_keys > 0")


def _seen(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    known = quotient.depot_known_keys(table(spark, d, "shared_chunk"), table(spark, d, "file_cache", "chunk_map"))
    return quotient.seen_before(table(spark, d, "upload_chunk_request", "request_id", "checksum"), "checksum", "request_id", known)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Requests whose checksum occurred before."""
    return _seen(spark, d)[1].select(F.col("arrival").alias("request_id"))


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """Answers of the filter against the exact ones, and the rate of wrong ones that was derived beforehand."""
    return quotient.error_rates(quotient.all_answers(*_seen(spark, d)))


def p3_error_rate(spark: SparkSession, d: str) -> DataFrame:
    """How many requests were judged, were seen, were missed by the filter, and whether wrong answers are as frequent as derived (within
    five standard deviations and one answer)."""
    r = p3_rates(spark, d)
    expected = F.col("derived_rate") * (F.col("requests") - F.col("seen"))
    return r.select("requests", "seen", "false_negatives", (F.abs(F.col("false_positives") - expected) <= 5 * F.sqrt(expected) + 1).alias("as_derived"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of every oversized item."""
    return splitting.depot_pieces(*(table(spark, d, t) for t in ("input_item", "svn_tag_file", "documents", "file_cache", "size_limit")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Items that had to be cut: those that have a second piece."""
    return p5_pieces(spark, d).where("piece_no = 1").select("item_table", "item_id")


def p5_check(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of each oversized item must satisfy: they cover it from end to end, none exceeds its limit, neighbours share the
    overlap, and the numbers have no gap."""
    limits = table(spark, d, "size_limit").where("item_kind is not null and limit_bytes > 0").select("item_kind", "limit_bytes", F.coalesce("overlap_bytes", F.lit(0)).alias("overlap_bytes"))
    kinds = table(spark, d, "input_item", "item_id", "doc_id", "kind").select(F.lit("input_item").alias("item_table"), "item_id", F.when(F.col("doc_id").isNotNull(), "Document").otherwise(F.col("kind")).alias("item_kind"))
    kinds = kinds.unionByName(table(spark, d, "svn_tag_file", "id").select(F.lit("svn_tag_file").alias("item_table"), F.col("id").alias("item_id"), F.lit("SvnFile").alias("item_kind")))
    pieces = p5_pieces(spark, d)
    after = pieces.select("item_table", "item_id", (F.col("piece_no") - 1).alias("piece_no"), F.col("byte_start").alias("next_start"))
    p = pieces.join(after, ["item_table", "item_id", "piece_no"], "left").join(kinds, ["item_table", "item_id"]).join(F.broadcast(limits), "item_kind")
    shared = F.col("next_start").isNull() | (F.col("next_start") == F.col("byte_end") - F.col("overlap_bytes"))
    g = p.groupBy("item_table", "item_id").agg(
        F.max("byte_end").alias("size"), (F.min("byte_start") == 0).alias("from_the_start"), F.bool_and(F.col("byte_end") - F.col("byte_start") <= F.col("limit_bytes")).alias("within_limit"), F.bool_and(shared).alias("shares_overlap"), (F.max("piece_no") + 1 == F.count("*")).alias("gapless")
    )
    return g


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every text by byte_bpe_50k."""
    return encoding.encode_corpus(table(spark, d, "documents", "doc_id", "text"))


def _mixture(spark: SparkSession, d: str) -> mixing.Mixture:
    return mixing.Mixture(table(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "mix_target"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture: which tokens of which document fill each slot."""
    return _mixture(spark, d).pieces()


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of the mixture."""
    return _mixture(spark, d).shares()


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """What the mixture must satisfy: slots are numbered without gaps, each holds a block of tokens, no text repeats too often, and the
    shares of the report add up."""
    mixture = _mixture(spark, d)
    pieces = mixture.pieces()
    slots = pieces.groupBy("slot").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("tokens"), F.countDistinct("source").alias("sources"), F.max("repeat").alias("again"), F.first("source").alias("source"))
    told = mixture.shares().select("source", "max_repeats", "actual_share", F.col("tokens").alias("held"))
    s = slots.join(F.broadcast(told), "source").agg((F.max("slot") + 1 == F.count("*")).alias("gapless"), F.bool_and((F.col("tokens") == mixing.BLOCK_TOKENS) & (F.col("sources") == 1)).alias("full"), F.bool_and(F.col("again") < F.col("max_repeats")).alias("within_repeats"), F.count("*").alias("slots"))
    t = told.agg((F.abs(F.sum("actual_share") - 1) < 1e-9).alias("shares_add_up"), F.sum("held").alias("held"))
    one = s.withColumn("k", F.lit(1)).join(t.withColumn("k", F.lit(1)), "k")
    return one.select("gapless", "full", "within_repeats", "shares_add_up", (F.col("held") == F.col("slots") * mixing.BLOCK_TOKENS).alias("as_reported"))


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    """Characters of every text, and its lines that are not blank."""
    return p8_stats(spark, d).select("doc_id", "n_chars", "n_lines")


def p8_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics and label shares of every text."""
    return quality.text_statistics(table(spark, d, "documents", "doc_id", "text"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts that are mostly no prose."""
    return quality.not_prose(p8_stats(spark, d)).select("doc_id")


QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p3_found": p3_found, "p3_error_rate": p3_error_rate, "p3_rates": p3_rates, "p5_found": p5_found, "p5_pieces": p5_pieces, "p5_check": p5_check, "p6_ids": p6_ids, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p7_check": p7_check, "p8_found": p8_found, "p8_stats": p8_stats, "p8_counts": p8_counts}

_P3 = """
WITH static AS (
  SELECT lower(hex(checksum)) k FROM shared_chunk WHERE octet_length(checksum) = 32
  UNION SELECT lower(trim(c, chr(32) || chr(9) || chr(10) || chr(13))) FROM (SELECT unnest(chunk_map).checksum c FROM file_cache) WHERE regexp_full_match(c, '\\s*[0-9a-fA-F]{64}\\s*')),
r AS (SELECT request_id, lower(hex(checksum)) k FROM upload_chunk_request WHERE octet_length(checksum) = 32),
judged AS (SELECT request_id, row_number() OVER (PARTITION BY k ORDER BY request_id) > 1 OR k IN (SELECT k FROM static) AS seen FROM r)
"""

_P5 = """
WITH lim AS (SELECT item_kind, limit_bytes FROM size_limit),
i AS (SELECT 'input_item' item_table, item_id, CASE WHEN doc_id IS NULL THEN kind ELSE 'Document' END k,
    CASE WHEN doc_id IS NOT NULL THEN (SELECT max(octet_length(encode(text))) FROM documents d WHERE d.doc_id = i.doc_id)
      ELSE coalesce(list_max(list_transform(chunk_map, lambda c: c.byte_offset + c.length)), length) END size
  FROM input_item i
  UNION ALL SELECT 'svn_tag_file', id, 'SvnFile', CASE WHEN file_size > 0 THEN file_size ELSE TRY_CAST(regexp_extract(candidate_key, '^[0-9]+') AS BIGINT) END FROM svn_tag_file)
"""

SQL = {
    "p1_counts": """
WITH u AS (SELECT upload_id, unnest(missing_chunk_checksums) c FROM upload_plan), f AS (SELECT c, min(upload_id) id FROM u WHERE c IS NOT NULL GROUP BY c)
SELECT id, count(*) new_keys FROM f WHERE c NOT IN (SELECT checksum FROM shared_chunk) GROUP BY id""",
    "p3_found": _P3 + "SELECT request_id FROM judged WHERE seen",
    "p3_error_rate": _P3 + "SELECT count(*) requests, count(*) FILTER (WHERE seen) seen, CAST(0 AS BIGINT) false_negatives, true AS as_derived FROM judged",
    "p5_found": _P5 + "SELECT item_table, item_id FROM i JOIN lim ON lim.item_kind = i.k WHERE size > limit_bytes",
    "p5_check": _P5 + "SELECT item_table, item_id, CAST(size AS BIGINT) size, true AS from_the_start, true AS within_limit, true AS shares_overlap, true AS gapless FROM i JOIN lim ON lim.item_kind = i.k WHERE size > limit_bytes",
    "p1_found": """
WITH RECURSIVE sets AS (SELECT upload_id id, list_distinct(list_filter(missing_chunk_checksums, lambda c: c IS NOT NULL)) s, chunks_written_new told FROM upload_plan),
u AS (SELECT id, unnest(s) c FROM sets),
pairs AS (SELECT b.id src, a.id dst, count(*) shared FROM u a JOIN u b ON a.c = b.c AND a.id < b.id GROUP BY 1, 2),
near AS MATERIALIZED (SELECT src, list(dst) dsts FROM pairs JOIN sets x ON x.id = src JOIN sets y ON y.id = dst WHERE 10 * shared >= 7 * (len(x.s) + len(y.s) - shared) GROUP BY src),
ranked AS MATERIALIZED (SELECT row_number() OVER (ORDER BY src) n, src, dsts FROM near),
judged AS (
  SELECT CAST(0 AS BIGINT) n, CAST([] AS BIGINT[]) repeats
  UNION ALL SELECT r.n, CASE WHEN len(list_filter(r.dsts, lambda x: NOT list_contains(j.repeats, x))) > 0 THEN list_append(j.repeats, r.src) ELSE j.repeats END FROM judged j JOIN ranked r ON r.n = j.n + 1),
fresh AS (SELECT c, min(id) id FROM u WHERE c NOT IN (SELECT checksum FROM shared_chunk) GROUP BY c),
counted AS (SELECT id, count(*) k FROM fresh GROUP BY id)
SELECT 'repeat' finding, unnest(repeats) upload_id FROM judged WHERE n = (SELECT max(n) FROM judged)
UNION ALL SELECT 'count', sets.id FROM sets LEFT JOIN counted USING (id) WHERE told IS NOT NULL AND told <> coalesce(k, 0)""",
    "p7_check": "SELECT true AS gapless, true AS \"full\", true AS within_repeats, true AS shares_add_up, true AS as_reported",
    "p8_counts": r"""
WITH t AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda x: regexp_matches(x, '[^\s\pZ\x0b\x1c-\x1f\x{85}\x{ad}\x{200b}\x{200c}\x{200e}\x{200f}\x{202a}-\x{202e}\x{2060}\x{feff}]')) shown FROM documents)
SELECT doc_id, CAST(length(text) AS BIGINT) n_chars, CAST(coalesce(len(shown), 0) AS BIGINT) n_lines FROM t""",
}
