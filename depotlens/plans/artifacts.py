"""Catalogue queries over artifacts: deltas, metrics, index maintenance, scalar functions and sessions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depotlens.functions import columns as c
from depotlens.operators import delta, metrics, storage
from depotlens.plans import mapping as m
from depotlens.plans.mapping import sql
from depotlens.sources.tables import table

QUERIES, SQL = {}, {}


def _query(text: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = text
        return f

    return register


# ---- uploads and deltas


@_query("""WITH r AS (SELECT delta_file_id, chunk_store_id, x.chunk_index idx, x.checksum c FROM (SELECT delta_file_id, chunk_store_id, unnest(chunks) x FROM delta_file))
SELECT c chunk_id, delta_file_id release_id, chunk_store_id component, idx FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY delta_file_id, chunk_store_id, idx) n FROM r WHERE c IS NOT NULL AND c NOT IN (SELECT checksum FROM chunk)) WHERE n = 1""")
def upload_plan(spark: SparkSession, d: str) -> DataFrame:
    """One source for each chunk that has to be uploaded."""
    f = table(spark, d, "delta_file", "delta_file_id", "chunk_store_id", "chunks").select(F.col("delta_file_id").alias("release_id"), F.col("chunk_store_id").alias("component"), F.explode("chunks").alias("x"))
    refs = f.select("release_id", "component", F.col("x.checksum").alias("chunk_id"), F.col("x.chunk_index").alias("idx")).where("chunk_id is not null")
    return delta.upload_plan(refs, table(spark, d, "chunk", "checksum").withColumnRenamed("checksum", "chunk_id"))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """References of each release as base and, against the release before it, as target; a pair is the base's number."""
    refs = m.references(spark, d).withColumns({"component": F.col("l_suppkey") % 7, "release_id": F.col("l_orderkey"), "chunk_id": F.col("l_partkey")})
    sized = refs.join(m.chunks(spark, d).select("chunk_id", "length"), "chunk_id")
    w = Window.partitionBy("release_id", "component").orderBy("chunk_id", "l_suppkey", *m.LINE_ORDER)
    f = sized.select("release_id", "component", "chunk_id", "length", (F.row_number().over(w) - 1).cast("bigint").alias("idx"))
    return f.withColumn("pair", F.col("release_id")), f.where("release_id > 1").withColumn("pair", F.col("release_id") - 1)


_SIDES = """, h AS (SELECT l_orderkey release_id, l_suppkey % 7 component, l_partkey chunk_id,
  row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 7 ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity, l_shipdate) - 1 idx FROM lineitem JOIN chk ON chunk_id = l_partkey),
b AS (SELECT release_id pair, component, chunk_id, idx FROM h), t AS (SELECT release_id - 1 pair, component, chunk_id, idx FROM h WHERE release_id > 1),
bs AS (SELECT pair, component, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY idx) s FROM b GROUP BY 1, 2), ts AS (SELECT pair, component, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY idx) s, count(*) n FROM t GROUP BY 1, 2),
st AS (SELECT ts.pair, ts.component, CASE WHEN bs.s IS NULL THEN 'new' WHEN bs.s = ts.s THEN 'keep' ELSE 'modified' END status, ts.n chunk_count FROM ts LEFT JOIN bs USING (pair, component))
"""


@_query(sql(_SIDES + "SELECT pair, component, status, chunk_count FROM st"))
def delta_files(spark: SparkSession, d: str) -> DataFrame:
    """Status of the files of each target release against its base."""
    base, target = _sides(spark, d)
    sign = lambda x: delta.file_signatures(x.drop("release_id").withColumnRenamed("pair", "release_id")).withColumnRenamed("release_id", "pair")
    return delta.delta_files(sign(base), sign(target))


_MODIFIED = _SIDES + """, u AS (SELECT pair, component, chunk_id, count(*) k FROM b GROUP BY 1, 2, 3),
refs AS (SELECT t.pair, t.component, t.idx, t.chunk_id, CAST(coalesce(sum(c.length) OVER (PARTITION BY t.pair, t.component ORDER BY t.idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) byte_offset, c.length,
  CASE WHEN row_number() OVER (PARTITION BY t.pair, t.component, t.chunk_id ORDER BY t.idx) <= coalesce(u.k, 0) THEN 'existing' ELSE 'new' END source
  FROM t JOIN st ON st.pair = t.pair AND st.component = t.component AND st.status = 'modified' JOIN chk c USING (chunk_id) LEFT JOIN u ON u.pair = t.pair AND u.component = t.component AND u.chunk_id = t.chunk_id)
"""


@_query(sql(_MODIFIED + "SELECT * FROM refs"))
def delta_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Origin and offset of the chunks of each modified file."""
    return delta.delta_chunks(*_sides(spark, d))


@_query(sql(_MODIFIED + "SELECT pair, chunk_id, min(length) length FROM refs WHERE source = 'new' GROUP BY 1, 2"))
def delta_new_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Distinct chunks to transfer for modified files; counts of uses decide, no window is needed."""
    base, target = _sides(spark, d)
    u = base.groupBy("pair", "component", "chunk_id").agg(F.count("*").alias("k"))
    v = target.groupBy("pair", "component", "chunk_id").agg(F.count("*").alias("n"), F.min("length").alias("length")).join(base.select("pair", "component"), ["pair", "component"], "left_semi")
    # A file that uses a chunk more often than its base does is modified.
    return v.join(u, ["pair", "component", "chunk_id"], "left").where(F.col("n") > F.coalesce("k", F.lit(0))).groupBy("pair", "chunk_id").agg(F.min("length").alias("length"))


@_query(sql(_SIDES + """, w AS (SELECT pair, count(DISTINCT component) = 1 single FROM t GROUP BY 1), z AS (SELECT t.pair, t.component, sum(length) total FROM t JOIN chk USING (chunk_id) GROUP BY 1, 2)
SELECT pair, CASE WHEN single THEN 'file' ELSE component || '/file' END path, status, CAST(total AS BIGINT) total_size, CASE WHEN status = 'modified' THEN chunk_count ELSE 0 END refs FROM st JOIN w USING (pair) JOIN z USING (pair, component)"""))
def delta_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The files of each manifest: path, status, total size and number of references."""
    base, target = _sides(spark, d)
    sign = lambda x: delta.file_signatures(x.drop("release_id").withColumnRenamed("pair", "release_id")).withColumnRenamed("release_id", "pair")
    files = delta.delta_files(sign(base), sign(target)).join(target.groupBy("pair", "component").agg(F.sum("length").alias("total_size")), ["pair", "component"])
    named = files.withColumns({"component": F.col("component").cast("string"), "name": F.lit("file")})
    return named.select("pair", delta.manifest_path("pair", "component", "name").alias("path"), "status", "total_size", F.when(F.col("status") == "modified", F.col("chunk_count")).otherwise(0).alias("refs"))


# ---- metrics

_METRICS = sql(""", first AS (SELECT chunk_id, min(release_id) r FROM fc GROUP BY 1), used AS (SELECT release_id, chunk_id, count(*) n FROM fc GROUP BY 1, 2),
x AS (SELECT u.release_id, count(*) chunks_in_release, count(*) FILTER (WHERE f.r = u.release_id) new_chunks, CAST(sum(n * length) AS BIGINT) logical_bytes,
  CAST(coalesce(sum(length) FILTER (WHERE f.r = u.release_id), 0) AS BIGINT) new_bytes, CAST(coalesce(sum(compressed_length) FILTER (WHERE f.r = u.release_id), 0) AS BIGINT) new_compressed_bytes
  FROM used u JOIN first f USING (chunk_id) JOIN chk USING (chunk_id) GROUP BY 1),
y AS (SELECT *, CASE WHEN new_compressed_bytes > 0 THEN new_bytes / new_compressed_bytes ELSE 1.0 END compression_ratio, CASE WHEN new_bytes > 0 THEN logical_bytes / new_bytes ELSE 1.0 END dedup_ratio,
  CASE WHEN new_compressed_bytes > 0 THEN logical_bytes / new_compressed_bytes ELSE 1.0 END effective_ratio, greatest(0, new_bytes - new_compressed_bytes) compression_saved, greatest(0, logical_bytes - new_bytes) dedup_saved,
  CASE WHEN logical_bytes > 0 THEN new_bytes / logical_bytes * 100.0 ELSE 0.0 END new_data_percent FROM x)
""")


def _release_references(spark: SparkSession, d: str) -> DataFrame:
    return m.references(spark, d).select(F.col("l_orderkey").alias("release_id"), F.col("l_suppkey").alias("component"), F.col("l_partkey").alias("chunk_id"))


@_query(_METRICS + "SELECT * FROM y")
def release_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.release_metrics(_release_references(spark, d), m.chunks(spark, d))


@_query(_METRICS + """, z AS (SELECT release_id, CAST(floor(100 * (0.35 * greatest(0, least(1, (effective_ratio - 1) / 3)) + 0.2 * greatest(0, least(1, (dedup_ratio - 1) / 4)) + 0.15 * greatest(0, least(1, (compression_ratio - 1) / 2))
 + 0.2 * (1 - CASE WHEN new_data_percent <= 1 THEN greatest(0, new_data_percent) ELSE least(1, new_data_percent / 100) END)
 + 0.1 * greatest(0, least(1, 0.7 * (dedup_saved / greatest(logical_bytes, 1)) + 0.3 * (compression_saved / greatest(logical_bytes, 1))))) + 0.5) AS BIGINT) score FROM y)
SELECT release_id, score, CASE WHEN score >= 85 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'mixed' ELSE 'poor' END tone FROM z""")
def release_score(spark: SparkSession, d: str) -> DataFrame:
    return metrics.release_score(release_metrics(spark, d))


@_query("""WITH c AS (SELECT chunk_store_id s, checksum, max(length) length, max(compressed_length) compressed_length FROM chunk WHERE deleted_at IS NULL GROUP BY 1, 2),
cs AS (SELECT s, count(*) chunk_count, CAST(sum(length) AS BIGINT) unique_bytes, CAST(sum(compressed_length) AS BIGINT) compressed_bytes, CAST(trunc(avg(length)) AS BIGINT) avg_chunk, CAST(trunc(avg(compressed_length)) AS BIGINT) avg_compressed FROM c GROUP BY 1),
f AS (SELECT chunk_store_id s, lower(hex(new_hash)) g, count(*) n, max(file_size) z, sum(file_size) t FROM delta_file GROUP BY 1, 2),
fs AS (SELECT s, count(*) unique_files, CAST(coalesce(sum(z), 0) AS BIGINT) unique_file_bytes, CAST(coalesce(sum(t), 0) AS BIGINT) logical_bytes FROM f GROUP BY 1),
n AS (SELECT chunk_store_id s, count(DISTINCT target_release_id) releases FROM delta_file GROUP BY 1),
r AS (SELECT chunk_store_id s, x.checksum k, max(x.length) l FROM (SELECT chunk_store_id, unnest(chunks) x FROM delta_file) WHERE x.checksum IS NOT NULL GROUP BY 1, 2),
rs AS (SELECT s, count(*) referenced_chunks, CAST(sum(coalesce(l, 0)) AS BIGINT) referenced_bytes FROM r GROUP BY 1)
SELECT cs.s store_id, chunk_count, unique_bytes, compressed_bytes, avg_chunk, avg_compressed, coalesce(unique_files, 0) unique_files, coalesce(unique_file_bytes, 0) unique_file_bytes, coalesce(logical_bytes, 0) logical_bytes, coalesce(releases, 0) releases, coalesce(referenced_chunks, 0) referenced_chunks, coalesce(referenced_bytes, 0) referenced_bytes,
CASE WHEN compressed_bytes > 0 THEN unique_bytes / compressed_bytes ELSE 1.0 END compression_ratio, CASE WHEN unique_bytes > 0 THEN coalesce(logical_bytes, 0) / unique_bytes ELSE 1.0 END dedup_ratio, CASE WHEN compressed_bytes > 0 THEN coalesce(logical_bytes, 0) / compressed_bytes ELSE 1.0 END effective_ratio,
greatest(0, unique_bytes - compressed_bytes) compression_saved, greatest(0, coalesce(logical_bytes, 0) - unique_bytes) dedup_saved
FROM cs LEFT JOIN fs USING (s) LEFT JOIN n USING (s) LEFT JOIN rs USING (s)""")
def store_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The periodic snapshot of every store."""
    stored = table(spark, d, "chunk", "chunk_store_id", "checksum", "length", "compressed_length", "deleted_at").where("deleted_at is null").groupBy(F.col("chunk_store_id").alias("store_id"), "checksum").agg(F.max("length").alias("length"), F.max("compressed_length").alias("compressed_length"))
    f = table(spark, d, "delta_file", "chunk_store_id", "new_hash", "file_size", "target_release_id", "chunks")
    refs = f.select(F.col("chunk_store_id").alias("store_id"), F.explode("chunks").alias("x")).select("store_id", "x.checksum", "x.length")
    files = f.select(F.col("chunk_store_id").alias("store_id"), F.col("new_hash").alias("digest"), "file_size", F.col("target_release_id").alias("release_id"))
    return metrics.store_snapshot(stored, refs, files)


# ---- index maintenance


@_query("""SELECT checksum, generation, length, compressed_length FROM (SELECT checksum, CAST(epoch_us(created_at) AS BIGINT) generation, length, compressed_length,
row_number() OVER (PARTITION BY checksum ORDER BY created_at DESC, length DESC, compressed_length DESC) n FROM chunk) WHERE n = 1""")
def index_compaction(spark: SparkSession, d: str) -> DataFrame:
    """Newest entry of each checksum over all segments."""
    e = table(spark, d, "chunk", "checksum", "created_at", "length", "compressed_length").withColumn("generation", F.unix_micros("created_at"))
    return storage.newest(e, "checksum", "generation", ["length", "compressed_length"])


@_query("SELECT checksum, entry_id, length FROM (SELECT *, row_number() OVER (PARTITION BY checksum ORDER BY entry_id) n FROM checksum_length WHERE checksum IS NOT NULL) WHERE n = 1")
def index_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Index from a scan: the first entry of each checksum."""
    e = table(spark, d, "checksum_length", "checksum", "entry_id", "length").where("checksum is not null")
    return storage.rebuild(e, "checksum", ["entry_id"], ["length"])


@_query("""SELECT checksum, request_id, data_length FROM (SELECT checksum, request_id, data_length, row_number() OVER (PARTITION BY checksum ORDER BY request_id) n FROM upload_chunk_request WHERE checksum IS NOT NULL)
WHERE n = 1 AND checksum NOT IN (SELECT checksum FROM chunk)""")
def idempotent_insert(spark: SparkSession, d: str) -> DataFrame:
    """Requests that write something: the first of each checksum that is not stored."""
    r = table(spark, d, "upload_chunk_request", "checksum", "request_id", "data_length")
    return storage.insert_new(table(spark, d, "chunk", "checksum"), r, "checksum", ["request_id"])


@_query("""WITH x AS (SELECT id, substr(relative_path, 1, 3) bucket, lower(hex(unhex(substr(sha256(relative_path), 1, 4)))) h FROM svn_tag_file)
SELECT id, bucket, substr(h, 1, 3) right_bucket FROM x WHERE bucket <> substr(h, 1, 3)""")
def rebucket(spark: SparkSession, d: str) -> DataFrame:
    """Records whose bucket is not the prefix of their digest."""
    r = table(spark, d, "svn_tag_file", "id", "relative_path").select("id", F.substring("relative_path", 1, 3).alias("bucket"), F.unhex(F.substring(F.sha2("relative_path", 256), 1, 4)).alias("digest"))
    return storage.misplaced(r, "bucket", "digest").select("id", "bucket", "right_bucket")


@_query("SELECT prefix, entries, CASE WHEN entries >= 4096 * 256 THEN 2 WHEN entries >= 4096 * 16 THEN 1 ELSE 0 END AS level FROM (SELECT substr(lower(hex(checksum)), 1, 1) prefix, count(*) entries FROM chunk GROUP BY 1)")
def segment_levels(spark: SparkSession, d: str) -> DataFrame:
    """Compaction level that each range of the index would have."""
    g = table(spark, d, "chunk", "checksum").groupBy(F.substring(F.lower(F.hex("checksum")), 1, 1).alias("prefix")).agg(F.count("*").alias("entries"))
    return g.select("prefix", "entries", storage.compaction_level(F.col("entries")).alias("level"))


# ---- scalar functions


@_query(r"""SELECT id, regexp_replace(replace(relative_path, chr(92), '/'), '^/+', '') normal, len(string_split(replace(relative_path, chr(92), '/'), '/')) tokens,
lower(CAST(file_size AS VARCHAR) || ':' || last_changed_revision || ':' || relative_path) k FROM svn_tag_file WHERE file_size IS NOT NULL AND last_changed_revision IS NOT NULL""")
def path_functions(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "svn_tag_file", "id", "relative_path", "file_size", "last_changed_revision").where("file_size is not null and last_changed_revision is not null")
    p = F.col("relative_path")
    return f.select("id", c.normal_path(p).alias("normal"), F.size(c.path_tokens(F.translate(p, "\\", "/"))).cast("bigint").alias("tokens"), c.candidate_key(F.col("file_size"), F.col("last_changed_revision"), p).alias("k"))


@_query(r"""WITH f AS (SELECT item_id, component, regexp_replace(replace(relative_path, chr(92), '/'), '^/+', '') p FROM input_item)
SELECT item_id, CASE WHEN component IS NOT NULL AND trim(component) <> '' AND lower(component) <> 'default' AND starts_with(lower(p), lower(component) || '/') THEN substr(p, length(component) + 2) ELSE p END inner_path,
CASE WHEN component IS NULL OR component = '' THEN p ELSE component || '/' || p END full_path FROM f""")
def component_strip(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "input_item", "item_id", "component", "relative_path")
    p, k = F.col("relative_path"), F.col("component")
    return i.select("item_id", c.strip_component(p, k).alias("inner_path"), c.combine_path(k, c.normal_path(p)).alias("full_path"))


@_query("SELECT token, count(*) uses FROM (SELECT unnest(string_split(replace(relative_path, chr(92), '/'), '/')) token FROM svn_tag_file) GROUP BY 1")
def token_table(spark: SparkSession, d: str) -> DataFrame:
    """Uses of every path segment."""
    return table(spark, d, "svn_tag_file", "relative_path").select(F.explode(c.path_tokens(F.translate("relative_path", "\\", "/"))).alias("token")).groupBy("token").agg(F.count("*").alias("uses"))


@_query(r"SELECT id, relative_path FROM svn_tag_file WHERE regexp_matches(replace(relative_path, chr(92), '/'), '(?i)^(bin/.*|[^/]*/web/.*\.png)$') AND NOT regexp_matches(replace(relative_path, chr(92), '/'), '(?i)^.*\.tm.$') AND NOT regexp_matches(lower(replace(relative_path, chr(92), '/')), '(^|/)\.(svn|git|hg)/')")
def glob_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "svn_tag_file", "id", "relative_path").where(c.glob_match(F.col("relative_path"), ["bin/**", "*/web/**.png"], ["**.tm?"]))


@_query("""SELECT id, file_size, CASE WHEN file_size < 1024 THEN file_size || ' B' WHEN file_size < 1048576 THEN printf('%.1f KB', round(file_size / 1024.0, 1)) ELSE printf('%.1f MB', round(file_size / 1048576.0, 1)) END size_text,
CAST(CASE WHEN file_size <= 1 THEN 1 ELSE CAST(1 AS BIGINT) << length(ltrim(bin(file_size - 1), '0')) END AS BIGINT) power FROM svn_tag_file WHERE file_size > 0""")
def bytes_human(spark: SparkSession, d: str) -> DataFrame:
    """Sizes as text, and the power of two that holds them."""
    f = table(spark, d, "svn_tag_file", "id", "file_size").where("file_size > 0")
    return f.select("id", "file_size", c.size_text(F.col("file_size")).alias("size_text"), c.power_of_two_at_least(F.col("file_size")).alias("power"))


@_query("SELECT checksum, lower(hex(checksum)) hex_text, substr(lower(hex(checksum)), 1, 3) prefix, octet_length(checksum) = 32 AS well_formed FROM checksum_length WHERE checksum IS NOT NULL")
def hash_functions(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("checksum")
    return table(spark, d, "checksum_length", "checksum").where("checksum is not null").select("checksum", F.lower(F.hex(h)).alias("hex_text"), c.hash_prefix(h).alias("prefix"), (F.octet_length(h) == 32).alias("well_formed"))


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') missing, CASE WHEN event_type = 'click' THEN 'k=' || json_extract_string(props, '$.k') ELSE event_type END label FROM events")
def job_progress_json(spark: SparkSession, d: str) -> DataFrame:
    """Payloads decoded by type."""
    e = table(spark, d, "events", "event_id", "event_type", "props")
    k = F.get_json_object("props", "$.k")
    return e.select("event_id", k.cast("bigint").alias("k"), F.get_json_object("props", "$.missing").alias("missing"), F.when(F.col("event_type") == "click", F.concat(F.lit("k="), k)).otherwise(F.col("event_type")).alias("label"))


@_query("SELECT event_id, value, CASE WHEN x > n THEN (value - n) / (x - n) ELSE 0.0 END scaled FROM events JOIN (SELECT event_type, min(value) n, max(value) x FROM events GROUP BY 1) g USING (event_type)")
def series_scaled(spark: SparkSession, d: str) -> DataFrame:
    """Values of each type scaled to 0..1."""
    e = table(spark, d, "events", "event_id", "event_type", "value")
    g = e.groupBy("event_type").agg(F.min("value").alias("n"), F.max("value").alias("x"))
    return e.join(g, "event_type").select("event_id", "value", F.when(F.col("x") > F.col("n"), (F.col("value") - F.col("n")) / (F.col("x") - F.col("n"))).otherwise(0.0).alias("scaled"))


# ---- sessions

_GAP = "INTERVAL 30 MINUTE"


@_query(f"""WITH e AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= {_GAP} THEN 1 ELSE 0 END s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) n FROM e)
SELECT user_id, min(ts) session_start, max(ts) last_seen, count(*) requests, count(DISTINCT event_id % 500) unique_chunks, CAST(sum(CAST(trunc(value) AS BIGINT)) AS BIGINT) bytes FROM k GROUP BY user_id, n""")
def sessions_30m(spark: SparkSession, d: str) -> DataFrame:
    """Ingest sessions that end after 30 minutes without a request, with their counters."""
    e = table(spark, d, "events", "event_id", "ts", "user_id", "value").select("user_id", "ts", (F.col("event_id") % 500).alias("chunk"), F.col("value").cast("bigint").alias("size"))
    per_chunk = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("s")).agg(F.min("ts").alias("session_start"), F.max("ts").alias("last_seen"), F.count("*").alias("requests"), F.size(F.collect_set("chunk")).cast("bigint").alias("unique_chunks"), F.sum("size").alias("bytes"))
    return per_chunk.drop("s")


@_query("""WITH r AS (SELECT session_id, checksum, data_length, row_number() OVER (PARTITION BY session_id, checksum ORDER BY request_id) n FROM upload_chunk_request WHERE checksum IS NOT NULL)
SELECT session_id, count(*) chunks_total, count(*) FILTER (WHERE n = 1) chunks_unique, CAST(coalesce(sum(data_length), 0) AS BIGINT) metered_bytes, CAST(coalesce(sum(data_length) FILTER (WHERE n = 1), 0) AS BIGINT) unique_bytes FROM r GROUP BY 1""")
def session_counters(spark: SparkSession, d: str) -> DataFrame:
    """Metering counts every chunk, the session's unique figures only the first of each checksum."""
    r = table(spark, d, "upload_chunk_request", "session_id", "checksum", "data_length", "request_id").where("checksum is not null")
    per = r.groupBy("session_id", "checksum").agg(F.count("*").alias("n"), F.sum("data_length").alias("total"), F.min(F.struct("request_id", "data_length")).alias("first"))
    return per.groupBy("session_id").agg(F.sum("n").alias("chunks_total"), F.count("*").alias("chunks_unique"), F.coalesce(F.sum("total"), F.lit(0)).alias("metered_bytes"), F.coalesce(F.sum(F.col("first.data_length").cast("bigint")), F.lit(0)).alias("unique_bytes"))
