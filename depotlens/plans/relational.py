"""Catalogue queries: projections, joins, aggregations, windows, paging and set operations over the domain views, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depotlens.operators import querying as q
from depotlens.plans import mapping as m
from depotlens.plans.mapping import sql
from depotlens.sources.tables import table

QUERIES, SQL = {}, {}

#: Fixed present for relative dates.
NOW = "2001-08-01 00:00:00"


def _query(text: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = text
        return f

    return register


def _bigint(c):
    return c.cast("bigint")


# ---- projections and filters


@_query(sql("SELECT r.repo_id, r.repo_name, s.store_name, t.slug FROM repo r JOIN tenant t USING (tenant_id) JOIN store s USING (store_id) WHERE t.tenant_id = 7"))
def tenant_repositories(spark: SparkSession, d: str) -> DataFrame:
    """Repositories of one tenant with the name of their store, through two references."""
    r = m.repositories(spark, d).where("tenant_id = 7").join(m.tenants(spark, d), "tenant_id").join(m.stores(spark, d), "store_id")
    return r.select("repo_id", "repo_name", "store_name", "slug")


@_query("SELECT r.repo_name, r.tenant_id, r.chunk_store_id, count(c.checksum) stored_chunks, CAST(coalesce(sum(c.length), 0) AS BIGINT) stored_bytes FROM repository r LEFT JOIN chunk c ON c.chunk_store_id = r.chunk_store_id AND c.deleted_at IS NULL WHERE r.storage_class = 'hot' GROUP BY ALL")
def repositories_with_store(spark: SparkSession, d: str) -> DataFrame:
    """Repositories of a class with what their chunk store holds; the chunks are aggregated per store before the join."""
    held = table(spark, d, "chunk", "chunk_store_id", "checksum", "length", "deleted_at").where("deleted_at is null").groupBy("chunk_store_id").agg(F.count("checksum").alias("n"), F.sum("length").alias("bytes"))
    r = table(spark, d, "repository").where("storage_class = 'hot'").join(held, "chunk_store_id", "left")
    return r.select("repo_name", "tenant_id", "chunk_store_id", F.coalesce("n", F.lit(0)).alias("stored_chunks"), F.coalesce("bytes", F.lit(0)).alias("stored_bytes"))


@_query(sql("SELECT release_id, repo_id, version, created_at FROM rel WHERE (state = 'F' OR version LIKE '%99%') AND created_at >= TIMESTAMP '2001-08-01 00:00:00' - INTERVAL 90 DAY"))
def releases_filtered(spark: SparkSession, d: str) -> DataFrame:
    """A nested filter given as a value, with a relative date."""
    since = F.lit(NOW).cast("timestamp") - F.expr("interval 90 days")
    spec = {"and": [{"or": [{"state": {"eq": "F"}}, {"version": {"contains": "99"}}]}]}
    return q.select_fields(m.releases(spark, d).where(q.predicate(spec)).where(F.col("created_at") >= since), ["release_id", "repo_id", "version", "created_at"])


@_query("SELECT event_id, event_type FROM events WHERE event_type IN (SELECT event_type FROM events WHERE event_id = 1)")
def jobs_by_optional_type(spark: SparkSession, d: str) -> DataFrame:
    """Jobs of the type of job 1; without a type the filter would keep all."""
    e = table(spark, d, "events", "event_id", "event_type")
    kind = e.where("event_id = 1").select("event_type")
    return e.where(q.optional_equal("event_type", None)).join(kind, "event_type", "left_semi").select("event_id", "event_type")


@_query("SELECT id, tag_id FROM svn_tag_file WHERE last_changed_revision < 20000 AND file_size > 0 AND file_hash_hex IS NULL")
def tag_files_without_digest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "svn_tag_file").where("last_changed_revision < 20000 AND file_size > 0 AND file_hash_hex IS NULL").select("id", "tag_id")


@_query("SELECT candidate_key, file_size FROM file_cache WHERE evicted_at IS NULL AND (last_used_at IS NULL OR last_used_at > TIMESTAMPTZ '2025-09-01 00:00:00+00')")
def active_cache_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries that are not evicted and were used recently or never."""
    c = table(spark, d, "file_cache", "candidate_key", "file_size", "evicted_at", "last_used_at")
    return c.where(F.col("evicted_at").isNull() & (F.col("last_used_at").isNull() | (F.col("last_used_at") > F.lit("2025-09-01 00:00:00").cast("timestamp")))).select("candidate_key", "file_size")


# ---- joins


@_query(sql("SELECT rel.release_id, rel.version, repo.repo_name FROM rel JOIN repo USING (repo_id) JOIN tenant USING (tenant_id) WHERE store_id = 2"))
def releases_for_store(spark: SparkSession, d: str) -> DataFrame:
    """Releases whose repository's tenant lies in one store; the filter sits on the smallest table."""
    t = m.tenants(spark, d).where("store_id = 2").select("tenant_id")
    return m.releases(spark, d).join(m.repositories(spark, d).join(t, "tenant_id"), "repo_id").select("release_id", "version", "repo_name")


@_query(sql(", u AS (SELECT DISTINCT chunk_id FROM fc) SELECT chunk_id, length FROM chk WHERE chunk_id NOT IN (SELECT chunk_id FROM u)"))
def unreferenced_chunks(spark: SparkSession, d: str) -> DataFrame:
    return m.chunks(spark, d).join(m.references(spark, d).select(F.col("l_partkey").alias("chunk_id")), "chunk_id", "left_anti").select("chunk_id", "length")


_REFERENCED = "(SELECT delta_file_id, chunk_store_id, x.chunk_index, x.checksum, x.length FROM (SELECT delta_file_id, chunk_store_id, unnest(chunks) x FROM delta_file))"


def _referenced(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that delta files refer to."""
    f = table(spark, d, "delta_file", "delta_file_id", "chunk_store_id", "chunks")
    return f.select("delta_file_id", "chunk_store_id", F.explode("chunks").alias("x")).select("delta_file_id", "chunk_store_id", "x.chunk_index", "x.checksum", "x.length")


@_query(f"SELECT DISTINCT chunk_store_id, checksum FROM {_REFERENCED} r WHERE checksum IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chunk c WHERE c.chunk_store_id = r.chunk_store_id AND c.checksum = r.checksum)")
def missing_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Referenced chunks that their store never held."""
    r = _referenced(spark, d).where("checksum is not null").select("chunk_store_id", "checksum").distinct()
    return r.join(table(spark, d, "chunk", "chunk_store_id", "checksum"), ["chunk_store_id", "checksum"], "left_anti")


@_query(f"SELECT chunk_store_id, checksum, length FROM chunk c WHERE deleted_at IS NULL AND EXISTS (SELECT 1 FROM {_REFERENCED} r WHERE c.chunk_store_id = r.chunk_store_id AND c.checksum = r.checksum)")
def known_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Stored chunks that some delta file refers to."""
    c = table(spark, d, "chunk", "chunk_store_id", "checksum", "length", "deleted_at").where("deleted_at is null").drop("deleted_at")
    return c.join(_referenced(spark, d).select("chunk_store_id", "checksum"), ["chunk_store_id", "checksum"], "left_semi")


@_query(f"""SELECT r.delta_file_id, r.chunk_index, coalesce(r.length, k.length, 0) length, r.length IS NULL AND k.length IS NULL AS unknown
FROM {_REFERENCED} r LEFT JOIN (SELECT chunk_store_id, checksum, max(length) length FROM chunk GROUP BY 1, 2) k ON k.chunk_store_id = r.chunk_store_id AND k.checksum = r.checksum""")
def fill_missing_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Length of each reference: its own, else that of the stored chunk, else 0."""
    k = table(spark, d, "chunk", "chunk_store_id", "checksum", "length").groupBy("chunk_store_id", "checksum").agg(F.max("length").alias("stored"))
    j = _referenced(spark, d).join(k, ["chunk_store_id", "checksum"], "left")
    return j.select("delta_file_id", "chunk_index", F.coalesce("length", "stored", F.lit(0)).alias("length"), (F.col("length").isNull() & F.col("stored").isNull()).alias("unknown"))


@_query(sql("SELECT t.tenant_id, t.tenant_name, array_to_string(list_sort(coalesce(list(DISTINCT a.role) FILTER (a.role IS NOT NULL), [])), ',') roles, count(a.account_id) members FROM tenant t LEFT JOIN acc a USING (tenant_id) GROUP BY ALL"))
def members_with_roles(spark: SparkSession, d: str) -> DataFrame:
    """Roles present in each tenant as a list; a tenant without members has an empty one."""
    a = m.accounts(spark, d).groupBy("tenant_id").agg(F.collect_set("role").alias("roles"), F.count("*").alias("members"))
    j = m.tenants(spark, d).join(a, "tenant_id", "left")
    return j.select("tenant_id", "tenant_name", F.array_join(F.array_sort(F.coalesce("roles", F.array().cast("array<string>"))), ",").alias("roles"), F.coalesce("members", F.lit(0)).alias("members"))


@_query(sql("SELECT tenant_id, tenant_name, (SELECT min(role) FROM acc WHERE acc.tenant_id = tenant.tenant_id) first_role FROM tenant"))
def first_role_of_tenant(spark: SparkSession, d: str) -> DataFrame:
    """A correlated scalar subquery, decorrelated into an aggregate and a join."""
    m.tenants(spark, d).createOrReplaceTempView("tenant_view")
    m.accounts(spark, d).createOrReplaceTempView("account_view")
    return spark.sql("SELECT tenant_id, tenant_name, (SELECT min(role) FROM account_view a WHERE a.tenant_id = t.tenant_id) AS first_role FROM tenant_view t")


@_query(sql("SELECT tenant_id FROM tenant WHERE EXISTS (SELECT 1 FROM acc WHERE acc.tenant_id = tenant.tenant_id AND role = 'Owner' AND account_id > (SELECT min(account_id) FROM acc))"))
def tenants_with_owner(spark: SparkSession, d: str) -> DataFrame:
    """A correlated EXISTS with a nested scalar subquery."""
    m.tenants(spark, d).createOrReplaceTempView("tenant_view")
    m.accounts(spark, d).createOrReplaceTempView("account_view")
    return spark.sql("SELECT tenant_id FROM tenant_view t WHERE EXISTS (SELECT 1 FROM account_view a WHERE a.tenant_id = t.tenant_id AND a.role = 'Owner' AND a.account_id > (SELECT min(account_id) FROM account_view))")


@_query("SELECT r.repo_name, lower(r.storage_class) storage_class, c.rank FROM repository r JOIN (VALUES ('hot', 1), ('standard', 2), ('cold', 3), ('archive', 4)) c(name, rank) ON c.name = lower(r.storage_class)")
def storage_class_map(spark: SparkSession, d: str) -> DataFrame:
    """Repositories joined to the ranks of their storage class."""
    c = spark.createDataFrame([("hot", 1), ("standard", 2), ("cold", 3), ("archive", 4)], "storage_class string, rank int")
    return table(spark, d, "repository").select("repo_name", F.lower("storage_class").alias("storage_class")).join(c, "storage_class").select("repo_name", "storage_class", "rank")


_PREFIXES = [("bin", "runtime"), ("bin/data", "payload"), ("docs", "manual"), ("data", "payload"), ("data/web", "site"), ("web", "site"), ("shaders/assets", "art")]
_PREFIX_SQL = ", ".join(f"('{a}', '{b}')" for a, b in _PREFIXES)


@_query(f"""WITH f AS (SELECT id, trim(replace(relative_path, chr(92), '/'), '/') p FROM svn_tag_file),
x AS (SELECT f.id, f.p, k.component, row_number() OVER (PARTITION BY f.id ORDER BY length(k.prefix) DESC NULLS LAST) n
  FROM f LEFT JOIN (VALUES {_PREFIX_SQL}) k(prefix, component) ON f.p = k.prefix OR starts_with(f.p, k.prefix || '/'))
SELECT id, coalesce(component, CASE WHEN contains(p, '/') THEN split_part(p, '/', 1) ELSE 'default' END) component FROM x WHERE n = 1""")
def component_longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Component of a path: the longest mapped prefix, else the first folder, else `default`.

    The map is a fixed list, so the longest match is a chain of comparisons, longest first: no join, no window."""
    p = F.regexp_replace(F.translate("relative_path", "\\", "/"), "^/+|/+$", "")
    match = F.when(p.contains("/"), F.split_part(p, F.lit("/"), F.lit(1))).otherwise("default")
    for prefix, component in sorted(_PREFIXES, key=lambda x: len(x[0])):
        match = F.when((p == prefix) | p.startswith(prefix + "/"), component).otherwise(match)
    return table(spark, d, "svn_tag_file", "id", "relative_path").select("id", match.alias("component"))


@_query("""WITH f AS (SELECT id, lower(candidate_key) k FROM svn_tag_file), c AS (SELECT candidate_key k, min(first_seen_at) seen FROM file_cache WHERE evicted_at IS NULL GROUP BY 1)
SELECT f.id, c.seen IS NOT NULL AS hit FROM f LEFT JOIN c USING (k)""")
def download_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """Which tag files a cached download serves."""
    c = table(spark, d, "file_cache", "candidate_key", "first_seen_at", "evicted_at").where("evicted_at is null").groupBy(F.col("candidate_key").alias("k")).agg(F.min("first_seen_at").alias("seen"))
    return table(spark, d, "svn_tag_file", "id", "candidate_key").select("id", F.lower("candidate_key").alias("k")).join(c, "k", "left").select("id", F.col("seen").isNotNull().alias("hit"))


# ---- aggregations


@_query(sql("SELECT t.tenant_id, t.tenant_name, CAST(sum(c.length) AS BIGINT) used_bytes, count(DISTINCT rel.release_id) releases FROM fc JOIN chk c USING (chunk_id) JOIN rel USING (release_id) JOIN repo USING (repo_id) JOIN tenant t USING (tenant_id) GROUP BY ALL"))
def tenant_usage(spark: SparkSession, d: str) -> DataFrame:
    """Logical bytes and releases of each tenant.  References are reduced to one row a release before any further join."""
    refs = m.references(spark, d).select(F.col("l_orderkey").alias("release_id"), F.col("l_partkey").alias("chunk_id")).join(m.chunks(spark, d).select("chunk_id", "length"), "chunk_id")
    size = refs.groupBy("release_id").agg(F.sum(F.col("length").cast("decimal(20,0)")).alias("bytes"))
    owned = size.join(m.releases(spark, d).select("release_id", "repo_id"), "release_id").join(m.repositories(spark, d).select("repo_id", "tenant_id"), "repo_id")
    usage = owned.groupBy("tenant_id").agg(_bigint(F.sum("bytes")).alias("used_bytes"), F.count("*").alias("releases"))
    return usage.join(m.tenants(spark, d).select("tenant_id", "tenant_name"), "tenant_id")


@_query("SELECT (SELECT count(*) FROM repository) repositories, (SELECT count(DISTINCT tenant_id) FROM repository) tenants, (SELECT count(DISTINCT target_release_id) FROM delta_file) releases, (SELECT count(*) FROM chunk WHERE deleted_at IS NULL) chunks")
def instance_totals(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "repository").agg(F.count("*").alias("repositories"), F.countDistinct("tenant_id").alias("tenants"))
    rel = table(spark, d, "delta_file", "target_release_id").agg(F.countDistinct("target_release_id").alias("releases"))
    c = table(spark, d, "chunk", "deleted_at").where("deleted_at is null").agg(F.count("*").alias("chunks"))
    # Three single rows.
    one = F.lit(1)
    return r.withColumn("k", one).join(rel.withColumn("k", one), "k").join(c.withColumn("k", one), "k").drop("k")


@_query("""SELECT chunk_store_id, count(*) chunk_count, CAST(sum(length) AS BIGINT) logical_bytes, CAST(sum(compressed_length) AS BIGINT) compressed_bytes,
CAST(trunc(avg(length)) AS BIGINT) avg_length, CAST(trunc(avg(compressed_length)) AS BIGINT) avg_compressed,
CASE WHEN sum(compressed_length) > 0 THEN sum(length) / sum(compressed_length) ELSE 1.0 END compression_ratio, CAST(greatest(0, sum(length) - sum(compressed_length)) AS BIGINT) saved_bytes
FROM chunk WHERE deleted_at IS NULL GROUP BY 1""")
def chunk_store_stats(spark: SparkSession, d: str) -> DataFrame:
    """Chunk figures of every store in one pass; averages are cut to whole bytes."""
    g = table(spark, d, "chunk", "chunk_store_id", "length", "compressed_length", "deleted_at").where("deleted_at is null").groupBy("chunk_store_id").agg(
        F.count("*").alias("chunk_count"), F.sum("length").alias("logical_bytes"), F.sum("compressed_length").alias("compressed_bytes"), _bigint(F.avg("length")).alias("avg_length"), _bigint(F.avg("compressed_length")).alias("avg_compressed")
    )
    return g.withColumns({
        "compression_ratio": F.when(F.col("compressed_bytes") > 0, F.col("logical_bytes") / F.col("compressed_bytes")).otherwise(1.0),
        "saved_bytes": F.greatest(F.lit(0).cast("bigint"), F.col("logical_bytes") - F.col("compressed_bytes")),
    })


@_query(sql("SELECT count(*) chunk_count, CAST(sum(length) AS BIGINT) logical_bytes, CAST(trunc(avg(length)) AS BIGINT) avg_length, CAST(sqrt(avg(power(length - (SELECT trunc(avg(length)) FROM chk), 2))) AS BIGINT) deviation, min(length) least, max(length) most FROM chk"))
def chunk_global_stats(spark: SparkSession, d: str) -> DataFrame:
    """Global figures; the deviation is taken from the truncated mean, by sums of squares in one pass."""
    return chunk_figures(m.chunks(spark, d), "length")


def chunk_figures(chunks: DataFrame, length: str) -> DataFrame:
    """One row of figures over a column of lengths.  Sums are decimals of 38 digits: squares of billions of chunks leave a bigint."""
    wide = F.col(length).cast("decimal(19,0)")
    c = chunks.agg(F.count(length).alias("n"), F.sum(wide).alias("s"), F.sum((wide * wide).cast("decimal(38,0)")).cast("decimal(38,0)").alias("s2"), F.min(length).alias("least"), F.max(length).alias("most"))
    mean = F.when(F.col("n") > 0, F.expr("s div n"))
    exact = lambda x: x.cast("decimal(38,0)")
    squares = exact(F.col("s2")) - exact(2 * mean) * exact(F.col("s")) + exact(F.col("n")) * exact(mean) * exact(mean)
    return c.select(F.col("n").alias("chunk_count"), _bigint(F.col("s")).alias("logical_bytes"), _bigint(mean).alias("avg_length"), _bigint(F.round(F.sqrt(squares.cast("double") / F.col("n")))).alias("deviation"), "least", "most")


@_query("SELECT kind, count(*) items, count(DISTINCT lower(component)) components, count(*) FILTER (WHERE doc_id IS NOT NULL) texts FROM input_item GROUP BY 1")
def item_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Items by kind, with a case-insensitive distinct count and a conditional count."""
    return table(spark, d, "input_item", "kind", "component", "doc_id").groupBy("kind").agg(F.count("*").alias("items"), F.countDistinct(F.lower("component")).alias("components"), F.count_if(F.col("doc_id").isNotNull()).alias("texts"))


@_query("SELECT substr(lower(hex(checksum)), 1, 3) prefix, count(*) chunks, CAST(sum(compressed_length) AS BIGINT) bytes FROM chunk GROUP BY 1")
def bucket_stats(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each of the 4096 buckets by hash prefix."""
    return table(spark, d, "chunk", "checksum", "compressed_length").groupBy(F.substring(F.lower(F.hex("checksum")), 1, 3).alias("prefix")).agg(F.count("*").alias("chunks"), F.sum("compressed_length").alias("bytes"))


@_query("""WITH r AS (SELECT CASE WHEN contains(relative_path, '.') THEN lower(regexp_extract(relative_path, '\\.([^./\\\\]*)$', 1)) ELSE '' END ext, file_size FROM svn_tag_file)
SELECT CASE WHEN ext IN ('zip', 'jar', 'apk', 'nupkg', 'tar') THEN ext WHEN ext = 'gz' THEN 'gzip' WHEN ext = 'zst' THEN 'zstd' ELSE 'file' END format_id, count(*) files, CAST(sum(file_size) FILTER (WHERE file_size > 0) AS BIGINT) bytes FROM r GROUP BY 1""")
def format_detect(spark: SparkSession, d: str) -> DataFrame:
    """Files by the format that their extension tells."""
    from depotlens.functions.columns import format_id

    f = table(spark, d, "svn_tag_file", "relative_path", "file_size")
    return f.groupBy(format_id(F.col("relative_path")).alias("format_id")).agg(F.count("*").alias("files"), F.sum(F.when(F.col("file_size") > 0, F.col("file_size"))).alias("bytes"))


@_query("SELECT lang, count(*) blobs, count(DISTINCT sha256(text)) unique_blobs, CAST(sum(octet_length(encode(text))) AS BIGINT) bytes FROM documents WHERE text IS NOT NULL GROUP BY 1")
def dedup_by_lang(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "lang", "text").where("text is not null").select("lang", F.sha2("text", 256).alias("id"), F.octet_length("text").alias("n"))
    u = docs.groupBy("lang", "id").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    return u.groupBy("lang").agg(F.sum("c").alias("blobs"), F.count("*").alias("unique_blobs"), F.sum("n").alias("bytes"))


# ---- windows


@_query("""SELECT chunk_store_id, checksum, length, created_at FROM (SELECT *, row_number() OVER (PARTITION BY chunk_store_id, checksum ORDER BY length DESC, created_at, deleted_at NULLS FIRST) n FROM chunk) WHERE n = 1""")
def dedupe_keep_largest(spark: SparkSession, d: str) -> DataFrame:
    """One row for each chunk of a store: the longest, then the oldest.  An aggregate, so it combines before the shuffle."""
    c = table(spark, d, "chunk", "chunk_store_id", "checksum", "length", "created_at")
    best = c.groupBy("chunk_store_id", "checksum").agg(F.max(F.struct("length", (-F.unix_micros("created_at")).alias("age"))).alias("b"))
    return best.select("chunk_store_id", "checksum", "b.length", F.timestamp_micros(-F.col("b.age")).alias("created_at"))


@_query(sql("SELECT fc.release_id, fc.component, fc.idx, fc.chunk_id, CAST(coalesce(sum(c.length) OVER (PARTITION BY release_id, component ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) byte_offset, c.length FROM fc JOIN chk c USING (chunk_id)"))
def chunk_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Running offset of each chunk in its file: lengths are joined first, then one sort serves both windows."""
    refs = m.references(spark, d).join(m.chunks(spark, d).select(F.col("chunk_id").alias("l_partkey"), "length"), "l_partkey")
    w = Window.partitionBy("l_orderkey", "l_suppkey").orderBy(*m.LINE_ORDER)
    offset = F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return refs.select(F.col("l_orderkey").alias("release_id"), F.col("l_suppkey").alias("component"), (F.row_number().over(w) - 1).cast("bigint").alias("idx"), F.col("l_partkey").alias("chunk_id"), offset.alias("byte_offset"), "length")


@_query("SELECT item_id, component, kind, row_number() OVER (PARTITION BY component, kind ORDER BY relative_path, item_id) - 1 ordinal FROM input_item")
def backing_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """Ordinal of each item among those of its component and kind."""
    w = Window.partitionBy("component", "kind").orderBy("relative_path", "item_id")
    return table(spark, d, "input_item", "item_id", "component", "kind", "relative_path").select("item_id", "component", "kind", _bigint(F.row_number().over(w) - 1).alias("ordinal"))


@_query("SELECT checksum, count(*) copies FROM (SELECT chunk_store_id, checksum, lag(checksum) OVER (PARTITION BY chunk_store_id ORDER BY checksum, created_at) p FROM chunk) WHERE p = checksum GROUP BY 1")
def sorted_run_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Entries equal to their predecessor in a store's sorted run.

    Rows beyond the first of an equal run are its count less one, so an aggregate replaces the window over whole stores."""
    g = table(spark, d, "chunk", "chunk_store_id", "checksum").groupBy("chunk_store_id", "checksum").agg((F.count("*") - 1).alias("n"))
    return g.groupBy("checksum").agg(F.sum("n").alias("copies")).where("copies > 0")


# ---- order, pages, top n


@_query(sql("SELECT repo_id, release_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, release_id DESC) n FROM rel) WHERE n = 1"))
def latest_release_per_repo(spark: SparkSession, d: str) -> DataFrame:
    r = m.releases(spark, d).groupBy("repo_id").agg(F.max(F.struct("created_at", "release_id")).alias("b"))
    return r.select("repo_id", "b.release_id", "b.created_at")


@_query(sql("SELECT repo_id, release_id, CAST(n AS INT) AS rank, total FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY created_at DESC, release_id DESC) n, count(*) OVER (PARTITION BY repo_id) total FROM rel) WHERE n <= 3"))
def top_n_releases_per_repo(spark: SparkSession, d: str) -> DataFrame:
    """Newest three releases of each repository and how many it has."""
    r = m.releases(spark, d)
    top = q.top_per_group(r, ["repo_id"], [F.col("created_at").desc(), F.col("release_id").desc()], 3)
    return top.join(r.groupBy("repo_id").agg(F.count("*").alias("total")), "repo_id").select("repo_id", "release_id", "rank", "total")


@_query(sql("SELECT release_id, version, CAST(row_number() OVER (ORDER BY created_at DESC, release_id) AS INT) page_row, true has_next FROM rel WHERE (created_at < TIMESTAMP '1998-01-01' OR (created_at = TIMESTAMP '1998-01-01' AND release_id > 100)) ORDER BY created_at DESC, release_id LIMIT 25"))
def releases_page(spark: SparkSession, d: str) -> DataFrame:
    """The page of 25 after a cursor."""
    import datetime

    order = [{"created_at": "DESC"}, {"release_id": "ASC"}]
    page = q.keyset_page(m.releases(spark, d), order, 25, {"created_at": datetime.datetime(1998, 1, 1), "release_id": 100})
    return page.select("release_id", "version", "page_row", "has_next")


@_query(sql("SELECT repo_id, repo_name FROM repo ORDER BY repo_name, repo_id LIMIT 12 OFFSET 24"))
def repositories_page(spark: SparkSession, d: str) -> DataFrame:
    """Third page of twelve by offset."""
    return q.offset_page(m.repositories(spark, d).select("repo_id", "repo_name"), [{"repo_name": "ASC"}, {"repo_id": "ASC"}], 3)


@_query("SELECT event_id, event_type, CAST((row_number() OVER (ORDER BY ts, event_id) - 1) // 500 AS BIGINT) batch FROM events WHERE event_type IN (SELECT min(event_type) FROM events UNION SELECT max(event_type) FROM events)")
def incomplete_jobs_in_batches(spark: SparkSession, d: str) -> DataFrame:
    """Jobs of two states in order of creation, in batches of 500."""
    e = table(spark, d, "events", "event_id", "event_type", "ts")
    states = e.agg(F.array(F.min("event_type"), F.max("event_type")).alias("s")).select(F.explode("s").alias("event_type")).distinct()
    return q.batches(e.join(states, "event_type", "left_semi").select("event_id", "event_type", "ts"), F.to_date("ts"), ["ts", "event_id"], 500).select("event_id", "event_type", "batch")


@_query("""WITH f AS (SELECT DISTINCT relative_path || '@' || epoch_us(scanned_at) p FROM svn_tag_file),
k AS (SELECT p, array_to_string(list_transform(regexp_extract_all(p, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN lpad(CAST(length(ltrim(x, '0')) AS VARCHAR), 10, '0') || ltrim(x, '0') ELSE lower(x) END), chr(1)) key FROM f)
SELECT p label, key natural_key FROM k WHERE p IS NOT NULL""")
def natural_sort_keys(spark: SparkSession, d: str) -> DataFrame:
    """A key under which the labels of scanned files, `path@microseconds`, sort naturally: digit runs of any length by value."""
    from depotlens.functions.columns import natural_key

    label = F.concat("relative_path", F.lit("@"), F.unix_micros("scanned_at").cast("string"))
    return table(spark, d, "svn_tag_file", "relative_path", "scanned_at").select(label.alias("label")).where("label is not null").distinct().select("label", natural_key(F.col("label")).alias("natural_key"))


# ---- sets


@_query("SELECT DISTINCT checksum FROM checksum_length WHERE checksum IS NOT NULL EXCEPT SELECT checksum FROM chunk")
def checksums_never_stored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "checksum_length", "checksum").where("checksum is not null").subtract(table(spark, d, "chunk", "checksum"))


@_query(sql("SELECT repo_id subject, 'direct' source FROM repo WHERE storage_class = 'BUILDING' UNION ALL SELECT account_id, 'tenant admin' FROM acc WHERE role = 'Owner'"))
def repo_access_list(spark: SparkSession, d: str) -> DataFrame:
    """Concatenation that keeps duplicates."""
    a = m.repositories(spark, d).where("storage_class = 'BUILDING'").select(F.col("repo_id").alias("subject"), F.lit("direct").alias("source"))
    return a.unionByName(m.accounts(spark, d).where("role = 'Owner'").select(F.col("account_id").alias("subject"), F.lit("tenant admin").alias("source")))


@_query("""WITH have AS (SELECT DISTINCT repo_id, component FROM input_item WHERE kind = 'ContainerEntry'), want AS (SELECT DISTINCT repo_id, component FROM input_item WHERE kind = 'FileSystemFile')
SELECT repo_id, component, 'remove' change FROM have WHERE NOT EXISTS (SELECT 1 FROM want w WHERE w.repo_id = have.repo_id AND w.component = have.component)
UNION ALL SELECT repo_id, component, 'add' FROM want WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.repo_id = want.repo_id AND h.component = want.component)""")
def assignments_add_remove(spark: SparkSession, d: str) -> DataFrame:
    """Differences both ways between two sets of assignments."""
    i = table(spark, d, "input_item", "repo_id", "component", "kind")
    have, want = i.where("kind = 'ContainerEntry'").select("repo_id", "component").distinct(), i.where("kind = 'FileSystemFile'").select("repo_id", "component").distinct()
    k = ["repo_id", "component"]
    return have.join(want, k, "left_anti").withColumn("change", F.lit("remove")).unionByName(want.join(have, k, "left_anti").withColumn("change", F.lit("add")))


@_query(sql("SELECT tenant_id, len(list_filter(['Reader', 'Writer', 'Owner'], lambda r: NOT list_contains(rs, r))) = 0 AS has_all FROM (SELECT tenant_id, list(DISTINCT role) rs FROM acc GROUP BY 1)"))
def superset_check(spark: SparkSession, d: str) -> DataFrame:
    roles = m.accounts(spark, d).groupBy("tenant_id").agg(F.collect_set("role").alias("rs"))
    return roles.select("tenant_id", (F.size(F.array_except(F.array(F.lit("Reader"), F.lit("Writer"), F.lit("Owner")), "rs")) == 0).alias("has_all"))


@_query("""SELECT coalesce(n.candidate_key, o.candidate_key) candidate_key, CASE WHEN n.candidate_key IS NULL THEN o.file_size ELSE n.file_size END file_size, coalesce(o.first_seen_at, n.first_seen_at) first_seen_at
FROM (SELECT candidate_key, max(file_size) file_size, min(first_seen_at) first_seen_at FROM file_cache WHERE evicted_at IS NULL GROUP BY 1) o
FULL JOIN (SELECT lower(candidate_key) candidate_key, max(file_size) file_size, min(scanned_at) first_seen_at FROM svn_tag_file WHERE file_size > 0 GROUP BY 1) n USING (candidate_key)""")
def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The cache after an upsert from the scanned files: sizes are updated, the first sighting is kept."""
    o = table(spark, d, "file_cache", "candidate_key", "file_size", "first_seen_at", "evicted_at").where("evicted_at is null").groupBy("candidate_key").agg(F.max("file_size").alias("file_size"), F.min("first_seen_at").alias("first_seen_at"))
    n = table(spark, d, "svn_tag_file", "candidate_key", "file_size", "scanned_at").where("file_size > 0").groupBy(F.lower("candidate_key").alias("candidate_key")).agg(F.max("file_size").alias("file_size"), F.min("scanned_at").alias("first_seen_at"))
    return q.upsert(o, n, ["candidate_key"], keep=["first_seen_at"])


# ---- validation of keys


@_query("""SELECT 'chunk' table_name, 'duplicate key' problem, count(*) found FROM (SELECT 1 FROM chunk WHERE deleted_at IS NULL GROUP BY chunk_store_id, checksum HAVING count(*) > 1)
UNION ALL SELECT 'checksum_length', 'malformed checksum', count(*) FROM checksum_length WHERE checksum IS NULL OR octet_length(checksum) <> 32
UNION ALL SELECT 'upload_chunk_request', 'malformed checksum', count(*) FROM upload_chunk_request WHERE checksum IS NULL OR octet_length(checksum) <> 32
UNION ALL SELECT 'repository', 'duplicate key', count(*) FROM (SELECT 1 FROM repository GROUP BY tenant_id, repo_name HAVING count(*) > 1)""")
def validate_keys(spark: SparkSession, d: str) -> DataFrame:
    """Violations of the keys and checks that the store's metadata promises."""

    def row(df, t, p):
        return df.agg(F.count("*").alias("found")).select(F.lit(t).alias("table_name"), F.lit(p).alias("problem"), "found")

    def twice(df, *k):
        return df.groupBy(*k).agg(F.count("*").alias("n")).where("n > 1")

    bad = F.col("checksum").isNull() | (F.octet_length("checksum") != 32)
    out = row(twice(table(spark, d, "chunk", "chunk_store_id", "checksum", "deleted_at").where("deleted_at is null"), "chunk_store_id", "checksum"), "chunk", "duplicate key")
    out = out.unionByName(row(table(spark, d, "checksum_length", "checksum").where(bad), "checksum_length", "malformed checksum"))
    out = out.unionByName(row(table(spark, d, "upload_chunk_request", "checksum").where(bad), "upload_chunk_request", "malformed checksum"))
    return out.unionByName(row(twice(table(spark, d, "repository", "tenant_id", "repo_name"), "tenant_id", "repo_name"), "repository", "duplicate key"))
