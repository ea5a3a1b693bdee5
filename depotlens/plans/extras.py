"""Further catalogue queries: name functions, settings, roles, filters of the index, archives and tar streams, with their SQL."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens.functions import codecs
from depotlens.functions import columns as c
from depotlens.functions.arrow import slices
from depotlens.operators import bloom, delta
from depotlens.operators import querying as q
from depotlens.plans import mapping as m
from depotlens.plans.mapping import sql
from depotlens.sources import files
from depotlens.sources.tables import table

QUERIES, SQL = {}, {}


def _query(text: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = text
        return f

    return register


@_query("""SELECT repo_id, repo_name || '.depot.example' host, repo_name slug, '1.0.' || regexp_extract(repo_name || '-17', '-([0-9]+)$', 1) AS version, 'a.zip' AS archive, 'in|' || repo_name entry FROM repository""")
def name_functions(spark: SparkSession, d: str) -> DataFrame:
    """Host names, version names and container locators taken apart."""
    r = table(spark, d, "repository", "repo_id", "repo_name")
    host = F.concat("repo_name", F.lit(".depot.example"))
    parts = c.locator_parts(F.concat(F.lit("zip|a.zip|in|"), F.col("repo_name")))
    return r.select("repo_id", host.alias("host"), c.tenant_slug(host, "depot.example").alias("slug"), c.revision_version(F.concat("repo_name", F.lit("-17/"))).alias("version"), parts["archive"].alias("archive"), parts["entry"].alias("entry"))


@_query("SELECT id, array_to_string(list_transform(string_split(replace(relative_path, chr(92), '/'), '/'), lambda s: url_encode(s)), '/') url FROM svn_tag_file")
def url_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "svn_tag_file", "id", "relative_path").select("id", c.url_path(F.translate("relative_path", "\\", "/")).alias("url"))


@_query("SELECT token, regexp_matches(token, '(?i)password|secret|key|token') AS secret FROM (SELECT DISTINCT component token FROM input_item WHERE component IS NOT NULL UNION SELECT DISTINCT repo_name FROM repository)")
def secret_names(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "input_item", "component").select(F.col("component").alias("token")).where("token is not null").union(table(spark, d, "repository", "repo_name")).distinct()
    return names.select("token", c.is_secret(F.col("token")).alias("secret"))


@_query("SELECT event_id, 'props:k' setting, json_extract_string(props, '$.k') setting_value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def settings_flattened(spark: SparkSession, d: str) -> DataFrame:
    """Payloads as flat settings; keys are whatever the payload has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys, values = [], [], []
            for i, p in zip(b.column("event_id").to_pylist(), b.column("props").to_pylist()):
                for k, v in codecs.flatten(json.loads(p), "props").items():
                    ids.append(i)
                    keys.append(k)
                    values.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string()), pa.array(values, pa.string())], names=["event_id", "setting", "setting_value"])

    return table(spark, d, "events", "event_id", "props").where("props is not null").mapInArrow(run, "event_id bigint, setting string, setting_value string")


@_query("SELECT event_id, true AS same FROM events WHERE props IS NOT NULL")
def settings_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Flat settings nested again are the payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = []
            for p in b.column("props").to_pylist():
                flat = codecs.flatten(json.loads(p))
                same.append(codecs.flatten(codecs.unflatten(flat)) == flat)
            yield pa.RecordBatch.from_arrays([b.column("event_id"), pa.array(same, pa.bool_())], names=["event_id", "same"])

    return table(spark, d, "events", "event_id", "props").where("props is not null").mapInArrow(run, "event_id bigint, same boolean")


@_query(sql(""", w AS (SELECT *, CASE role WHEN 'Reader' THEN 1 WHEN 'Writer' THEN 2 WHEN 'Maintainer' THEN 3 ELSE 4 END r FROM acc)
SELECT repo.repo_id, arg_max(w.role, w.r) strongest, max(w.r) >= 2 AS may_write FROM repo JOIN w USING (tenant_id) GROUP BY 1"""))
def effective_access(spark: SparkSession, d: str) -> DataFrame:
    """Strongest role that anyone has on a repository through its tenant; roles are reduced by tenant before the join."""
    rank = F.create_map(*[F.lit(x) for pair in (("Reader", 1), ("Writer", 2), ("Maintainer", 3), ("Owner", 4)) for x in pair])
    best = m.accounts(spark, d).groupBy("tenant_id").agg(F.max(F.struct(rank[F.col("role")].alias("r"), "role")).alias("b"))
    return m.repositories(spark, d).join(best, "tenant_id").select("repo_id", F.col("b.role").alias("strongest"), (F.col("b.r") >= 2).alias("may_write"))


@_query(sql("SELECT repo_id FROM repo WHERE NOT EXISTS (SELECT 1 FROM rel WHERE rel.repo_id = repo.repo_id AND rel.state = 'P')"))
def repos_without_open_release(spark: SparkSession, d: str) -> DataFrame:
    """Repositories all of whose releases are in another state."""
    return m.repositories(spark, d).join(m.releases(spark, d).where("state = 'P'"), "repo_id", "left_anti").select("repo_id")


@_query("""WITH t AS (SELECT DISTINCT lower(relative_path) p FROM svn_tag_file), f AS (SELECT DISTINCT item_id, lower(relative_path) p FROM input_item)
SELECT f.item_id, t.p IS NOT NULL AS bound FROM f LEFT JOIN t USING (p)""")
def items_bound_by_path(spark: SparkSession, d: str) -> DataFrame:
    """Items that a scanned file of the same path, without case, binds to."""
    t = table(spark, d, "svn_tag_file", "relative_path").select(F.lower("relative_path").alias("p")).distinct().withColumn("hit", F.lit(True))
    return table(spark, d, "input_item", "item_id", "relative_path").select("item_id", F.lower("relative_path").alias("p")).join(t, "p", "left").select("item_id", F.col("hit").isNotNull().alias("bound"))


@_query("""SELECT repo_id, repo_name, last FROM (SELECT r.repo_id, r.repo_name, CAST(max(u.request_id) AS BIGINT) AS last FROM repository r LEFT JOIN upload_chunk_request u USING (repo_id) GROUP BY ALL) ORDER BY last DESC NULLS LAST, repo_name LIMIT 20""")
def recent_repositories(spark: SparkSession, d: str) -> DataFrame:
    """Top 20 repositories by last use; those never used come last, by name."""
    u = table(spark, d, "upload_chunk_request", "repo_id", "request_id").groupBy("repo_id").agg(F.max("request_id").alias("last"))
    r = table(spark, d, "repository", "repo_id", "repo_name").join(u, "repo_id", "left")
    return r.orderBy(F.col("last").desc_nulls_last(), "repo_name").limit(20)


@_query("""SELECT coalesce(a.candidate_key, b.candidate_key) candidate_key, CASE WHEN a.candidate_key IS NOT NULL THEN 'cache' ELSE 'scan' END source
FROM (SELECT DISTINCT candidate_key FROM file_cache) a FULL JOIN (SELECT DISTINCT candidate_key FROM svn_tag_file) b USING (candidate_key)""")
def keys_union_first(spark: SparkSession, d: str) -> DataFrame:
    """All candidate keys; for those in both tables the cache's row is kept."""
    a = table(spark, d, "file_cache", "candidate_key").distinct().withColumn("source", F.lit("cache"))
    b = table(spark, d, "svn_tag_file", "candidate_key").distinct().withColumn("source", F.lit("scan"))
    return q.union_first(a, b, ["candidate_key"])


#: Entries that one of the 256 buckets of the filter query is sized for.
_PER_BUCKET = 4096


@_query("SELECT DISTINCT checksum digest FROM checksum_length WHERE octet_length(checksum) = 32 AND checksum IN (SELECT checksum FROM chunk)")
def index_filter_hits(spark: SparkSession, d: str) -> DataFrame:
    """Lookups that pass the Bloom filters of the index, confirmed by the index itself."""
    bucket = lambda: F.substring(F.hex("checksum"), 1, 2)
    stored, asked = table(spark, d, "chunk", "checksum"), table(spark, d, "checksum_length", "checksum")
    passed = bloom.might_contain(asked, bucket(), "checksum", bloom.build(stored, bucket(), "checksum", _PER_BUCKET), _PER_BUCKET).where("maybe").select("digest")
    return passed.join(stored.select(F.col("checksum").alias("digest")), "digest", "left_semi")


@_query("SELECT doc_id, 'texts/' || doc_id || '.txt' entry_path, CAST(octet_length(encode(text)) AS BIGINT) length, 'semantic' reconstruction FROM documents WHERE text IS NOT NULL AND text <> ''")
def archived_documents(spark: SparkSession, d: str) -> DataFrame:
    """Texts put into zip archives, listed again and planned for storage."""
    archives = zipped_texts(spark, d)
    entries = files.archive_entries(archives, "archive", "data")
    plans = files.plan_archives(archives.select("archive"), entries, "archive").select("archive", "reconstruction")
    listed = entries.where("not is_dir").join(plans, "archive")
    return listed.select(F.regexp_extract("archive", "^([0-9]+)", 1).cast("bigint").alias("doc_id"), "entry_path", "length", "reconstruction")


def zipped_texts(spark: SparkSession, d: str) -> DataFrame:
    """(archive, data): a zip archive of each text."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            out = []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("texts/", b"")
                    z.writestr(f"texts/{i}.txt", t.encode())
                out.append(buffer.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([f"{i}.zip" for i in b.column("doc_id").to_pylist()]), pa.array(out, pa.binary())], names=["archive", "data"])

    docs = table(spark, d, "documents", "doc_id", "text").where("text is not null and text <> ''")
    return docs.mapInArrow(pack, "archive string, data binary")


@_query("SELECT repo_id, count(*) members, CAST(sum(octet_length(encode(text))) AS BIGINT) bytes FROM documents WHERE text IS NOT NULL AND repo_id IN (SELECT repo_id FROM repository WHERE storage_class = 'hot') GROUP BY 1")
def tar_downloads(spark: SparkSession, d: str) -> DataFrame:
    """A compressed tar of the texts of each hot repository, read again and summed."""
    import tarfile

    hot = table(spark, d, "repository", "repo_id", "storage_class").where("storage_class = 'hot'")
    docs = table(spark, d, "documents", "doc_id", "repo_id", "text").where("text is not null").join(hot, "repo_id", "left_semi")
    tars = files.tar_stream(docs.select("repo_id", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content")), "repo_id", "path", "content")

    whole = delta.reassemble(tars, "group", "part_no", "tar_zst")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for b in slices(batches, "content"):
            counts, sums = [], []
            for data in b.column("content").to_pylist():
                with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)) as z, tarfile.open(fileobj=z, mode="r|") as t:
                    sizes = [x.size for x in t]
                counts.append(len(sizes))
                sums.append(sum(sizes))
            yield pa.RecordBatch.from_arrays([b.column("group"), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], names=["repo_id", "members", "bytes"])

    return whole.mapInArrow(read, "repo_id string, members bigint, bytes bigint")


@_query("SELECT chunk_store_id, CASE WHEN dead > 0.5 THEN 'unhealthy' WHEN dead > 0.05 THEN 'degraded' ELSE 'healthy' END health FROM (SELECT chunk_store_id, count(deleted_at) / count(*) dead FROM chunk GROUP BY 1)")
def store_health(spark: SparkSession, d: str) -> DataFrame:
    """State of each store by the share of its chunks that are deleted."""
    dead = F.count("deleted_at") / F.count("*")
    g = table(spark, d, "chunk", "chunk_store_id", "deleted_at").groupBy("chunk_store_id").agg(dead.alias("dead"))
    return g.select("chunk_store_id", F.when(F.col("dead") > 0.5, "unhealthy").when(F.col("dead") > 0.05, "degraded").otherwise("healthy").alias("health"))


@_query("SELECT item_id, x.byte_offset, CAST(x.length AS BIGINT) length FROM (SELECT item_id, unnest(chunk_map) x FROM input_item WHERE doc_id IS NULL) WHERE x.checksum IS NOT NULL AND octet_length(x.checksum) = 32")
def chunk_map_entries(spark: SparkSession, d: str) -> DataFrame:
    """Well-formed entries of the chunk maps of plain items, one row each."""
    i = table(spark, d, "input_item", "item_id", "doc_id", "chunk_map").where("doc_id is null").select("item_id", F.explode("chunk_map").alias("x"))
    return i.where("octet_length(x.checksum) = 32").select("item_id", "x.byte_offset", F.col("x.length").cast("bigint").alias("length"))
