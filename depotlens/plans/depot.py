"""Catalogue queries over the depot's own tables: access, pages, packs, index tiers, settings, sessions and payloads, with their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depotlens.functions import chunking, codecs
from depotlens.functions import columns as c
from depotlens.functions.arrow import slices
from depotlens.operators import metrics, storage
from depotlens.operators import querying as q
from depotlens.operators.index_store import PackIndex
from depotlens.plans import mapping as m
from depotlens.plans.mapping import sql
from depotlens.session import Workspace
from depotlens.sources import files, packs
from depotlens.sources.tables import table
from depotlens.streaming import ingest

QUERIES, SQL = {}, {}


def _query(text: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = text
        return f

    return register


# ---- access

_ACCESS = """, asked AS (SELECT DISTINCT o_orderkey % (SELECT count(*) FROM supplier) + 1 account_id, o_custkey repo_id FROM orders),
direct AS (SELECT o_orderkey % (SELECT count(*) FROM supplier) + 1 account_id, o_custkey repo_id, max(o_orderkey % 3) r FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
member AS (SELECT account_id, tenant_id FROM acc), grp AS (SELECT account_id, account_id % 7 group_id, tenant_id FROM acc),
grole AS (SELECT c_custkey repo_id, c_custkey % 7 group_id, c_custkey % 3 r FROM customer WHERE c_mktsegment <> 'BUILDING'),
j AS (SELECT a.account_id, a.repo_id, a.account_id % 50 = 0 AS instance_admin, mm.account_id IS NOT NULL AS member, acc.role = 'Owner' AS tenant_admin, d.r direct_r, g.r group_r
  FROM asked a JOIN repo ON repo.repo_id = a.repo_id LEFT JOIN member mm ON mm.account_id = a.account_id AND mm.tenant_id = repo.tenant_id LEFT JOIN acc ON acc.account_id = a.account_id
  LEFT JOIN direct d ON d.account_id = a.account_id AND d.repo_id = a.repo_id
  LEFT JOIN (SELECT grp.account_id, grp.tenant_id, grole.repo_id, max(grole.r) r FROM grp JOIN grole USING (group_id) JOIN repo USING (repo_id) WHERE repo.tenant_id = grp.tenant_id GROUP BY ALL) g ON g.account_id = a.account_id AND g.repo_id = a.repo_id AND g.tenant_id = repo.tenant_id)
SELECT account_id, repo_id, CASE WHEN instance_admin THEN 'instance admin' WHEN NOT member THEN 'no member' WHEN tenant_admin THEN 'tenant admin' WHEN direct_r >= 1 THEN 'direct role' WHEN group_r >= 1 THEN 'group role' ELSE 'none' END AS rule,
  CASE WHEN instance_admin THEN true WHEN NOT member THEN false WHEN tenant_admin THEN true ELSE coalesce(direct_r >= 1, false) OR coalesce(group_r >= 1, false) END AS may_write FROM j"""


@_query(sql(_ACCESS))
def effective_access_rules(spark: SparkSession, d: str) -> DataFrame:
    """Whether an account may write to a repository, by the first rule that decides: instance admin, member of the tenant at all, tenant
    admin, direct role, role of a group.  All assignments are reduced to one row a subject and repository before they meet the asked pairs."""
    accounts = m.accounts(spark, d)
    n = table(spark, d, "supplier").agg(F.count("*").alias("n"))
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus").join(F.broadcast(n))
    o = o.select((F.col("o_orderkey") % F.col("n") + 1).alias("account_id"), F.col("o_custkey").alias("repo_id"), "o_orderstatus", (F.col("o_orderkey") % 3).alias("r"))
    asked = o.select("account_id", "repo_id").distinct()
    direct = o.where("o_orderstatus = 'F'").groupBy("account_id", "repo_id").agg(F.max("r").alias("direct_r"))
    repos = m.repositories(spark, d).select("repo_id", "tenant_id", "storage_class")
    group_roles = repos.where("storage_class <> 'BUILDING'").select("repo_id", (F.col("repo_id") % 7).alias("group_id"), (F.col("repo_id") % 3).alias("group_r"))
    j = asked.join(repos.select("repo_id", "tenant_id"), "repo_id").join(accounts.select("account_id", F.col("tenant_id").alias("own_tenant"), "role"), "account_id", "left").join(direct, ["account_id", "repo_id"], "left")
    # An account is in the group of its number, inside its own tenant.
    j = j.withColumn("group_id", F.when(F.col("own_tenant") == F.col("tenant_id"), F.col("account_id") % 7)).join(group_roles, ["repo_id", "group_id"], "left")
    admin, member = F.col("account_id") % 50 == 0, F.coalesce(F.col("own_tenant") == F.col("tenant_id"), F.lit(False))
    own, group = F.coalesce(F.col("direct_r") >= 1, F.lit(False)), F.coalesce(F.col("group_r") >= 1, F.lit(False))
    rule = F.when(admin, "instance admin").when(~member, "no member").when(F.col("role") == "Owner", "tenant admin").when(own, "direct role").when(group, "group role").otherwise("none")
    return j.select("account_id", "repo_id", rule.alias("rule")).withColumn("may_write", F.col("rule").isin("instance admin", "tenant admin", "direct role", "group role"))


@_query(sql("SELECT a.account_id, u.s_name user_name, a.role, t.slug FROM acc a JOIN supplier u ON u.s_suppkey = a.account_id JOIN tenant t USING (tenant_id) WHERE a.role <> 'Reader'"))
def members_with_users(spark: SparkSession, d: str) -> DataFrame:
    """Members of tenants with the user's name."""
    users = table(spark, d, "supplier", "s_suppkey", "s_name").select(F.col("s_suppkey").alias("account_id"), F.col("s_name").alias("user_name"))
    return m.accounts(spark, d).where("role <> 'Reader'").join(users, "account_id").join(m.tenants(spark, d).select("tenant_id", "slug"), "tenant_id").select("account_id", "user_name", "role", "slug")


@_query(sql("SELECT a.account_id, a.account_name, t.tenant_name FROM acc a JOIN tenant t USING (tenant_id) WHERE a.account_name LIKE '%7'"))
def service_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Service accounts with their tenant."""
    return m.accounts(spark, d).where("account_name LIKE '%7'").join(m.tenants(spark, d), "tenant_id").select("account_id", "account_name", "tenant_name")


@_query("""WITH map AS (SELECT tenant_id, storage_class, count(*) >= 2 AS enabled FROM repository WHERE storage_class IS NOT NULL GROUP BY ALL)
SELECT r.repo_id, r.storage_class, l.label FROM repository r JOIN map m ON m.tenant_id = r.tenant_id AND m.storage_class = r.storage_class AND m.enabled JOIN (SELECT storage_class, 'class ' || lower(storage_class) label FROM repository WHERE storage_class IS NOT NULL GROUP BY 1) l ON l.storage_class = r.storage_class""")
def enabled_storage_classes(spark: SparkSession, d: str) -> DataFrame:
    """Repositories whose tenant has their storage class enabled, with the class's label: mapping joined to classes, filtered by its flag."""
    r = table(spark, d, "repository", "repo_id", "tenant_id", "storage_class").where("storage_class is not null")
    mapping = r.groupBy("tenant_id", "storage_class").agg((F.count("*") >= 2).alias("enabled")).where("enabled")
    classes = r.select("storage_class").distinct().withColumn("label", F.concat(F.lit("class "), F.lower("storage_class")))
    return r.join(mapping, ["tenant_id", "storage_class"], "left_semi").join(classes, "storage_class").select("repo_id", "storage_class", "label")


@_query(sql("SELECT r.repo_id, s.store_name store_name, s.store_id store_options_average, t.slug owner_slug FROM repo r JOIN tenant t USING (tenant_id) JOIN store s USING (store_id)"))
def repositories_nested(spark: SparkSession, d: str) -> DataFrame:
    """Projection through nested structs: the store and its options stay structs until fields of them are asked for."""
    store = m.stores(spark, d).select("store_id", F.struct(F.col("store_name").alias("name"), F.struct(F.col("store_id").alias("average")).alias("options")).alias("store"))
    r = m.repositories(spark, d).join(m.tenants(spark, d).select("tenant_id", "store_id", F.struct("slug").alias("owner")), "tenant_id").join(store, "store_id")
    return q.select_fields(r, ["repo_id", "store.name", "store.options.average", "owner.slug"])


@_query("SELECT event_id, event_type FROM events WHERE event_type = 'click'")
def jobs_of_a_type(spark: SparkSession, d: str) -> DataFrame:
    """Optional filters: one is given, the other is not and leaves no trace in the plan."""
    e = table(spark, d, "events", "event_id", "event_type", "user_id")
    return e.where(q.optional_equal("event_type", "click")).where(q.optional_equal("user_id", None)).select("event_id", "event_type")


@_query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') IN (SELECT json_extract_string(props, '$.k') FROM events WHERE event_id <= 3)")
def jobs_naming_ids(spark: SparkSession, d: str) -> DataFrame:
    """Jobs whose payload names one of a set of ids."""
    e = table(spark, d, "events", "event_id", "props").withColumn("k", F.get_json_object("props", "$.k"))
    return e.join(e.where("event_id <= 3").select("k").where("k is not null").distinct(), "k", "left_semi").select("event_id")


@_query("SELECT upload_id, session_id, sent_at + INTERVAL 30 MINUTE expires_at, CAST(epoch_us(sent_at + INTERVAL 30 MINUTE) // 1000000 AS BIGINT) expires_unix FROM upload_plan WHERE chunks_written_new IS NOT NULL AND sent_at + INTERVAL 30 MINUTE > TIMESTAMPTZ '2025-06-01 00:00:00+00' AND batch_no % 3 IN (0, 1)")
def open_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Uploads in one of two states whose deadline has not passed, with the deadline as a time and in seconds."""
    u = table(spark, d, "upload_plan", "upload_id", "session_id", "sent_at", "chunks_written_new", "batch_no")
    at = F.col("sent_at") + F.expr("interval 30 minutes")
    state = (F.col("batch_no") % 3).isin(0, 1)
    return u.where(F.col("chunks_written_new").isNotNull() & state & (at > F.lit("2025-06-01 00:00:00+00:00").cast("timestamp"))).select("upload_id", "session_id", at.alias("expires_at"), F.unix_seconds(at).alias("expires_unix"))


# ---- lookups, pages


@_query("""WITH k AS (SELECT chunk_store_id s, checksum c, max(length) length FROM chunk GROUP BY 1, 2)
SELECT delta_file_id, x.chunk_index, CAST(k.length AS BIGINT) stored_length FROM (SELECT delta_file_id, chunk_store_id s, unnest(chunks) x FROM delta_file) f JOIN k ON k.s = f.s AND k.c = f.x.checksum""")
def stored_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Length of each reference whose chunk is stored, by a lookup that fails if one is missing."""
    k = table(spark, d, "chunk", "chunk_store_id", "checksum", "length").groupBy("chunk_store_id", "checksum").agg(F.max("length").cast("bigint").alias("stored_length"))
    refs = table(spark, d, "delta_file", "delta_file_id", "chunk_store_id", "chunks").select("delta_file_id", "chunk_store_id", F.explode("chunks").alias("x")).select("delta_file_id", "chunk_store_id", "x.chunk_index", "x.checksum")
    known = refs.join(k, ["chunk_store_id", "checksum"], "left_semi")
    return q.lookup_or_fail(known, k, ["chunk_store_id", "checksum"], "stored_length", "chunk").select("delta_file_id", "chunk_index", "stored_length")


@_query(sql(""", f AS (SELECT * FROM rel WHERE version LIKE '%7%'), p AS (SELECT *, row_number() OVER (ORDER BY state, created_at DESC, release_id) n FROM f WHERE state > 'F' OR (state = 'F' AND (created_at < TIMESTAMP '1997-01-01' OR (created_at = TIMESTAMP '1997-01-01' AND release_id > 5))))
SELECT release_id, state, CAST(n AS INT) page_row, (SELECT count(*) FROM p) > 20 AS has_next, true AS has_previous, (SELECT count(*) FROM f) total_count, (SELECT count(*) FROM rel) unfiltered_count FROM p WHERE n <= 20"""))
def releases_connection(spark: SparkSession, d: str) -> DataFrame:
    """A page of 20 after a cursor of three keys, with the counts of the filtered and of all releases beside it."""
    import datetime

    order = [{"state": "ASC"}, {"created_at": "DESC"}, {"release_id": "ASC"}]
    after = {"state": "F", "created_at": datetime.datetime(1997, 1, 1), "release_id": 5}
    page = q.connection(m.releases(spark, d).select("release_id", "version", "state", "created_at"), order, 20, after, q.predicate({"version": {"contains": "7"}}))
    return page.select("release_id", "state", "page_row", "has_next", "has_previous", "total_count", "unfiltered_count")


@_query("""WITH t AS (SELECT DISTINCT relative_path p FROM svn_tag_file WHERE relative_path IS NOT NULL), l AS (SELECT p FROM t ORDER BY p LIMIT 40),
k AS (SELECT p, array_to_string(list_transform(regexp_extract_all(p, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN lpad(CAST(length(ltrim(x, '0')) AS VARCHAR), 10, '0') || ltrim(x, '0') ELSE lower(x) END), chr(1)) key FROM l)
SELECT p relative_path, CAST(row_number() OVER (ORDER BY key, p) AS INT) place FROM k""")
def first_tags_in_natural_order(spark: SparkSession, d: str) -> DataFrame:
    """The first 40 paths in plain order, and only then put in natural order: the limit comes first."""
    first = table(spark, d, "svn_tag_file", "relative_path").where("relative_path is not null").distinct().orderBy("relative_path").limit(40)
    # At most 40 rows are numbered.
    return first.select("relative_path", F.row_number().over(Window.orderBy(c.natural_key(F.col("relative_path")), "relative_path")).alias("place"))


_MAP = [("bin", "runtime"), ("bin/data", "payload"), ("docs", "manual"), ("data", "payload"), ("data/web", "site"), ("web", "site"), ("shaders/assets", "art"), ("config", "config")]


@_query(f"""WITH f AS (SELECT id, trim(replace(relative_path, chr(92), '/'), '/') p FROM svn_tag_file),
x AS (SELECT f.id, f.p, k.component, row_number() OVER (PARTITION BY f.id ORDER BY length(k.prefix) DESC NULLS LAST) n FROM f LEFT JOIN (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _MAP)}) k(prefix, component) ON f.p = k.prefix OR starts_with(f.p, k.prefix || '/')),
y AS (SELECT id, p, coalesce(component, CASE WHEN contains(p, '/') THEN split_part(p, '/', 1) ELSE 'default' END) component FROM x WHERE n = 1)
SELECT id, component, CASE WHEN contains(p, '/') AND split_part(p, '/', 1) = component THEN substr(p, length(component) + 2) ELSE p END file_name FROM y""")
def release_file_names(spark: SparkSession, d: str) -> DataFrame:
    """Component by the longest prefix in a map table, and the file's name in the release.

    A path is joined to the map by each of its ancestors, so the match is an equality however large the map is."""
    mapping = spark.createDataFrame(_MAP, "prefix string, component string")
    f = table(spark, d, "svn_tag_file", "id", "relative_path").select("id", F.regexp_replace(F.translate("relative_path", "\\", "/"), "^/+|/+$", "").alias("p"))
    hits = f.select("id", F.explode(c.path_prefixes(F.col("p"))).alias("prefix")).join(mapping, "prefix").groupBy("id").agg(F.max_by("component", F.length("prefix")).alias("mapped"))
    first = F.when(F.col("p").contains("/"), F.split_part("p", F.lit("/"), F.lit(1))).otherwise("default")
    named = f.join(hits, "id", "left").withColumn("component", F.coalesce("mapped", first))
    return named.select("id", "component", c.release_file_name(F.col("p"), F.col("component")).alias("file_name"))


@_query("SELECT id, '1.0.' || tag_id AS version FROM svn_tag_file WHERE tag_id IS NOT NULL")
def tag_versions(spark: SparkSession, d: str) -> DataFrame:
    """Version of each tag from its folder's name; a folder without a revision is an error."""
    t = table(spark, d, "svn_tag_file", "id", "tag_id").where("tag_id is not null")
    return t.select("id", c.revision_version(F.concat(F.lit("/tags/rel-"), F.col("tag_id").cast("string"), F.lit("/")), strict=True).alias("version"))


# ---- settings and payloads


@_query("""WITH s AS (SELECT repo_id, unnest([{'k': 'depot:name', 'v': repo_name}, {'k': 'depot:store:id', 'v': coalesce(chunk_store_id, '')}, {'k': 'depot:store:accessKey', 'v': CASE WHEN tenant_id IS NULL THEN '' ELSE '***' END}]) x FROM repository)
SELECT repo_id, x.k setting, x.v setting_value FROM s""")
def settings_masked(spark: SparkSession, d: str) -> DataFrame:
    """Nested settings flattened to an allow-list of keys, secrets masked; sections that are not allowed are left out."""
    r = table(spark, d, "repository")
    nested = F.to_json(F.struct(F.struct(F.col("repo_name").alias("name"), F.struct(F.coalesce("chunk_store_id", F.lit("")).alias("id"), F.coalesce("tenant_id", F.lit("")).alias("accessKey")).alias("store")).alias("depot"), F.struct(F.lit("x").alias("debug")).alias("internal")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for b in batches:
            rows = [(i, k, v) for i, p in zip(b.column("repo_id").to_pylist(), b.column("p").to_pylist()) for k, v in codecs.flatten(json.loads(p)).items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*rows) if rows else [[], [], []])], names=["repo_id", "setting", "setting_value"])

    flat = r.select("repo_id", nested.alias("p")).mapInArrow(run, "repo_id string, setting string, setting_value string").where("startswith(setting, 'depot:')")
    return flat.select("repo_id", "setting", c.masked(F.col("setting"), F.col("setting_value")).alias("setting_value"))


@_query("SELECT item_kind || ':' || x.k setting, x.v setting_value FROM (SELECT item_kind, unnest([{'k': 'limit', 'v': CAST(limit_bytes AS VARCHAR)}, {'k': 'overlap', 'v': CAST(overlap_bytes AS VARCHAR)}]) x FROM size_limit)")
def settings_table(spark: SparkSession, d: str) -> DataFrame:
    """Settings as the key and value rows of a configuration source."""
    s = table(spark, d, "size_limit").select("item_kind", F.col("limit_bytes").cast("string").alias("limit"), F.col("overlap_bytes").cast("string").alias("overlap"))
    return s.unpivot("item_kind", ["limit", "overlap"], "k", "setting_value").select(F.concat_ws(":", "item_kind", "k").alias("setting"), "setting_value")


@_query("SELECT item_id, kind, CASE kind WHEN 'FileSystemFile' THEN relative_path ELSE coalesce(component, '') || '!' || relative_path END target, CASE kind WHEN 'FileSystemFile' THEN length END size FROM input_item WHERE relative_path IS NOT NULL")
def payloads_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """Payloads built as JSON of one shape a kind, and decoded by the schema of their kind."""
    i = table(spark, d, "input_item", "item_id", "kind", "component", "relative_path", "length").where("relative_path is not null")
    file_ = F.col("kind") == "FileSystemFile"
    payload = F.when(file_, F.to_json(F.struct(F.col("relative_path").alias("path"), "length"))).otherwise(F.to_json(F.struct(F.coalesce("component", F.lit("")).alias("archive"), F.col("relative_path").alias("entry"))))
    j = i.select("item_id", "kind", payload.alias("payload"))
    a, b = F.from_json("payload", "path string, length bigint"), F.from_json("payload", "archive string, entry string")
    return j.select("item_id", "kind", F.when(file_, a["path"]).otherwise(F.concat_ws("!", b["archive"], b["entry"])).alias("target"), F.when(file_, a["length"]).alias("size"))


@_query(r"SELECT entry_id, lower(hex(checksum)) hex_text, octet_length(checksum) bytes, rtrim(lower(hex(checksum)), '0') trimmed, checksum AS back FROM checksum_length WHERE checksum IS NOT NULL")
def bytes_functions(spark: SparkSession, d: str) -> DataFrame:
    """Bytes to hexadecimal text and back, their length, and the text without trailing zeros."""
    h = F.lower(F.hex("checksum"))
    return table(spark, d, "checksum_length", "entry_id", "checksum").where("checksum is not null").select("entry_id", h.alias("hex_text"), F.octet_length("checksum").cast("bigint").alias("bytes"), F.rtrim(h, F.lit("0")).alias("trimmed"), F.unhex(h).alias("back"))


@_query("""WITH s AS (SELECT id, file_size n FROM svn_tag_file WHERE file_size > 0), u AS (SELECT id, n, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 ELSE 3 END k FROM s),
t AS (SELECT id, n, k, regexp_replace(regexp_replace(printf('%.2f', round(n / power(1024.0, k), 2)), '0+$', ''), '\\.$', '') v FROM u) SELECT id, regexp_replace(v, '^0\\.', '.') || ' ' || ['byte', 'Kb', 'Mb', 'Gb'][k + 1] human FROM t""")
def sizes_in_words(spark: SparkSession, d: str) -> DataFrame:
    """Sizes in words."""
    return table(spark, d, "svn_tag_file", "id", "file_size").where("file_size > 0").select("id", c.bytes_human(F.col("file_size")).alias("human"))


@_query("""WITH s AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY upload_id) n, list_filter(missing_chunk_checksums, lambda x: octet_length(x) = 32) l FROM upload_plan WHERE session_id IS NOT NULL AND missing_chunk_checksums IS NOT NULL)
SELECT session_id, count(*) files, CAST(sum(len(l)) AS BIGINT) chunks, true AS same FROM s WHERE n <= 100 GROUP BY 1""")
def batch_payloads(spark: SparkSession, d: str) -> DataFrame:
    """File records of a session in one message (a message has at most 100 files), decoded again."""
    u = table(spark, d, "upload_plan", "upload_id", "session_id", "missing_chunk_checksums").where("session_id is not null and missing_chunk_checksums is not null")
    first = q.top_per_group(u.withColumn("l", F.filter("missing_chunk_checksums", lambda x: F.octet_length(x) == 32)), ["session_id"], [F.col("upload_id")], 100)
    lists = first.groupBy("session_id").agg(F.collect_list("l").alias("lists"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for session, many in zip(b.column("session_id").to_pylist(), b.column("lists").to_pylist()):
                sent = [(bytes(32), len(x), x) for x in many]
                got = codecs.decode_batch(codecs.encode_batch(sent))
                rows.append((session, len(got), sum(len(x[2]) for x in got), got == sent))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.bool_()))], names=["session_id", "files", "chunks", "same"])

    return lists.mapInArrow(run, "session_id string, files bigint, chunks bigint, same boolean")


# ---- packs and the index


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text", "lang").where("text is not null").select("doc_id", "lang", F.encode("text", "UTF-8").alias("content"))


@_query("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) length, sha256(text) content_id FROM documents WHERE text IS NOT NULL AND lang = 'en'")
def pack_bulk_get(spark: SparkSession, d: str) -> DataFrame:
    """Texts written to rotating packs; those of one language fetched by key, where they lie, with all checks."""
    texts = _texts(spark, d)
    index = packs.write_packs(texts, "doc_id", "content", Workspace(spark).path("packs"), rotate=1 << 20)
    got = packs.bulk_get(texts.where("lang = 'en'"), index, "doc_id")
    return got.select(F.col("key").alias("doc_id"), "length", F.sha2("content", 256).alias("content_id"))


@_query("SELECT sha256(text) content_id, count(*) > 0 AS indexed, CAST(max(octet_length(encode(text))) AS BIGINT) length FROM documents WHERE text IS NOT NULL AND octet_length(encode(text)) >= 200 GROUP BY 1")
def packs_rewritten(spark: SparkSession, d: str) -> DataFrame:
    """Packs rewritten without short contents, and their index built anew from the packs alone."""
    work = Workspace(spark)
    index = packs.write_packs(_texts(spark, d), "doc_id", "content", work.path("packs"), rotate=1 << 20)
    new = work.path("packs")
    packs.rewrite_packs(index, new, lambda content: F.octet_length(content) >= 200, rotate=1 << 20)
    return packs.rebuild_index(spark, new, lambda content: F.sha2(content, 256)).select(F.col("key").alias("content_id"), F.lit(True).alias("indexed"), "length")


_GENERATION = "CASE WHEN created_at < TIMESTAMPTZ '2025-03-01 00:00:00+00' THEN 1 WHEN created_at < TIMESTAMPTZ '2025-07-01 00:00:00+00' THEN 2 ELSE 3 END"


@_query(f"""WITH e AS (SELECT checksum, CAST({_GENERATION} AS BIGINT) generation, length, compressed_length FROM chunk WHERE checksum IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY checksum ORDER BY generation DESC, length DESC NULLS LAST, compressed_length DESC NULLS LAST) r FROM e)
SELECT checksum, generation, length, compressed_length FROM n WHERE r = 1 AND checksum IN (SELECT checksum FROM checksum_length)""")
def index_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Checksums looked up in an index of three generations, through its log and its sorted runs; the newest entry wins."""
    chunks = table(spark, d, "chunk", "checksum", "created_at", "length", "compressed_length").withColumn("g", F.expr("CASE WHEN created_at < timestamp'2025-03-01 00:00:00+00:00' THEN 1 WHEN created_at < timestamp'2025-07-01 00:00:00+00:00' THEN 2 ELSE 3 END"))
    index = PackIndex(spark, Workspace(spark).path("index"), "length int, compressed_length int")
    for g in (1, 2, 3):
        index.add(chunks.where(F.col("g") == g).select("checksum", "length", "compressed_length"))
    return index.find(table(spark, d, "checksum_length", "checksum"))


@_query("SELECT count(*) AS rows FROM chunk")
def index_rows(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a written index, counted from footers alone."""
    path = Workspace(spark).path("index")
    storage.write_index(table(spark, d, "chunk", "checksum", "length"), path, "checksum", 4)
    return packs.row_count(spark, path).select("rows")


@_query("""SELECT checksum, substr(lower(hex(checksum)), 1, 3) bucket, CASE WHEN deleted_at IS NULL THEN substr(lower(hex(checksum)), 1, 3) ELSE substr(lower(hex(checksum)), 1, 2) END <> substr(lower(hex(checksum)), 1, 3) AS moved FROM chunk""")
def rebucket_moves(spark: SparkSession, d: str) -> DataFrame:
    """Records of an older layout, with buckets of two digits, put into those of three."""
    h = F.lower(F.hex("checksum"))
    r = table(spark, d, "chunk", "checksum", "deleted_at").select("checksum", F.when(F.col("deleted_at").isNull(), F.substring(h, 1, 3)).otherwise(F.substring(h, 1, 2)).alias("bucket"))
    return storage.rebucketed(r, "bucket", "checksum").select("checksum", "bucket", "moved")


@_query("""SELECT target_release_id release_id, count(*) artifacts, count(DISTINCT new_hash) plain_hashes, true AS packed FROM delta_file WHERE file_size IS NOT NULL AND new_hash IS NOT NULL AND target_release_id IS NOT NULL GROUP BY 1""")
def package_metrics(spark: SparkSession, d: str) -> DataFrame:
    """What writing each release package came to."""
    f = table(spark, d, "delta_file", "target_release_id", "path", "new_hash", "file_size").where("file_size is not null and new_hash is not null and target_release_id is not null")
    lists = f.groupBy(F.col("target_release_id").alias("release_id")).agg(F.collect_list(F.struct("path", "new_hash", "file_size")).alias("files"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for rid, many in zip(b.column("release_id").to_pylist(), b.column("files").to_pylist()):
                p = codecs.Package("1.0", rid, "", artifacts=[codecs.Artifact(r["path"] or "", content_hash=r["new_hash"], length=max(0, r["file_size"])) for r in many])
                data = codecs.encode_package(p)
                x = codecs.package_metrics(p, data)
                rows.append((rid, x["artifacts"], x["plain_hashes"], 0 < x["bytes"] == len(data)))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.bool_()))], names=["release_id", "artifacts", "plain_hashes", "packed"])

    return lists.mapInArrow(run, "release_id string, artifacts bigint, plain_hashes bigint, packed boolean")


@_query("""WITH t AS (SELECT sha256(text) content_id, max(octet_length(encode(text))) n, bool_or(lang = 'de') AS de FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT content_id, CAST(n AS BIGINT) length FROM t WHERE NOT coalesce(de, false)""")
def content_store(spark: SparkSession, d: str) -> DataFrame:
    """Contents put under their digest twice, those of German texts deleted, the rest got by digest."""
    store = storage.ContentStore(spark, Workspace(spark).path("contents"), digits=1)
    texts = _texts(spark, d)
    store.put(texts.select("content"))
    store.put(texts.select("content"))  # nothing is stored twice
    ids = texts.select(F.sha2("content", 256).alias("content_id"), "lang")
    store.delete(ids.where("lang = 'de'").select("content_id"))
    return store.get(ids.select("content_id")).select("content_id", F.octet_length("content").cast("bigint").alias("length"))


# ---- contents


@_query("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) total FROM documents WHERE text IS NOT NULL AND text <> ''")
def chunks_loaded(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of texts loaded by their maps; one that ends early or has another digest is an error."""
    texts = _texts(spark, d).select("doc_id", "content")
    maps = chunking.chunk_blobs(texts, "doc_id", "content", [(256, 1024, 8192)]).drop("average").withColumnRenamed("key", "doc_id")
    return chunking.load_chunks(texts, maps, "doc_id", "content").groupBy("doc_id").agg(F.sum(F.octet_length("data").cast("bigint")).alias("total"))


@_query("""WITH defs AS (SELECT new_hash h, max(list_sum(list_transform(chunks, lambda x: x.length))) n FROM delta_file WHERE new_hash IS NOT NULL AND chunks IS NOT NULL GROUP BY 1),
f AS (SELECT chunk_store_id s, new_hash h, coalesce(file_size, n, 0) z FROM delta_file LEFT JOIN defs ON defs.h = new_hash WHERE new_hash IS NOT NULL),
u AS (SELECT s, h, max(z) z, sum(z) t FROM f GROUP BY 1, 2), r AS (SELECT chunk_store_id s, x.checksum k, max(x.length) l FROM (SELECT chunk_store_id, unnest(chunks) x FROM delta_file) WHERE x.checksum IS NOT NULL GROUP BY 1, 2)
SELECT u.s store_id, CAST(sum(t) AS BIGINT) total_logical_bytes, CAST(sum(z) AS BIGINT) unique_file_bytes, count(*) file_definitions, CAST(coalesce(any_value(c.b), 0) AS BIGINT) referenced_chunk_bytes FROM u LEFT JOIN (SELECT s, sum(coalesce(l, 0)) b FROM r GROUP BY 1) c ON c.s = u.s GROUP BY 1""")
def logical_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Logical sizes of each store: a file has its explicit length, else that of its definition, else 0."""
    f = table(spark, d, "delta_file", "chunk_store_id", "new_hash", "file_size", "chunks")
    return metrics.logical_sizes(f.select(F.col("chunk_store_id").alias("store_id"), F.col("new_hash").alias("digest"), "file_size", "chunks"))



@_query("SELECT doc_id, 'texts/' || doc_id || '.txt' entry_path, sha256(text) content_id FROM documents WHERE text IS NOT NULL AND text <> ''")
def archive_members(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of archive members, streamed out of their archives."""
    from depotlens.plans.extras import zipped_texts

    entries = files.archive_entries(zipped_texts(spark, d), "archive", "data", with_content=True).where("not is_dir")
    return entries.select(F.regexp_extract("archive", "^([0-9]+)", 1).cast("bigint").alias("doc_id"), "entry_path", F.sha2("content", 256).alias("content_id"))


@_query("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) total, true AS same FROM documents WHERE text IS NOT NULL AND text <> ''")
def chunks_of_streams(spark: SparkSession, d: str) -> DataFrame:
    """Texts that arrive in pieces of uneven size, cut as they come: the same chunks as of the whole."""
    sizes = (256, 1024, 8192)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "content"):
            totals, same = [], []
            for data in b.column("content").to_pylist():
                chunker, got, at, step = chunking.StreamingChunker(*sizes), [], 0, 701
                while at < len(data):
                    got += chunker.append(data[at : at + step])
                    at, step = at + step, step * 3 % 4099 + 1
                got += chunker.finish()
                ends = chunking.cut_points(data, *sizes)
                totals.append(sum(x[2] for x in got))
                same.append([x[1] + x[2] for x in got] == ends)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(totals, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "total", "same"])

    return _texts(spark, d).where("octet_length(content) > 0").select("doc_id", "content").mapInArrow(run, "doc_id bigint, total bigint, same boolean")


@_query("""WITH t AS (SELECT sha256(text) id, max(octet_length(encode(text))) n FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY 1)
SELECT id content_id, CAST(n AS BIGINT) total FROM t WHERE id NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL AND lang = 'en')""")
def missing_contents_chunked(spark: SparkSession, d: str) -> DataFrame:
    """Chunk maps of the contents that are not known yet, one for each; known here are those of English texts."""
    texts = _texts(spark, d)
    known = texts.where("lang = 'en'").select(F.unhex(F.sha2("content", 256)).alias("content_id"))
    maps = chunking.chunk_missing(texts.select("doc_id", "content"), "doc_id", "content", known, (256, 1024, 8192))
    return maps.groupBy("content_id").agg(F.sum("length").alias("total")).select(F.lower(F.hex("content_id")).alias("content_id"), "total")


@_query("""WITH f AS (SELECT lower(hex(new_hash)) h, min(delta_file_id) id FROM delta_file WHERE new_hash IS NOT NULL GROUP BY 1), k AS (SELECT DISTINCT lower(trim(file_hash_hex, chr(32) || chr(9) || chr(10) || chr(13))) h FROM file_cache WHERE file_hash_hex IS NOT NULL)
SELECT f.h file_hash, d.delta_file_id, CAST(coalesce(len(d.chunks), 0) AS BIGINT) chunk_count FROM f JOIN delta_file d ON d.delta_file_id = f.id WHERE f.h NOT IN (SELECT h FROM k)""")
def file_definitions_to_upload(spark: SparkSession, d: str) -> DataFrame:
    """One definition, the list of its chunks, for each distinct file that the cache does not know."""
    f = table(spark, d, "delta_file", "delta_file_id", "new_hash", "chunks").where("new_hash is not null")
    first = f.groupBy(F.lower(F.hex("new_hash")).alias("file_hash")).agg(F.min(F.struct("delta_file_id", F.coalesce(F.size("chunks"), F.lit(0)).alias("n"))).alias("f"))
    known = table(spark, d, "file_cache", "file_hash_hex").select(F.lower(F.regexp_replace("file_hash_hex", r"^\s+|\s+$", "")).alias("file_hash"))
    return first.join(known, "file_hash", "left_anti").select("file_hash", "f.delta_file_id", F.greatest(F.col("f.n"), F.lit(0)).cast("bigint").alias("chunk_count"))


@_query("""WITH f AS (SELECT delta_file_id, target_release_id, regexp_replace(replace(path, chr(92), '/'), '^\\./', '') path, new_hash, chunks FROM delta_file WHERE chunks IS NOT NULL AND len(chunks) > 0 AND starts_with(regexp_replace(replace(path, chr(92), '/'), '^\\./', ''), 'data/'))
SELECT delta_file_id, path, CAST(x.chunk_index AS BIGINT) idx, x.checksum FROM (SELECT delta_file_id, path, unnest(chunks) x FROM f)""")
def download_resolution(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of the files of one component, in order, for those files that are stored as chunks."""
    p = F.regexp_replace(F.translate("path", "\\", "/"), "^\\./", "")
    f = table(spark, d, "delta_file", "delta_file_id", "path", "chunks").select("delta_file_id", p.alias("path"), "chunks").where(F.col("path").startswith("data/"))
    return f.select("delta_file_id", "path", F.explode("chunks").alias("x")).select("delta_file_id", "path", F.col("x.chunk_index").cast("bigint").alias("idx"), "x.checksum")


@_query("""WITH x AS (SELECT id, CASE WHEN contains(relative_path, '.') THEN lower(regexp_extract(relative_path, '\\.([^./\\\\]*)$', 1)) ELSE '' END ext, file_size FROM svn_tag_file)
SELECT id, CASE WHEN ext IN ('zip', 'jar', 'apk', 'nupkg') THEN 'archive' ELSE 'file' END handler, CASE WHEN ext = 'zip' AND file_size > 0 THEN 'expand' ELSE 'store' END action FROM x""")
def ingestion_plan(spark: SparkSession, d: str) -> DataFrame:
    """Detection, handler and action of every file, from a registry of handlers with a fallback."""
    f = table(spark, d, "svn_tag_file", "id", "relative_path", "file_size")
    kind = c.format_id(F.col("relative_path"))
    return f.select("id", files.handler_of(kind).alias("handler"), F.when((kind == "zip") & (F.col("file_size") > 0), "expand").otherwise("store").alias("action"))


# ---- sessions


@_query("""WITH r AS (SELECT session_id, checksum, data_length, row_number() OVER (PARTITION BY session_id, checksum ORDER BY request_id) n FROM upload_chunk_request WHERE checksum IS NOT NULL),
k AS (SELECT checksum, max(compressed_length) z FROM chunk GROUP BY 1)
SELECT session_id, count(*) total, count(*) FILTER (WHERE n = 1) uniques, count(*) FILTER (WHERE n = 1 AND k.checksum IS NULL) fresh, CAST(coalesce(sum(data_length), 0) AS BIGINT) logical_bytes, CAST(coalesce(sum(k.z) FILTER (WHERE n = 1), 0) AS BIGINT) stored_bytes FROM r LEFT JOIN k USING (checksum) GROUP BY 1""")
def session_figures(spark: SparkSession, d: str) -> DataFrame:
    """Counters of each session: all chunks, distinct ones, those the store lacks, logical bytes, and stored bytes of the known ones."""
    r = table(spark, d, "upload_chunk_request", "session_id", "checksum", "data_length").where("checksum is not null")
    per = r.groupBy("session_id", "checksum").agg(F.count("*").alias("n"), F.sum("data_length").alias("bytes"))
    k = table(spark, d, "chunk", "checksum", "compressed_length").groupBy("checksum").agg(F.max("compressed_length").alias("z"), F.lit(True).alias("known"))
    j = per.join(k, "checksum", "left")
    return j.groupBy("session_id").agg(F.sum("n").alias("total"), F.count("*").alias("uniques"), F.count_if(F.col("known").isNull()).alias("fresh"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("logical_bytes"), F.coalesce(F.sum(F.col("z").cast("bigint")), F.lit(0)).alias("stored_bytes"))


def _arriving(spark: SparkSession, d: str) -> DataFrame:
    return ingest.read_uploads(spark, f"{d}/upload_chunk_request.parquet*", table(spark, d, "upload_chunk_request").schema)


@_query("""WITH r AS (SELECT request_id, session_id, sent_at, CASE WHEN sent_at IS NOT NULL AND sent_at - lag(sent_at) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END gap FROM upload_chunk_request WHERE session_id IS NOT NULL
  WINDOW w AS (PARTITION BY session_id, sent_at IS NULL ORDER BY sent_at, request_id)),
s AS (SELECT *, max(gap) OVER (PARTITION BY session_id, sent_at IS NULL ORDER BY sent_at, request_id ROWS UNBOUNDED PRECEDING) late FROM r)
SELECT request_id, CASE WHEN sent_at IS NULL THEN 'invalid' WHEN late = 1 THEN 'late' ELSE 'accepted' END outcome FROM s""")
def stream_session_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of every upload in its session's state machine, as a stream over all of them; the rejected are a side output."""
    return ingest.run_to_table(ingest.session_outcomes(_arriving(spark, d)), "outcomes").select("request_id", "outcome")


@_query("SELECT DISTINCT session_id, checksum FROM upload_chunk_request WHERE checksum IS NOT NULL")
def stream_unique_uploads(spark: SparkSession, d: str) -> DataFrame:
    """Distinct checksums of each session, however far apart its repeats come, as a stream."""
    return ingest.run_to_table(ingest.unique_in_session(_arriving(spark, d).select("session_id", "checksum")), "unique")
