"""References to records that do not exist, at the time of the reference, and what hangs on them.

Orphans come from a fixpoint over the foreign-key graph.  Its first round has the references whose target is missing, by one left anti join
per reference table.  References are the streamed, left side, so a key that holds a third of them is split by adaptive skew handling
without any group being held in memory; targets are first folded to one row per key and lifetime.  The records that own such a
reference are marked, and semi-joins down the graph mark their children until a round finds nothing new.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens.session import Workspace


def living_at(at: Column, since: Column, until: Column) -> Column:
    """Existence from ``since`` on and before ``until``; a null ``until`` is still alive, a null ``since`` or ``at`` proves nothing."""
    return (since <= at) & (until.isNull() | (at < until))


def direct_orphans(references: DataFrame, targets: DataFrame, keys: Sequence[str], at: str = "at") -> DataFrame:
    """Rows of ``references`` without a target of the same keys that lives at their time.

    ``references``: keys, ``at`` and any other columns.  ``targets``: keys, since, until; other columns are ignored, so names may
    clash.  A reference with a null key has no target; drop such rows before if a null is no reference.  A reference without
    a time has no target either.  Repeated references come out as often as they came in; an empty target table orphans all.
    """
    t = targets.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("since").alias("__since"), F.col("until").alias("__until")).distinct()
    on = living_at(F.col(at), F.col("__since"), F.col("__until"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return references.join(t, on, "left_anti")


@dataclass
class ForeignKey:
    """child.child_key refers to parent.parent_key; both name tables of the cascade."""

    child: str
    child_key: str
    parent: str
    parent_key: str


def _close_chain(work: Workspace, edges: DataFrame, marked: DataFrame) -> DataFrame:
    """All records below the marked ones along a self-referring key: (record_id, depth), the marked included.

    Each round semi-joins the records to their ancestor 2**k steps up and then squares that ancestor table, so a chain of n
    records takes log2(n) rounds, not n.  A round that finds nothing proves there is nothing deeper, also on cycles.
    """
    known, path = work.write(marked, "chain")
    jump, jump_path = work.write(edges, "jump")
    step = 1
    while True:
        hit = jump.join(known.select(F.col("record_id").alias("ancestor"), F.col("depth").alias("above")), "ancestor")
        new = hit.groupBy("record_id").agg((F.min("above") + step).alias("depth")).join(known.select("record_id"), "record_id", "left_anti")
        new, new_path = work.write(new, "chain")
        if new.isEmpty():
            return known
        known_next, known_path = work.write(known.unionByName(new), "chain")
        far = jump.select(F.col("record_id").alias("ancestor"), F.col("ancestor").alias("farther"))
        jump_next, next_path = work.write(jump.join(far, "ancestor").select("record_id", F.col("farther").alias("ancestor")).distinct(), "jump")
        work.drop(path, new_path, jump_path)
        known, path, jump, jump_path, step = known_next, known_path, jump_next, next_path, 2 * step


def cascade(spark: SparkSession, tables: dict[str, DataFrame], keys: Sequence[ForeignKey], seeds: DataFrame) -> DataFrame:
    """Direct and inherited orphans over a foreign-key graph: (table_name, record_id, orphan_kind, depth, and what else the seeds have).

    ``tables``: for each name a DataFrame with record_id (string) and the key columns; extra columns are ignored.  ``seeds``:
    (table_name, record_id) of the records that hold a direct orphan, a row for each, with columns that tell more of it; these are
    null for inherited ones.  A record is an inherited orphan when it is no direct one
    and a foreign key of it refers to an orphan; depth counts the references from it to the nearest direct one found.  Each
    round semi-joins only the records found in the round before down every foreign key; rounds end at the fixpoint, so cycles
    are harmless.  Null keys refer to nothing, repeated rows count once, empty tables have no orphans.  A table may have one
    self-referring key.  Every round is a table in the shared folder, so no lineage grows.
    """
    work = Workspace(spark)
    own = {fk.child: fk for fk in keys if fk.child == fk.parent}
    across = [fk for fk in keys if fk.child != fk.parent]
    seeds, _ = work.write(seeds.where("record_id is not null"), "seeds")
    direct = seeds.select("table_name", "record_id").distinct()
    edges = {}
    for name, fk in own.items():
        t = tables[name]
        up = t.select(F.col("record_id").alias("ancestor"), F.col(fk.parent_key).alias("p_key")).where("p_key is not null")
        edges[name] = t.select("record_id", F.col(fk.child_key).alias("p_key")).join(up, "p_key").select("record_id", "ancestor").where("record_id <> ancestor").distinct()

    def close(front: DataFrame) -> DataFrame:
        """The front with everything below it inside its own tables."""
        parts = []
        for name in tables:
            mine = front.where(F.col("table_name") == name).select("record_id", "depth")
            parts.append((_close_chain(work, edges[name], mine) if name in own else mine).select(F.lit(name).alias("table_name"), "record_id", "depth"))
        return reduce(DataFrame.unionByName, parts)

    front, _ = work.write(close(work.write(direct.withColumn("depth", F.lit(0)), "direct")[0]), "front")
    known = front
    while across:
        steps = []
        for fk in across:
            hit = front.where(F.col("table_name") == fk.parent).select("record_id", "depth")
            parent = tables[fk.parent].select("record_id", F.col(fk.parent_key).alias("p_key")).join(hit, "record_id").where("p_key is not null").groupBy("p_key").agg(F.min("depth").alias("depth"))
            child = tables[fk.child].select("record_id", F.col(fk.child_key).alias("p_key"))
            steps.append(child.join(parent, "p_key").select(F.lit(fk.child).alias("table_name"), "record_id", (F.col("depth") + 1).alias("depth")))
        new = reduce(DataFrame.unionByName, steps).where("record_id is not null").groupBy("table_name", "record_id").agg(F.min("depth").alias("depth"))
        new, _ = work.write(new.join(known, ["table_name", "record_id"], "left_anti"), "front")
        if new.isEmpty():
            break
        front, _ = work.write(close(new).join(known, ["table_name", "record_id"], "left_anti"), "front")
        known, _ = work.write(known.unionByName(front), "known")
    found = seeds.withColumns({"orphan_kind": F.lit("direct"), "depth": F.lit(0)})
    return found.unionByName(known.where("depth > 0").select("table_name", "record_id", F.lit("inherited").alias("orphan_kind"), "depth"), True)


def same_digest(c: Column | str) -> Column:
    """Text digest without letter case and surrounding white space; null if nothing is left."""
    t = F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, "(?U)^\\s+|\\s+$", ""))
    return F.when(t != "", t)


def month(c: str) -> Column:
    """Month in UTC, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(F.col(c), F.current_timezone()), "yyyy-MM")


def chunk_references(delta: DataFrame, lengths: DataFrame) -> DataFrame:
    """References to chunks: (ref_table, ref_id, ref_pos, at, chunk_store_id, checksum); null checksums are none."""
    d = delta.select("delta_file_id", "chunk_store_id", "created_at", F.explode("chunks").alias("c")).select(
        F.lit("delta_file").alias("ref_table"), F.col("delta_file_id").alias("ref_id"), F.col("c.chunk_index").cast("bigint").alias("ref_pos"), F.col("created_at").alias("at"), "chunk_store_id", F.col("c.checksum").alias("checksum")
    )
    n = lengths.select(F.lit("checksum_length").alias("ref_table"), F.col("entry_id").alias("ref_id"), F.lit(0).cast("bigint").alias("ref_pos"), F.col("collected_at").alias("at"), "chunk_store_id", "checksum")
    return d.unionByName(n).where("checksum is not null")


def depot_references(delta: DataFrame, lengths: DataFrame, chunks: DataFrame, tag_files: DataFrame, cache: DataFrame) -> DataFrame:
    """The depot's references without a target at their time: (table_name, record_id, ref_pos, at), the seeds of the cascade."""
    stored = chunks.select("chunk_store_id", "checksum", F.col("created_at").alias("since"), F.col("deleted_at").alias("until"))
    blocks = direct_orphans(chunk_references(delta, lengths), stored, ["chunk_store_id", "checksum"])
    tags = tag_files.select(F.lit("svn_tag_file").alias("ref_table"), F.col("id").alias("ref_id"), F.lit(0).cast("bigint").alias("ref_pos"), F.col("scanned_at").alias("at"), same_digest("file_hash_hex").alias("digest")).where("digest is not null")
    cached = cache.select(same_digest("file_hash_hex").alias("digest"), F.col("first_seen_at").alias("since"), F.col("evicted_at").alias("until")).where("digest is not null")
    files = direct_orphans(tags, cached, ["digest"])
    out = [F.col("ref_table").alias("table_name"), F.col("ref_id").cast("string").alias("record_id"), "ref_pos", "at"]
    return blocks.select(*out).unionByName(files.select(*out))


def depot_orphans(delta: DataFrame, lengths: DataFrame, chunks: DataFrame, tag_files: DataFrame, cache: DataFrame) -> DataFrame:
    """Orphans of the depot and what hangs on them: (table_name, record_id, orphan_kind, depth, ref_pos, at).

    At depth 0 is each reference without a target, at its time.  A release hangs on the files of its list and on its base, a tag on its
    files; nothing refers to a checksum_length.  Inherited orphans have no position and no time of their own.
    """
    ident = lambda c: F.col(c).cast("string").alias("record_id")
    none = F.lit(None).cast("string")
    # A row for each file, and one for the release itself, which alone takes part in the chain of bases.
    lists = delta.select(ident("target_release_id"), F.col("delta_file_id").cast("string").alias("file_id"), none.alias("base_release_id"), none.alias("own_key"))
    heads = delta.where("target_release_id is not null").groupBy("target_release_id").agg(F.max("base_release_id").alias("base_release_id")).select(ident("target_release_id"), none.alias("file_id"), "base_release_id", F.col("target_release_id").alias("own_key"))
    leaves = {"delta_file": (delta, "delta_file_id"), "checksum_length": (lengths, "entry_id"), "svn_tag_file": (tag_files, "id")}
    tables = {name: t.select(ident(key)).withColumn("own_key", F.col("record_id")) for name, (t, key) in leaves.items()}
    tables |= {"release": lists.unionByName(heads), "svn_tag": tag_files.select(ident("tag_id"), F.col("id").cast("string").alias("file_id"))}
    keys = [ForeignKey("release", "base_release_id", "release", "own_key"), ForeignKey("release", "file_id", "delta_file", "own_key"), ForeignKey("svn_tag", "file_id", "svn_tag_file", "own_key")]
    return cascade(delta.sparkSession, tables, keys, depot_references(delta, lengths, chunks, tag_files, cache))


def dated(orphans: DataFrame, delta: DataFrame, tag_files: DataFrame) -> DataFrame:
    """Orphans with a time for the inherited ones too: a release and a tag have that of their earliest file."""
    releases = delta.groupBy(F.col("target_release_id").alias("record_id")).agg(F.min("created_at").alias("own_at")).withColumn("table_name", F.lit("release"))
    tags = tag_files.groupBy(F.col("tag_id").cast("string").alias("record_id")).agg(F.min("scanned_at").alias("own_at")).withColumn("table_name", F.lit("svn_tag"))
    return orphans.join(releases.unionByName(tags), ["table_name", "record_id"], "left").withColumn("at", F.coalesce("at", "own_at")).drop("own_at")
