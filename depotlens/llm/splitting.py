"""Splitting oversized items at natural boundaries by pointer doubling.

Every item becomes a table of boundaries: 0, its size, the natural places between, and, where two neighbours are farther apart
than a piece can reach, hard places in between.  From a cut at b the next piece begins at b - overlap, so it may end at most at
b - overlap + limit (from the start of the item: at limit).  Each boundary is joined to the farthest natural one within that reach, or
else to the farthest hard one: its successor.  The cuts are what the start reaches by successors; they are derived without walking:
the table of 2**k-fold successors is squared round by round, and each round doubles the reached part of every item at once.

Pieces are byte ranges [byte_start, byte_end) of at most limit_bytes; neighbours share exactly overlap_bytes, so the
first cut lies beyond the first overlap.  Texts are cut after
paragraphs, lines or sentences, and never inside a character; a piece of text may begin inside one, if the overlap does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from depotlens.functions.arrow import slices
from depotlens.session import Workspace

#: Reaches in a segment; the boundaries of one item are looked up segment by segment, so a huge item is no single task.
SEGMENT_REACHES = 4096

#: Ends of paragraphs and lines (CR LF, LF, CR, NEL, LS, PS), of sentences before white space, and of sentences in scripts without it.
_NATURAL = re.compile(rb"(?:\r\n|\n|\r|\xc2\x85|\xe2\x80[\xa8\xa9])+|(?:[.!?]|\xe2\x80\xa6)+[\"')\]]*[ \t]+|\xe3\x80\x82|\xef\xbc[\x81\x9f]")


def text_boundaries(text: bytes, reach: int, step: int) -> list[int]:
    """Natural boundaries inside the text, beyond the first overlap, and the hard ones that its gaps need, sorted."""
    n = len(text)
    points = sorted({m.end() for m in _NATURAL.finditer(text) if reach - step < m.end() < n and text[m.end()] & 0xC0 != 0x80} | {n})
    out, b, far = [], 0, reach
    for p in points:
        while p - b > far:
            cut = b + far
            while cut > b + 1 and text[cut] & 0xC0 == 0x80:
                cut -= 1
            out.append(-cut)  # negative: a hard place
            b, far = cut, step
        out.append(p)
        b, far = p, step
    return out[:-1]


_POINTS = T.ArrayType(T.LongType())


def _document_points(docs: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(doc_id, size, points) of the texts above the limit; a text does not leave the task that reads it."""
    step = limit - overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            texts = [x.encode("utf-8", "surrogatepass") for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array([text_boundaries(x, limit, step) for x in texts], pa.list_(pa.int64()))], names=["doc_id", "size", "points"])

    big = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.octet_length("text") > limit)
    return big.mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("size", T.LongType()), T.StructField("points", _POINTS)]))


def map_end(chunk_map: str) -> Column:
    """Greatest byte_offset + length of a chunk map; null without entries."""
    return F.array_max(F.transform(F.col(chunk_map), lambda c: c["byte_offset"] + c["length"]))


def _map_points(chunk_map: Column, size: Column, limit: Column, overlap: Column) -> Column:
    """Boundaries inside an item that the starts and ends of its map's entries give, and (negative) hard ones where the map leaves gaps."""
    entries = F.coalesce(chunk_map, F.array().cast(chunk_map_type))
    # Where an entry is missing, the next one's start is the end of none.
    sides = F.concat(F.transform(entries, lambda c: c["byte_offset"]), F.transform(entries, lambda c: c["byte_offset"] + c["length"]))
    places = F.array_sort(F.array_distinct(F.filter(sides, lambda e: e.isNotNull() & (e > overlap) & (e < size))))
    points = F.concat(F.array(F.lit(0).cast("bigint")), places, F.array(size))
    step = limit - overlap

    def gap(i: Column) -> Column:
        a, b = F.element_at(points, i), F.element_at(points, i + 1)
        first = a + F.when(a == 0, limit).otherwise(step)
        return F.when(b > first, F.transform(F.sequence(first, b - 1, step), lambda x: -x)).otherwise(F.array().cast("array<bigint>"))

    return F.concat(places, F.flatten(F.transform(F.sequence(F.lit(1), F.size(points) - 1), gap)))


chunk_map_type = "array<struct<byte_offset:bigint,length:int>>"


def cut_all(contents: DataFrame) -> DataFrame:
    """Greedy pieces of every content: (content, piece_no, byte_start, byte_end, natural).

    ``contents``: content (unique string), size, limit_bytes, overlap_bytes, points (array of distinct inner boundaries; hard ones
    negative, which fill every gap wider than a reach).  Contents not above their limit give no rows; an empty table gives none.
    """
    work = Workspace(contents.sparkSession)
    c = contents.where(F.col("size") > F.col("limit_bytes"))
    step = F.col("limit_bytes") - F.col("overlap_bytes")
    rows = c.select("content", "size", "limit_bytes", "overlap_bytes", F.explode(F.concat(F.array(F.lit(0).cast("bigint")), "points", F.array("size"))).alias("p"))
    b = rows.select("content", "size", "overlap_bytes", F.abs("p").alias("pos"), (F.col("p") >= 0).alias("natural"), step.alias("step"), (step * SEGMENT_REACHES).alias("segment"))
    # Successor of every boundary: the last boundary at or before its reach, looked up within a segment and the stretch before it.
    reach = F.least("size", F.col("pos") + F.col("step") + F.when(F.col("pos") == 0, F.col("overlap_bytes")).otherwise(0))
    own = F.floor(F.col("pos") / F.col("segment")).cast("bigint")
    near = F.when(F.col("pos") + F.col("step") + F.col("overlap_bytes") >= (own + 1) * F.col("segment"), F.array(own, own + 1)).otherwise(F.array(own))
    places = b.select("content", F.explode(near).alias("seg"), F.col("pos").alias("at"), F.lit(0).alias("ask"), F.col("pos").alias("val"), F.col("natural"), F.lit(None).cast("bigint").alias("src"), "overlap_bytes")
    asks = b.where("pos < size").select("content", F.floor(reach / F.col("segment")).cast("bigint").alias("seg"), reach.alias("at"), F.lit(1).alias("ask"), F.lit(None).cast("bigint").alias("val"), F.lit(None).cast("boolean").alias("natural"), F.col("pos").alias("src"), "overlap_bytes")
    w = Window.partitionBy("content", "seg").orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda kind: F.last(F.when(kind, F.col("val")), True).over(w)
    found = places.unionByName(asks).select("content", "ask", "src", "overlap_bytes", last(F.col("natural")).alias("near"), last(~F.col("natural")).alias("hard")).where("ask = 1")
    # A natural place in reach always comes before a hard one; hard ones serve only the gap in which they lie.
    natural = F.coalesce(F.col("near") > F.col("src"), F.lit(False))
    successors, _ = work.write(found.select("content", F.col("src").alias("pos"), F.when(natural, F.col("near")).otherwise(F.col("hard")).alias("nxt"), natural.alias("natural"), "overlap_bytes"), "successors")
    # Doubling: cuts 0 .. 2**k - 1 are known; the 2**k-fold successor table adds the next 2**k, then is squared.  A round drops what
    # it supersedes, so two rounds are on disk at most.
    table, reached, old, k = successors.select("content", "pos", "nxt"), successors.where("pos = 0").select("content", "pos", F.lit(0).cast("bigint").alias("piece_no")), [], 0
    while True:
        ahead = reached.join(table, ["content", "pos"]).select("content", F.col("nxt").alias("pos"), (F.col("piece_no") + (1 << k)).alias("piece_no"))
        new, new_path = work.write(ahead.join(successors.select("content", "pos"), ["content", "pos"], "left_semi"), "reached")
        if new.isEmpty():
            break
        reached, reached_path = work.write(reached.unionByName(new), "reached")
        squared = table.join(table.select("content", F.col("pos").alias("nxt"), F.col("nxt").alias("farther")), ["content", "nxt"]).select("content", "pos", F.col("farther").alias("nxt"))
        table, table_path = work.write(squared, "squared")
        work.drop(new_path, *old)
        old = [reached_path, table_path]
        k += 1
    start = F.when(F.col("pos") == 0, F.lit(0)).otherwise(F.col("pos") - F.col("overlap_bytes"))
    return reached.join(successors, ["content", "pos"]).select("content", "piece_no", start.cast("bigint").alias("byte_start"), F.col("nxt").alias("byte_end"), "natural")


def depot_pieces(items: DataFrame, tag_files: DataFrame, documents: DataFrame, cache: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of all oversized items: (item_table, item_id, piece_no, byte_start, byte_end, natural).

    Sizes and limits are those of the test data's statement.  Items without a size, with a size that is not positive or with a
    kind that has no limit are no cases; a doc_id without text gives no size.  Contents that several items share are cut once: a
    document by its id, a file of a tag by candidate key and size (boundaries from the cached map of that key with most entries).
    """
    # size_limit is a table of one row for each kind of item, not of items.
    lim = {r["item_kind"]: (r["limit_bytes"], r["overlap_bytes"] or 0) for r in limits.where("item_kind is not null and limit_bytes > 0").select("item_kind", "limit_bytes", "overlap_bytes").collect()}
    for kind, (most, shared) in lim.items():
        if not 0 <= shared <= most - 4:
            raise ValueError(f"{kind}: an overlap of {shared} bytes leaves pieces of {most} bytes no room")
    big = lambda n: F.lit(n).cast("bigint")
    pick = lambda kind, i: F.coalesce(*[F.when(kind == k, big(v[i])) for k, v in lim.items()], F.lit(None).cast("bigint"))
    parts, links = [], []

    slim = items.select("item_id", "doc_id", "kind", "length", F.transform("chunk_map", lambda c: F.struct(c["byte_offset"].alias("byte_offset"), c["length"].alias("length"))).alias("map"))
    mapped = slim.where("doc_id is null").withColumns({"size": F.coalesce(map_end("map"), F.col("length").cast("bigint")), "limit_bytes": pick(F.col("kind"), 0), "overlap_bytes": pick(F.col("kind"), 1)}).where("size > limit_bytes")
    own = F.concat(F.lit("i:"), F.col("item_id").cast("string"))
    parts.append(mapped.select(own.alias("content"), "size", "limit_bytes", "overlap_bytes", _map_points(F.col("map"), F.col("size"), F.col("limit_bytes"), F.col("overlap_bytes")).alias("points")))
    links.append(mapped.select(F.lit("input_item").alias("item_table"), "item_id", own.alias("content")))

    if "Document" in lim:
        most, shared = lim["Document"]
        docs = _document_points(documents, most, shared)
        wanted = slim.where("doc_id is not null").select("item_id", F.col("doc_id").cast("bigint").alias("doc_id"))
        name = F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("content")
        parts.append(docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select(name, "size", big(most).alias("limit_bytes"), big(shared).alias("overlap_bytes"), "points"))
        links.append(wanted.select(F.lit("input_item").alias("item_table"), "item_id", name))

    if "SvnFile" in lim:
        most, shared = lim["SvnFile"]
        size = F.when(F.col("file_size") > 0, F.col("file_size")).otherwise(F.regexp_extract("candidate_key", "^([0-9]+)", 1).try_cast("bigint"))
        tags = tag_files.select("id", F.coalesce("candidate_key", F.lit("")).alias("candidate_key"), size.cast("bigint").alias("size")).where(F.col("size") > most)
        name = F.concat(F.lit("s:"), F.col("size").cast("string"), F.lit(":"), F.col("candidate_key")).alias("content")
        cached = cache.select("candidate_key", F.transform("chunk_map", lambda c: F.struct(c["byte_offset"].alias("byte_offset"), c["length"].alias("length"))).alias("map")).where("candidate_key is not null")
        longest = cached.groupBy("candidate_key").agg(F.max(F.struct(F.size("map").alias("n"), "map")).getField("map").alias("map"))
        keyed = tags.select("candidate_key", "size").distinct().join(longest, "candidate_key", "left")
        parts.append(keyed.select(name, "size", big(most).alias("limit_bytes"), big(shared).alias("overlap_bytes"), _map_points(F.col("map"), F.col("size"), big(most), big(shared)).alias("points")))
        links.append(tags.select(F.lit("svn_tag_file").alias("item_table"), F.col("id").alias("item_id"), name))

    contents, items_of = parts[0], links[0]
    for p, x in zip(parts[1:], links[1:]):
        contents, items_of = contents.unionByName(p), items_of.unionByName(x)
    return items_of.join(cut_all(contents), "content").select("item_table", "item_id", "piece_no", "byte_start", "byte_end", "natural")
