"""Deduplicating new batches against all history with a segment index for edit distance.

A record is a set of keys.  Sorted by one fixed order, hot keys last, it is a string over the alphabet of keys, and the insertions
and deletions between two such strings are the keys in which the sets differ.  Two sets of sizes l and m share at least p/q of
their union exactly when that edit distance is at most t(l, m) = (q - p) (l + m) / (q + p).  So a string of length l is stored as a
fixed number of segments, one more than the largest distance that matters at this length: a string within that distance keeps at
least one of them whole, and at most t places from where it was.  A batch probes its own substrings of the segments' lengths at
the positions that can match, the candidates' distance is verified, and the segments of what is accepted are appended.

History lies in sorted runs, segments by the hash of their symbols and sets by the hash of their id.  A batch reads only the row groups
that its probes and candidates touch; history is neither scanned nor shuffled.  What is stored counts as earlier than any batch,
whatever its ids; inside a batch records are judged in order of id, the first maximal independent set by arrival.  Because a batch first
meets the accepted records, a crowd of near copies costs each later copy one match with those few of its crowd that were accepted,
and a batch that is a crowd itself is halved until its pairs are few.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlens.operators import sorted_runs
from depotlens.operators.sorted_runs import Run
from depotlens.session import Workspace, delete, exists, get_text, names, put_text

#: Near: at least NEAR[0]/NEAR[1] of the union is shared.
NEAR = (7, 10)
#: A key is hot when it is one of HOT_KEYS that could be this frequent, and in at least LEAST_HOT records.  There are at most
#: HOT_KEYS of them, whatever the data, so their 64-bit hashes fit every task.
HOT_KEYS, LEAST_HOT = 20_000, 64
#: Most records of the first batch of a bulk load; each next batch has up to 15 times all before it.
FIRST_BATCH = 1 << 15
#: A batch of more than LEAST_SPLIT records whose equal segments make more than CROWD pairs a record is halved.
CROWD, LEAST_SPLIT = 64, 256
#: Open near pairs that one task may take (16 bytes each); more are decided in rounds.
OPEN_EDGES = 1_000_000
#: Runs of one size that are merged into one of the next, and the rows of the smallest size.
FAN_IN, LEVEL_ROWS = 8, 1 << 16

_SETS = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", T.LongType()), T.StructField("syms", T.ArrayType(T.LongType()))])
_SEGMENTS = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("pos", T.IntegerType())])


def distance_bound(l: np.ndarray, m: np.ndarray, near: tuple[int, int] = NEAR) -> np.ndarray:
    """Largest edit distance of near strings of lengths l and m, which has the parity of l - m; negative when none are near."""
    p, q = near
    t = (q - p) * (l + m) // (q + p)
    t = t - (t - (l - m)) % 2
    return np.where((q * l >= p * m) & (q * m >= p * l), t, -1)


def segment_counts(longest: int, near: tuple[int, int] = NEAR) -> np.ndarray:
    """Number of segments by length: one more than the largest distance to anything near."""
    p, q = near
    out = np.ones(longest + 1, np.int64)
    for l in range(1, longest + 1):
        m = np.arange(-(-p * l // q), q * l // p + 1)
        out[l] = distance_bound(np.full(len(m), l), m, near).max() + 1
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _one(a: np.ndarray) -> np.ndarray:
    return _mix(a + np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(_mix(a) + b * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _strings(b: pa.RecordBatch, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """ids, sizes, offsets, the symbols of all strings end to end, and how many of each are not hot."""
    ids = b.column("id").to_numpy()
    lists = b.column("syms")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    syms = lists.values.to_numpy()[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(ids)), sizes)
    at = np.searchsorted(hot, syms)
    is_hot = (hot[np.minimum(at, len(hot) - 1)] == syms) if len(hot) else np.zeros(len(syms), bool)
    order = np.lexsort((syms, is_hot, row))
    cold = np.bincount(row, weights=~is_hot, minlength=len(ids)).astype(np.int64)
    return ids, sizes, offsets, syms[order].view(np.uint64), cold


def _layout(sizes: np.ndarray, cold: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each string its number of segments and how many of them, the first, have one symbol; the rest have two.  Hot symbols
    are left out wherever the others suffice."""
    k = counts[sizes]
    span = np.where(cold >= k, cold, sizes)
    return k, k - np.minimum(k, span - k)


def _rows(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Repeats each row counts[i] times: (row, 0..counts[i]-1 + starts[i])."""
    row = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return row, within + np.repeat(starts, counts)


def _batch(key: np.ndarray, ids: np.ndarray, sizes: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(sizes.astype(np.int32)), pa.array(pos.astype(np.int32))], names=_SEGMENTS.names)


def _segments(hot: np.ndarray, near: tuple[int, int]) -> callable:
    """Stored side: the segments of each string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, sizes, offsets, syms, cold = _strings(b, hot)
            k, ones = _layout(sizes, cold, segment_counts(int(sizes.max()), near))
            zero = np.zeros(len(ids), np.int64)
            r1, p1 = _rows(zero, ones)
            r2, i2 = _rows(zero, k - ones)
            p2 = ones[r2] + 2 * i2
            at = offsets[:-1]
            key = np.concatenate([_one(syms[at[r1] + p1]), _two(syms[at[r2] + p2], syms[at[r2] + p2 + 1])])
            row, pos = np.concatenate([r1, r2]), np.concatenate([p1, p2])
            yield _batch(key, ids[row], sizes[row], pos)

    return run


def _probes(hot: np.ndarray, near: tuple[int, int]) -> callable:
    """Probing side: the substrings of each string that can meet a stored segment."""
    p, q = near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, sizes, offsets, syms, cold = _strings(b, hot)
            at = offsets[:-1]
            zero = np.zeros(len(ids), np.int64)
            r2, p2 = _rows(zero, np.maximum(sizes - 1, 0))
            # One-symbol segments: with no hot key near, a string of length l has max(0, 2k - l) of them, all in front.
            counts = segment_counts(int(q * sizes.max() // p) + 1, near)
            ell = np.arange(len(counts))
            alone = np.maximum(0, 2 * counts - ell)
            reach = np.zeros(int(sizes.max()) + 1, np.int64)
            for m in range(1, len(reach)):
                l = np.arange(-(-p * m // q), q * m // p + 1)
                l = l[l >= 1]
                far = np.where(alone[l] > 0, alone[l] + distance_bound(l, np.full(len(l), m), near), 0)
                reach[m] = min(m, far.max(initial=0))
            # Beside hot keys any of the other keys may stand alone, so all of them are probed.
            n1 = np.where(cold < sizes, np.maximum(cold, reach[sizes]), reach[sizes])
            r1, p1 = _rows(zero, n1)
            key = np.concatenate([_one(syms[at[r1] + p1]), _two(syms[at[r2] + p2], syms[at[r2] + p2 + 1])])
            row, pos = np.concatenate([r1, r2]), np.concatenate([p1, p2])
            yield _batch(key, ids[row], sizes[row], pos)

    return run


def _candidates(near: tuple[int, int]) -> sorted_runs.Match:
    """Pairs (src, dst) of probes and stored segments that lengths and positions allow; a record is no candidate of itself."""
    p, q = near

    def match(probes: pa.RecordBatch, i: np.ndarray, stored: pa.Table, j: np.ndarray) -> pa.RecordBatch:
        a, b = lambda c: probes.column(c).to_numpy()[i].astype(np.int64), lambda c: stored[c].to_numpy()[j].astype(np.int64)
        l, m, src, dst = b("size"), a("size"), a("id"), b("id")
        ok = (dst != src) & (q * l >= p * m) & (q * m >= p * l) & ((q + p) * np.abs(b("pos") - a("pos")) <= (q - p) * (l + m))
        src, dst = src[ok], dst[ok]
        by = np.lexsort((dst, src))
        src, dst = src[by], dst[by]
        new = np.ones(len(src), bool)
        new[1:] = (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])
        return pa.RecordBatch.from_arrays([pa.array(src[new]), pa.array(dst[new])], names=["src", "dst"])

    return match


def _fetch() -> sorted_runs.Match:
    """Pairs (src, dst) with the stored string of dst."""

    def match(probes: pa.RecordBatch, i: np.ndarray, stored: pa.Table, j: np.ndarray) -> pa.RecordBatch:
        right = probes.column("dst").to_numpy()[i] == stored["id"].to_numpy()[j]
        i, j = pa.array(i[right]), pa.array(j[right])
        return pa.RecordBatch.from_arrays([probes.column("src").take(i), probes.column("dst").take(i), stored["syms"].take(j).combine_chunks()], names=["src", "dst", "y"])

    return match


class SegmentStore:
    """Accepted records as sorted runs of sets and segments, with one manifest for each commit.

    A batch is written to folders of its own and takes part only once its manifest is there, which is created whole or not at all: what
    a killed batch left is overwritten by its retry.  A batch that is committed under the same name is not judged again; its answer is
    kept.  Runs of one size are merged FAN_IN at a time, so a store has few runs.  One writer at a time; a second one's commit fails.
    """

    def __init__(self, spark: SparkSession, hot: list[int] | None = None, near: tuple[int, int] = NEAR, path: str | None = None, granule: int = sorted_runs.GRANULE_BYTES, meter=None):
        """Opens the store at ``path``, or begins one there; without a path it lasts for this session only.

        ``hot`` (64-bit hashes of keys) fixes the order of keys for the life of a store, and is kept with it; any choice is correct.
        ``granule``: bytes of a row group.  ``meter``: an accumulator that counts the bytes read from the runs.
        """
        self.spark, self.near, self.granule, self.meter = spark, near, granule, meter
        self.work = Workspace(spark)
        self.path = path or self.work.path("store")
        if not put_text(spark, f"{self.path}/hot.json", json.dumps(hot or [])):
            hot = json.loads(get_text(spark, f"{self.path}/hot.json"))
        self.hot = np.array(sorted(hot or []), np.int64)
        found = [n for n in names(spark, f"{self.path}/manifests") if n.endswith(".json") and not n.startswith(".")]
        state = json.loads(get_text(spark, f"{self.path}/manifests/{found[-1]}")) if found else {"number": 0, "batch": None, "runs": []}
        self.number, self.last = state["number"], state["batch"]
        self.runs = [(Run(**a), Run(**b)) for a, b in state["runs"]]
        if self.last is not None:  # a crash may have come between the manifest and this mark
            put_text(spark, f"{self.path}/batches/{self.last}", str(self.number))

    @property
    def empty(self) -> bool:
        return not self.runs

    def sets(self) -> DataFrame:
        """All accepted records: (key, id, syms)."""
        return sorted_runs.read_runs(self.spark, [s for s, _ in self.runs], _SETS)

    def _commit(self, runs: list[tuple[Run, Run]], batch: str | None) -> None:
        """The one step that changes the store."""
        text = json.dumps({"number": self.number + 1, "batch": batch, "runs": [[asdict(a), asdict(b)] for a, b in runs]})
        if not put_text(self.spark, f"{self.path}/manifests/{self.number + 1:012d}.json", text):
            raise RuntimeError("another writer has committed to this store")
        self.number, self.runs, self.last = self.number + 1, runs, batch
        if batch is not None:
            put_text(self.spark, f"{self.path}/batches/{batch}", str(self.number))

    def judge_records(self, records: DataFrame, id_column: str, keys: str, name: str | None = None, fresh: bool = False) -> DataFrame:
        """Judges a batch as ``repeats`` does, all that is stored counting as earlier: gives the ids of those not accepted, and appends
        the accepted ones.

        ``name``: names the batch for good; by default a digest of its ids and keys.  A record whose id is stored was accepted
        before and is neither judged nor appended again; ``fresh`` says that there are none.  Late records, with ids below stored ones, are
        matched like any others.
        """
        rows = key_sets(records, id_column, keys).where("size > 0")
        if name is None:
            n, x, s = rows.agg(F.count("*"), F.bit_xor(F.xxhash64("id", "syms")), F.sum(F.xxhash64("syms", "id").cast("decimal(38,0)"))).first()
            name = f"{n}-{(x or 0) & (1 << 64) - 1:016x}-{int(s or 0) & (1 << 64) - 1:016x}"
        answer = f"{self.path}/answers/{name}"
        if exists(self.spark, f"{self.path}/batches/{name}"):
            return self.spark.read.schema("id bigint").parquet(answer)
        if self.runs and not fresh:
            asked = rows.select("id").select(F.xxhash64("id").alias("key"), F.lit(0).cast("bigint").alias("src"), F.col("id").alias("dst"))
            stored = sorted_runs.lookup(asked, [s for s, _ in self.runs], _fetch(), "src bigint, dst bigint, y array<bigint>", meter=self.meter)
            known, _ = self.work.write(stored.select(F.col("dst").alias("id")), "known")
            rows = rows.join(known, "id", "left_anti")
        sets, path = self.work.write(distinct_sets(rows), "sets")
        copies = rows.select("id").join(sets.select("id"), "id", "left_anti")
        rejected, runs = self._judge(sets, self.runs, f"{self.path}/runs/{name}")
        for found in rejected:
            copies = copies.unionByName(found)
        copies.write.mode("overwrite").parquet(answer)
        self._commit([*self.runs, *runs], name)
        self.work.drop(path)
        self.compact()
        return self.spark.read.schema("id bigint").parquet(answer)

    def _judge(self, sets: DataFrame, history: list[tuple[Run, Run]], path: str) -> tuple[list[DataFrame], list[tuple[Run, Run]]]:
        """Rejected ids, and the runs written for the others, of sets (id, size, syms) that come after ``history``."""
        rejected = []
        if history:
            near, _ = self.work.write(self._near_history(sets, history), "rejected")
            rejected.append(near)
            sets, _ = self.work.write(sets.join(near, "id", "left_anti"), "open")
        # Every set has one segment at its start, so these count the sets; equal segments count the pairs to come.
        same = sets.mapInArrow(_segments(self.hot, self.near), _SEGMENTS).groupBy("key").agg(F.count("*").cast("double").alias("c"), F.count_if(F.col("pos") == 0).alias("n"))
        n, crowd = same.agg(F.sum("n"), F.sum(F.col("c") * (F.col("c") - 1) / 2)).first()
        if not n:
            return rejected, []
        if n > LEAST_SPLIT and crowd > CROWD * n:
            middle = sets.agg(F.percentile_approx("id", 0.5, 10_000)).first()[0]
            first, runs = self._judge(sets.where(F.col("id") <= middle), [], f"{path}-0")
            second, more = self._judge(sets.where(F.col("id") > middle), runs, f"{path}-1")
            return [*rejected, *first, *second], [*runs, *more]
        edges, _ = self.work.write(self._near_inside(sets), "near")
        later = self._later_of(edges)
        if later is not None:
            rejected.append(later)
            sets = sets.join(later, "id", "left_anti")
        return rejected, [self._append(sets, n, path)]

    def _append(self, sets: DataFrame, n: int, path: str) -> tuple[Run, Run]:
        keyed = sets.select(F.xxhash64("id").alias("key"), "id", "syms")
        segments = sets.mapInArrow(_segments(self.hot, self.near), _SEGMENTS)
        return sorted_runs.write_run(keyed, f"{path}/sets", n, granule=self.granule), sorted_runs.write_run(segments, f"{path}/segments", 8 * n, granule=self.granule)

    def _distance_holds(self, pairs: DataFrame) -> DataFrame:
        """Of (src, x, dst, y) the near ones.  Sorted strings hold no key twice, so the distance by insertions and deletions is
        |x| + |y| - 2 |x and y|."""
        p, q = self.near
        distance = F.size("x") + F.size("y") - 2 * F.size(F.array_intersect("x", "y"))
        return pairs.where((q + p) * distance <= (q - p) * (F.size("x") + F.size("y")))

    def _near_history(self, sets: DataFrame, history: list[tuple[Run, Run]]) -> DataFrame:
        """Ids of the sets near a stored one, by lookups in the runs."""
        probes = sets.mapInArrow(_probes(self.hot, self.near), _SEGMENTS)
        pairs = sorted_runs.lookup(probes, [g for _, g in history], _candidates(self.near), "src bigint, dst bigint", meter=self.meter).distinct()
        asked = pairs.select(F.xxhash64("dst").alias("key"), "src", "dst")
        found = sorted_runs.lookup(asked, [s for s, _ in history], _fetch(), "src bigint, dst bigint, y array<bigint>", meter=self.meter)
        both = found.join(sets.select(F.col("id").alias("src"), F.col("syms").alias("x")), "src")
        return self._distance_holds(both).select(F.col("src").alias("id")).distinct()

    def _near_inside(self, sets: DataFrame) -> DataFrame:
        """Near pairs (src, dst) inside a batch, dst the earlier."""
        p, q = self.near
        a = sets.mapInArrow(_segments(self.hot, self.near), _SEGMENTS).select("key", F.col("id").alias("dst"), F.col("size").alias("l"), F.col("pos").alias("at"))
        b = sets.mapInArrow(_probes(self.hot, self.near), _SEGMENTS).select("key", F.col("id").alias("src"), F.col("size").alias("m"), "pos")
        possible = (F.col("dst") < F.col("src")) & (q * F.col("l") >= p * F.col("m")) & (q * F.col("m") >= p * F.col("l")) & ((q + p) * F.abs(F.col("at") - F.col("pos")) <= (q - p) * (F.col("l") + F.col("m")))
        pairs = b.join(a, "key").where(possible).select("src", "dst").distinct()
        both = pairs.join(sets.select(F.col("id").alias("src"), F.col("syms").alias("x")), "src").join(sets.select(F.col("id").alias("dst"), F.col("syms").alias("y")), "dst")
        return self._distance_holds(both).select("src", "dst")

    def _later_of(self, edges: DataFrame) -> DataFrame | None:
        """Records near an accepted earlier one, when edges are all near pairs.

        Up to OPEN_EDGES pairs are taken by one task in order of arrival.  With more, a round first accepts what has no open earlier
        neighbour and rejects what is near to it, then decides the earliest OPEN_EDGES of the pairs left in order, so rounds are at
        most as many as the longest chain and as the pairs over OPEN_EDGES."""
        found = []

        def settle(rejected: DataFrame, edges: DataFrame) -> DataFrame:
            found.append(rejected)
            gone = lambda side: rejected.select(F.col("id").alias(side))
            return self.work.write(edges.join(gone("src"), "src", "left_anti").join(gone("dst"), "dst", "left_anti"), "open")[0]

        while True:
            count = edges.count()
            if count <= OPEN_EDGES:
                if count:
                    found.append(self.work.write(edges.coalesce(1).mapInArrow(_greedy, "id bigint"), "later")[0])
                break
            open_later = edges.select(F.col("src").alias("dst")).distinct()
            roots = edges.select("dst").distinct().join(open_later, "dst", "left_anti")
            edges = settle(self.work.write(edges.join(roots, "dst", "left_semi").select(F.col("src").alias("id")).distinct(), "later")[0], edges)
            cut = edges.agg(F.percentile_approx("src", min(1.0, OPEN_EDGES / count), 10_000)).first()[0]
            early = edges.where(F.col("src") <= cut) if cut is not None else edges.limit(0)
            if 0 < early.count() <= OPEN_EDGES:
                # All earlier neighbours of these are early too: they are decided for good.
                decided, _ = self.work.write(early.coalesce(1).mapInArrow(_greedy, "id bigint"), "later")
                left = settle(decided, edges.where(F.col("src") > cut))
                again, _ = self.work.write(left.where(F.col("dst") <= cut).select(F.col("src").alias("id")).distinct(), "later")
                edges = settle(again, left.where(F.col("dst") > cut))
        if not found:
            return None
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out

    def compact(self) -> None:
        """Merges runs of one size, FAN_IN or more at a time, into one."""
        level = lambda r: max(0, int(np.log(max(1, r.rows) / LEVEL_ROWS) / np.log(FAN_IN))) if r.rows > LEVEL_ROWS else 0
        by_level: dict[int, list[tuple[Run, Run]]] = {}
        for pair in self.runs:
            by_level.setdefault(level(pair[1]), []).append(pair)
        for _, pairs in sorted(by_level.items()):
            if len(pairs) >= FAN_IN:
                path = f"{self.path}/runs/merged-{uuid.uuid4().hex}"
                merged = [sorted_runs.write_run(sorted_runs.read_runs(self.spark, part, kind), f"{path}/{name}", sum(r.rows for r in part), granule=self.granule) for part, kind, name in zip(zip(*pairs), (_SETS, _SEGMENTS), ("sets", "segments"))]
                self._commit([*(x for x in self.runs if x not in pairs), tuple(merged)], None)
                for pair in pairs:
                    for r in pair:
                        delete(self.spark, r.path)
                return self.compact()


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most OPEN_EDGES pairs (src, dst): a src is rejected when some earlier dst of it is not."""
    got = [(b.column("src").to_numpy(), b.column("dst").to_numpy()) for b in batches]
    if got:
        src, dst = (np.concatenate(x) for x in zip(*got))
        order = np.argsort(src, kind="stable")
        rejected: set[int] = set()
        for v, u in zip(src[order].tolist(), dst[order].tolist()):
            if u not in rejected:
                rejected.add(v)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(rejected), pa.int64())], names=["id"])


def key_sets(records: DataFrame, id_column: str, keys: str) -> DataFrame:
    """(id, keys, size, syms): the set of the non-null keys of each record, and its string as sorted 64-bit hashes of the keys.

    Two different keys of one pair of records would have to collide for a wrong distance: about l * m in 2**64.
    """
    distinct = F.array_distinct(F.filter(F.coalesce(F.col(keys), F.array().cast("array<binary>")), lambda x: x.isNotNull()))
    rows = records.select(F.col(id_column).cast("bigint").alias("id"), distinct.alias("keys"))
    return rows.withColumns({"size": F.size("keys"), "syms": F.array_sort(F.transform("keys", lambda x: F.xxhash64(x)))})


def distinct_sets(rows: DataFrame) -> DataFrame:
    """The earliest record of each set of ``key_sets``: (id, size, syms)."""
    signature = F.unhex(F.sha2(F.array_join(F.array_sort(F.transform("keys", lambda x: F.hex(x))), ","), 256))
    first = rows.groupBy(signature.alias("signature")).agg(F.min(F.struct("id", "size", "syms")).alias("f"))
    return first.select("f.id", "f.size", "f.syms")


def repeats(records: DataFrame, id_column: str, keys: str, hot: list[int] | None = None, near: tuple[int, int] = NEAR) -> DataFrame:
    """Ids of the records that are not accepted, judged in order of id.

    ``id_column``: unique bigint, the order of arrival.  ``keys``: array of binary; null arrays, empty ones and those of nulls only are
    neither accepted nor repeats; repeated keys of a record count once.  A record is accepted unless it shares at least ``near`` of the
    union with an earlier accepted one.  The table goes through a store in batches.  Equal sets of a batch are grouped first, with map-side
    combining, and only the earliest is judged: a later copy is near whatever decided the first; copies in different batches meet in
    the index.  Extra columns are ignored; an empty table gives no rows.
    """
    spark = records.sparkSession
    store = SegmentStore(spark, hot, near)
    found = None
    ident = F.col(id_column).cast("bigint")
    for i, (a, z) in enumerate(batches(records, id_column, keys)):
        part = records if a is None and z is None else records.where((F.lit(True) if a is None else ident > a) & (F.lit(True) if z is None else ident <= z))
        ids = store.judge_records(part, id_column, keys, f"load-{i}", fresh=True)
        found = ids if found is None else found.unionByName(ids)
    return found


def batches(records: DataFrame, id_column: str, keys: str) -> list[tuple[int | None, int | None]]:
    """Ranges (above, up to) of ids for a bulk load: of all records, of a sixteenth, and so on down to FIRST_BATCH records."""
    shares = [16.0**-i for i in range(12)]
    n, ends = records.where(F.size(keys) > 0).agg(F.count("*"), F.percentile_approx(F.col(id_column).cast("bigint"), shares, 1_000_000)).first()
    cuts = sorted({e for e, share, before in zip((ends or [])[1:], shares[1:], shares) if n * before > FIRST_BATCH})
    return list(zip([None, *cuts], [*cuts, None]))


def first_seen(records: DataFrame, id_column: str, keys: str, static: DataFrame) -> tuple[DataFrame, list[int]]:
    """For each record the number of its keys that neither ``static`` (column key) nor an earlier record has, and the hot keys.

    (id, new_keys) has only records with such keys.  One aggregation by whole keys, combined on the map side, so that a key in a
    third of all records moves once from each task.
    """
    spark = records.sparkSession
    work = Workspace(spark)
    rows = records.select(F.col(id_column).cast("bigint").alias("id"), F.col(keys).alias("keys"))
    total = rows.agg(F.sum(F.greatest(F.size("keys"), F.lit(0)))).first()[0] or 0
    least = max(LEAST_HOT, total // HOT_KEYS)
    uses = rows.select("id", F.explode("keys").alias("key")).where("key is not null")
    keyed = uses.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("uses"))
    known = static.select("key").where("key is not null").distinct().withColumn("static", F.lit(True))
    marked = keyed.join(known, "key", "left").select("id", F.col("static").isNull().cast("int").alias("new"), F.when(F.col("uses") >= least, F.xxhash64("key")).alias("hot"))
    table, _ = work.write(marked.groupBy("id").agg(F.sum("new").alias("new_keys"), F.collect_list("hot").alias("hot")), "first")
    # At most HOT_KEYS keys can be in total / HOT_KEYS records each.
    hot = [r[0] for r in table.where(F.size("hot") > 0).select(F.explode("hot")).collect()]
    return table.select("id", "new_keys"), hot


def wrong_replies(plans: DataFrame, new_keys: DataFrame) -> DataFrame:
    """Uploads whose chunks_written_new is not null and not the number of new checksums."""
    told = plans.select(F.col("upload_id").cast("bigint").alias("id"), F.col("chunks_written_new").cast("bigint").alias("told")).where("told is not null")
    return told.join(new_keys, "id", "left").where(F.col("told") != F.coalesce("new_keys", F.lit(0))).select("id")


def judge_uploads(plans: DataFrame, shared: DataFrame) -> DataFrame:
    """(finding, upload_id): `repeat` for uploads that repeat an accepted one, wholly or nearly, `count` for replies that counted wrongly."""
    new_keys, hot = first_seen(plans, "upload_id", "missing_chunk_checksums", shared.select(F.col("checksum").alias("key")))
    again = repeats(plans, "upload_id", "missing_chunk_checksums", hot)
    return again.select(F.lit("repeat").alias("finding"), F.col("id").alias("upload_id")).unionByName(wrong_replies(plans, new_keys).select(F.lit("count").alias("finding"), F.col("id").alias("upload_id")))
