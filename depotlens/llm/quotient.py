"""Has this key been seen before?  Sharded quotient filters over hashed keys.

A key's 64-bit hash is cut to p = q + r bits.  The upper q bits, the quotient, name a slot; the lower r bits, the remainder,
are stored, sorted, in the run of that quotient, with three bits of metadata a slot: occupied (some key has this quotient),
continuation (not the first of its run), shifted (not in its own slot).  Quotient and remainder can be read back, so two filters
merge by merging their sorted fingerprints, and a filter grows by moving bits from the remainder to the quotient, without the keys.

Keys are spread over shards by their hash.  A shard reads 64-bit hashes in order of arrival, probes each block against its filter, merges
the block and lets it go, so it holds a filter, never earlier keys.  Whole keys are looked at only for the exact answer, and only those
that the filter calls seen, in joins and in lookups of sorted runs.

A filter has no false negatives.  Two different keys collide when their p bits agree, so a filter of n keys wrongly says "seen"
with probability 1 - (1 - 2**-p)**n; ``wrong_rate`` derives it and the operators measure it.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlens.operators import sorted_runs
from depotlens.operators.sorted_runs import Run
from depotlens.session import Workspace, get_text, names, put_text, shuffle_partitions

#: Bits of a remainder.  With filters three quarters full or less, about 0.75 * 2**-10 of the new keys are taken for seen.
REMAINDER_BITS = 10
#: Keys arrive at a shard in blocks of this many; each block is probed, then merged into the shard's filter.
BLOCK_ROWS = 1 << 16
#: Rows of a scan that are combined before they move.
COMBINE_ROWS = 1 << 17
#: Keys that a shard should have at most; there are more shards than shuffle partitions when the tables need them.
SHARD_ROWS = 1 << 20


class QuotientFilter:
    """Immutable filter over p-bit fingerprints held in numpy arrays; slots past the last quotient take the overflow."""

    def __init__(self, p: int, q: int, remainders: np.ndarray, occupied: np.ndarray, continuation: np.ndarray, shifted: np.ndarray, n: int):
        self.p, self.q, self.r, self.n = p, q, p - q, n
        self.remainders, self.occupied, self.continuation, self.shifted = remainders, occupied, continuation, shifted
        used = np.flatnonzero(continuation | shifted | np.pad(occupied, (0, len(shifted) - len(occupied))))
        first = np.flatnonzero(~continuation[used])
        self._starts = used[first]
        self._lengths = np.diff(np.append(first, len(used)))
        self._rank = np.cumsum(occupied) - 1
        self._longest = int(self._lengths.max()) if len(self._lengths) else 0

    @staticmethod
    def quotient_bits(n: int) -> int:
        """The quotient that leaves a filter of n keys at most three quarters full."""
        return max(4, int(np.ceil(np.log2(max(1, n) / 0.75))))

    @classmethod
    def build(cls, fingerprints: np.ndarray, p: int) -> QuotientFilter:
        """From sorted or unsorted p-bit fingerprints; repeated ones are stored once."""
        fp = np.unique(fingerprints.astype(np.uint64))
        q = min(p - 1, cls.quotient_bits(len(fp)))
        r = p - q
        quotient = (fp >> np.uint64(r)).astype(np.int64)
        i = np.arange(len(fp))
        slot = i + np.maximum.accumulate(quotient - i) if len(fp) else i
        size = max(1 << q, int(slot[-1]) + 1 if len(fp) else 0)
        kind = np.uint16 if r <= 16 else np.uint32 if r <= 32 else np.uint64
        remainders = np.zeros(size, kind)
        remainders[slot] = (fp & np.uint64((1 << r) - 1)).astype(kind)
        occupied, continuation, shifted = np.zeros(1 << q, bool), np.zeros(size, bool), np.zeros(size, bool)
        occupied[quotient] = True
        continuation[slot[1:]] = quotient[1:] == quotient[:-1]
        shifted[slot] = slot != quotient
        return cls(p, q, remainders, occupied, continuation, shifted, len(fp))

    def contains(self, fingerprints: np.ndarray) -> np.ndarray:
        fp = fingerprints.astype(np.uint64)
        quotient = (fp >> np.uint64(self.r)).astype(np.int64)
        remainder = (fp & np.uint64((1 << self.r) - 1)).astype(self.remainders.dtype)
        at = np.flatnonzero(self.occupied[quotient])
        found = np.zeros(len(fp), bool)
        run = self._rank[quotient[at]]
        start, length = self._starts[run], self._lengths[run]
        for j in range(self._longest):
            on = length > j
            if not on.all():
                at, start, length = at[on], start[on], length[on]
            hit = self.remainders[start + j] == remainder[at]
            found[at[hit]] = True
        return found

    def fingerprints(self) -> np.ndarray:
        """The stored fingerprints, sorted, read back from slots and metadata."""
        used = np.flatnonzero(self.continuation | self.shifted | np.pad(self.occupied, (0, len(self.shifted) - len(self.occupied))))
        quotient = np.repeat(np.flatnonzero(self.occupied), self._lengths).astype(np.uint64)
        return (quotient << np.uint64(self.r)) | self.remainders[used].astype(np.uint64)

    def merge(self, other: QuotientFilter) -> QuotientFilter:
        """Merge of two sorted filters of the same p; the quotient grows with the number of keys."""
        if self.p != other.p:
            raise ValueError("filters of different fingerprint length cannot merge")
        return QuotientFilter.build(np.concatenate([self.fingerprints(), other.fingerprints()]), self.p)

    def wrong_rate(self) -> float:
        """Derived share of new keys that this filter takes for seen."""
        return float(-np.expm1(self.n * np.log1p(-(2.0**-self.p))))

    def to_bytes(self) -> bytes:
        head = struct.pack("<BBQQ", self.p, self.q, self.n, len(self.remainders))
        bits = ((self.remainders[:, None] >> np.arange(self.r, dtype=self.remainders.dtype)) & 1).astype(np.uint8)
        return head + b"".join(np.packbits(x).tobytes() for x in (bits, self.occupied, self.continuation, self.shifted))

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        p, q, n, size = struct.unpack_from("<BBQQ", data)
        at, r = struct.calcsize("<BBQQ"), p - q

        def bits(count: int) -> np.ndarray:
            nonlocal at
            raw = np.frombuffer(data, np.uint8, (count + 7) // 8, at)
            at += len(raw)
            return np.unpackbits(raw, count=count)

        kind = np.uint16 if r <= 16 else np.uint32 if r <= 32 else np.uint64
        rem = (bits(size * r).reshape(size, r).astype(np.uint64) << np.arange(r, dtype=np.uint64)).sum(1).astype(kind) if size else np.zeros(0, kind)
        return cls(p, q, rem, bits(1 << q).astype(bool), bits(size).astype(bool), bits(size).astype(bool), n)


# ---- the shards

_SHUFFLED = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("arrival", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("again", T.BooleanType()), T.StructField("filter", T.BinaryType())])
_JUDGED = T.StructType([T.StructField("arrival", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("maybe", T.BooleanType()), T.StructField("derived", T.DoubleType()), T.StructField("shard", T.IntegerType()), T.StructField("keys", T.LongType()), T.StructField("filter", T.BinaryType())])
#: A stored filter comes before all arrivals of its shard.
_FIRST = -1


def _combine(shards: int) -> callable:
    """Map side: of equal hashes scanned together the first arrival goes to the shard.  The later ones have the same fingerprint, so any
    filter calls them seen: they are marked, and spread by arrival."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def flush() -> pa.RecordBatch:
            arrival, h = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("arrival", "hash"))
            by = np.lexsort((arrival, h))
            arrival, h = arrival[by], h[by]
            again = np.zeros(len(h), bool)
            again[1:] = h[1:] == h[:-1]
            shard = np.where(again, arrival % shards, (h.astype(np.uint64) % np.uint64(shards)).astype(np.int64)).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(arrival), pa.array(h), pa.array(again), pa.nulls(len(h), pa.binary())], names=_SHUFFLED.names)

        for b in batches:
            if b.num_rows:
                held.append(b)
                count += b.num_rows
            if count >= COMBINE_ROWS:
                yield flush()
                held.clear()
                count = 0
        if held:
            yield flush()

    return run


def _fingerprint(h: np.ndarray, shards: int, p: int) -> np.ndarray:
    """p bits of the hash that do not depend on the shard, from a multiplicative mix."""
    x = h.astype(np.uint64) // np.uint64(shards)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x >> np.uint64(64 - p)


def _judge(shards: int, p: int) -> callable:
    """One shard in order of arrival: its stored filter, then blocks of hashes, each probed against all before and merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = QuotientFilter.build(np.zeros(0, np.uint64), p)
        shard, held, count = None, [], 0

        def block() -> pa.RecordBatch:
            nonlocal before
            arrival, h = (np.concatenate(x) for x in zip(*held))
            f = _fingerprint(h, shards, p)
            by = np.argsort(f, kind="stable")
            within = np.zeros(len(f), bool)
            within[by[1:]] = f[by[1:]] == f[by[:-1]]
            maybe = before.contains(f) | within
            derived = -np.expm1((before.n + np.arange(len(f))) * np.log1p(-(2.0**-p)))
            before = before.merge(QuotientFilter.build(f, p))
            return out(arrival, h, maybe, pa.array(derived))

        def out(arrival: np.ndarray, h: np.ndarray, maybe: np.ndarray, derived: pa.Array) -> pa.RecordBatch:
            n = len(arrival)
            return pa.RecordBatch.from_arrays([pa.array(arrival), pa.array(h), pa.array(maybe), derived, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=_JUDGED.names)

        for b in batches:
            if not b.num_rows:
                continue
            again = b.column("again").to_numpy(zero_copy_only=False)
            stored = b.column("filter").is_valid().to_numpy(zero_copy_only=False)
            for x in b.column("filter").filter(pa.array(stored)).to_pylist():
                before = before.merge(QuotientFilter.from_bytes(x))
            arrival, h = b.column("arrival").to_numpy(), b.column("hash").to_numpy(zero_copy_only=False)
            if again.any():
                yield out(arrival[again], h[again], np.ones(int(again.sum()), bool), pa.nulls(int(again.sum()), pa.float64()))
            own = ~again & ~stored
            if shard is None and (~again).any():
                shard = b.column("shard")[int(np.flatnonzero(~again)[0])].as_py()
            if own.any():
                held.append((arrival[own].copy(), h[own].copy()))
                count += int(own.sum())
            if count >= BLOCK_ROWS:
                yield block()
                held, count = [], 0
        if held:
            yield block()
        if before.n:
            none = lambda kind: pa.nulls(1, kind)
            yield pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.int64()), none(pa.bool_()), none(pa.float64()), pa.array([shard], pa.int32()), pa.array([before.n]), pa.array([before.to_bytes()], pa.binary())], names=_JUDGED.names)

    return run


def _same_key() -> sorted_runs.Match:
    """Asked keys that a run holds, compared whole."""

    def match(probes: pa.RecordBatch, i: np.ndarray, stored: pa.Table, j: np.ndarray) -> pa.RecordBatch:
        keys = probes.column("key").take(pa.array(i))
        same = pc.equal(keys, stored["key"].combine_chunks().take(pa.array(j)))
        return pa.RecordBatch.from_arrays([probes.column("hash").take(pa.array(i)).filter(same), keys.filter(same)], names=["hash", "key"])

    return match


class KeyHistory:
    """All keys seen so far: a quotient filter for each shard, and the keys themselves in sorted runs, read for the exact answer only.

    A batch shuffles its own hashes, not history: a shard's filter joins them as one row.  ``shards`` and the length ``p`` of fingerprints
    are fixed for the life of a history.  Each commit is one manifest, written whole or not at all; there is one writer at a time.
    """

    _RUN = T.StructType([T.StructField("hash", T.LongType()), T.StructField("key", T.BinaryType())])

    def __init__(self, spark: SparkSession, shards: int, p: int, path: str | None = None, width: int = 32):
        """Opens the history at ``path``, or begins one; without a path it lasts for this session.  Keys have ``width`` bytes."""
        self.spark, self.width, self.work = spark, width, Workspace(spark)
        self.path = path or self.work.path("history")
        found = [n for n in names(spark, f"{self.path}/manifests") if n.endswith(".json") and not n.startswith(".")]
        state = json.loads(get_text(spark, f"{self.path}/manifests/{found[-1]}")) if found else {"number": 0, "shards": shards, "p": p, "judged": None, "runs": []}
        self.number, self.shards, self.p, self.judged = state["number"], state["shards"], state["p"], state["judged"]
        self.runs = [Run(**r) for r in state["runs"]]

    def _keyed(self, rows: DataFrame, key: str, arrival: Column) -> DataFrame:
        valid = rows.select(arrival.cast("bigint").alias("arrival"), F.col(key).alias("key")).where(F.octet_length("key") == self.width)
        return valid.select("arrival", F.xxhash64("key").alias("hash"), "key")

    def filters(self) -> DataFrame:
        """(shard, keys, filter) as of the last commit."""
        if self.judged is None:
            return self.spark.createDataFrame([], _STORED)
        return self.spark.read.schema(_JUDGED).parquet(self.judged).where("filter is not null").select("shard", "keys", "filter")

    def _pass(self, rows: DataFrame, number: int) -> DataFrame:
        """Hashes through the filters; the answers and the merged filters are one written table."""
        moved = rows.select("arrival", "hash").mapInArrow(_combine(self.shards), _SHUFFLED)
        if self.judged is not None:
            moved = moved.unionByName(self.filters().select("shard", F.lit(_FIRST).cast("bigint").alias("arrival"), F.lit(0).cast("bigint").alias("hash"), F.lit(False).alias("again"), "filter"))
        judged = moved.repartitionById(self.shards, F.col("shard")).sortWithinPartitions("arrival").mapInArrow(_judge(self.shards, self.p), _JUDGED)
        path = f"{self.path}/judged-{number:012d}"
        judged.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(_JUDGED).parquet(path)

    def _commit(self, number: int, runs: list[Run]) -> None:
        state = {"number": number, "shards": self.shards, "p": self.p, "judged": f"{self.path}/judged-{number:012d}", "runs": [asdict(r) for r in runs]}
        if not put_text(self.spark, f"{self.path}/manifests/{number:012d}.json", json.dumps(state)):
            raise RuntimeError("another writer has committed to this history")
        self.number, self.runs, self.judged = number, runs, state["judged"]

    def add(self, keys: DataFrame, key: str = "key") -> None:
        """Keys that count as seen before all later batches; nulls and other lengths are left out, repeated keys count once."""
        distinct = self._keyed(keys, key, F.lit(0)).select("arrival", "hash", "key").distinct()
        number = self.number + 1
        distinct, _ = self.work.write(distinct, "added")
        self._pass(distinct, number)
        run = sorted_runs.write_run(distinct.select("hash", "key"), f"{self.path}/run-{number:012d}", max(1, distinct.count()), key="hash")
        self._commit(number, [*self.runs, run])

    def judge(self, requests: DataFrame, key: str, arrival: str, keep: bool = True) -> tuple[DataFrame, DataFrame]:
        """The filter's answers (arrival, maybe, derived), and the exact (arrival) of the seen ones.

        ``maybe`` says that the fingerprint occurred before.  The exact answer follows it: the keys of the hashes called seen are fetched by a
        semi join, their first arrivals found by an aggregate, and the first ones looked up in the runs of earlier keys.  ``keep``: the
        batch's new keys become history."""
        number = self.number + 1
        rows = self._keyed(requests, key, F.col(arrival))
        judged = self._pass(rows, number).where("filter is null")
        suspects = judged.where("maybe").select("hash").distinct()
        asked = rows.join(suspects, "hash", "left_semi")
        firsts = asked.groupBy("hash", "key").agg(F.min("arrival").alias("first"))
        if self.runs:
            old = sorted_runs.lookup(firsts.select("hash", "key"), self.runs, _same_key(), self._RUN, key="hash").distinct().withColumn("old", F.lit(True))
            firsts = firsts.join(old, ["hash", "key"], "left")
        else:
            firsts = firsts.withColumn("old", F.lit(None).cast("boolean"))
        firsts, _ = self.work.write(firsts, "firsts")
        seen = asked.join(firsts, ["hash", "key"]).where(F.col("old") | (F.col("arrival") > F.col("first"))).select("arrival")
        if keep:
            fresh = rows.join(suspects, "hash", "left_anti").select("hash", "key").unionByName(firsts.where("old is null").select("hash", "key"))
            run = sorted_runs.write_run(fresh, f"{self.path}/run-{number:012d}", max(1, requests.count()), key="hash")
            self._commit(number, [*self.runs, run])
        return judged.select("arrival", "maybe", "derived"), seen


def seen_before(requests: DataFrame, key: str, arrival: str, known: DataFrame | None = None, width: int = 32, shards: int | None = None, r_bits: int = REMAINDER_BITS) -> tuple[DataFrame, DataFrame]:
    """For each request whether its key was in an earlier request or among ``known``: the filter's answers (arrival, maybe, derived), and
    the exact (arrival) of the requests seen before.

    ``key``: binary of ``width`` bytes; null keys and keys of another length are never seen, never count and have no row.
    ``arrival``: unique non-negative bigint, the order; rows of equal arrival and key are one request.  ``known``: a DataFrame with
    a column ``key``, known before all requests, may repeat or be empty.  Extra columns are ignored.  ``derived`` is the filter's derived
    rate of wrong answers at that moment, null for repeats that were combined where they were scanned.

    One shuffle of hashes; a key that holds a third of all rows reaches its shard once a scan of COMBINE_ROWS.
    """
    spark = requests.sparkSession
    # Both counts read no keys: row counts of the files, and lengths of the lists that known keys come from.
    rows = requests.count() + (known.count() if known is not None else 0)
    shards = shards or max(shuffle_partitions(spark), -(-rows // SHARD_ROWS))
    history = KeyHistory(spark, shards, QuotientFilter.quotient_bits(-(-rows // shards)) + r_bits, width=width)
    if known is not None:
        history.add(known)
    return history.judge(requests, key, arrival, keep=False)


def all_answers(judged: DataFrame, seen: DataFrame) -> DataFrame:
    """(arrival, maybe, seen, derived) of every request."""
    return judged.join(seen.distinct().withColumn("seen", F.lit(True)), "arrival", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


def error_rates(judged: DataFrame) -> DataFrame:
    """One row: what the filter answered, how often it was wrong, and the rate derived beforehand."""
    new = ~F.col("seen")
    counts = judged.agg(
        F.count("*").alias("requests"), F.count_if("maybe").alias("called_seen"), F.count_if("seen").alias("seen"), F.count_if(F.col("maybe") & new).alias("false_positives"), F.count_if(~F.col("maybe") & F.col("seen")).alias("false_negatives"), F.avg(F.when(new, F.col("derived"))).alias("derived_rate")
    )
    return counts.withColumn("measured_rate", F.when(F.col("requests") > F.col("seen"), F.col("false_positives") / (F.col("requests") - F.col("seen"))))


# ---- filters kept between batches

_STORED = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("keys", T.LongType()), T.StructField("filter", T.BinaryType())])


def build_filters(keys: DataFrame, key: str, shards: int, p: int) -> DataFrame:
    """One filter a shard: (shard, keys, filter).  All filters of one store share ``shards`` and the fingerprint length ``p``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("shard")[0].as_py(), b.column("hash").to_numpy()) for b in batches if b.num_rows]
        if got:
            f = QuotientFilter.build(_fingerprint(np.concatenate([h for _, h in got]), shards, p), p)
            yield pa.RecordBatch.from_arrays([pa.array([got[0][0]], pa.int32()), pa.array([f.n]), pa.array([f.to_bytes()], pa.binary())], names=_STORED.names)

    hashed = keys.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("hash")).distinct()
    return hashed.select(_shard(F.col("hash"), shards).alias("shard"), "hash").repartitionById(shards, F.col("shard")).mapInArrow(run, _STORED)


def _shard(h: Column, shards: int) -> Column:
    """The unsigned hash modulo the number of shards, as the workers compute it."""
    return F.pmod(F.pmod(h, F.lit(shards)) + F.when(h < 0, F.lit((1 << 64) % shards)).otherwise(F.lit(0)), F.lit(shards)).cast("int")


def merge_filters(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merges two stores shard by shard without any key."""

    def run(table: pa.Table) -> pa.Table:
        fs = [QuotientFilter.from_bytes(x) for x in table["filter"].to_pylist()]
        f = fs[0]
        for g in fs[1:]:
            f = f.merge(g)
        return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int32()), "keys": pa.array([f.n]), "filter": pa.array([f.to_bytes()], pa.binary())})

    return old.unionByName(new).groupBy("shard").applyInArrow(run, _STORED)


def probe_filters(batch: DataFrame, key: str, filters: DataFrame, shards: int) -> DataFrame:
    """The batch's distinct keys with the store's answer: (key, maybe).  Keys are combined before they move; a shard without a
    filter has seen nothing."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"key": pa.array([], pa.binary()), "maybe": pa.array([], pa.bool_())})
        if right.num_rows:
            f = QuotientFilter.from_bytes(right["filter"][0].as_py())
            maybe = f.contains(_fingerprint(left["hash"].to_numpy(), shards, f.p))
        else:
            maybe = np.zeros(left.num_rows, bool)
        return pa.table({"key": left["key"], "maybe": pa.array(maybe)})

    rows = batch.where(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct().select("key", F.xxhash64("key").alias("hash"))
    rows = rows.withColumn("shard", _shard(F.col("hash"), shards))
    return rows.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(run, "key binary, maybe boolean")


# ---- the depot's keys


def depot_known_keys(shared: DataFrame, cache: DataFrame) -> DataFrame:
    """Checksums of shared_chunk and of every chunk_map of file_cache; text forms are 64 hexadecimal digits in any case, trimmed."""
    text = F.regexp_replace(F.col("c.checksum"), "(?U)^\\s+|\\s+$", "")
    mapped = cache.select(F.explode("chunk_map").alias("c")).select(F.when(F.octet_length(text) == 64, F.unhex(text)).alias("key"))
    return shared.select(F.col("checksum").alias("key")).unionByName(mapped).where("key is not null")
