"""Content-defined chunking of binary columns.

A rolling hash h = 2h + gear[byte] over 32 bits is tested against two masks: a stricter one up to the average size, a looser one
beyond it.  Its low bits depend on the last few bytes only, so the hash of a whole blob is computed at once by doubling the window,
and only the choice of cuts walks from cut to cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlens.functions.arrow import slices

#: The gear table is ours: the first four bytes of SHA-256 of each byte value.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([i])).digest()[:4], "little") for i in range(256)], np.uint32)
#: Average sizes that the advice compares, in KiB.
ADVISED_KIB = (8, 16, 32, 64, 128, 256)


def masks(average: int) -> tuple[int, int]:
    bits = average.bit_length() - 1
    return (1 << (bits + 1)) - 1, (1 << (bits - 1)) - 1


def _check(least: int, average: int, most: int) -> None:
    if not 0 < least < average < most:
        raise ValueError("sizes must satisfy 0 < least < average < most")


def cut_points_stepwise(data: bytes, least: int, average: int, most: int) -> list[int]:
    """Ends of the chunks by the definition, byte by byte; for sizes below the hash's reach and for tests."""
    _check(least, average, most)
    strict, loose = masks(average)
    gear, ends, start, h = GEAR.tolist(), [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + gear[b]) & 0xFFFFFFFF
        n = i + 1 - start
        if (n >= least and h & strict == 0) or (n >= average and h & loose == 0) or n >= most:
            ends.append(i + 1)
            start, h = i + 1, 0
    if start < len(data):
        ends.append(len(data))
    return ends


def cut_points(data: bytes, least: int, average: int, most: int) -> list[int]:
    """Ends of the chunks of a blob; an empty one has none."""
    _check(least, average, most)
    strict, loose = masks(average)
    if least < strict.bit_length():
        return cut_points_stepwise(data, least, average, most)
    h = GEAR[np.frombuffer(data, np.uint8)]
    w = 1
    while w < 32:
        h[w:] += h[:-w] << np.uint32(w)
        w *= 2
    far = np.flatnonzero((h & np.uint32(loose)) == 0)
    near = far[(h[far] & np.uint32(strict)) == 0]
    ends, start, n = [], 0, len(data)
    while start < n:
        end = min(start + most, n)
        i = np.searchsorted(near, start + least - 1)
        if i < len(near) and near[i] + 1 < min(end, start + average):
            end = int(near[i]) + 1
        else:
            j = np.searchsorted(far, start + average - 1)
            if j < len(far) and far[j] + 1 < end:
                end = int(far[j]) + 1
        ends.append(end)
        start = end
    return ends


#: Digests that a store may use for its chunks, by name; a callable from bytes to bytes may be given instead.
DIGESTS = {"sha256": lambda b: hashlib.sha256(b).digest(), "blake2b": lambda b: hashlib.blake2b(b, digest_size=32).digest(), "sha3": lambda b: hashlib.sha3_256(b).digest()}


class StreamingChunker:
    """Chunks of a blob that arrives in pieces: the same as ``cut_points`` of the whole, however it is split.

    Holds what comes after the last cut, less than ``most`` bytes beside the piece at hand.  ``append`` gives the chunks that are certain,
    ``finish`` the last one.  With ``known`` digests only chunks that were not seen before are given, each once."""

    def __init__(self, least: int, average: int, most: int, digest: str = "sha256", known: set[bytes] | None = None):
        _check(least, average, most)
        self.sizes, self.digest, self.known = (least, average, most), DIGESTS[digest], known
        self.held, self.at, self.index = b"", 0, 0

    def _give(self, ends: list[int]) -> list[tuple[int, int, int, bytes]]:
        out, a = [], 0
        for z in ends:
            digest = self.digest(self.held[a:z])
            if self.known is None or digest not in self.known:
                out.append((self.index, self.at + a, z - a, digest))
                if self.known is not None:
                    self.known.add(digest)
            self.index, a = self.index + 1, z
        self.held, self.at = self.held[a:], self.at + a
        return out

    def append(self, data: bytes) -> list[tuple[int, int, int, bytes]]:
        """(index, offset, length, digest) of the chunks that no later byte changes."""
        self.held += data
        ends = cut_points(self.held, *self.sizes) if len(self.held) >= self.sizes[2] else []
        # A chunk is certain unless it ends where the data so far ends.
        return self._give([z for z in ends if z < len(self.held) or z - (ends[-2] if len(ends) > 1 else 0) == self.sizes[2]])

    def finish(self) -> list[tuple[int, int, int, bytes]]:
        return self._give(cut_points(self.held, *self.sizes)) if self.held else []


_CHUNKS = [("chunk_index", T.IntegerType()), ("byte_offset", T.LongType()), ("length", T.IntegerType()), ("checksum", T.BinaryType())]


def chunk_blobs(blobs: DataFrame, key: str, content: str, sizes: list[tuple[int, int, int]], digest: str | Callable[[bytes], bytes] = "sha256") -> DataFrame:
    """(key, average, chunk_index, byte_offset, length, checksum) of every blob for each of ``sizes`` (least, average, most).

    Blobs stay in the task that reads them; null contents have no chunks."""
    for s in sizes:
        _check(*s)
    hashed = DIGESTS[digest] if isinstance(digest, str) else digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "content"):
            rows, avg, no, off, length, sums = [], [], [], [], [], []
            for r, data in enumerate(b.column("content").to_pylist()):
                for size in sizes:
                    a = 0
                    for k, z in enumerate(cut_points(data, *size)):
                        rows.append(r)
                        avg.append(size[1])
                        no.append(k)
                        off.append(a)
                        length.append(z - a)
                        sums.append(hashed(data[a:z]))
                        a = z
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(rows, pa.int64())), pa.array(avg, pa.int32()), pa.array(no, pa.int32()), pa.array(off, pa.int64()), pa.array(length, pa.int32()), pa.array(sums, pa.binary())], names=["key", "average", *(n for n, _ in _CHUNKS)])

    source = blobs.select(F.col(key).alias("key"), F.col(content).alias("content")).where("content is not null")
    return source.mapInArrow(run, T.StructType([T.StructField("key", source.schema["key"].dataType), T.StructField("average", T.IntegerType()), *(T.StructField(n, t) for n, t in _CHUNKS)]))


def new_chunks(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct chunks that the store does not hold: (checksum, length)."""
    return chunks.groupBy("checksum").agg(F.max("length").alias("length")).join(known.select("checksum"), "checksum", "left_anti")


def load_chunks(blobs: DataFrame, maps: DataFrame, key: str, content: str) -> DataFrame:
    """Appends ``data``, the bytes of each entry of a chunk map (byte_offset, length, checksum).  An entry beyond the end of its content, or
    one whose bytes have another SHA-256 than its checksum, is an error when the plan runs."""
    j = maps.join(blobs.select(key, F.col(content).alias("__content")), key)
    data = F.substring("__content", (F.col("byte_offset") + 1).cast("int"), F.col("length"))
    j = j.withColumn("data", data)
    whole = F.when(F.octet_length("data") == F.col("length"), True).otherwise(F.raise_error(F.lit("a chunk ends beyond its content")).cast("boolean"))
    right = F.when(F.unhex(F.sha2("data", 256)) == F.col("checksum"), True).otherwise(F.raise_error(F.lit("a chunk has another checksum")).cast("boolean"))
    return j.where(whole & right).drop("__content")


def chunk_missing(blobs: DataFrame, key: str, content: str, known: DataFrame, sizes: tuple[int, int, int]) -> DataFrame:
    """Chunk maps of the contents that ``known`` (content_id) lacks, one for each distinct content: only these are read for cutting."""
    ids = blobs.select(F.unhex(F.sha2(content, 256)).alias("content_id"), F.col(key).alias("k"))
    chosen = ids.where("content_id is not null").groupBy("content_id").agg(F.min("k").alias("k")).join(known.select("content_id"), "content_id", "left_anti")
    return chunk_blobs(blobs.join(chosen.withColumnRenamed("k", key), key), "content_id", content, [sizes]).drop("average").withColumnRenamed("key", "content_id")


def _power(n: int) -> int:
    p = 1
    while p < n:
        p <<= 1
    return p


def advised_sizes(averages: list[int]) -> list[tuple[int, int, int]]:
    return [(_power(int(a * 0.15)), a, _power(a * 6)) for a in averages]


def advice(blobs: DataFrame, key: str, content: str, target: str = "dedupe", averages: list[int] | None = None) -> DataFrame:
    """Figures of each chunk size and which one suits the target: (average, ..., score, recommended).

    Targets: dedupe (highest share of repeated chunks), throughput and chunk_count (fewest chunks), balanced (chunks closest to the
    wanted size).  Ties go to the smallest average."""
    sizes = advised_sizes(averages or [k * 1024 for k in ADVISED_KIB])
    c = chunk_blobs(blobs, key, content, sizes)
    # Repeats are combined first; every figure follows from lengths, counts and squares.
    u = c.groupBy("average", "checksum").agg(F.count("*").alias("n"), F.max("length").alias("length"))
    g = u.groupBy("average").agg(
        F.sum("n").alias("chunks"), F.count("*").alias("unique_chunks"), F.sum(F.col("n") * F.col("length")).alias("bytes"), F.sum(F.col("n") * F.col("length").cast("double") * F.col("length")).alias("squares"), F.min("length").alias("smallest"), F.max("length").alias("largest")
    )
    mean = (F.col("bytes") / F.col("chunks")).cast("bigint")
    g = g.withColumn("observed", mean).withColumns({"deviation": F.sqrt((F.col("squares") - 2.0 * mean * F.col("bytes") + 1.0 * F.col("chunks") * mean * mean) / F.col("chunks")).cast("bigint"), "dedup_ratio": F.col("chunks") / F.col("unique_chunks")})
    score = {"dedupe": (F.col("dedup_ratio") * 1000).cast("bigint"), "throughput": -F.col("chunks"), "chunk_count": -F.col("chunks"), "balanced": -(F.col("deviation") + F.abs(F.col("average") - F.col("observed")))}[target]
    scored = g.withColumn("score", score.cast("bigint"))
    # One row for each size compared.
    w = Window.orderBy(F.col("score").desc(), F.col("average"))
    return scored.withColumn("recommended", F.row_number().over(w) == 1).select("average", "chunks", "unique_chunks", "observed", "deviation", "smallest", "largest", "dedup_ratio", "score", "recommended")
