"""Bloom filters of an index, one a bucket, built and merged over Arrow batches.

Bits come from the digests themselves, which are uniform already: the first eight bytes give the start, the next eight, made odd, the
step.  Filters of one size merge by OR, so buckets are filled wherever their rows are read and combined afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of strangers that a filter may take for members.
WRONG = 0.001


def dimensions(entries: int, wrong: float = WRONG) -> tuple[int, int]:
    """(bits, probes) for so many entries."""
    bits = max(64, math.ceil(-entries * math.log(wrong) / math.log(2) ** 2))
    bits = -(-bits // 8) * 8
    return bits, max(1, math.ceil(bits / max(1, entries) * math.log(2)))


def _positions(digests: np.ndarray, bits: int, probes: int) -> np.ndarray:
    words = digests[:, :16].copy().view("<u8")
    step = words[:, 1] | np.uint64(1)
    return (words[:, :1] + np.arange(probes, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


def _digests(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def build(entries: DataFrame, bucket: Column, digest: str, per_bucket: int, wrong: float = WRONG) -> DataFrame:
    """(bucket, entries, filter) for 32-byte digests; ``per_bucket`` is what a bucket is expected to hold.

    Partial filters are built by task and merged by bucket, so a bucket moves as bits, never as rows."""
    bits, probes = dimensions(per_bucket, wrong)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            buckets, d = np.array(b.column("bucket").to_pylist()), _digests(b.column("digest"))
            names, row = np.unique(buckets, return_inverse=True)
            table = np.zeros((len(names), bits), bool)
            np.put_along_axis(table.reshape(-1), (row[:, None] * bits + _positions(d, bits, probes).astype(np.int64)).reshape(-1), True, 0)
            yield pa.RecordBatch.from_arrays([pa.array(names.tolist()), pa.array(np.bincount(row).tolist(), pa.int64()), pa.array([np.packbits(t).tobytes() for t in table], pa.binary())], names=["bucket", "entries", "filter"])

    def merge(table: pa.Table) -> pa.Table:
        merged = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table["filter"].to_pylist()])
        return pa.table({"bucket": table["bucket"].slice(0, 1), "entries": pa.array([sum(table["entries"].to_pylist())]), "filter": pa.array([merged.tobytes()], pa.binary())})

    schema = "bucket string, entries bigint, filter binary"
    rows = entries.select(bucket.alias("bucket"), F.col(digest).alias("digest")).where(F.octet_length("digest") == 32)
    return rows.mapInArrow(partial, schema).groupBy("bucket").applyInArrow(merge, schema)


def might_contain(probes_for: DataFrame, bucket: Column, digest: str, filters: DataFrame, per_bucket: int, wrong: float = WRONG) -> DataFrame:
    """(digest, maybe) of the distinct digests asked for; buckets without a filter hold nothing."""
    bits, probes = dimensions(per_bucket, wrong)

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"digest": pa.array([], pa.binary()), "maybe": pa.array([], pa.bool_())})
        if right.num_rows:
            f = np.unpackbits(np.frombuffer(right["filter"][0].as_py(), np.uint8)).astype(bool)
            maybe = f[_positions(_digests(left["digest"]), bits, probes).astype(np.int64)].all(1)
        else:
            maybe = np.zeros(left.num_rows, bool)
        return pa.table({"digest": left["digest"], "maybe": pa.array(maybe)})

    rows = probes_for.select(bucket.alias("bucket"), F.col(digest).alias("digest")).where(F.octet_length("digest") == 32).distinct()
    return rows.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(ask, "digest binary, maybe boolean")
