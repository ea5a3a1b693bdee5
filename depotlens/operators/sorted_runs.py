"""Sorted runs: rows kept sorted by a 64-bit hash, with lookups that read only the row groups which the asked keys touch.

A run is a folder of Parquet files, one folder a bucket; the bucket is the upper bits of the key, and within it rows are sorted by key
and cut into small row groups.  A lookup sorts its probes by bucket and key, opens the buckets that they fall in, and reads the row
groups whose bounds hold a probe, found in the footers.  So a batch of fixed size reads nearly the same number of bytes however
large the history is, and history is never shuffled.  Runs are read-only: probes of one hot key may be split over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from depotlens.session import shuffle_partitions

#: Bytes of a row group: what one probe reads at most, if its key occurs in one group.
GRANULE_BYTES = 64 << 10
#: Rows that a bucket is meant to hold.
BUCKET_ROWS = 1 << 20
#: Probes are spread over at least so many buckets (a power of two), however few the runs have.
LEAST_BITS = 8
#: Pairs of a probe and a stored row, and stored rows, that a worker holds at one time.
PAIRS, ROWS = 1 << 19, 1 << 18


@dataclass(frozen=True)
class Run:
    """A written run: its folder, how many upper bits of the key name a bucket, and about how many rows it has."""

    path: str
    bits: int
    rows: int


def _bucket(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)


def write_run(rows: DataFrame, path: str, expected: int, key: str = "key", granule: int = GRANULE_BYTES) -> Run:
    """Writes rows as a run; ``key`` is a bigint hash without nulls.  ``expected`` rows decide the number of buckets only."""
    bits = max(_log2(expected // BUCKET_ROWS + 1), _log2(shuffle_partitions(rows.sparkSession)))
    bucketed = rows.withColumn("bucket", _bucket(F.col(key), bits)).repartitionById(1 << bits, F.col("bucket")).sortWithinPartitions("bucket", key)
    bucketed.write.mode("overwrite").option("parquet.block.size", granule).option("parquet.page.size", granule).option("parquet.enable.dictionary", False).partitionBy("bucket").parquet(path)
    return Run(path, bits, expected)


def _log2(n: int) -> int:
    """Smallest number of bits that tell n things apart."""
    return max(0, n - 1).bit_length()


def read_runs(spark: SparkSession, runs: Sequence[Run], schema: StructType) -> DataFrame:
    """All rows of the runs, for merges and tests."""
    if not runs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*[r.path for r in runs])


class _Bucket:
    """One bucket of a run, open for lookups in rising order of keys."""

    def __init__(self, run: Run, bucket: int, key: str, meter):
        import pyarrow.fs as pf
        import pyarrow.parquet as pq

        fs, folder = pf.FileSystem.from_uri(run.path.replace("s3a://", "s3://"))
        found = fs.get_file_info(pf.FileSelector(f"{folder}/bucket={bucket}", allow_not_found=True))
        self.key, self.meter, self.files = key, meter, []
        for f in found:
            if f.path.endswith(".parquet"):
                file = pq.ParquetFile(fs.open_input_file(f.path))
                m = file.metadata
                at = m.schema.to_arrow_schema().get_field_index(key)
                stats = [m.row_group(i).column(at).statistics for i in range(m.num_row_groups)]
                sizes = np.array([m.row_group(i).num_rows for i in range(m.num_row_groups)], np.int64)
                self.files.append((file, np.array([s.min for s in stats], np.int64), np.array([s.max for s in stats], np.int64), sizes))
                if meter is not None:
                    meter.add(m.serialized_size)

    def tables(self, keys: np.ndarray) -> Iterator[pa.Table]:
        """The row groups that may hold one of the sorted keys, some at a time."""
        for file, low, high, sizes in self.files:
            wanted = np.flatnonzero(np.searchsorted(keys, low, "left") < np.searchsorted(keys, high, "right"))
            held = np.cumsum(sizes[wanted]) // ROWS
            for part in np.split(wanted, np.flatnonzero(np.diff(held)) + 1) if len(wanted) else []:
                if self.meter is not None:
                    self.meter.add(sum(file.metadata.row_group(int(i)).column(c).total_compressed_size for i in part for c in range(file.metadata.num_columns)))
                yield file.read_row_groups(part.tolist(), use_threads=False)


def _join(keys: np.ndarray, stored: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (probe, stored row) of equal keys, both sorted, at most about PAIRS at a time."""
    first, last = np.searchsorted(keys, stored, "left"), np.searchsorted(keys, stored, "right")
    hit = np.flatnonzero(last > first)
    counts = (last - first)[hit]
    at = 0
    while at < len(hit):
        # One stored row that more than PAIRS probes ask for is cut on the probes' side.
        end = max(at + 1, at + int(np.searchsorted(np.cumsum(counts[at:]), PAIRS, "right")))
        rows, n = hit[at:end], counts[at:end]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        probe, row = inside + np.repeat(first[rows], n), np.repeat(rows, n)
        for a in range(0, len(probe), PAIRS):
            yield probe[a : a + PAIRS], row[a : a + PAIRS]
        at = end


#: What becomes of pairs: (probes, positions in them, stored rows, positions in them) to rows of the result, or None.
Match = Callable[[pa.RecordBatch, np.ndarray, pa.Table, np.ndarray], "pa.RecordBatch | None"]


def lookup(probes: DataFrame, runs: Sequence[Run], match: Match, schema: StructType | str, key: str = "key", meter=None) -> DataFrame:
    """Rows that ``match`` makes of each probe and each stored row of the same key.

    ``probes``: ``key`` (bigint without nulls) and other columns.  ``match`` gets them in batches and must not depend on how they are cut.
    ``meter``: an accumulator that counts the bytes read from files.  Without runs the result is empty.
    """
    bits = max([LEAST_BITS, *(r.bits for r in runs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[int, tuple[int, _Bucket]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            bucket, keys = b.column("__bucket").to_numpy(), b.column(key).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for a, z in zip(cuts, cuts[1:]):
                part, asked = b.slice(a, z - a), keys[a:z]
                for i, r in enumerate(runs):
                    number = int(bucket[a]) >> (bits - r.bits)
                    if i not in opened or opened[i][0] != number:
                        opened[i] = (number, _Bucket(r, number, key, meter))
                    for t in opened[i][1].tables(asked):
                        for probe, row in _join(asked, t[key].to_numpy()):
                            out = match(part, probe, t, row)
                            if out is not None and out.num_rows:
                                yield out

    spread = probes.withColumn("__bucket", _bucket(F.col(key), bits)).hint("rebalance", "__bucket").sortWithinPartitions("__bucket", key)
    return spread.mapInArrow(run, schema)
