"""An index of checksums in tiers: a log of the newest entries, sorted runs below it, merged by size.

Entries (checksum, then any values) are added in generations.  Up to FLUSH entries stay in the log; beyond that the log becomes a sorted run.
FAN_IN runs of a level are merged into one of the next, up to LEVELS, the newest entry of a checksum surviving.  A lookup meets the log by a
join and the runs by reading the row groups that its checksums touch, and the newest generation wins.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlens.operators import sorted_runs
from depotlens.operators.sorted_runs import Run
from depotlens.operators.storage import newest
from depotlens.session import delete, get_text, names, put_text

FLUSH, FAN_IN, LEVELS = 4096, 16, 2


def _matching(columns: list[str]) -> sorted_runs.Match:
    """Stored entries of the asked checksums, compared whole."""

    def match(probes: pa.RecordBatch, i: np.ndarray, stored: pa.Table, j: np.ndarray) -> pa.RecordBatch:
        rows = stored.select(columns).take(pa.array(j))
        same = pc.equal(probes.column("checksum").take(pa.array(i)), rows["checksum"].combine_chunks())
        return rows.filter(same).combine_chunks().to_batches(max_chunksize=None)[0] if pc.any(same).as_py() else None

    return match


class PackIndex:
    """The index at a folder.  ``values``: DDL of what an entry holds beside checksum (binary) and generation (bigint).

    Each step writes new folders and then one manifest, whole or not at all; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, values: str):
        self.spark, self.path = spark, path
        self.schema = T.StructType.fromDDL(f"checksum binary, generation bigint, {values}")
        self.stored = T.StructType([T.StructField("key", T.LongType()), *self.schema.fields])
        self.values = [f.name for f in self.schema.fields[2:]]
        found = [n for n in names(spark, f"{path}/manifests") if n.endswith(".json") and not n.startswith(".")]
        state = json.loads(get_text(spark, f"{path}/manifests/{found[-1]}")) if found else {"number": 0, "logs": [], "logged": 0, "levels": []}
        self.number, self.logs, self.logged, self.levels = state["number"], state["logs"], state["logged"], [[Run(**r) for r in level] for level in state["levels"]]

    @property
    def runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    def log(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.logs) if self.logs else self.spark.createDataFrame([], self.schema)

    def entries(self) -> DataFrame:
        """The newest entry of every checksum."""
        runs = sorted_runs.read_runs(self.spark, self.runs, self.stored).select(*self.schema.names)
        return newest(self.log().unionByName(runs), "checksum", "generation", self.values)

    def add(self, entries: DataFrame) -> None:
        """One generation: entries (checksum, values...); null checksums are left out, of several for one the greatest values count."""
        generation = self.number + 1
        rows = entries.where("checksum is not null").withColumn("generation", F.lit(generation).cast("bigint"))
        path = f"{self.path}/log-{generation:012d}-{uuid.uuid4().hex}"
        newest(rows, "checksum", "generation", self.values).select(*self.schema.names).write.parquet(path)
        count = self.spark.read.schema(self.schema).parquet(path).count()
        logs, logged, levels = [*self.logs, path], self.logged + count, [list(level) for level in self.levels] or [[]]
        dropped: list[str] = []
        if logged >= FLUSH:
            rows = newest(self.spark.read.schema(self.schema).parquet(*logs), "checksum", "generation", self.values)
            levels[0].append(self._write(rows, logged))
            dropped, logs, logged = logs, [], 0
        for level in range(LEVELS):
            if level < len(levels) and len(levels[level]) >= FAN_IN:
                merged = newest(sorted_runs.read_runs(self.spark, levels[level], self.stored), "checksum", "generation", self.values)
                dropped += [r.path for r in levels[level]]
                if level + 1 == len(levels):
                    levels.append([])
                levels[level + 1].append(self._write(merged, sum(r.rows for r in levels[level])))
                levels[level] = []
        state = {"number": generation, "logs": logs, "logged": logged, "levels": [[asdict(r) for r in level] for level in levels]}
        if not put_text(self.spark, f"{self.path}/manifests/{generation:012d}.json", json.dumps(state)):
            raise RuntimeError("another writer has changed this index")
        self.number, self.logs, self.logged, self.levels = generation, logs, logged, levels
        for p in dropped:
            delete(self.spark, p)

    def _write(self, rows: DataFrame, count: int) -> Run:
        return sorted_runs.write_run(rows.select(F.xxhash64("checksum").alias("key"), *self.schema.names), f"{self.path}/run-{uuid.uuid4().hex}", count)

    def find(self, asked: DataFrame, checksum: str = "checksum") -> DataFrame:
        """(checksum, generation, values...) of the asked checksums that the index holds, the newest entry of each."""
        keys = asked.select(F.col(checksum).alias("checksum")).where("checksum is not null").distinct()
        hits = sorted_runs.lookup(keys.select(F.xxhash64("checksum").alias("key"), "checksum"), self.runs, _matching(self.schema.names), self.schema)
        return newest(hits.unionByName(self.log().join(keys, "checksum", "left_semi")), "checksum", "generation", self.values).select(*self.schema.names)
