"""Lookups in sorted runs against a plain join."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from depotlens.operators import sorted_runs as r


def matcher():
    def match(probes, i, stored, j):
        return pa.RecordBatch.from_arrays([probes.column("n").take(pa.array(i)), stored["v"].combine_chunks().take(pa.array(j))], names=["n", "v"])

    return match


def rows(spark, n, mod, name):
    return spark.range(n).select(F.xxhash64(F.col("id") % mod).alias("key"), F.col("id").alias(name))


@pytest.mark.parametrize("runs", [0, 1, 3])
def test_lookup_is_a_join(spark, tmp_path, runs):
    made = [r.write_run(rows(spark, 3000 + 100 * i, 500, "v"), str(tmp_path / f"run{i}"), 3000, granule=4096) for i in range(runs)]
    probes = rows(spark, 900, 700, "n").unionByName(rows(spark, 3, 900, "n").withColumn("key", F.lit(5).cast("bigint")))
    got = sorted(tuple(x) for x in r.lookup(probes, made, matcher(), "n bigint, v bigint").collect())
    stored = r.read_runs(spark, made, "key bigint, v bigint")
    assert got == sorted(tuple(x) for x in probes.join(stored, "key").select("n", "v").collect())
    assert r.lookup(probes.limit(0), made, matcher(), "n bigint, v bigint").count() == 0


def test_many_probes_of_one_key_come_in_pieces(monkeypatch):
    monkeypatch.setattr(r, "PAIRS", 4)
    keys, stored = np.array([1, 2, 2, 2, 2, 2, 2, 3]), np.array([0, 2, 2, 3, 4])
    pairs = list(r._join(keys, stored))
    assert all(len(p) <= 4 for p, _ in pairs)
    assert sorted((int(a), int(b)) for p, q in pairs for a, b in zip(p, q)) == sorted((i, j) for i, k in enumerate(keys) for j, s in enumerate(stored) if k == s)


def test_few_keys_read_little(spark, tmp_path, monkeypatch):
    """Bytes read follow the probes, not the run."""
    monkeypatch.setattr(r, "BUCKET_ROWS", 4096)
    read = []
    probes = rows(spark, 3, 3, "n")
    for n in (20_000, 320_000):
        run = r.write_run(spark.range(n).select(F.xxhash64("id").alias("key"), F.col("id").alias("v")), str(tmp_path / str(n)), n, granule=4096)
        meter = spark.sparkContext.accumulator(0)
        assert r.lookup(probes, [run], matcher(), "n bigint, v bigint", meter=meter).count() == 3
        read.append(meter.value)
    assert 0 < read[1] < 2 * read[0]


def test_small_files_are_written_once(spark, tmp_path):
    from depotlens import session

    path = f"file://{tmp_path}/m.json"
    assert session.put_text(spark, path, "ü") and not session.put_text(spark, path, "b") and session.get_text(spark, path) == "ü"
    assert session.names(spark, f"file://{tmp_path}") == [".m.json.crc", "m.json"] or "m.json" in session.names(spark, f"file://{tmp_path}")
    assert session.names(spark, f"file://{tmp_path}/none") == []
