import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from depotlens.llm import dedup_index as x
from depotlens.operators import sorted_runs


def judge(rows, near=(7, 10)):
    """Ids that are not accepted, by the definition."""
    accepted, out = [], set()
    for i, keys in sorted(rows):
        s = {k for k in keys or [] if k is not None}
        if not s:
            continue
        if any(near[1] * len(s & a) >= near[0] * len(s | a) for a in accepted):
            out.add(i)
        else:
            accepted.append(s)
    return out


def test_bounds_by_enumeration():
    for l in range(1, 40):
        for m in range(1, 40):
            # Largest difference of sets of sizes l and m that are still near.
            best = -1
            for common in range(min(l, m) + 1):
                if 10 * common >= 7 * (l + m - common):
                    best = max(best, l + m - 2 * common)
            assert x.distance_bound(np.array([l]), np.array([m]))[0] == best
    counts = x.segment_counts(40)
    assert all(counts[l] == 1 + max(x.distance_bound(np.full(60, l), np.arange(1, 61))) for l in range(1, 41))
    assert (counts[1:] <= np.arange(1, 41)).all()


def family(rnd, n, pool, hot):
    rows, made = [], []
    for i in range(n):
        if made and rnd.random() < 0.6:
            s = set(rnd.choice(made[-30:]))
            for _ in range(rnd.randrange(0, 1 + len(s) // 3)):
                if rnd.random() < 0.5 and s:
                    s.discard(rnd.choice(sorted(s)))
                else:
                    s.add(rnd.choice(pool))
        else:
            s = set(rnd.sample(pool, rnd.randrange(1, 25)))
            if rnd.random() < 0.5:
                s |= set(rnd.sample(hot, rnd.randrange(1, len(hot) + 1)))
        made.append(s)
        keys = [*s, *rnd.sample(sorted(s), min(len(s), 2)), None] if s else []
        rnd.shuffle(keys)
        rows.append((i, keys))
    return rows


@pytest.mark.parametrize("seed, hot_known, first", [(1, True, 2000), (2, False, 40), (3, True, 2)])
def test_against_the_definition(spark, monkeypatch, seed, hot_known, first):
    monkeypatch.setattr(x, "FIRST_BATCH", first)
    rnd = random.Random(seed)
    pool, hot = [rnd.randbytes(32) for _ in range(200)], [rnd.randbytes(32) for _ in range(9)]
    rows = family(rnd, 400, pool, hot) + [(1000, None), (1001, []), (1002, [None, None])]
    df = spark.createDataFrame([(i, k, "x") for i, k in rows], "n bigint, keys_in array<binary>, id string")
    found = None
    if hot_known:
        found = [r[0] for r in spark.createDataFrame([(h,) for h in hot], "k binary").selectExpr("xxhash64(k)").collect()]
    got = [r.id for r in x.repeats(df, "n", "keys_in", found).collect()]
    assert len(got) == len(set(got)) and set(got) == judge(rows)


def test_rounds_agree_with_the_single_task(spark, monkeypatch):
    monkeypatch.setattr(x, "OPEN_EDGES", 3)
    rnd = random.Random(9)
    pool = [bytes([i]) * 32 for i in range(60)]
    drift = [(i, [pool[(i + j) % 60] for j in range(10)]) for i in range(40)]
    crowd = [(100 + i, [*pool[:20], rnd.randbytes(32)]) for i in range(30)]
    rows = drift + crowd
    df = spark.createDataFrame(rows, "id bigint, keys array<binary>")
    assert {r.id for r in x.repeats(df, "id", "keys").collect()} == judge(rows)


def test_counts_and_replies(spark):
    a, b, c, s = (bytes([i]) * 32 for i in range(4))
    rows = [(1, [a, b, a, None], 2), (2, [a, s], 1), (3, [c, s], 1), (4, None, 0), (5, [], 3), (6, [c], None), (7, [b"odd"], 1), (8, [None], 1)]
    plans = spark.createDataFrame([(i, k, n, 0) for i, k, n in rows], "upload_id bigint, missing_chunk_checksums array<binary>, chunks_written_new int, id int")
    shared = spark.createDataFrame([(s, "x")], "checksum binary, id string")
    got = {(r.finding, r.upload_id) for r in x.judge_uploads(plans, shared).collect()}
    assert got == {("count", 2), ("count", 5), ("count", 8)}
    assert x.judge_uploads(plans.limit(0), shared.limit(0)).count() == 0


def test_batches_cover_every_id(spark, monkeypatch):
    monkeypatch.setattr(x, "FIRST_BATCH", 10)
    for n, step in [(0, 1), (1, 1), (9, 5), (2000, 1), (3000, 10**12)]:
        df = spark.range(n).select((F.col("id") * step).alias("n"), F.array(F.lit(b"k")).alias("keys"))
        got = x.batches(df, "n", "keys")
        assert got[0][0] is None and got[-1][1] is None and all(p[1] == q[0] for p, q in zip(got, got[1:])) and len(got) == len(set(got))
        assert len(got) == {0: 1, 1: 1, 9: 1, 2000: 3, 3000: 4}[n]


def as_batch(spark, rows):
    return spark.createDataFrame(rows, "n bigint, keys array<binary>")


def ids(df):
    got = [r.id for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def hashes(spark, keys):
    return [r[0] for r in spark.createDataFrame([(h,) for h in keys], "k binary").selectExpr("xxhash64(k)").collect()]


def test_store_goes_on_in_later_sessions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(x, "FAN_IN", 2)  # runs are merged on the way
    rnd = random.Random(11)
    pool = [rnd.randbytes(32) for _ in range(120)]
    rows = family(rnd, 240, pool, pool[:6])
    hot = hashes(spark, pool[:6])
    found = set()
    for start in range(0, 240, 80):  # each batch opens the store anew
        store = x.SegmentStore(spark, hot if start == 0 else None, path=str(tmp_path / "store"))
        assert store.empty == (start == 0) and len(store.hot) == 6
        found |= ids(store.judge_records(as_batch(spark, rows[start : start + 80]), "n", "keys"))
    assert found == judge(rows)
    assert len(store.runs) < 3 and {r.id for r in store.sets().collect()} == {i for i, k in rows if any(k)} - found


def test_retries_and_late_records(spark, tmp_path):
    rnd = random.Random(12)
    pool = [rnd.randbytes(32) for _ in range(100)]
    rows = [(i + 1000, k) for i, k in family(rnd, 120, pool, pool[:4]) if k]
    store = x.SegmentStore(spark, path=str(tmp_path / "store"))
    first = ids(store.judge_records(as_batch(spark, rows), "n", "keys"))
    assert first == judge(rows)
    held, number = sorted(store.sets().collect()), store.number
    # The same batch again, in other order: the same answer, no new commit.
    assert ids(store.judge_records(as_batch(spark, rows[::-1]), "n", "keys")) == first and store.number == number
    # The same records inside a batch of another name: accepted ones stay accepted and are not stored twice.
    again = ids(store.judge_records(as_batch(spark, rows), "n", "keys", name="other"))
    assert again == first and sorted(store.sets().collect()) == held
    # Late records, with smaller ids, that copy accepted ones exactly or nearly are found in the index.
    accepted = [(i, k) for i, k in rows if i not in first and len(set(k) - {None}) > 8]
    late = [(j, k) for j, (i, k) in enumerate(accepted)] + [(500 + j, [*k, rnd.randbytes(32)]) for j, (i, k) in enumerate(accepted)]
    assert ids(store.judge_records(as_batch(spark, late), "n", "keys")) == {i for i, _ in late}
    assert sorted(store.sets().collect()) == held


def test_a_killed_append_loses_nothing(spark, tmp_path, monkeypatch):
    rnd = random.Random(13)
    pool = [rnd.randbytes(32) for _ in range(100)]
    rows = [(i, k) for i, k in family(rnd, 160, pool, pool[:4]) if k]
    path = str(tmp_path / "store")
    x.SegmentStore(spark, path=path).judge_records(as_batch(spark, rows[:80]), "n", "keys")
    store = x.SegmentStore(spark, path=path)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(store, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            store.judge_records(as_batch(spark, rows[80:]), "n", "keys")
    reopened = x.SegmentStore(spark, path=path)
    assert reopened.number == 1
    got = ids(reopened.judge_records(as_batch(spark, rows[80:]), "n", "keys"))
    assert got == {i for i in judge(rows) if i >= rows[80][0]}
    # Killed between the manifest and its mark: the next opening sets the mark.
    (tmp_path / "store" / "batches" / reopened.last).unlink()
    assert ids(x.SegmentStore(spark, path=path).judge_records(as_batch(spark, rows[80:]), "n", "keys")) == got
    # The store that missed a commit does not overwrite it.
    with pytest.raises(RuntimeError):
        store.judge_records(as_batch(spark, rows[:3]), "n", "keys", name="late writer")


def test_crowds_are_halved(spark, monkeypatch):
    monkeypatch.setattr(x, "LEAST_SPLIT", 20)
    monkeypatch.setattr(x, "CROWD", 2)
    rnd = random.Random(14)
    base = [rnd.randbytes(32) for _ in range(20)]
    rows = [(i, [*base, rnd.randbytes(32)] if i % 3 else [rnd.randbytes(32) for _ in range(9)]) for i in range(150)]
    assert ids(x.repeats(as_batch(spark, rows), "n", "keys")) == judge(rows)


def test_a_batch_reads_the_same_from_a_longer_history(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sorted_runs, "BUCKET_ROWS", 1024)
    rnd, read = random.Random(15), []
    batch = [(10**9 + i, [rnd.randbytes(32) for _ in range(6)]) for i in range(2)]
    for n in (2000, 16000):
        meter = spark.sparkContext.accumulator(0)
        store = x.SegmentStore(spark, path=str(tmp_path / str(n)), granule=2048, meter=meter)
        key = lambda j: F.unhex(F.sha2(F.concat_ws("-", "id", F.lit(j)), 256))
        store.judge_records(spark.range(n).select(F.col("id").alias("n"), F.array(*[key(j) for j in range(6)]).alias("keys")), "n", "keys", "history")
        before = meter.value
        assert before == 0
        assert ids(store.judge_records(as_batch(spark, batch), "n", "keys")) == set()
        read.append(meter.value)
    assert 0 < read[1] < 2 * read[0]


def test_empty_batches(spark, tmp_path):
    store = x.SegmentStore(spark, path=str(tmp_path / "store"))
    assert ids(store.judge_records(as_batch(spark, []), "n", "keys")) == set()
    assert ids(store.judge_records(as_batch(spark, [(1, None), (2, []), (3, [None])]), "n", "keys")) == set() and store.sets().count() == 0
