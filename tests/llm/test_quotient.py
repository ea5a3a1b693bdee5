import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from depotlens.llm import quotient as q
from depotlens.operators import sorted_runs


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**20 - 1), max_size=300), st.lists(st.integers(0, 2**20 - 1), max_size=300))
def test_filter_holds_exactly_its_fingerprints(a, b):
    f = q.QuotientFilter.build(np.array(a, np.uint64), 20)
    assert f.fingerprints().tolist() == sorted(set(a))
    assert f.contains(np.array(a + b, np.uint64)).tolist() == [x in set(a) for x in a + b]
    g = q.QuotientFilter.from_bytes(f.merge(q.QuotientFilter.build(np.array(b, np.uint64), 20)).to_bytes())
    assert g.fingerprints().tolist() == sorted(set(a) | set(b)) and g.n == len(set(a) | set(b))


def test_filter_is_compact_and_its_rate_is_as_derived():
    rng = np.random.default_rng(1)
    p = q.QuotientFilter.quotient_bits(50_000) + q.REMAINDER_BITS
    f = q.QuotientFilter.build(rng.integers(0, 1 << p, 50_000, dtype=np.uint64), p)
    assert len(f.to_bytes()) * 8 < 50_000 * (q.REMAINDER_BITS + 3) * 8 / 3 + 200  # at least three eighths full
    other = rng.integers(0, 1 << p, 400_000, dtype=np.uint64)
    measured = f.contains(other).mean()
    assert measured == pytest.approx(f.wrong_rate(), rel=0.25)
    with pytest.raises(ValueError):
        f.merge(q.QuotientFilter.build(np.zeros(0, np.uint64), p + 1))


def judged(spark, rows, known=(), **options):
    df = spark.createDataFrame([(i, k, b"x", "s") for i, k in rows], "n bigint, sum binary, key binary, hash string")
    kn = spark.createDataFrame([(k, 1) for k in known], "key binary, arrival int")
    return q.all_answers(*q.seen_before(df, "sum", "n", kn, **options)).collect()


@pytest.mark.parametrize("r_bits", [1, 10])
def test_exact_answer_against_a_set(spark, r_bits, monkeypatch):
    rnd = random.Random(5)
    pool = [rnd.randbytes(32) for _ in range(300)]
    alike = [bytes(24) + bytes([i]) * 8 for i in range(50)] + [bytes([i]) * 8 + bytes(24) for i in range(50)]
    rows = []
    for i in range(4000):
        x = rnd.random()
        rows.append((i, pool[0] if x < 0.33 else rnd.choice(pool) if x < 0.6 else rnd.choice(alike) if x < 0.7 else None if x < 0.72 else b"" if x < 0.74 else rnd.randbytes(31) if x < 0.76 else rnd.randbytes(32)))
    known = [pool[5], alike[3], None, b"short", rnd.randbytes(32), pool[5]]
    rnd.shuffle(rows)
    got = judged(spark, rows, known, r_bits=r_bits)
    before = {k for k in known if k is not None and len(k) == 32}
    want = {}
    for i, k in sorted(rows):
        if k is not None and len(k) == 32:
            want[i] = k in before
            before.add(k)
    assert {r.arrival: r.seen for r in got} == want
    assert len(got) == len(want)
    assert all(r.maybe for r in got if r.seen)  # no false negatives
    wrong = sum(r.maybe and not r.seen for r in got)
    assert (wrong > 0) == (r_bits == 1)


def test_empty_tables(spark):
    assert judged(spark, [], [b"k" * 32]) == []
    assert [(r.arrival, r.seen) for r in judged(spark, [(7, b"k" * 32)])] == [(7, False)]
    rates = q.error_rates(q.all_answers(*q.seen_before(spark.createDataFrame([], "n bigint, k binary"), "k", "n"))).first()
    assert rates.requests == 0 and rates.measured_rate is None


def test_other_key_widths(spark):
    rows = [(1, b"abc"), (2, b"abd"), (3, b"abc")]
    assert {r.arrival: r.seen for r in judged(spark, rows, width=3)} == {1: False, 2: False, 3: True}


def test_filters_kept_between_batches(spark):
    a = spark.range(0, 3000).select(F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("k"))
    b = spark.range(2000, 6000).select(F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("k"))
    c = spark.range(5000, 9000).select(F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("k"))
    store = q.merge_filters(q.build_filters(a, "k", 4, 30), q.build_filters(b, "k", 4, 30))
    assert store.agg(F.sum("keys")).first()[0] == 6000
    answers = q.probe_filters(c, "k", store, 4)
    seen = {bytes(r.k) for r in b.collect()}
    wrong = [r for r in answers.collect() if r.maybe != (bytes(r.key) in seen)]
    assert answers.count() == 4000 and len(wrong) <= 5 and all(r.maybe for r in wrong)


def test_history_in_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(q, "COMBINE_ROWS", 50)
    monkeypatch.setattr(q, "BLOCK_ROWS", 64)
    rnd = random.Random(6)
    pool = [rnd.randbytes(32) for _ in range(150)]
    rows = [(i, pool[0] if rnd.random() < 0.33 else rnd.choice(pool) if rnd.random() < 0.5 else rnd.randbytes(32)) for i in range(1200)]
    seen = set()
    for start in range(0, 1200, 400):  # each batch opens the history anew
        history = q.KeyHistory(spark, 3, 24, str(tmp_path / "h"))
        if start == 0:
            history.add(spark.createDataFrame([(pool[1],), (None,), (pool[1],), (b"short",)], "key binary"))
        batch = spark.createDataFrame(rows[start : start + 400], "n bigint, k binary")
        answers, again = history.judge(batch, "k", "n")
        got = {r.arrival: (r.maybe, r.seen) for r in q.all_answers(answers, again).collect()}
        assert len(got) == 400 and all(m for m, s in got.values() if s)
        seen |= {i for i, (_, s) in got.items() if s}
    before, want = {pool[1]}, set()
    for i, k in rows:
        want |= {i} if k in before else set()
        before.add(k)
    assert seen == want
    assert history.filters().agg(F.sum("keys")).first()[0] <= len(before)
    assert sorted_runs.read_runs(spark, history.runs, q.KeyHistory._RUN).count() == len(before)
