import datetime
import random

import pytest

from depotlens.operators import snapshot_diff as s

SCHEMA = "delta_file_id bigint, base_release_id string, target_release_id string, path string, new_hash binary, delivered_at timestamp, extra string, side string"


def at(n):
    return None if n is None else datetime.datetime(2025, 1, 1) + datetime.timedelta(minutes=n)


def changes(spark, rows, partitions=None):
    df = spark.createDataFrame([(i, b, t, p, h, at(d), "x", "clash") for i, (b, t, p, h, d) in enumerate(rows)], SCHEMA)
    return sorted(map(tuple, s.release_changes(df, partitions).collect()))


def test_kinds_spellings_and_superseded_rows(spark):
    rows = [
        (None, "a", "x\\y", b"1", 1), (None, "a", "./gone", b"2", 1), (None, "a", "same", b"3", 1), (None, "a", "Case", b"4", 1),
        ("a", "b", "x/y", b"9", 1), (None, "b", "./same", b"3", 2), ("a", "b", "case", b"4", 1), ("a", "b", "new", b"5", 3), ("a", "b", "new", b"6", None),
        ("a", "b", "././odd", b"7", 1), ("missing", "c", "x", b"1", 1), ("b", "d", "same", None, 1), ("b", "d", "same", b"3", 0),
    ]
    got = changes(spark, rows)
    assert got == sorted([
        ("a", "b", "x/y", "changed"), ("a", "b", "gone", "removed"), ("a", "b", "Case", "removed"), ("a", "b", "case", "added"), ("a", "b", "new", "added"), ("a", "b", "./odd", "added"),
        ("b", "d", "same", "changed"), ("b", "d", "x/y", "removed"), ("b", "d", "case", "removed"), ("b", "d", "new", "removed"), ("b", "d", "./odd", "removed"),
    ])


def test_empty_and_null(spark):
    assert changes(spark, []) == []
    assert changes(spark, [(None, None, None, None, None), ("a", None, "p", b"1", 1), (None, "a", None, b"1", 1)]) == []


def test_ties_take_the_larger_id(spark):
    rows = [(None, "a", "p", b"1", 1), ("a", "b", "p", b"2", 5), ("a", "b", "p", b"1", 5)]
    assert changes(spark, rows) == []


def test_against_dictionaries(spark):
    rnd = random.Random(7)
    rows, lists, base = [], {}, {}
    for r in range(12):
        name, b = f"r{r}", f"r{rnd.randrange(r)}" if r and rnd.random() < 0.8 else None
        base[name] = b
        for _ in range(rnd.randrange(1, 400)):
            p, h, d = f"p{rnd.randrange(150)}", bytes([rnd.randrange(3)]), rnd.randrange(50)
            rows.append((b if rnd.random() < 0.7 else None, name, p, h, d))
    real = {}
    for i, (b, t, p, h, d) in enumerate(rows):
        if b:
            real[t] = b
        old = lists.setdefault(t, {}).get(p)
        if old is None or (d, i) > old[:2]:
            lists[t][p] = (d, i, h)
    want = []
    for t, b in real.items():
        for p in lists[t].keys() | lists[b].keys():
            o, n = lists[b].get(p), lists[t].get(p)
            kind = "added" if o is None else "removed" if n is None else "changed" if o[2] != n[2] else None
            if kind:
                want.append((b, t, p, kind))
    assert changes(spark, rows, 5) == sorted(want)


@pytest.mark.parametrize("small, named", [(0, 0), (1000, 0), (0, 1000), (1000, 1000)])
def test_every_plan_gives_the_same(spark, monkeypatch, small, named):
    """The release graph broadcast or joined, releases named in the scan's filter or joined."""
    monkeypatch.setattr(s, "SMALL_GRAPH", small)
    monkeypatch.setattr(s, "NAMED_RELEASES", named)
    test_kinds_spellings_and_superseded_rows(spark)


def test_kept_lists_and_later_releases(spark, tmp_path):
    def rows(*lists):
        return spark.createDataFrame([(i, b, t, p, h, at(d), "x", "y") for i, b, t, p, h, d in lists], SCHEMA)

    path = str(tmp_path / "store")
    store = s.SnapshotStore(spark, path)
    store.add(rows((1, None, "a", "p", b"1", 1), (2, None, "a", "q", b"1", 1), (3, "a", "b", "p", b"2", 1), (4, "z", "zz", "p", b"2", 1)), "first")
    assert sorted(map(tuple, store.changes("first").collect())) == [("a", "b", "p", "changed"), ("a", "b", "q", "removed")]
    for f in (tmp_path / "store" / "lists" / "first").glob("*.parquet"):
        keys = [(r.release, r.path) for r in spark.read.parquet(str(f)).collect()]
        assert keys == sorted(keys)
    # A new release is compared with its base only; its scan names the two lists.
    store = s.SnapshotStore(spark, path)
    store.add(rows((5, "b", "c", "p", b"2", 2), (6, "b", "c", "r", b"1", 2)), "second")
    assert sorted(map(tuple, store.changes("second").collect())) == [("b", "c", "r", "added")]
    plan = store.rows("second")._jdf.queryExecution().executedPlan().toString()
    assert "In(release, [b,c])" in plan or "In(release, [c,b])" in plan
    # Late rows of a base supersede older ones, and the comparisons with it are made again.
    again = [("a", "b", "p", "changed"), ("a", "b", "q", "removed"), ("b", "c", "p", "changed"), ("b", "c", "r", "added")]
    store.add(rows((7, None, "b", "p", b"9", 9)), "late")
    assert sorted(map(tuple, store.changes("late").collect())) == again
    store.add(rows((8, None, "b", "p", b"0", 99)), "late")  # a batch is kept once
    assert sorted(map(tuple, store.changes("late").collect())) == again


def test_a_path_delivered_over_and_over(spark):
    rows = [(None, "a", "hot", b"1", 1)] * 500 + [("a", "b", "hot", bytes([i % 7]), i) for i in range(3000)] + [("a", "b", "x", b"2", 1)]
    assert changes(spark, rows) == [("a", "b", "hot", "changed"), ("a", "b", "x", "added")]
