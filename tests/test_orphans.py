import datetime
import random

from depotlens.operators import orphans as o


def at(n):
    return None if n is None else datetime.datetime(2025, 1, 1) + datetime.timedelta(days=n)


def test_direct_against_brute_force(spark):
    rnd = random.Random(3)
    refs = [(i, rnd.choice(["s", "t", None]), rnd.randrange(6), rnd.choice([*range(40), None])) for i in range(400)]
    targets = [(rnd.choice(["s", "t"]), rnd.randrange(6), rnd.randrange(30), rnd.choice([None, *range(10, 40)])) for _ in range(12)]
    targets += targets[:3]
    r = spark.createDataFrame([(i, s, k, at(t), "x") for i, s, k, t in refs], "id int, store string, k int, at timestamp, since string")
    t = spark.createDataFrame([(s, k, at(a), at(b), 1) for s, k, a, b in targets], "store string, k int, since timestamp, until timestamp, id int")
    got = sorted(x.id for x in o.direct_orphans(r, t, ["store", "k"]).collect())
    alive = lambda s, k, n: n is not None and any(ts == s and tk == k and a <= n and (b is None or n < b) for ts, tk, a, b in targets)
    assert got == [i for i, s, k, n in refs if not alive(s, k, n)]


def test_boundaries_and_empty_tables(spark):
    schema = "k int, since timestamp, until timestamp"
    refs = spark.createDataFrame([(1, at(5)), (1, at(9)), (1, at(4)), (None, at(5))], "k int, at timestamp")
    one = spark.createDataFrame([(1, at(5), at(9))], schema)
    assert sorted(str(r) for r in o.direct_orphans(refs, one, ["k"]).collect()) == sorted(str(r) for r in refs.where("k is null or at <> timestamp'2025-01-06'").collect())
    assert o.direct_orphans(refs, one.limit(0), ["k"]).count() == 4
    assert o.direct_orphans(refs.limit(0), one, ["k"]).count() == 0


def test_digest_spelling(spark):
    df = spark.createDataFrame([("\tAB \n",), ("ab",), ("  ",), (None,), (" Ab ",)], "d string")
    assert [r[0] for r in df.select(o.same_digest("d")).collect()] == ["ab", "ab", None, None, "ab"]


def test_cascade_depths_chains_and_cycles(spark):
    parents = {str(i): str(i - 1) for i in range(1, 40)} | {"0": "gone", "a": "b", "b": "c", "c": "a", "free": None}
    release = spark.createDataFrame([(k, v, k) for k, v in parents.items()] + [("7", "6", "7")], "record_id string, base string, own string")
    files = spark.createDataFrame([(f"f{i}", str(i)) for i in range(0, 60, 10)] + [("fa", "a"), ("fn", None)], "record_id string, release string")
    keys = [o.ForeignKey("release", "base", "release", "own"), o.ForeignKey("file", "release", "release", "own")]
    seeds = spark.createDataFrame([("release", "0"), ("release", "0"), ("release", None), ("release", "20")], "table_name string, record_id string")
    got = {(r.table_name, r.record_id): (r.orphan_kind, r.depth) for r in o.cascade(spark, {"release": release, "file": files}, keys, seeds).collect()}
    want = {("release", str(i)): ("direct" if i in (0, 20) else "inherited", i % 20) for i in range(40)}
    want |= {("file", f"f{i}"): ("inherited", i % 20 + 1) for i in range(0, 40, 10)}
    assert got == want
    ring = spark.createDataFrame([("release", "a")], "table_name string, record_id string")
    got = {(r.table_name, r.record_id): r.depth for r in o.cascade(spark, {"release": release, "file": files}, keys, ring).collect()}
    assert got == {("release", "a"): 0, ("release", "c"): 1, ("release", "b"): 2, ("file", "fa"): 1}
    assert o.cascade(spark, {"release": release, "file": files}, keys, seeds.limit(0)).count() == 0


def test_months_are_in_utc(spark):
    df = spark.createDataFrame([("2025-02-28T23:30:00Z",), ("2025-03-01T00:30:00Z",)], "t string").selectExpr("cast(t as timestamp) t")
    for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert [r[0] for r in df.select(o.month("t")).collect()] == ["2025-02", "2025-03"]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_what_hangs_on_the_orphans_of_the_depot(spark):
    # Release r1 has a file with a missing chunk, r2 and r3 are built on it, r4 is whole; tag 7 has a file with a lost digest.
    chunk = [(0, b"gone")]
    files = [(1, "r1", None, chunk), (2, "r1", None, None), (3, "r2", "r1", None), (4, "r3", "r2", [(0, b"kept")]), (5, "r4", "r0", None), (6, None, "r1", chunk)]
    delta = spark.createDataFrame([(i, "s", b, r, at(i), c) for i, r, b, c in files], "delta_file_id long, chunk_store_id string, base_release_id string, target_release_id string, created_at timestamp, chunks array<struct<chunk_index int, checksum binary>>")
    lengths = spark.createDataFrame([(1, "s", b"gone", at(40)), (2, "s", b"kept", at(40))], "entry_id long, chunk_store_id string, checksum binary, collected_at timestamp")
    chunks = spark.createDataFrame([("s", b"kept", at(0), None)], "chunk_store_id string, checksum binary, created_at timestamp, deleted_at timestamp")
    tags = spark.createDataFrame([(1, 7, "aa", at(1)), (2, 7, "bb", at(2)), (3, 8, "bb", at(2)), (4, None, "aa", at(2))], "id long, tag_id long, file_hash_hex string, scanned_at timestamp")
    cache = spark.createDataFrame([("BB", at(0), None)], "file_hash_hex string, first_seen_at timestamp, evicted_at timestamp")
    found = o.depot_orphans(delta, lengths, chunks, tags, cache)
    assert sorted(map(tuple, found.select("table_name", "record_id", "orphan_kind", "depth").collect())) == [
        ("checksum_length", "1", "direct", 0), ("delta_file", "1", "direct", 0), ("delta_file", "6", "direct", 0), ("release", "r1", "inherited", 1), ("release", "r2", "inherited", 2), ("release", "r3", "inherited", 3),
        ("svn_tag", "7", "inherited", 1), ("svn_tag_file", "1", "direct", 0), ("svn_tag_file", "4", "direct", 0),
    ]
    when = {(r.table_name, r.record_id): r.at for r in o.dated(found, delta, tags).collect()}
    assert when["release", "r1"] == at(1) and when["svn_tag", "7"] == at(1) and when["checksum_length", "1"] == at(40)
    assert o.depot_orphans(delta.limit(0), lengths.limit(0), chunks, tags.limit(0), cache).count() == 0
