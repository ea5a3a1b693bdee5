import hashlib

from pyspark.sql import functions as F

from depotlens.operators import bloom


def test_dimensions():
    bits, probes = bloom.dimensions(65_536)
    assert 14 < bits / 65_536 < 15 and probes == 10
    assert bloom.dimensions(0)[0] >= 64


def test_members_pass_and_few_strangers_do(spark):
    digest = lambda i: hashlib.sha256(str(i).encode()).digest()
    stored = spark.createDataFrame([(digest(i),) for i in range(3000)] + [(None,), (b"short",), (digest(1),)], "d binary")
    asked = spark.createDataFrame([(digest(i),) for i in range(2000, 12000)] + [(None,)], "d binary")
    bucket = F.substring(F.hex("d"), 1, 1)
    filters = bloom.build(stored, bucket, "d", 256)
    assert filters.count() == 16 and filters.agg(F.sum("entries")).first()[0] == 3001
    got = {bytes(r.digest): r.maybe for r in bloom.might_contain(asked, bucket, "d", filters, 256).collect()}
    assert len(got) == 10_000 and all(got[digest(i)] for i in range(2000, 3000))
    assert sum(got[digest(i)] for i in range(3000, 12000)) < 30
    assert not any(r.maybe for r in bloom.might_contain(asked, bucket, "d", filters.limit(0), 256).collect())
