import pyarrow as pa

from depotlens.functions.arrow import slices


def test_slices_keep_rows_and_bound_bytes():
    texts = [None, "a" * 30, "b" * 5, "", "c" * 100, "d" * 7, "e" * 7, None, "f" * 12]
    b = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], names=["i", "t"])
    for kind in (pa.string(), pa.large_string(), pa.binary()):
        c = pa.RecordBatch.from_arrays([b.column("i"), b.column("t").cast(kind)], names=["i", "t"]).slice(1)
        got = list(slices(iter([c, c.slice(0, 0)]), "t", 20))
        assert [x for g in got for x in g.column("i").to_pylist()] == list(range(1, 9))
        assert all(g.num_rows == 1 or sum(len(x or "") for x in g.column("t").to_pylist()) <= 20 for g in got)
