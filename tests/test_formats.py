import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from depotlens.functions import chunking as c
from depotlens.functions import codecs as k


@given(st.data())
def test_varints_come_back(data):
    kind = data.draw(st.sampled_from(list(k.KINDS)))
    bits, signed = k.KINDS[kind]
    v = data.draw(st.integers(-(1 << bits - 1), (1 << bits - 1) - 1) if signed else st.integers(0, (1 << bits) - 1))
    cur = k.Cursor(k.write_varint(v, kind))
    assert cur.varint(kind) == v and not cur


@pytest.mark.parametrize("kind", list(k.KINDS))
def test_varint_errors(kind):
    with pytest.raises(k.FormatError):
        k.Cursor(b"\x80").varint(kind)
    with pytest.raises(k.FormatError):
        k.Cursor(b"\xff" * 11).varint(kind)
    with pytest.raises(OverflowError):
        k.write_varint(1 << 64, kind)


@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 64)), max_size=20))
def test_bits_come_back(pairs):
    widths = [w for _, w in pairs]
    data = k.write_bits([v for v, _ in pairs], widths)
    assert k.read_bits(data, widths) == [v & (1 << w) - 1 for v, w in pairs]


@given(st.lists(st.binary(min_size=32, max_size=32), max_size=40))
def test_hash_lists_keep_order(hashes):
    assert k.decode_hashes(k.encode_hashes(hashes)) == hashes
    assert k.decode_record(k.encode_record(bytes(32), 5, hashes)) == (bytes(32), 5, hashes)


@pytest.mark.parametrize("size", [0, 16, 31, 33])
def test_hash_of_wrong_size(size):
    with pytest.raises(k.FormatError):
        k.encode_hashes([bytes(size)])


def test_broken_records():
    good = k.encode_record(bytes(32), 1, [bytes(32)])
    for bad in (good[:20], b"XXXX" + good[4:], good[:4] + b"\x09" + good[5:], good[:45] + b"\x07" + good[46:]):
        with pytest.raises(k.FormatError):
            k.decode_record(bad)


def test_packs():
    parts = [b"abc", b"", os.urandom(5000)]
    pack = b"".join(map(k.encode_pack_entry, parts))
    assert [x[2] for x in k.scan_pack(pack)] == parts
    assert k.pack_lengths(pack) == [3, 0, 5000]
    at = list(k.scan_pack(pack))[2][0]
    assert k.read_pack_entry(pack, at) == parts[2]
    broken = pack[:-1] + bytes([pack[-1] ^ 1])
    with pytest.raises(k.FormatError):
        list(k.scan_pack(broken))
    with pytest.raises(k.FormatError):
        list(k.scan_pack(pack[:-10]))


def test_log_tail_is_tolerated():
    rows = [(bytes([i]) * 32, i, i * 100, 7) for i in range(5)]
    assert k.scan_log(k.encode_log(rows) + b"cut") == rows


def test_nodes_are_canonical():
    a = k.encode_node(1, [(1, "utf8", "x"), (3, "map", {"b": "2", "a": "1"}), (4, "hash32", bytes(32))])
    assert a == k.encode_node(1, [(1, "utf8", "x"), (3, "map", {"a": "1", "b": "2"}), (4, "hash32", bytes(32))])
    with pytest.raises(k.FormatError):
        k.encode_node(1, [(2, "uvarint", 1), (2, "uvarint", 1)])


@pytest.mark.parametrize("compress", [True, False])
def test_packages_come_back(compress):
    h = [bytes([i]) * 32 for i in range(5)]
    p = k.Package("1.0", "r", "q", "", 1748779200, {"url": "http:///x", "": ""}, [
        k.Artifact("component/file.bin", content_hash=h[0], length=1024), k.Artifact("b/z.zip", format_id="zip", reconstruction=1, recipe=b"{}", members=[("inner/x.dll", h[1], 9), ("a//b", h[0], 3)]),
        k.Artifact("a", 1, True, h[2], 0), k.Artifact("b/y.zip", format_id="zip", recipe=b"", members=[]),
    ])
    q = k.decode_package(k.encode_package(p, compress))
    assert sorted(map(repr, q.artifacts)) == sorted(map(repr, p.artifacts))
    assert (q.version, q.release_id, q.repo_id, q.notes, q.created_at, q.properties) == (p.version, p.release_id, p.repo_id, p.notes, p.created_at, p.properties)
    with pytest.raises(k.FormatError):
        k.decode_package(b"NOPE" + k.encode_package(p)[4:])
    with pytest.raises(k.FormatError):
        k.decode_package(k.encode_package(p)[:4] + b"\x63" + k.encode_package(p)[5:])


def test_settings():
    assert k.unflatten({"a": "1", "a:b": "2", "a:b:c": "3", "d": "4"}) == {"a": {"b": {"c": "3"}}, "d": "4"}
    assert k.flatten({"a": {"b": [1, None, True]}}, "s") == {"s:a:b:0": "1", "s:a:b:1": "", "s:a:b:2": "true"}


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=6000), st.sampled_from([(16, 40, 100), (64, 256, 2048), (5, 64, 80)]))
def test_chunks_follow_the_definition(data, sizes):
    ends = c.cut_points(data, *sizes)
    assert ends == c.cut_points_stepwise(data, *sizes)
    assert (ends[-1] if ends else 0) == len(data) and ends == sorted(set(ends))
    lengths = [b - a for a, b in zip([0, *ends], ends)]
    assert all(sizes[0] <= n <= sizes[2] for n in lengths[:-1])


def test_chunk_sizes_near_target_and_local_edits():
    import random

    data = random.Random(999).randbytes(8 << 20)
    ends = c.cut_points(data, 8192, 32768, 262144)
    assert 0.5 < len(data) / len(ends) / 32768 < 1.5
    edited = data[: 4 << 20] + b"\xaa" * 20 + data[4 << 20 :]
    pieces = lambda d: {d[a:b] for e in [c.cut_points(d, 8192, 32768, 262144)] for a, b in zip([0, *e], e)}
    assert len(pieces(data) & pieces(edited)) > 0.4 * len(ends)


def test_bad_sizes():
    for s in [(0, 1, 2), (5, 5, 9), (5, 9, 9)]:
        with pytest.raises(ValueError):
            c.cut_points(b"x", *s)
