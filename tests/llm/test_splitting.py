import random

import pytest
from pyspark.sql import functions as F

from depotlens.llm import splitting as s

LIMITS = [("FileSystemFile", 100, 10), ("ContainerEntry", 60, 0), ("Document", 80, 8), ("SvnFile", 200, 16)]


def pieces(spark, items=(), tags=(), docs=(), cache=(), limits=LIMITS):
    i = spark.createDataFrame([(n, k, ln, m, d, "x") for n, k, ln, m, d in items], "item_id bigint, kind string, length bigint, chunk_map array<struct<byte_offset:bigint,length:int,checksum:binary>>, doc_id bigint, size string")
    t = spark.createDataFrame([(n, z, k, 1) for n, z, k in tags], "id bigint, file_size bigint, candidate_key string, content int")
    d = spark.createDataFrame(list(docs), "doc_id bigint, text string")
    c = spark.createDataFrame(list(cache), "candidate_key string, chunk_map array<struct<checksum:string,byte_offset:bigint,length:int>>")
    lim = spark.createDataFrame(list(limits), "item_kind string, limit_bytes bigint, overlap_bytes bigint")
    out = {}
    for r in s.depot_pieces(i, t, d, c, lim).collect():
        out.setdefault((r.item_table, r.item_id), []).append((r.piece_no, r.byte_start, r.byte_end, r.natural))
    return {k: sorted(v) for k, v in out.items()}


def check(cuts, size, limit, overlap):
    assert [p[0] for p in cuts] == list(range(len(cuts)))
    assert cuts[0][1] == 0 and cuts[-1][2] == size
    assert all(0 < z - a <= limit for _, a, z, _ in cuts)
    assert all(q[1] == p[2] - overlap >= 0 and q[2] > p[2] for p, q in zip(cuts, cuts[1:]))


def greedy(bounds, size, limit, overlap):
    """Ends of the pieces by walking: the farthest boundary in reach, else as far as a piece goes."""
    ends, e, far = [], 0, limit
    while e < size:
        reach = min(size, e + far)
        inside = [b for b in [*bounds, size] if max(e, overlap) < b <= reach]  # neighbours share a whole overlap
        e = max(inside) if inside else reach
        ends.append(e)
        far = limit - overlap
    return ends


def test_maps_against_walking(spark):
    rnd = random.Random(2)
    items, want = [], {}
    for n in range(60):
        at, m = 0, []
        for _ in range(rnd.randrange(1, 40)):
            step = rnd.choice([3, 20, 50, 90, 250])
            m.append((at, step, None))
            at += step
        real = list(m)
        if rnd.random() < 0.5:
            m.append(m[0])
            rnd.shuffle(m)
        kind, limit, overlap = LIMITS[n % 2]
        items.append((n, kind, rnd.choice([None, -1, 5]), m, None))
        if at > limit:
            want["input_item", n] = (greedy([o + x for o, x, _ in real][:-1], at, limit, overlap), at, limit, overlap)
    got = pieces(spark, items)
    assert got.keys() == want.keys()
    for k, (ends, size, limit, overlap) in want.items():
        check(got[k], size, limit, overlap)
        assert [p[2] for p in got[k]] == ends


def test_sizes_and_no_cases(spark):
    items = [
        (1, "FileSystemFile", 101, None, None), (2, "FileSystemFile", 100, [], None), (3, "FileSystemFile", None, None, None), (4, "FileSystemFile", -5, [], None), (5, "Unknown", 10**6, None, None),
        (6, "ContainerEntry", 7, [(0, 61, None)], None), (7, "FileSystemFile", 10**6, [(0, 50, None)], None), (8, "FileSystemFile", 10**6, None, 404), (9, None, 10**6, None, None), (10, "FileSystemFile", 10**6, None, 2),
    ]
    tags = [(1, 201, None), (2, 0, "500:1:p"), (3, -1, "12:1:p"), (4, None, "x"), (5, None, None), (6, 200, "9999:1:p"), (7, None, "99999999999999999999:1:p")]
    got = pieces(spark, items, tags, docs=[(2, None), (3, "a" * 500)])
    assert set(got) == {("input_item", 1), ("input_item", 6), ("svn_tag_file", 1), ("svn_tag_file", 2)}
    check(got["svn_tag_file", 2], 500, 200, 16)
    assert pieces(spark) == {}


def test_tag_files_use_the_cached_map(spark):
    cache = [("450:1:a", [(None, 0, 150), (None, 150, 150)]), ("450:1:a", [(None, 0, 40)]), ("450:1:a", None)]
    got = pieces(spark, tags=[(1, 450, "450:1:a"), (2, 450, "450:1:a")], cache=cache)
    assert [p[1:] for p in got["svn_tag_file", 1]] == [(0, 150, True), (134, 300, True), (284, 450, True)] == [p[1:] for p in got["svn_tag_file", 2]]


def test_texts_are_cut_after_sentences_and_never_inside_characters(spark):
    texts = [
        "A short sentence here. " * 20, "no stops at all " * 30, "ä" * 300, "漢字" * 100, "line one\nline two\r\nline three\r\n\r\n" * 12, "終わりました。" * 30, "", None, "x" * 80, "\U0001f600" * 50, "Ende! „Ja.“ Und weiter? " * 9,
    ]
    docs = list(enumerate(texts))
    got = pieces(spark, [(100 + i, "FileSystemFile", 1, None, i) for i, _ in docs], docs=docs)
    assert {k[1] - 100 for k in got} == {i for i, t in docs if t and len(t.encode()) > 80}
    for (_, item), cuts in got.items():
        raw = texts[item - 100].encode()
        check(cuts, len(raw), 80, 8)
        for _, _, z, natural in cuts:
            assert z == len(raw) or raw[z] & 0xC0 != 0x80
        if item == 100:
            assert all(n for *_, n in cuts) and all(raw[:z].endswith(b". ") for _, _, z, _ in cuts)


def test_segments_of_huge_items(spark, monkeypatch):
    monkeypatch.setattr(s, "SEGMENT_REACHES", 3)
    rnd = random.Random(4)
    at, m = 0, []
    while at < 30_000:
        step = rnd.choice([5, 30, 70, 130])
        m.append((at, step, None))
        at += step
    got = pieces(spark, [(1, "FileSystemFile", None, m, None)])["input_item", 1]
    assert [p[2] for p in got] == greedy([o + n for o, n, _ in m][:-1], at, 100, 10)


def test_overlap_that_leaves_no_room(spark):
    with pytest.raises(ValueError):
        pieces(spark, limits=[("Document", 10, 10)])


def test_letters_that_share_bytes_with_the_ellipsis_end_no_sentence(spark):
    # The last byte of U+0440 and U+00C0 is 80, that of U+0446 is A6: both are bytes of the ellipsis.
    words = ["мир", "отец", "CIELÀ", "двор"]
    text = " ".join(words * 3) + ". " + " ".join(words * 2) + "… " + " ".join(words * 2) + "\n" + " ".join(words * 6)
    raw = text.encode()
    real = [raw.index(m.encode()) + len(m.encode()) for m in (". ", "… ", "\n")]
    assert [p for p in s.text_boundaries(raw, len(raw), len(raw)) if p >= 0] == real
    got = pieces(spark, [(1, "FileSystemFile", 1, None, 1)], docs=[(1, text)], limits=[("Document", 120, 8)])["input_item", 1]
    check(got, len(raw), 120, 8)
    assert [z for _, _, z, natural in got if natural] == [*real, len(raw)]


def test_entries_behind_a_gap_are_cut_at_their_start(spark):
    m = [(0, 40, None), (90, 30, None), (90, None, None), (None, 5, None), (300, 60, None)]  # nothing from 40 to 90 and from 120 to 300
    got = pieces(spark, [(1, "FileSystemFile", None, m, None)])["input_item", 1]
    check(got, 360, 100, 10)
    assert [(z, natural) for _, _, z, natural in got] == [(90, True), (120, True), (210, False), (300, True), (360, True)]
