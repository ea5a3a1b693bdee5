import random
import textwrap

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import paragraphs
from depotlens.llm import encoding as e
from depotlens.llm import mixing as m
from depotlens.llm import quality as q

ENCODE = e.encoder(e.default_tokenizer()).encode_ordinary
ALPHABET = list("abc 's1\n\t .é漢。　 \U0001f600<|>\r-_")


def by_chunks(text):
    import numpy as np

    raw = text.encode()
    ends, kinds = e._cuts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
    cut = [0, *ends]
    parts = [raw[a:z].decode() for a, z in zip(cut, cut[1:])]
    out = []
    for (head, tail, put), p in zip(e.repair(parts, kinds, ENCODE), parts):
        out += put
        if head >= 0:
            ids = ENCODE(p)
            out += ids[head : len(ids) - tail]
    return out


def joined(parts, safe):
    out = []
    for (head, tail, put), p in zip(e.repair(parts, safe, ENCODE), parts):
        out += put
        if head >= 0:
            ids = ENCODE(p)
            out += ids[head : len(ids) - tail]
    return out


def test_no_task_gets_all_copies_of_a_hot_chunk(spark):
    """A chunk that holds a third of the pieces: no task has twice the rows of the median task, and the ids are exact."""
    rnd = random.Random(2)
    hot = "the hot paragraph of every page. " * 8
    rows = [(i, hot if i % 3 == 0 else " ".join(str(rnd.random()) for _ in range(14))) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(12)
    met = e._meeting(docs, e.default_tokenizer())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = sorted(r[1] for r in met.groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
    sample = {r.doc_id: r.ids for r in e.encode_corpus(docs).where("doc_id % 500 < 2").collect()}
    assert all(sample[i] == ENCODE(t) for i, t in rows if i % 500 < 2)
    r = e.reuse(docs).first()
    assert r.chunks > r.distinct_chunks and r.chunk_bytes == sum(len(t) for _, t in rows) and r.distinct_bytes <= r.distinct_text_bytes


def test_wide_vocabularies(spark, monkeypatch):
    """Ids above 65,535 travel as four bytes."""
    import numpy as np

    assert e._kind(e.default_tokenizer()) == np.dtype("<u2")
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1, 2]), pa.array([0, 1, 0]), pa.array([e._pack([70_000, 1], np.dtype("<u4")), e._pack([2], np.dtype("<u4")), b""])], names=["doc_id", "no", "ids"])
    monkeypatch.setattr(e, "_kind", lambda path: np.dtype("<u4"))
    assert [b.to_pylist() for b in e._assemble("any")([batch])] == [[{"doc_id": 1, "ids": [70_000, 1, 2]}], [{"doc_id": 2, "ids": []}]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(ALPHABET), st.integers(1, 9)), min_size=1, max_size=25))
def test_repaired_joins_agree_with_the_whole(runs):
    text = "".join(c * n for c, n in runs)
    old = e.MIN_BYTES, e.MAX_BYTES, e.SAFE_ONE_IN, e.ANY_ONE_IN
    e.MIN_BYTES, e.MAX_BYTES, e.SAFE_ONE_IN, e.ANY_ONE_IN = 2, 12, 2, 4
    try:
        assert by_chunks(text) == ENCODE(text)
    finally:
        e.MIN_BYTES, e.MAX_BYTES, e.SAFE_ONE_IN, e.ANY_ONE_IN = old


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"a '.é1revl\n", "'re", "'ve", "'ll", " we'"]), min_size=1, max_size=14), st.data())
def test_repaired_joins_at_contractions(runs, data):
    text = "".join(runs)
    cuts = sorted(data.draw(st.sets(st.integers(1, len(text)), max_size=6)) - {len(text)})
    parts = [text[a:z] for a, z in zip([0, *cuts], [*cuts, len(text)])]
    assert joined(parts, [False] * len(cuts) + [True]) == ENCODE(text)


@pytest.mark.parametrize("text", ["so we're are", "we've vexed", "they'll lull", "'re", "x''re", "'rest 'velvet 'llama"])
def test_cuts_inside_contractions(text):
    for a in range(1, len(text)):
        for b in range(a, len(text)):
            parts = [p for p in (text[:a], text[a:b], text[b:]) if p]
            assert joined(parts, [False] * (len(parts) - 1) + [True]) == ENCODE(text), parts


def test_corpus_ids(spark):
    rnd = random.Random(1)
    long = " ".join(rnd.choice(["alpha", "beta", "gamma,", "δελτα", "it's", "42"]) for _ in range(9000))
    texts = [None, "", " ", "a", long, long, long[100:], "x" * 20_000, "漢字かな" * 3000, "<|endoftext|> is text", "\r\n\n \t ", "é" * 5000 + " " * 700 + "\n" * 300 + "end"]
    df = spark.createDataFrame([(i, t, "y", b"z") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string, content binary")
    got = {r.doc_id: r.ids for r in e.encode_corpus(df).collect()}
    assert got == {i: ENCODE(t or "") for i, t in enumerate(texts)}
    assert e.encode_corpus(df.limit(0)).count() == 0
    assert e.encode_corpus(df).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]


# ---- mixing


def test_plan_fills_as_far_as_repeats_allow():
    plan = m.plan_blocks({"a": 10_000, "b": 100, "c": 10_000}, {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 1), "d": (0.1, 9)}, 10_000, 10)
    assert plan["b"] == 20 and plan["d"] == 0 and plan["a"] + plan["b"] + plan["c"] == 1000
    assert plan["a"] / plan["c"] == pytest.approx(2.5, rel=0.01)
    assert m.plan_blocks({}, {"a": (1.0, 1)}, 100, 10) == {"a": 0}
    assert m.plan_blocks({"a": 100}, {}, 100, 10) == {}
    assert sum(m.plan_blocks({"a": 35, "b": 38}, {"a": (0.5, 1), "b": (0.5, 1)}, 10_000, 10).values()) == 6


def test_schedule_is_even_everywhere(spark):
    plan = {"a": 500, "b": 300, "c": 7, "none": 0}
    rows = sorted(map(tuple, m.schedule(spark, plan).collect()))
    assert [r[0] for r in rows] == list(range(807))
    seen = {s: 0 for s in plan}
    for slot, s, block in rows:
        assert block == seen[s]
        seen[s] += 1
        for k, n in seen.items():
            assert abs(n - plan[k] * (slot + 1) / 807) < 8
    assert m.schedule(spark, {"a": 0}).count() == 0


def test_mixture_of_texts(spark, monkeypatch):
    monkeypatch.setattr(m, "BUCKET_ROWS", 7)
    rnd = random.Random(3)
    docs = [(i, rnd.choice([" A", "a", "A "]), "word " * rnd.randrange(1, 60), 1) for i in range(60)]
    docs += [(100 + i, "b", "tiny text", 1) for i in range(3)] + [(200, "b", None, 1), (201, "b", "", 1), (202, None, "lost", 1), (203, "unnamed", "lost too", 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string, slot int")
    targets = spark.createDataFrame([("A", 0.6, 2, 0), ("b", 0.3, 2, 0), ("absent", 0.1, 5, 0)], "source string, target_share double, max_repeats int, begin int")
    mix = m.Mixture(df, targets, block=4)
    rows = mix.pieces().collect()
    filled, uses = {}, {}
    for r in rows:
        filled[r.slot] = filled.get(r.slot, 0) + r.token_to - r.token_from
        for t in range(r.token_from, r.token_to):
            uses[r.doc_id, t] = uses.get((r.doc_id, t), 0) + 1
    assert set(filled.values()) == {4} and sorted(filled) == list(range(sum(mix.plan.values())))
    assert max(uses.values()) <= 2 and not {200, 201, 202, 203} & {d for d, _ in uses}
    shares = {r.source: r for r in mix.shares().collect()}
    assert shares["b"].tokens == mix.plan["b"] * 4 and shares["absent"].tokens == 0 and shares["absent"].limited
    assert sum(r.actual_share for r in shares.values()) == pytest.approx(1.0)
    assert shares["b"].repeats == 2 and shares["a"].repeats <= 2
    again = m.Mixture(df, targets, block=4)
    assert sorted(map(tuple, again.pieces().collect())) == sorted(map(tuple, rows))
    assert m.Mixture(df.limit(0), targets).pieces().count() == 0 and m.Mixture(df, targets.limit(0)).shares().count() == 0


# ---- quality

PROSE = [
    "We have looked at the report and it was clear that nothing in the store had changed since the last week, so the job was closed.",
    "Wir haben das gestern noch einmal geprüft, weil der Speicher nicht mehr leer war und es am Montag zu spät ist.",
    "Nous avons vu que la session n'était pas prête, et il a fallu attendre que le groupe des outils ait fini.",
    "No creo que la cola tenga la culpa de todo esto, porque el archivo viejo seguía abierto y no se ha borrado.",
    "Мы сделали это вчера вечером, потому что старый файл был ещё открыт и места не было.",
    "昨日の夜に検査一覧を確認しましたが、特に問題はありませんでした。空き容量は十分にありました。",
]
JUNK = [
    "name;size;state\nalpha;12;ok\nbeta;15;failed\ngamma;99;ok", "- red box\n- green lamp\n- blue cable\n- small table", "2025-07-11T05:21:47Z DEBUG worker-4 idle\n2025-07-11T05:21:51Z ERROR worker-5 idle",
    "Home | Top | Search | Print | Next | Help | Home", "uYiEmIQq8nloGM2/LDKLTvaNlvdvkngoHDdzzR0+hb8/+ufy7HWAH+b1eMXOr1ZUOsPY", "ok ok ok ok ok ok ok ok ok ok ok ok ok ok", "def f(x, n=1):\n    if x.size > 5:\n        return x[n:]\n",
    "00000000  2a 22 99 5d fa 73 79 5b ff ce 2c 44 95 04 1a 30  |*\"..|\n00000010  72 9b f0 af 42 f9 6d 7b df c8 18 43 fc fc c0 a8  |r...|", "hinge retention keen ember inkwell hollow cobble split manifest small repository map pack mortar ferry", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "the the the the the the the the the the the the the the the the",
]


MODEL = q.Model(q.default_model())


def prose_share(text):
    return MODEL.statistics([text])["prose"][0]


@pytest.mark.parametrize("text", [*PROSE, *(t.upper() for t in PROSE), *(t.lower().rstrip(".。") for t in PROSE), "\n".join(PROSE[0].split(" ")[i] + " " + " ".join(PROSE[0].split(" ")[i + 1 : i + 5]) for i in range(0, 25, 5))])
def test_prose_is_prose(text):
    assert prose_share(text) >= 0.5


@pytest.mark.parametrize("language", paragraphs.PROSE)
def test_prose_in_languages_that_the_corpus_lacks(language):
    text = paragraphs.PROSE[language]
    for form in (text, text.lower(), text.upper(), textwrap.fill(text, 40), text.replace(". ", " ").replace(".", "")):
        assert prose_share(form) >= 0.5


@pytest.mark.parametrize("text", [*JUNK, *paragraphs.JUNK.values()])
def test_junk_is_not(text):
    assert prose_share(text) < 0.5


def test_most_characters_decide():
    assert prose_share(PROSE[0] + "\n\n" + JUNK[0] * 10) < 0.5
    assert prose_share((PROSE[0] + "\n") * 10 + JUNK[0]) > 0.5


def test_statistics_of_special_texts(spark):
    texts = [None, "", "  \n\t", "　 ", "a", PROSE[0] * 3000, "One two. Three!\n\nfour"]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id bigint, text string, prose double")
    got = {r.doc_id: r for r in q.text_statistics(df).collect()}
    assert [got[i].n_lines for i in range(7)] == [0, 0, 0, 0, 1, 1, 2]
    assert got[0].n_chars is None and got[1].prose is None and got[5].n_chars == len(texts[5])
    r = got[6]
    assert (r.n_words, r.mean_word_length, r.ended_lines) == (4, 15 / 4, 0.5)
    assert all(abs(x.prose + x["list"] + x.table + x.junk - 1) < 1e-9 for x in got.values() if x.n_lines)
    assert {x.doc_id for x in q.not_prose(q.text_statistics(df)).collect()} <= {4, 6}
    assert q.text_statistics(df.limit(0)).count() == 0


def test_a_batch_is_judged_as_each_text_alone():
    texts = [None, "", *PROSE, *JUNK, "\r\n".join(JUNK), "\n\n", *paragraphs.PROSE.values(), "x" * 2000, PROSE[0] * 40]
    together = MODEL.statistics(texts)
    for i, t in enumerate(texts):
        alone = MODEL.statistics([t])
        assert all(together[n][i] == pytest.approx(alone[n][0]) for n, _ in q.FIELDS)


def test_viterbi_against_all_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    move, start = np.log(rng.dirichlet(np.ones(3), 3)), np.log(rng.dirichlet(np.ones(3)))
    text = np.repeat(np.arange(6), [1, 4, 2, 5, 1, 3])
    scores = rng.normal(size=(len(text), 3))
    got = q.viterbi(text, scores, start, move)
    for t in range(6):
        s, path = scores[text == t], got[text == t].tolist()
        value = lambda p: start[p[0]] + s[0, p[0]] + sum(move[a, b] + s[i + 1, b] for i, (a, b) in enumerate(zip(p, p[1:])))  # noqa: B023, E731
        assert path == list(max(itertools.product(range(3), repeat=len(s)), key=value))


def test_fit_learns_and_is_bounded(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(q, "FIT_TEXTS", 40)
    rows = [(i, (PROSE + JUNK)[i % 17] + f" {i}" * (i % 2)) for i in range(200)] + [(900, None), (901, " ")]
    made = q.fit_model(spark.createDataFrame(rows, "doc_id bigint, text string"))
    model = q.Model(made)
    assert all(np.allclose(np.sum(v, 1), 1, atol=1e-4) for v in made["chances"].values()) and np.allclose(np.sum(made["move"], 1), 1, atol=1e-4)
    assert any(np.abs(model.chances[n] - p).max() > 0.0005 for n, p in q.believed().items())
    assert model.statistics([PROSE[0]])["prose"][0] == 1.0 and model.statistics([JUNK[0]])["prose"][0] == 0.0


@pytest.mark.parametrize("tail", [" " * 11, " " * 12, "\t" * 40, ")" * 12, "”)" + " " * 30, "。" + " " * 12])
def test_padded_lines_are_ended(tail):
    assert MODEL.statistics(["The build is done." + tail])["ended_lines"] == [1.0]
    assert MODEL.statistics(["The build is done" + tail.replace("。", "")])["ended_lines"] == [0.0]
    assert MODEL.statistics(["\n".join(["The build is done." + tail] * 3)])["ended_lines"] == [1.0]
