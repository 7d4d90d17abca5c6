"""SentencePiece: against the library for a BPE model, against all segmentations for a unigram one."""

import random
from functools import cache

import pytest

from siftline.llm.pieces import Pieces, decode, edge_table, encode, encode_segment, encode_segments, fold_edges

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def model():
    return Pieces.load(MODEL)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts():
    rng = random.Random(21)
    alphabets = ["ab eorstin. é1\n", "the ing", "日本語 ab", "0123456789abcdef", " \t\r\nx"]
    return ["", None, " ", "x" * 300, "a▁b", "\x00�\U0001f600", "b" + "ac" * 5000] + ["".join(rng.choice(a) for _ in range(rng.randint(1, 70))) for a in alphabets for _ in range(60)]


def test_ids_are_the_librarys(spark, model, library):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "doc_id int, text string, ids string")
    out = decode(encode(df, model), model, "_ids").collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["_ids"] == (None if r.text is None else library.encode(r.text))
        assert r.decoded == (None if r.text is None else r.text.replace("▁", " "))


def test_decoding_in_one_pass(spark, model):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id int, text string")
    out = {r.doc_id: r for r in encode(df, model, decoded="doc_id", keep_text=False).collect()}
    assert all(out[i]["_doc_id"] == (None if t is None else t.replace("▁", " ")) for i, t in enumerate(texts()))


def test_repeated_long_segments(spark, model, library):
    rng = random.Random(24)
    long = ["".join(rng.choice("abcdeinrst") for _ in range(n)) for n in (100, 128, 129, 10_000)]
    df = spark.createDataFrame([(i, f"one {long[i % 4]} two {long[(i + 1) % 4]}") for i in range(1000)], "doc_id int, text string").repartition(4)
    want = {i: library.encode(f"one {long[i % 4]} two {long[(i + 1) % 4]}") for i in range(4)}
    assert all(r.ids == want[r.doc_id % 4] for r in encode(df, model).collect())


def test_partitions_that_change_between_readings(spark, model, library, monkeypatch):
    """Ids are right even if a task finds nothing of its segments in its partition's folder."""
    from siftline.llm import pieces

    real = pieces._own_ids
    monkeypatch.setattr(pieces, "_own_ids", lambda folder, kind: real(folder + "0000", kind))
    df = spark.createDataFrame(list(enumerate(t for t in texts() if t)), "doc_id int, text string")
    assert all(r.ids == library.encode(r.text) for r in encode(df, model).collect())


def test_tables_on_the_way_hold_a_segment_once(spark, model, library):
    from siftline.llm import common

    before = common.mark()
    df = spark.createDataFrame([(i, f"one two three {i % 3}") for i in range(400)], "doc_id int, text string").repartition(4)
    assert all(r.ids == library.encode(r.text) for r in encode(df, model).collect())
    tables = [spark.read.parquet(x) for x in common._made[before:]]
    assert len(tables) == 3 and all(t.count() == t.select("segment").distinct().count() for t in tables if "part" not in t.columns)
    assert sum("part" in t.columns for t in tables) == 1


def test_the_lattice_is_grouped_by_number_and_sorted_natively(spark, model, library):
    """Edges are grouped as they come, within one stage, and no comparison in SQL sorts them."""
    words = spark.createDataFrame([(" " + w,) for w in ("one", "walking", "one", "é1")], "segment string").repartition(2, "segment")
    lattice = edge_table(words, model).collect()
    assert sorted(r.segment for r in lattice) == [" one", " one", " walking", " é1"]
    assert all(len(r.edges) == len(set(r.edges)) for r in lattice)
    coded = encode_segments(words.distinct().repartition(2, "segment"), model)
    fold = str(fold_edges(model))
    assert "sort_array(edges" in fold and "array_sort(" not in fold
    assert {r.segment: [a << 8 | b for a, b in zip(r.ids[::2], r.ids[1::2])] for r in coded.collect()} == {w: library.encode(w[1:]) for w in (" one", " walking", " é1")}


def test_many_segments_are_passed_on(spark, model, library, monkeypatch):
    from siftline.llm import pieces

    monkeypatch.setattr(pieces, "HELD", 50)
    monkeypatch.setattr(pieces, "SLICE", 1 << 12)
    df = spark.createDataFrame(list(enumerate(t for t in texts() if t)), "doc_id int, text string")
    assert all(r.ids == library.encode(r.text) for r in encode(df, model).collect())


def test_empty_table(spark, model):
    assert decode(encode(spark.createDataFrame([], "text string"), model), model).count() == 0


def test_unigram_viterbi_is_optimal(spark):
    rng = random.Random(22)
    names = sorted({"".join(rng.choice("abc ") for _ in range(n)) for n in (1, 2, 2, 3, 3, 4) for _ in range(8)} | set("abc "))
    p = Pieces("unigram", names, list(range(3, 3 + len(names))), [-rng.random() * 5 - (len(n) == 1) for n in names], None, 0, 3 + len(names))
    score = dict(zip(p.texts, p.scores))

    def best(t):
        @cache
        def at(i):
            return max((score.get(t[i:j], min(score.values()) - 10 if j - i == 1 else -1e9) + at(j) for j in range(i + 1, min(len(t), i + 4) + 1)), default=0.0)

        return at(0)

    docs = ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 30))) for _ in range(80)] + ["ab" * 100]
    rows = encode(spark.createDataFrame([(t,) for t in docs], "text string"), p).collect()
    of_id = {i: t for t, i in zip(p.texts, p.ids)}
    for r in rows:
        total = sum(score[of_id[i]] if i in of_id else min(score.values()) - 10 for i in r.ids)
        assert total == pytest.approx(best(" " + r.text))


def test_long_segment_fold_equals_the_short_one(model, library):
    rng = random.Random(23)
    for _ in range(300):
        w = "".join(rng.choice("abcdeinrst") for _ in range(rng.randint(1, 30)))
        assert encode_segment(" " + w, model) == library.encode(w)
