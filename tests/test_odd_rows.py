"""Null, empty, repeated and malformed rows in the operators of the core."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from siftline.functions import batches
from siftline.operators import chunking, dedup, guidelines, models, relational
from siftline.sinks.files import append_missing
from siftline.sources.annotations import pubtator, pubtator_errors
from siftline.sources.html import html_text


def test_dedup_lines_keeps_rows_of_one_id_apart(spark):
    rows = [(1, "a\nb"), (1, "c\nd"), (2, "e\nx"), (2, "e\nx"), (3, None), (None, "x\ny")]
    out = dedup.dedup_lines(spark.createDataFrame(rows, "doc_id int, text string"), most=1).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(1, "a\nb"), (1, "c\nd"), (3, None), (None, "y")], key=str)
    out = dedup.dedup_lines(spark.createDataFrame(rows, "doc_id int, text string"), most=2).collect()
    assert [tuple(r) for r in out].count((2, "e")) == 2
    assert dedup.dedup_lines(spark.createDataFrame([], "doc_id int, text string")).collect() == []


def test_wordless_texts_are_no_copies(spark):
    rows = [(1, "!!!"), (2, ""), (3, "???"), (4, None), (5, "one two"), (6, "One, two!")]
    assert [tuple(r) for r in dedup.minhash_pairs(spark.createDataFrame(rows, "doc_id int, text string")).collect()] == [(5, 6, 1.0)]


def test_cosine_of_nothing_is_null(spark):
    row = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    none, one = row.select(relational.cosine(F.col("a"), F.col("b")), relational.cosine(F.col("b"), F.col("b"))).first()
    assert none is None and one == pytest.approx(1)
    texts = spark.createDataFrame([(1, ""), (2, "a b"), (3, "b a"), (4, "")], "id int, text string")
    assert (2, 3, 1.0) in [tuple(r) for r in dedup.similar_pairs(texts, F.lit(1), "id", "text", "cosine").collect()]


def test_mention_without_numbers_is_an_error(spark):
    text = "1|t|Title\n1|a|Abstract\nx\t0\t5\tTitle\tT1\tC1\n\n2|t|Two\n2|a|More\n2\t0\t3\tTwo\tT1\tC1"
    df = spark.createDataFrame([("f", text)], "file string, text string")
    assert {r.id: len(r.tags) for r in pubtator(df).collect()} == {1: 0, 2: 1}
    assert "x\t0\t5\tTitle\tT1\tC1" in [r.line for r in pubtator_errors(df).collect()]


def test_unreadable_sink_is_an_error(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    path = str(tmp_path / "sink")
    assert append_missing(df, path, kind="parquet") == 1
    assert append_missing(df, path, kind="parquet") == 0
    (tmp_path / "bad").mkdir()
    with pytest.raises(AnalysisException):
        append_missing(df, str(tmp_path / "bad"), kind="parquet")


@pytest.mark.parametrize("metric", ["levenshtein", "jaro", "jaro_winkler"])
def test_similar_pairs_over_many_tiles(spark, metric):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcé") for _ in range(n)) for n in (0, 1, 2, 9, 20, 63, 64, 65, 130)]
    texts = [*base * 2, "a\0b", "a\0", "a"]
    for t in base[3:] * 4:
        k = rng.randrange(len(t))
        texts.append(t[:k] + rng.choice(["", "x", "ab"]) + t[k + 1 :])
    rows = [(k, k % 2, t) for k, t in enumerate(texts)] + [(900, None, "aaaa"), (901, 0, None), (None, 0, "abc"), (3, 1, texts[3])]
    df = spark.createDataFrame(rows, "id int, k int, t string")
    pair = df.select("k", F.col("id").alias("a"), F.col("t").alias("ta")).join(df.select("k", F.col("id").alias("b"), F.col("t").alias("tb")), "k").where("a < b")
    plain = {"levenshtein": 1 - F.levenshtein("ta", "tb") / F.greatest(F.length("ta"), F.length("tb"), F.lit(1)), "jaro": dedup.jaro("ta", "tb"), "jaro_winkler": dedup.jaro_winkler("ta", "tb")}
    want = sorted(map(tuple, pair.select("a", "b", F.round(plain[metric], 6).alias("s")).where("s >= 0.8").collect()))
    for tile in (4, 2048):
        assert sorted(map(tuple, dedup.similar_pairs(df, F.col("k"), "id", "t", metric, 0.8, tile).collect())) == want
    cosine = [sorted(map(tuple, dedup.similar_pairs(df, F.col("k"), "id", "t", "cosine", 0.8, tile).collect())) for tile in (3, 2048)]
    assert cosine[0] == cosine[1] != []


def test_similar_pairs_spreads_a_hot_block(spark):
    texts = spark.range(3000).select("id", F.concat(F.lit("http://host/"), F.col("id")).alias("t"))
    for metric in ("levenshtein", "jaro"):
        busy = dedup.similar_pairs(texts, F.lit(1), "id", "t", metric, tile=500).select(F.spark_partition_id().alias("p")).distinct().count()
        assert busy > 1


def test_embed_words_with_nulls_and_without_exploding(spark):
    tokens = spark.createDataFrame([(1, "aa"), (1, "bb"), (1, "aa"), (2, "cc"), (3, "dd"), (4, "eeeeeee"), (5, None), (None, "aa"), (None, "bb")], "k int, w string")
    vectors = spark.createDataFrame([("aa", [1.0, None, 0.1]), ("bb", [2.0, 5.0]), ("cc", []), ("dd", [None])], "w string, v array<float>")
    df = models.embed_words(tokens, vectors, "k", "w", "v", repair=False)
    assert {r.k: r.v for r in df.collect()} == {1: [1.333333, 5.0, 0.1], 3: [None], None: [1.5, 5.0, 0.1]}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan


def test_minhash_makes_each_key_once(spark):
    texts = spark.createDataFrame([(k, " ".join(f"w{(k % 3) * 100 + x}" for x in range(300))) for k in range(9)] + [(4, "same id, other text")], "doc_id int, text string")
    df = dedup.minhash_pairs(texts)
    assert sorted(map(tuple, df.collect())) == sorted((a, b, 1.0) for a in (0, 1, 2) for b in (a + 3, a + 6))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    uses = plan.count("ArrowEvalPython") / plan.count("LeftSemi")
    assert uses <= 3 and "Window" in plan


@pytest.mark.parametrize("name", ["chunks", "html"])
def test_python_on_texts_in_small_steps(spark, name):
    df = spark.createDataFrame([(k, None if k % 7 == 0 else f"<p>one {k}</p>\n\n<p>two</p>") for k in range(300)], "id int, t string").repartition(1)
    column = chunking.paragraph_chunks(F.col("t"), 2) if name == "chunks" else html_text(F.col("t"))
    got = {r.id: r.x for r in df.select("id", column.alias("x")).collect()}
    want = {k: None if k % 7 == 0 else [f"<p>one {k}</p>", "<p>two</p>"] if name == "chunks" else f"one {k}\ntwo" for k in range(300)}
    assert got == want


def test_each_holds_few_results(monkeypatch):
    monkeypatch.setattr(F, "arrow_udf", lambda kind: lambda fn: fn)
    run = batches.each(str.upper, "string")
    sizes = [len(x) for x in run(iter([pa.array(["a"] * 1000), pa.array([None, "b"])]))]
    assert max(sizes) <= batches.STEP and sum(sizes) == 1002


def test_guidelines_run_on_arrow_rows(spark):
    text = "Overview\n" + "\n".join(f"A line of the guideline with many words, number {w}." for w in ("one", "two", "three", "four"))
    rows = [("cma", k, None if k % 2 else f"title {k}", f"{text} {'x' * k}", "u", None) for k in range(150)] + [("unknown", 1, "t", text, "u", None)]
    df = guidelines.process_guidelines(spark.createDataFrame(rows, "source string, position long, title string, text string, url string, overview string"))
    assert df.count() == 150 and "MapInArrow" in df._jdf.queryExecution().optimizedPlan().toString()
