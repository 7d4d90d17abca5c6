"""Sources, sinks, streams and models."""

import gzip
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.operators import models, relational
from siftline.operators.chunking import split_by_marker
from siftline.operators.pipeline import Deidentifier, Pipeline
from siftline.sinks import files as sinks
from siftline.sources import annotations, files
from siftline.streaming import stages


def test_scans(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.txt").write_text("one\ntwo")
    (d / "b.jsonl").write_text('{"id": "b1", "text": "three"}\n\n{broken\n{"id": "b2", "text": "four"}\n')
    (d / "c.json").write_text('[{"id": "c1", "text": "five"}]')
    (d / "e.xml").write_text('<r><p id="x1">six</p><p> </p><q>seven</q></r>')
    got = {(r.id, r.text) for r in files.read_directory(spark, str(d)).collect()}
    assert {("a", "one\ntwo"), ("b1", "three"), ("b2", "four"), ("c1", "five"), ("x1", "six")} <= got and len(got) == 6
    assert {(r.id, r.text) for r in files.read_line_documents(spark, f"{d}/a.txt").collect()} == {("a_0", "one"), ("a_1", "two")}
    (tmp_path / "l.txt").write_bytes("caf\xe9\nthe".encode("latin-1"))
    assert [r.value for r in files.read_lines(spark, str(tmp_path / "l.txt"), "ISO-8859-1", ["é"]).collect()] == ["café"]
    assert files.list_files(spark, str(d)).count() == 4
    with pytest.raises(ValueError):
        files.extension("x.exe")
    marked = files.marker_documents(spark, f"{d}/a.txt", lambda r: split_by_marker(r, "file", "pos", "text", "one"))
    assert sorted(r.text for r in marked.collect()) == ["one", "two"]


def test_archives_and_tables(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("first.txt", "x\ny\n")
        z.writestr("second.txt", "z")
    with gzip.open(tmp_path / "b.txt.gz", "wt") as f:
        f.write("g\n")
    got = [(r.member, r.value) for r in files.read_archives(spark, f"{tmp_path}/*.{{zip,gz}}").collect()]
    assert sorted(got) == [("b.txt", "g"), ("first.txt", "x"), ("first.txt", "y")]
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx\n")
    assert files.read_tabular(spark, str(tmp_path / "t.tsv")).collect()[0].asDict() == {"a": "1", "b": "x"}
    (tmp_path / "uu_texts.jsonl").write_text('{"file": "f", "pseudo_pagenum": 1, "text": "t"}\nbad\n')
    assert [tuple(r) for r in files.read_institutes(spark, f"{tmp_path}/*_texts.jsonl").collect()] == [("uu", "f", 1, "t")]


def test_citations(spark, tmp_path):
    xml = """<?xml version="1.0" ?><Set><PubmedArticle><PMID>7</PMID><ArticleTitle>A  title</ArticleTitle><Abstract><AbstractText>Some
    text.</AbstractText><CopyrightInformation>mine</CopyrightInformation></Abstract><PubDate><Year>1999</Year><Month>Jan</Month></PubDate><Language>eng</Language>
    <MeshHeadingList><MeshHeading><DescriptorName UI="D1">Heart</DescriptorName></MeshHeading></MeshHeadingList><ArticleId IdType="pmc">PMC1</ArticleId></PubmedArticle>
    <PubmedArticle><PMID>8</PMID></PubmedArticle></Set>"""
    (tmp_path / "p.xml").write_text(xml)
    row = files.read_articles(spark, str(tmp_path / "p.xml")).collect()
    assert len(row) == 1 and row[0].asDict() == {"pmid": "7", "title": "A title", "abstract": "Some text.", "pubdate_year": "1999", "pubdate_month": "Jan", "mesh_ids": ["D1"], "mesh_terms": ["Heart"], "pmc": "PMC1", "language": "eng"}
    assert files.article_record(files.read_articles(spark, str(tmp_path / "p.xml")), open_access=False).count() == 0
    assert [r.value.split() for r in files.read_abstract_texts(spark, str(tmp_path / "p.xml")).collect()] == [["Some", "text."]]


def test_annotation_files(spark, tmp_path):
    (tmp_path / "d1.txt").write_text("het ritmestormen beeld")
    (tmp_path / "d1.ann").write_text("T1\tDISEASE 4 16\tritmestormen\nT2\tX 1 2;3 4\tab\n#1\tnote\n")
    (tmp_path / "spans.tsv").write_text("name\ttag\tstart_span\tend_span\ttext\tcomment\nd1\tDISEASE\t4\t16\tx\t\n")
    for df in (annotations.read_standoff(spark, str(tmp_path), str(tmp_path)), annotations.read_span_table(spark, str(tmp_path / "spans.tsv"), str(tmp_path))):
        row = df.collect()
        assert len(row) == 1 and row[0].id == "d1" and [tuple(t) for t in row[0].tags] == [(4, 16, "DISEASE")]
    bad = spark.createDataFrame([("f", "1|a|abstract first\n1|t|title")], "file string, text string")
    assert annotations.pubtator_errors(bad).count() == 1


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}", None if i else "failed") for i in range(4)], "id int, text string, error_message string")
    out = str(tmp_path / "out")
    assert sinks.append_missing(rows, out, kind="parquet") == 4
    assert sinks.append_missing(rows, out, kind="parquet") == 1  # the row with an error is tried again
    nested = spark.createDataFrame([(1, (2, ("x",)))], "a int, b struct<c:int,d:struct<e:string>>")
    assert sinks.flatten(nested).columns == ["a", "b_c", "b_d_e"]
    sinks.write_flat(nested, str(tmp_path / "flat"))
    sinks.write_splits(rows.withColumn("split", F.lit("train")), str(tmp_path / "splits"))
    assert (tmp_path / "splits" / "split=train").is_dir()
    sinks.write_text(rows, str(tmp_path / "text"), encoding="ISO-8859-1")
    labels = rows.select(F.col("id").alias("k"), "id", F.lit(True).alias("success"), *[F.lit("x").alias(c) for c in ("text", "inferred_label", "model", "instructions", "meta")], F.lit(0.5).alias("proba"), F.lit(-1).alias("logprob"))
    sinks.write_labels(labels, str(tmp_path / "labels"))
    assert spark.read.parquet(str(tmp_path / "labels")).schema == sinks.LABEL_SCHEMA


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i % 3}") for i in range(9)], "id long, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    for name, opening in (("a", False), ("b", True)):
        stream = stages.dedup_stream(stages.read_stream(spark, str(tmp_path / "in"), rows.schema, files_per_batch=1), opening=opening)
        stages.write_stream(stream, str(tmp_path / name), str(tmp_path / f"{name}-state")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / name)).count() == 3
    for _ in range(2):  # the second run, with a new checkpoint, adds nothing
        source = stages.read_stream(spark, str(tmp_path / "in"), rows.schema)
        stages.run_batches(source, str(tmp_path / "c"), str(tmp_path / f"c-{_}"), lambda d: d.withColumn("n", F.length("text"))).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "c")).count() == 9


def test_asof_against_brute_force(spark):
    rng = np.random.default_rng(1)
    left = [(i, int(rng.integers(0, 4)), int(rng.integers(0, 50))) for i in range(60)]
    right = [(i, int(rng.integers(0, 3)), int(rng.integers(0, 50)), float(i)) for i in range(50)]
    out = relational.asof_nearest(spark.createDataFrame(left, "id int, u int, t int"), spark.createDataFrame(right, "rid int, u int, t int, v double"), "u", "t", "v", "rid")
    for r in out.collect():
        own = [x for x in right if x[1] == r.u]
        back, ahead = [x for x in own if x[2] <= r.t], [x for x in own if x[2] >= r.t]
        b, a = (max(back, key=lambda x: (x[2], x[0])) if back else None), (min(ahead, key=lambda x: (x[2], x[0])) if ahead else None)
        want = b if b and (not a or r.t - b[2] <= a[2] - r.t) else a
        assert r.near_v == (want[3] if want else None)


def test_models(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, ""), (3, None)], "id int, text string")
    out = {r.id: r for r in models.run_model(rows, "text", models.ModelSettings(instructions=("upper", "reverse"))).collect()}
    assert out[1].text_out == "CBA" and out[1].steps == ["ABC", "CBA"] and out[1].proba == pytest.approx(np.exp(-0.006))
    assert not out[2].success and out[3].error_message == "empty text" and json.loads(out[1].metadata) == {}
    assert models.run_distinct(rows.unionByName(rows), "text").count() == 6
    assert models.with_glossary("Hello, world!", {"Hello": "Hola"}, str.upper) == "Hola, WORLD!"
    low, sparse = models.robust_pca(np.outer(np.arange(1.0, 9), np.ones(6)) + np.diag([9.0] * 6 + [0, 0])[:, :6] * 0)
    assert np.allclose(low + sparse, np.outer(np.arange(1.0, 9), np.ones(6)), atol=1e-3)
    cost = spark.createDataFrame([(1_000_000,)], "n long").select(models.google_cost(F.col("n")), models.deepl_cost(F.col("n"))).first()
    assert tuple(cost) == (20.0, 25.0)
    fixed = models.embed_words(spark.createDataFrame([(1, "hart"), (1, "hard"), (2, "zzzzzz")], "k int, w string"), spark.createDataFrame([("hart", [1.0, 2.0])], "w string, v array<double>"), "k", "w", "v").collect()
    assert [(r.k, r.v) for r in fixed] == [(1, [1.0, 2.0])]


def test_pipeline_facade(spark):
    rows = spark.createDataFrame([("nr 111222333.",)], "text string")
    assert Pipeline([("mask", Deidentifier(options={"numbers": False}).transform)]).fit_transform(rows).first()[0] == "nr [BSN]."
    with pytest.raises(ValueError):
        Pipeline([("a", lambda d: d), ("a", lambda d: d)])


def test_samples(spark):
    rows = spark.range(100).withColumn("g", F.col("id") % 3)
    assert relational.sample_k(rows, "id", 10).count() == 10
    with pytest.raises(ValueError):
        relational.sample_k(rows, "id", 101)
    groups = relational.balanced_groups(rows, "id", 5).groupBy("group").count().collect()
    assert {r["count"] for r in groups} == {40}
    split = {r.split: r["count"] for r in relational.split_sets(rows, "g", "id").groupBy("split").count().collect()}
    assert split == {"train": 94, "validation": 3, "test": 3}


def test_entry_works_without_the_language_model_folders(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'corpus_report' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, timeout=120)
