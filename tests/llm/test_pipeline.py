"""The pipeline's stages on a small corpus with planted cases, and their contracts."""

import random

import corpus_pipeline
from siftline.llm.oracles import ORACLES
from siftline.llm.queries import QUERIES

from .conftest import words


def corpus(rng):
    langs = {"aa": "abcdefg", "bb": "tuvwxyz"}
    rows = [(i, "\n".join(" ".join(words(rng, 12, langs[lang])) for _ in range(12)), lang) for i, lang in enumerate(["aa", "bb"] * 40)]
    copy = "\n".join(line if n % 2 else "tuv" + line for n, line in enumerate(rows[3][1].split("\n")))
    passage = " ".join(words(rng, 90, langs["aa"]))
    rows += [(100, "0123 4567 !!", "aa"), (101, copy, "bb"), (102, rows[5][1], "bb"), (103, rows[0][1] + "\n" + passage, "aa"), (104, rows[2][1].upper()[:0] + " ".join(words(rng, 100, langs["aa"])) + " " + passage, "aa")]
    return rows, passage


def test_stages_keep_what_is_clean_and_drop_what_is_not(spark, make, tmp_path):
    rows, passage = corpus(random.Random(31))
    make(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        assert docs.columns == columns
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert 100 not in seen["language_id"] and len(seen["language_id"]) == len(rows) - 1
    assert 102 not in seen["line_dedup"]
    assert 101 not in seen["near_duplicates"] and set(range(80)) <= set(seen["near_duplicates"])
    last = seen["substring_dedup"]
    assert sum(passage in t for t in last.values()) <= 1 and set(range(80)) <= set(last)
    tokens = sum(len(t.split()) for t in last.values())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.token_end - r.token_start for r in packed) == tokens


def test_registry():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "substring_dedup", "packing"]
