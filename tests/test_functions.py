"""Column functions against small models of their rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siftline.functions import pii
from siftline.functions import rules as R
from siftline.functions import text as X
from siftline.operators import chunking, dedup, filters, guidelines, pages, repetition, spans
from siftline.sources import html


def apply(spark, fn, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string").repartition(2)
    return [r.out for r in rows.select("i", fn(F.col("text")).alias("out")).orderBy("i").collect()]


def test_golden_vectors(spark):
    assert apply(spark, pii.bsn_valid, ["111222333", "123456782", "123456789", "12345678", None]) == [True, True, False, False, False]
    assert apply(spark, X.fix_mojibake, ["patiÃ«nt"]) == ["patiënt"]
    assert apply(spark, lambda c: X.fold(c, R.MASK_DIGITS), ["12 345"]) == ["## ###"]
    assert apply(spark, lambda c: X.fold(c, R.REPEATS), ["the the cat!!  sat"]) == ["the cat! sat"]


def test_masks(spark):
    assert apply(spark, pii.mask_bsn, ["bsn 111222333, not 123456789 nor 1112223334"]) == ["bsn [BSN], not 123456789 nor 1112223334"]
    assert apply(spark, pii.mask_phones, ["bel 0612345678 of +31 612345678 of <a 0612345678>"]) == ["bel [TELEFOONNUMMER] of [TELEFOONNUMMER] of <a 0612345678>"]
    assert apply(spark, pii.mask_patient_numbers, ["Patiëntnummer: 1234567 x"]) == ["[PATIENTNUMMER] x"]
    assert apply(spark, lambda c: X.fold(c, R.PLACEHOLDERS), ["[**2150-1-2**] at [**Hospital1 18**] by [**Doctor Last Name **]"]) == ["[DATE] at [HOSPITAL] by [DOCTOR_LAST_NAME]"]
    assert apply(spark, lambda c: pii.deidentify(c, date=True, url=True), ["1999-01-02 http://a.nl 3.5 7"]) == ["[DATUM] [URL] [FLOAT] [INT]"]


def test_clean_on_columns_equals_clean_on_strings(spark):
    rng = random.Random(1)
    pieces = ["\n", "\n#", "##", "* ", "• ", "a", "Bc ", "[x](y)", "http://a.b/c ", "1", "<b>", "\n\n", "**", "◆", " "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    assert apply(spark, X.clean, texts) == [guidelines.clean_text(t) for t in texts]


def test_between_headings(spark):
    texts = ["x ABSTRACT one Introduction y", "no", "Abstract a abstract b introduction c INTRODUCTION d", "introduction Abstract"]
    want = [m.group(1) if (m := re.match(r"(?is).*Abstract(.*)Introduction.*", t)) else "" for t in texts]
    assert apply(spark, X.between_headings, texts) == want


def test_encoding_and_rtf(spark):
    broken = "naïve café".encode().decode("latin-1")
    assert apply(spark, X.fix_encoding, [broken, "fine", "日本 Ã©"]) == ["naïve café", "fine", "日本 Ã©"]
    assert apply(spark, lambda c: X.fold(c, R.RTF), [r"{\rtf1 {\*\gen x;}\f0 Hello}"]) == ["Hello"]


def model_low_entropy(t, w=5):
    gone = {p for s in range(len(t) - w + 1) if len(set(t[s : s + w])) <= 2 for p in range(s, s + w)}
    return "".join(c for p, c in enumerate(t) if p not in gone)


def test_low_entropy(spark):
    rng = random.Random(2)
    texts = [None, "", "aaaa", "😀😀😀😀😀x"] + ["".join(rng.choice("ab c") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    assert apply(spark, repetition.remove_low_entropy, texts) == [t if t is None or len(t) < 5 else model_low_entropy(t) for t in texts]
    assert apply(spark, lambda c: repetition.remove_low_entropy(c, block=7), texts) == apply(spark, repetition.remove_low_entropy, texts)


def test_echoes(spark):
    assert apply(spark, repetition.remove_echoes, ["a b a b c d e. x y", "one two one two", None, ""]) == ["a b c d e. x y", "one two one two", None, ""]


@pytest.mark.parametrize("fn,size,most", [(chunking.sentence_chunks, chunking.word_count, 12), (chunking.paragraph_chunks, chunking.word_count, 12), (chunking.char_chunks, len, 40)])
def test_packers(spark, fn, size, most):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["word ", "two. ", "\n", "longer "]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    for text, got in zip(texts, apply(spark, lambda c: fn(c, most), texts)):
        assert " ".join(got).split() == text.split() and all(got)
        parts = {" ".join(x.split()) for x in (chunking.sentences(text) if fn is chunking.sentence_chunks else text.split("\n"))}
        assert all(size(a) <= most or " ".join(a.split()) in parts for a in got)  # a part that is too large stands alone
        if fn is chunking.char_chunks:  # greedy: the next word would not have fitted
            assert all(len(a) + 1 + len(b.split()[0]) > most for a, b in zip(got, got[1:]))


def test_pack_is_greedy():
    assert chunking.pack(["aa", "bb", "cccccc", "d"], len, 5, "|") == ["aa|bb", "cccccc", "d"]
    assert chunking.pack([], len, 5) == []


def test_split_by_bytes(spark):
    got = apply(spark, lambda c: chunking.split_by_bytes(c, 6, "^--"), ["ab\ncd\nef\n--x\ngh", "", None])
    assert got == [["ab\ncd", "ef\n--x", "gh"], [""], [""]]


def test_filters(spark):
    assert apply(spark, lambda c: filters.term_relevant(c, ["a"], ["b"]), ["a", "ab", "c"]) == [True, False, False]
    assert apply(spark, lambda c: filters.term_relevant(c, ["a"], ["b"], False), ["a", "ab", "c"]) == [True, False, True]
    assert apply(spark, filters.atc_valid, ["A", "A01", "A01B", "A01BA", "A01BA02", "a01", "A01BAX"]) == [True, True, True, True, True, False, False]
    body = "word " * 60
    assert apply(spark, filters.page_is_body, [body, "short", body + "References", body + "chapter 1 chapter 2"]) == [True, False, False, False]


def test_similarities(spark):
    df = spark.createDataFrame([("martha", "marhta"), ("dixon", "dicksonx"), ("a", "b"), ("same", "same")], "a string, b string")
    got = [(round(r[0], 4), round(r[1], 4)) for r in df.select(dedup.jaro("a", "b"), dedup.jaro_winkler("a", "b")).collect()]
    assert got == [(0.9444, 0.9611), (0.7667, 0.8133), (0.0, 0.0), (1.0, 1.0)]


def test_minhash_recall_against_all_pairs(spark):
    rng = random.Random(4)
    base = [["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(80)] for _ in range(15)]
    docs = [(g * 10 + c, " ".join(w if rng.random() > 0.01 * c else "zz" for w in b)) for g, b in enumerate(base) for c in range(4)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sets = {r.doc_id: set(r.s) for r in df.select("doc_id", dedup.shingles(F.col("text")).alias("s")).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = {(r.a, r.b) for r in dedup.minhash_pairs(df).collect()}
    root = {d: d for d in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in got:
        root[find(b)] = find(a)
    assert got <= want and sum(find(a) == find(b) for a, b in want) >= 0.9 * len(want)


def test_spans(spark):
    s = [{"start": 0, "end": 4, "text": "", "tag": "A", "cui": "C1"}, {"start": 2, "end": 10, "text": "", "tag": "B", "cui": "C2"}, {"start": 12, "end": 14, "text": "", "tag": "A", "cui": "C3"}]
    assert [x["cui"] for x in spans.resolve(s)] == ["C2", "C3"] and [x["cui"] for x in spans.resolve(s, longest=False)] == ["C1", "C3"]
    assert spans.biluo("big red cat sat", [{"start": 0, "end": 11, "tag": "X"}, {"start": 12, "end": 15, "tag": "Y"}], "tag") == [("big", "B-X"), ("red", "I-X"), ("cat", "L-X"), ("sat", "U-Y")]
    assert spans.biluo("redcat", [{"start": 0, "end": 3, "tag": "X"}], "tag") == [("redcat", "-")]
    df = spark.createDataFrame([("ab cd", [(3, 5, "cd", "T", "C9"), (0, 2, "ab", "T", "C8")])], "text string, tags " + f"array<{spans.SPAN}>")
    assert df.select(spans.inject(F.col("text"), F.col("tags"))).first()[0] == "[[ab][C8]] [[cd][C9]]"


def test_truncate_and_sources():
    text = "Intro line\n## Key recommendations\nDo this.\n| table\n123\nReferences\nmore"
    assert guidelines.truncate(text, ["key recommendations"], ["|"], ["references"]) == "## Key recommendations\nDo this."
    assert guidelines.truncate("References\nStart here", ["start"], (), ["references"]) == ""
    assert guidelines.number_framed_headers(["1", "Title", "2", "x", "y", "z"]) == ["# Title", "x", "x", "y", "z"]
    g = {"title": "T | AAFP", "text": "The AAFP supports X on this topic.", "source": "aafp"}
    assert guidelines.SOURCES["aafp"](g) is None and len(guidelines.SOURCES) == 18
    assert guidelines.nice_sections([("Update", "a"), ("Discussion of update", "b"), ("Care", "c")]) == [("Discussion of update", "b"), ("Care", "c")]
    wiki = {"title": "W", "urls": [], "text": "Editor: me\n# H\nAny recommendations found on these pages\nhidden\n# Next\n" + "\n".join(["word " * 12] * 3) + "\nexternal links\nx"}
    out = guidelines.SOURCES["wikidoc"](wiki)["text"]
    assert "hidden" not in out and "Editor" not in out and "# Next" in out


def test_pages():
    book = ["cover", "Summary\nfirst", "second", "References\nz", "Samenvatting\neerste"]
    assert pages.capture(book, ("summary",), ("references", "samenvatting")) == ["Summary\nfirst", "second"]
    assert pages.capture(["S ummary x"], ("summary",), ()) == ["S ummary x"]


def test_html():
    page = "<html><head><title>T</title></head><body><h1>One<p>a <b>b</b>\n c<br>d<p>e<ul><li>x<li>y <p>z</p></ul><table><tr><td><p>no</table><div class='toc'><p>no</div><script>no</script><h2>References</h2><p>end"
    assert html.to_text(page) == "# One\na b c d\ne\n- x\n- y z"
    assert html.to_text(None) is None and html.to_text("") == "" and html.to_text("<p>a</p></div></p><p>b") == "a\nb"
    assert html.to_text("<h2>2.1 Care [3]</h2><p>do [12] it</p>", html.NICE) == "# Care \ndo  it"
