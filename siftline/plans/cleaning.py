"""Queries on text cleaning, filters, personal data and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pii
from ..functions import rules as R
from ..functions import text as X
from ..operators import chunking as C
from ..operators import filters as L
from ..operators import repetition as W
from .registry import LINES, NONWORD, WORDS, Tables, query, quoted, sql_any, sql_fold, words_of

TERMS = ["the ", "ation", "ing "]
NOT_TERMS = ["$$$", "###", "Click"]
SMALL_RULES = {
    "squeezed": R.SQUEEZE_NONWORD, "bracketless": R.DOUBLE_BRACKETS, "pii": R.UNDERSCORES, "cited": R.EMPTY_CITATIONS, "breaks": R.LINE_BREAKS, "headings": R.HEADING_NUMBERS, "wiki": R.WIKI_TEMPLATES, "emails": R.EMAIL,
}
MASKS = {"dates": R.DATES, "numbers": R.NUMBERS, "links": R.LINKS, "dois": R.DOI, "patients": R.PATIENT, "tags": R.SIMPLE_TAGS}


def _sections_sql(t: str) -> str:
    least = f"list_min(list_transform(regexp_extract_all({t}, '\n#+'), lambda m: length(m) - 1))"
    lifted = f"regexp_replace({t}, '\n#{{' || {least} || '}}', '\n#', 'g')"
    return f"CASE WHEN contains({t}, '\n#') THEN regexp_replace({lifted}, '\n#{{3,}}', '\n###', 'g') ELSE {t} END"


CLEAN_SQL = f"""
    WITH a AS (SELECT doc_id, {sql_fold("text", [*R.URLS, *R.REFERENCES, *R.LISTS, *R.GLYPHS])} AS t FROM documents),
    b AS (SELECT doc_id, {_sections_sql("t")} AS t FROM a),
    c AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[a-zA-Z]')) AS l FROM b),
    e AS (SELECT doc_id, CASE WHEN len(l) > 0 THEN array_to_string(l, chr(10)) || chr(10) ELSE '' END AS t FROM c)
    SELECT doc_id, {sql_fold("t", [(chr(10) + r"\s*" + chr(10), chr(10)), (chr(10) + "#", chr(10) * 2 + "#"), (r"^\s+", ""), (r"\s+$", "")])} AS text FROM e
"""


def _folded(d: DataFrame, rules: dict, column: str = "text") -> DataFrame:
    return d.select("doc_id", *[X.fold(F.col(column), r).alias(n) for n, r in rules.items()])


def _folded_sql(rules: dict) -> str:
    return "SELECT doc_id, " + ", ".join(f"{sql_fold('text', r)} AS {n}" for n, r in rules.items()) + " FROM documents"


@query("corpus_report", f"""
    WITH c AS (SELECT doc_id, source, {sql_fold("text", [*R.URLS, *R.REFERENCES, *R.MASK_DIGITS])} AS text FROM documents),
    f AS (SELECT * FROM c WHERE len({WORDS}) >= 20),
    d AS (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS k FROM f)
    SELECT source, count(*) AS documents, sum(len({LINES}))::BIGINT AS lines, sum(len({WORDS}))::BIGINT AS words, sum(length(text))::BIGINT AS chars,
           round(avg(len({LINES})), 6) AS mean_lines, round(avg(len({WORDS})), 6) AS mean_words
    FROM d WHERE k = 1 GROUP BY ROLLUP (source)
""")
def corpus_report(t: Tables) -> DataFrame:
    """Clean, filter by length, deduplicate, and count by source."""
    from ..operators.dedup import dedup_exact
    from ..operators.relational import corpus_stats

    cleaned = t.documents.select("doc_id", "source", X.fold(F.col("text"), [*R.URLS, *R.REFERENCES, *R.MASK_DIGITS]).alias("text"))
    return corpus_stats(dedup_exact(cleaned.where(L.min_words(F.col("text"), 20))), "source")


@query("clean_regex_chain", _folded_sql({"parity": R.MASK_DIGITS, "longest": R.MASK_DIGITS_LONGEST}))
def clean_regex_chain(t: Tables) -> DataFrame:
    return _folded(t.documents, {"parity": R.MASK_DIGITS, "longest": R.MASK_DIGITS_LONGEST})


@query("clean_urls_refs", f"SELECT page_id, {sql_fold('html', [*R.URLS, *R.REFERENCES])} AS text FROM pages")
def clean_urls_refs(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.fold(F.col("html"), [*R.URLS, *R.REFERENCES]).alias("text"))


@query("clean_lists_glyphs", _folded_sql({"lists": R.LISTS, "lists_parity": R.LISTS_PARITY, "glyphs": R.GLYPHS}))
def clean_lists_glyphs(t: Tables) -> DataFrame:
    return _folded(t.documents, {"lists": R.LISTS, "lists_parity": R.LISTS_PARITY, "glyphs": R.GLYPHS})


@query("clean_chain", CLEAN_SQL)
def clean_chain(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.clean(F.col("text")).alias("text"))


@query("clean_sections", f"SELECT doc_id, {_sections_sql('t')} AS text FROM (SELECT doc_id, regexp_replace(text, '\n([A-Z])', '\n##\\1', 'g') AS t FROM documents)")
def clean_sections(t: Tables) -> DataFrame:
    marked = F.regexp_replace("text", "\n([A-Z])", "\n##$1")
    return t.documents.select("doc_id", X.normalize_sections(marked).alias("text"))


def _bad(c: str) -> str:
    return c.encode().decode("cp1252")


@query("fix_mojibake", "SELECT doc_id, text FROM (SELECT doc_id, text FROM documents WHERE NOT regexp_matches(text, '[Ãâ]'))")
def fix_mojibake(t: Tables) -> DataFrame:
    """Texts broken as a wrong decoding breaks them, and put right."""
    from functools import reduce

    broken = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(_bad(x))), "ëéèïö", F.col("text"))
    return t.documents.where(~F.col("text").rlike("[Ãâ]")).select("doc_id", X.fix_mojibake(broken).alias("text"))


@query("lines_min_len", rf"""
    SELECT doc_id, array_to_string(list_filter(list_transform({LINES}, lambda x: trim(regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '[0-9]+', '#', 'g'))), lambda x: length(x) > 20), chr(10)) AS text FROM documents
""")
def lines_min_len(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.squeeze_lines(F.col("text")).alias("text"))


@query("clean_xml_text", f"SELECT page_id, trim({sql_fold('html', R.PMC_TAGS)}) AS text, trim({sql_fold('html', R.PARAGRAPH_TAGS)}) AS paragraph FROM pages")
def clean_xml_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.clean_pmc(F.col("html")).alias("text"), F.trim(X.fold(F.col("html"), R.PARAGRAPH_TAGS)).alias("paragraph"))


@query("clean_page_text", _folded_sql({"text": R.PAGE}))
def clean_page_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.clean_page(F.col("text")).alias("text"))


_SUM = [R.SUMMARY[0], (r"^\s+", ""), (r"\s+$", ""), *R.SUMMARY[1:], (r"^\s+", ""), (r"\s+$", "")]


@query("clean_summary", f"SELECT doc_id, array_to_string(list_filter(string_split({sql_fold('text', _SUM)}, chr(10)), lambda x: len({words_of('x')}) > 3), chr(10)) AS text FROM documents")
def clean_summary(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.clean_summary(F.col("text")).alias("text"))


@query("strip_rtf", r"SELECT doc_id, replace(text, '\', '') AS text FROM documents WHERE NOT regexp_matches(text, '[{}\\]')")
def strip_rtf(t: Tables) -> DataFrame:
    """Texts wrapped as RTF and stripped again."""
    wrapped = F.concat(F.lit(r"{\rtf1 {\*\generator x;}\f0\fs24 "), F.col("text"), F.lit("}"))
    return t.documents.where(~F.col("text").rlike(r"[{}\\]")).select("doc_id", X.fold(wrapped, R.RTF).alias("text"))


@query("clean_small_rules", _folded_sql(SMALL_RULES))
def clean_small_rules(t: Tables) -> DataFrame:
    return _folded(t.documents, SMALL_RULES)


@query("collapse_repeats")
def collapse_repeats(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.fold(F.col("text"), R.REPEATS).alias("text"))


@query("text_hashes", "SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1, md5(text) AS md5, sha256(encode(text)[1:400]) AS head FROM documents")
def text_hashes(t: Tables) -> DataFrame:
    raw = F.encode("text", "UTF-8")
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"), F.sha1("text").alias("sha1"), F.md5("text").alias("md5"), F.sha2(F.substring(raw, 1, 400), 256).alias("head"))


@query("text_keys", r"""
    SELECT doc_id, regexp_replace(lower(text[1:500]), '[^a-zA-Z0-9]', '', 'g') AS fingerprint, regexp_replace(text, '[^a-zA-Z0-9]', '', 'g')[1:20] AS tag,
           '"' || translate(translate(text, chr(10) || chr(13), ''), '"', '''') || '"' AS field, regexp_extract(text, '(?is).*the(.*)of.*', 1) AS between FROM documents
""")
def text_keys(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.documents.select("doc_id", X.fingerprint(c).alias("fingerprint"), X.doc_tag(c).alias("tag"), X.csv_summary(c).alias("field"), X.between_headings(c, "the", "of").alias("between"))


@query("word_counts", rf"""
    SELECT doc_id, len({NONWORD})::BIGINT AS nonword, len({WORDS})::BIGINT AS ws, len(string_split(text, ' '))::BIGINT AS space, len(regexp_extract_all(text, '\S+'))::BIGINT AS nonspace FROM documents
""")
def word_counts(t: Tables) -> DataFrame:
    kinds = {"nonword": X.words_nonword, "ws": X.words_ws, "space": X.words_space, "nonspace": X.words_nonspace}
    return t.documents.select("doc_id", *[F.size(f(F.col("text"))).cast("long").alias(n) for n, f in kinds.items()])


@query("file_names", r"""
    SELECT page_id, translate(regexp_replace(list_last(string_split(regexp_replace(url, '[?#].*$', ''), '/')), '(?i)\.pdf$', ''), ',:. ', '') AS name FROM pages
""")
def file_names(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.file_name(F.col("url")).alias("name"))


@query("abbreviations")
def abbreviations(t: Tables) -> DataFrame:
    """Definitions of short forms, and how often each is given."""
    found = t.documents.select(F.explode(X.deabbreviate_pairs(F.concat(F.col("text"), F.lit(" Body Mass Index (BMI)")))).alias("p"))
    return found.groupBy("p.long", "p.short").agg(F.count("*").alias("n"))


# --- filters ------------------------------------------------------------------------------------


@query("lines_with_terms", f"SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(range(len({LINES}))) AS pos, unnest({LINES}) AS line FROM documents) WHERE {sql_any('line', TERMS)}")
def lines_with_terms(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("pos", "line"))
    return rows.where(L.any_of(F.col("line"), TERMS)).select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


@query("term_identify", f"""
    SELECT doc_id, {sql_any("text", TERMS)} AND NOT {sql_any("text", NOT_TERMS)} AS conservative, NOT {sql_any("text", NOT_TERMS)} AS open,
           {sql_any("text", R.INCLUDE_TERMS)} AND NOT {sql_any("text", R.EXCLUDE_TERMS)} AS medical FROM documents
""")
def term_identify(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.documents.select("doc_id", L.term_relevant(c, TERMS, NOT_TERMS).alias("conservative"), L.term_relevant(c, TERMS, NOT_TERMS, False).alias("open"), L.term_relevant(c).alias("medical"))


@query("model_identify", f"""
    WITH s AS (SELECT doc_id, {sql_any("text", TERMS)} AND NOT {sql_any("text", NOT_TERMS)} AS term, round(len({WORDS}) / (len({WORDS}) + 200.0), 6) AS score FROM documents WHERE len({WORDS}) >= 64)
    SELECT doc_id, term AND score >= 0.5 AS strict, term OR score >= 0.5 AS greedy, term AND (1 - score) >= 0.5 AS turned FROM s
""")
def model_identify(t: Tables) -> DataFrame:
    n = F.size(X.words_ws(F.col("text")))
    s = t.documents.where(L.min_words(F.col("text"), 64)).select("doc_id", L.term_relevant(F.col("text"), TERMS, NOT_TERMS).alias("term"), F.round(n / (n + 200.0), 6).alias("score"))
    term, score = F.col("term"), F.col("score")
    return s.select("doc_id", L.model_relevant(term, score).alias("strict"), L.model_relevant(term, score, greedy=True).alias("greedy"), L.model_relevant(term, score, outcome=False).alias("turned"))


@query("truncated_words", "SELECT doc_id, CASE WHEN length(text) > 200 THEN array_to_string(string_split(text, ' ')[1:200], ' ') ELSE text END AS text FROM documents")
def truncated_words(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", L.first_words(F.col("text"), 200).alias("text"))


_LOW = "lower(text)"
_PHRASES = " AND ".join(f"NOT {sql_any(_LOW, p)}" for p in R.PAGE_PHRASES.values())


@query("page_filter", f"""
    SELECT doc_id, len({WORDS})::BIGINT AS words FROM documents
    WHERE len({WORDS}) > 50 AND {_PHRASES} AND len(string_split({_LOW}, 'chapter ')) + len(string_split({_LOW}, 'hoofdstuk ')) - 2 < 2 AND len({words_of(sql_fold("text", R.PAGE))}) > 25
""")
def page_filter(t: Tables) -> DataFrame:
    return t.documents.where(L.page_is_body(F.col("text"))).select("doc_id", F.size(X.words_ws(F.col("text"))).cast("long").alias("words"))


@query("line_quality", f"SELECT doc_id, len(list_filter({LINES}, lambda x: len(string_split(x, ' ')) > 10))::BIGINT AS long_lines, len({LINES}) >= 5 AS five_lines FROM documents WHERE len(list_filter({LINES}, lambda x: len(string_split(x, ' ')) > 10)) >= 3")
def line_quality(t: Tables) -> DataFrame:
    n = L.long_lines(F.col("text"))
    return t.documents.where(n >= 3).select("doc_id", n.cast("long").alias("long_lines"), (F.size(X.lines(F.col("text"))) >= 5).alias("five_lines"))


@query("exclude_values", "SELECT doc_id, lang, source FROM documents WHERE coalesce(lang NOT IN ('fr', 'de'), true) AND coalesce(source NOT IN ('src1', 'src2'), true) AND NOT (lang IS NULL AND source IS NULL) AND NOT contains(lower(text), 'token')")
def exclude_values(t: Tables) -> DataFrame:
    rows = L.exclude_values(t.documents, {"lang": ["fr", "de"], "source": ["src1", "src2"]}).na.drop("all", subset=["lang", "source"])
    return rows.where(~F.contains(F.lower("text"), F.lit("token"))).select("doc_id", "lang", "source")


@query("code_validity", "SELECT p_partkey, code, regexp_matches(code, '^[A-Z](?:[^a-z][0-9]{1,2}(?:[A-Z]{1,2}(?:[0-9]{1,2})?)?)?$') AS valid FROM (SELECT p_partkey, upper(p_type[1:1]) || p_size || upper(p_name[1:1]) || CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE '' END AS code FROM part)")
def code_validity(t: Tables) -> DataFrame:
    code = F.concat(F.upper(F.substring("p_type", 1, 1)), F.col("p_size").cast("string"), F.upper(F.substring("p_name", 1, 1)), F.when(F.col("p_partkey") % 3 == 0, "x").otherwise(""))
    return t.part.select("p_partkey", code.alias("code")).withColumn("valid", L.atc_valid(F.col("code")))


@query("link_routes", """
    SELECT page_id, CASE WHEN contains(lower(url), 'pills') THEN 'drop' WHEN ends_with(lower(url), '.pdf') THEN 'pdf' WHEN regexp_matches(url, '^https?://[^/]*\\.org/') THEN 'org' ELSE 'other' END AS route,
           list_filter(list_distinct_in_order, lambda x: starts_with(lower(x), '/t') OR ends_with(lower(x), '.')) AS links
    FROM (SELECT *, regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"''#>]+)', 1) AS list_distinct_in_order FROM (SELECT page_id, url, html FROM pages))
""".replace("list_filter(list_distinct_in_order", "list_filter(list_transform(list_filter(list_zip(list_distinct_in_order, range(1, len(list_distinct_in_order) + 1)), lambda z: list_position(list_distinct_in_order, z[1]) = z[2]), lambda z: z[1])").replace("\\\\", "\\"))
def link_routes(t: Tables) -> DataFrame:
    from ..sources.html import html_links

    low = F.lower("url")
    route = F.when(F.contains(low, F.lit("pills")), "drop").when(low.endswith(".pdf"), "pdf").when(F.col("url").rlike(r"^https?://[^/]*\.org/"), "org").otherwise("other")
    wanted = F.filter(html_links(F.col("html")), lambda x: F.lower(x).startswith("/t") | F.lower(x).endswith("."))
    return t.pages.select("page_id", route.alias("route"), wanted.alias("links"))


@query("keyword_lookup", r"""
    WITH terms AS (SELECT DISTINCT p_name AS term FROM part UNION SELECT unnest(['the', 'of the', 'la', 'was the', 'de la'])),
    w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
    g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')))) AS gram FROM w)
    SELECT doc_id, term, count(*) AS n FROM g JOIN terms ON lower(term) = gram GROUP BY ALL
""")
def keyword_lookup(t: Tables) -> DataFrame:
    terms = t.part.select(F.col("p_name").alias("term")).distinct().unionByName(t.spark.createDataFrame([(x,) for x in ("the", "of the", "la", "was the", "de la")], "term string")).distinct()
    return L.keyword_lookup(t.documents, terms, most_words=2)


@query("record_filter", """
    SELECT o_orderkey FROM orders WHERE (contains(lower(o_orderpriority), 'urgent') OR contains(lower(o_orderpriority), 'high')) AND o_orderstatus <> 'P' AND o_orderkey % 5 <> 0
""")
def record_filter(t: Tables) -> DataFrame:
    """Orders seen as catalogue records: topic, format, level and rights as arrays."""
    fmt = F.array(F.lit("application/pdf"))
    kind = F.array(F.when(F.col("o_orderstatus") != "P", "info:doctoralThesis").otherwise("article"))
    rights = F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit("embargoedAccess"))).otherwise(F.array(F.lit("openAccess")))
    return t.orders.where(L.record_relevant(F.array("o_orderpriority"), fmt, kind, rights, ["urgent", "high"])).select("o_orderkey")


@query("summary_routes", f"""
    WITH p AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user') AS nl, string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant') AS en FROM conversations GROUP BY conv_id),
    n AS (SELECT conv_id, coalesce(len({words_of("nl")}), 0) AS a, coalesce(len({words_of("en")}), 0) AS b FROM p)
    SELECT conv_id, CASE WHEN a > 25 AND b > 25 THEN 'paired' WHEN a > 25 THEN 'dutch' WHEN b > 25 THEN 'english' ELSE 'none' END AS route, round(CASE WHEN a > 0 AND b > 0 THEN log10(a::DOUBLE / b) END, 6) AS ratio FROM n
""")
def summary_routes(t: Tables) -> DataFrame:
    from ..operators.relational import concat_groups

    halves = [concat_groups(t.conversations.where(F.col("role") == r), ["conv_id"], ["turn"], "text", " ", n) for r, n in (("user", "nl"), ("assistant", "en"))]
    every = t.conversations.select("conv_id").distinct().join(halves[0], "conv_id", "left").join(halves[1], "conv_id", "left")
    a, b = (F.coalesce(F.when(F.col(c).isNotNull(), F.size(X.words_ws(F.col(c)))), F.lit(0)) for c in ("nl", "en"))
    route = F.when((a > 25) & (b > 25), "paired").when(a > 25, "dutch").when(b > 25, "english").otherwise("none")
    return every.select("conv_id", route.alias("route"), F.round(F.when((a > 0) & (b > 0), F.log10(a / b)), 6).alias("ratio"))


# --- personal data --------------------------------------------------------------------------------

_DIGIT = "list_sum(list_transform(range(1, 10), lambda i: {n}[i:i]::INT * CASE WHEN i = 9 THEN -1 ELSE 10 - i END))"


@query("pii_bsn", f"SELECT o_orderkey, n, {_DIGIT.format(n='n')} % 11 = 0 AS valid, CASE WHEN {_DIGIT.format(n='n')} % 11 = 0 THEN 'nr [BSN].' ELSE 'nr ' || n || '.' END AS masked FROM (SELECT o_orderkey, lpad(((o_orderkey * 7919 + 111222333) % 1000000000)::VARCHAR, 9, '0') AS n FROM orders)")
def pii_bsn(t: Tables) -> DataFrame:
    n = F.lpad(((F.col("o_orderkey") * 7919 + 111222333) % 1000000000).cast("string"), 9, "0")
    return t.orders.select("o_orderkey", n.alias("n")).select("o_orderkey", "n", pii.bsn_valid(F.col("n")).alias("valid"), pii.mask_bsn(F.concat(F.lit("nr "), F.col("n"), F.lit("."))).alias("masked"))


@query("pii_masks", _folded_sql(MASKS))
def pii_masks(t: Tables) -> DataFrame:
    return _folded(t.documents, MASKS)


@query("pii_placeholders", f"SELECT doc_id, {sql_fold('n', R.PLACEHOLDERS)} AS text FROM (SELECT doc_id, regexp_replace(text, '([0-9]+)', '[**Hospital1 \\1**] [**2150-1-\\1**] [**Doctor Last Name **] [**\\1**]', 'g') AS n FROM documents)")
def pii_placeholders(t: Tables) -> DataFrame:
    note = F.regexp_replace("text", "([0-9]+)", "[**Hospital1 $1**] [**2150-1-$1**] [**Doctor Last Name **] [**$1**]")
    return t.documents.select("doc_id", X.fold(note, R.PLACEHOLDERS).alias("text"))


@query("pii_deidentify")
def pii_deidentify(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", pii.deidentify(F.col("text"), patient=True, phone=True, date=True, url=True, doi=True, custom=R.EMAIL).alias("text"))


# --- chunks and repetition --------------------------------------------------------------------------


@query("word_chunks_fixed", f"""
    SELECT doc_id, k AS chunk, array_to_string(w[k * 100 + 1:(k + 1) * 100], ' ') AS text
    FROM (SELECT doc_id, {WORDS} AS w, unnest(range(0, ceil(len({WORDS}) / 100.0)::INT)) AS k FROM documents)
""")
def word_chunks_fixed(t: Tables) -> DataFrame:
    rows = C.chunk(t.documents, "doc_id", C.word_chunks(F.col("text"), 100))
    return rows.withColumn("chunk", F.col("chunk").cast("long"))


@query("chunk_votes", f"""
    WITH c AS (SELECT doc_id, array_to_string(w[k * 50 + 1:(k + 1) * 50], ' ') AS text FROM (SELECT doc_id, {WORDS} AS w, unnest(range(0, ceil(len({WORDS}) / 50.0)::INT)) AS k FROM documents))
    SELECT doc_id, avg(CASE WHEN contains(text, 'the ') THEN 1.0 ELSE 0.0 END) > 0.5 AS relevant FROM c GROUP BY doc_id
""")
def chunk_votes(t: Tables) -> DataFrame:
    return C.majority_vote(t.documents, "doc_id", "text", 50, lambda c: F.contains(c, F.lit("the ")))


@query("chunk_paragraphs")
def chunk_paragraphs(t: Tables) -> DataFrame:
    return C.chunk(t.documents, "doc_id", C.paragraph_chunks(F.col("text")))


@query("chunk_sentences")
def chunk_sentences(t: Tables) -> DataFrame:
    return C.chunk(t.documents, "doc_id", C.sentence_chunks(F.col("text")))


@query("chunk_chars")
def chunk_chars(t: Tables) -> DataFrame:
    return C.chunk(t.documents, "doc_id", C.char_chunks(F.col("text")))


@query("chunk_separated", "SELECT doc_id, text FROM documents WHERE text <> ''")
def chunk_separated(t: Tables) -> DataFrame:
    """Chunks that keep their separators, put together again."""
    from ..operators.relational import concat_groups

    return concat_groups(C.chunk(t.documents, "doc_id", C.separated_chunks(F.col("text"), 1000)), ["doc_id"], ["chunk"], "text", "")


@query("chunk_tokens")
def chunk_tokens(t: Tables) -> DataFrame:
    return C.chunk(t.documents, "doc_id", C.token_chunks(F.col("text"), 128))


@query("split_marked", """
    WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
    h AS (SELECT *, regexp_matches(line, 'tion[a-z]{3,9}')::INT AS hit FROM l),
    p AS (SELECT *, coalesce(sum(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS part FROM h)
    SELECT doc_id, part, max(CASE WHEN hit = 1 THEN regexp_replace(regexp_extract(line, '(tion[a-z]{3,9})', 1), '[^a-zA-Z0-9]', '', 'g')[1:20] END) AS tag, string_agg(line, chr(10) ORDER BY pos) AS text FROM p GROUP BY doc_id, part
""")
def split_marked(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("pos", "text"))
    return C.split_by_marker(rows, "doc_id", "pos", "text", "tion[a-z]{3,9}")


@query("split_bytes")
def split_bytes(t: Tables) -> DataFrame:
    return C.chunk(t.documents, "doc_id", C.split_by_bytes(F.col("text"), 1000))


@query("low_entropy_removed")
def low_entropy_removed(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", W.remove_low_entropy(F.col("text")).alias("text"))


@query("low_entropy_words")
def low_entropy_words(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", W.remove_low_entropy_words(F.col("text")).alias("text"))


@query("echoes_removed")
def echoes_removed(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", W.remove_echoes(F.col("text")).alias("text"))


@query("encoding_fixed", f"SELECT doc_id, text FROM documents WHERE NOT regexp_matches(text, {quoted('[^' + chr(1) + '-ÿ]')})")
def encoding_fixed(t: Tables) -> DataFrame:
    """Latin-1 texts broken by a wrong decoding of their UTF-8 and put right."""
    rows = t.documents.where(~F.col("text").rlike("[^\u0001-ÿ]"))
    return rows.select("doc_id", X.fix_encoding(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")).alias("text"))
