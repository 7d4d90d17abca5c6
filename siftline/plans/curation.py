"""Queries on deduplication, spans, parsers and guideline sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dedup as D
from ..operators import guidelines as G
from ..operators import spans as S
from .registry import LINES, Tables, query, words_of


@query("exact_dedup", "SELECT doc_id, source, n AS copies FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY sha256(text)) AS n FROM documents) WHERE k = 1")
def exact_dedup(t: Tables) -> DataFrame:
    return D.dedup_exact(t.documents).select("doc_id", "source", "copies")


@query("prefix_fingerprint_dedup", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY regexp_replace(lower(text[1:500]), '[^a-zA-Z0-9]', '', 'g') ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def prefix_fingerprint_dedup(t: Tables) -> DataFrame:
    return D.dedup_opening(t.documents).select("doc_id")


@query("title_dedup", "SELECT page_id, title FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY page_id) AS k FROM (SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages)) WHERE k = 1")
def title_dedup(t: Tables) -> DataFrame:
    from ..sources.html import html_title

    return D.first_per_key(t.pages.select("page_id", html_title(F.col("html")).alias("title")), ["title"], ["page_id"])


@query("merged_names", """
    SELECT p_name AS name, arg_min(p_type, p_partkey) AS text, list(p_brand ORDER BY p_partkey) AS urls, count(*) - 1 AS duplicates, sum((p_type = f)::INT)::BIGINT - 1 AS same_text
    FROM (SELECT *, first_value(p_type) OVER (PARTITION BY p_name ORDER BY p_partkey) AS f FROM part) GROUP BY p_name
""")
def merged_names(t: Tables) -> DataFrame:
    return D.merge_names(t.part.select(F.col("p_name").alias("name"), F.col("p_type").alias("text"), F.col("p_brand").alias("url"), F.col("p_partkey").alias("pos")))


@query("pruned_subarticles", """
    WITH a AS (SELECT p_partkey, p_name || CASE WHEN p_partkey % 50 = 0 THEN ' overview' ELSE ' ' || p_partkey END AS name FROM part),
    s AS (SELECT DISTINCT trim(replace(name, 'overview', '')) AS subject FROM a WHERE ends_with(name, 'overview'))
    SELECT p_partkey, name FROM a WHERE NOT ends_with(name, 'overview') AND NOT EXISTS (SELECT 1 FROM s WHERE starts_with(name, subject))
    UNION ALL SELECT p_partkey, trim(replace(name, 'overview', '')) FROM a WHERE ends_with(name, 'overview')
""")
def pruned_subarticles(t: Tables) -> DataFrame:
    name = F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 50 == 0, " overview").otherwise(F.concat(F.lit(" "), F.col("p_partkey").cast("string"))))
    return D.prune_subarticles(t.part.select("p_partkey", name.alias("name")))


@query("frequent_line_dedup", f"""
    WITH l AS (SELECT doc_id, unnest(range(len({LINES}))) AS pos, unnest({LINES}) AS line FROM documents), f AS (SELECT line FROM l WHERE length(line) >= 1 GROUP BY line HAVING count(*) > 2)
    SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM l ANTI JOIN f USING (line) GROUP BY doc_id
""")
def frequent_line_dedup(t: Tables) -> DataFrame:
    return D.dedup_lines(t.documents.select("doc_id", "text"), most=2)


@query("ngram_dup_ratio", f"""
    WITH g AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END AS g FROM (SELECT doc_id, {words_of("text")} AS w FROM documents))
    SELECT doc_id, coalesce(round((len(g) - len(list_distinct(g)))::DOUBLE / len(g), 6), 0.0) AS share FROM g
""")
def ngram_dup_ratio(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", D.duplicate_ngram_share(F.col("text")).alias("share"))


@query("minhash_near_dups")
def minhash_near_dups(t: Tables) -> DataFrame:
    return D.minhash_pairs(t.documents)


@query("similar_names", """
    WITH r AS (SELECT page_id, url AS t, regexp_extract(url, '^https?://([^/?#]+)', 1) AS b FROM pages)
    SELECT x.page_id AS a, y.page_id AS b, round(1 - levenshtein(x.t, y.t) / greatest(length(x.t), length(y.t))::DOUBLE, 6) AS score
    FROM r x JOIN r y ON x.b = y.b AND x.page_id < y.page_id WHERE round(1 - levenshtein(x.t, y.t) / greatest(length(x.t), length(y.t))::DOUBLE, 6) >= 0.9
""")
def similar_names(t: Tables) -> DataFrame:
    return D.similar_pairs(t.pages, F.regexp_extract("url", "^https?://([^/?#]+)", 1), "page_id", "url")


@query("similar_names_jaro", """
    WITH r AS (SELECT page_id, url AS t, regexp_extract(url, '^https?://([^/?#]+)', 1) AS b FROM pages)
    SELECT x.page_id AS a, y.page_id AS b, round(jaro_similarity(x.t, y.t), 6) AS score FROM r x JOIN r y ON x.b = y.b AND x.page_id < y.page_id WHERE round(jaro_similarity(x.t, y.t), 6) >= 0.9
""")
def similar_names_jaro(t: Tables) -> DataFrame:
    return D.similar_pairs(t.pages, F.regexp_extract("url", "^https?://([^/?#]+)", 1), "page_id", "url", "jaro")


# --- spans: the capitalised words of a text stand in for annotations -----------------------------------


def _spans(t: Tables) -> DataFrame:
    words = F.split("text", " ", -1)
    starts = F.aggregate(words, F.struct(F.array().cast("array<struct<start:int,end:int,text:string,tag:string,cui:string>>").alias("s"), F.lit(0).alias("at")), _add_span, lambda a: a["s"])
    return t.benchmark.select(F.col("item_id").alias("id"), "text", starts.alias("tags"))


def _add_span(acc, w):
    end = acc["at"] + F.length(w)
    span = F.struct(acc["at"].alias("start"), end.alias("end"), w.alias("text"), F.lit("WORD").alias("tag"), F.concat(F.lit("C"), F.length(w).cast("string")).alias("cui"))
    return F.struct(F.when(w.rlike("^[A-Z]"), F.concat(acc["s"], F.array(span))).otherwise(acc["s"]).alias("s"), (end + 1).alias("at"))


@query("span_inject", "SELECT item_id AS id, array_to_string(list_transform(string_split(text, ' '), lambda w: CASE WHEN regexp_matches(w, '^[A-Z]') THEN '[[' || w || '][C' || length(w) || ']]' ELSE w END), ' ') AS text FROM benchmark")
def span_inject(t: Tables) -> DataFrame:
    return _spans(t).select("id", S.inject(F.col("text"), F.col("tags")).alias("text"))


_SPANS_SQL = """
    WITH w AS (SELECT item_id, text, string_split(text, ' ') AS w FROM benchmark),
    p AS (SELECT item_id, text, unnest(range(1, len(w) + 1)) AS i, w FROM w),
    s AS (SELECT item_id, i, w[i] AS surface, CASE WHEN i = 1 THEN 0 ELSE length(array_to_string(w[1:i - 1], ' ')) + 1 END AS start FROM p WHERE regexp_matches(w[i], '^[A-Z]'))
"""


@query("standoff_lines", _SPANS_SQL + "SELECT item_id AS id, n, 'T' || (n + 1) || chr(9) || 'WORD ' || start || ' ' || (start + length(surface)) || chr(9) || surface AS line FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY start) - 1 AS n FROM s)")
def standoff_lines(t: Tables) -> DataFrame:
    return S.to_brat(_spans(t)).withColumn("n", F.col("n").cast("long"))


@query("standoff_parsed", _SPANS_SQL + "SELECT item_id AS id, any_value(text) AS text, list(struct_pack(\"start\" := start::INT, \"end\" := (start + length(surface))::INT, tag := 'WORD') ORDER BY start) AS tags FROM s JOIN benchmark USING (item_id) GROUP BY item_id")
def standoff_parsed(t: Tables) -> DataFrame:
    from ..sources.annotations import ner_records, standoff_spans

    spans = _spans(t)
    rows = S.to_brat(spans).select("id", standoff_spans(F.col("line")).alias("s")).where("s IS NOT NULL").select("id", "s.start", "s.end", "s.tag")
    return ner_records(rows, spans)


@query("span_table", _SPANS_SQL + "SELECT item_id AS name, 'WORD' AS tag, start::INT AS start_span, (start + length(surface))::INT AS end_span, surface AS text, '' AS comment, length(surface)::INT AS size FROM s")
def span_table(t: Tables) -> DataFrame:
    return S.to_table(_spans(t)).withColumn("size", S.span_length(F.struct(F.col("start_span").alias("start"), F.col("end_span").alias("end"))))


@query("spans_resolved", _SPANS_SQL + "SELECT item_id AS id, count(*) AS n FROM s GROUP BY item_id")
def spans_resolved(t: Tables) -> DataFrame:
    """Spans with shorter ones inside them, resolved to the longest."""
    doubled = F.concat("tags", F.transform("tags", lambda s: s.withField("end", s["end"] - 1)))
    return _spans(t).where(F.size("tags") > 0).select("id", F.size(S.resolve_overlaps(doubled)).cast("long").alias("n"))


@query("token_tags")
def token_tags(t: Tables) -> DataFrame:
    return _spans(t).select("id", F.posexplode(S.token_tags(F.col("text"), F.col("tags"))).alias("k", "t")).select("id", "k", "t.*")


@query("merged_annotations", f"SELECT source, string_agg(line, chr(10) ORDER BY doc_id, pos) AS text FROM (SELECT source, doc_id, unnest(range(len({LINES}))) AS pos, unnest({LINES}) AS line FROM documents) WHERE trim(line) <> '' GROUP BY source")
def merged_annotations(t: Tables) -> DataFrame:
    return S.merge_annotations(t.documents, "source", "doc_id", "text")


def _pubtator(t: Tables) -> DataFrame:
    body = F.regexp_replace("text", "[\n|]", " ")
    text = F.concat(F.format_string("%d|t|Title %d\n%d|a|", "item_id", "item_id", "item_id"), body, F.format_string("\n%d\t0\t5\tTitle\tT%d\tC1\n\n", "item_id", F.col("item_id") % 3))
    return t.benchmark.groupBy((F.col("item_id") % 4).cast("string").alias("file")).agg(F.array_join(F.array_sort(F.collect_list(text)), "").alias("text"))


@query("pubtator_parsed", r"""
    SELECT item_id AS id, 'Title ' || item_id AS title, 'Title ' || item_id || ' ' || regexp_replace(text, '[\n|]', ' ', 'g') AS text,
           [struct_pack("start" := 0, "end" := 5, text := 'Title', tag := CASE WHEN item_id % 3 = 2 THEN 'Unknown' ELSE 'G' || item_id % 3 END, cui := 'C1')] AS tags FROM benchmark
""")
def pubtator_parsed(t: Tables) -> DataFrame:
    from ..sources.annotations import pubtator

    groups = t.spark.createDataFrame([("T0", "G0"), ("T1", "G1")], "tui string, `group` string")
    return pubtator(_pubtator(t), groups)


@query("pubtator_errors", "SELECT '' AS line WHERE false")
def pubtator_errors(t: Tables) -> DataFrame:
    from ..sources.annotations import pubtator_errors as errors

    return errors(_pubtator(t)).select("line")


# --- pages -------------------------------------------------------------------------------------------


@query("html_text")
def html_text(t: Tables) -> DataFrame:
    from ..sources.html import html_text as text

    return t.pages.select("page_id", text(F.col("html")).alias("text"))


@query("html_titles", "SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages")
def html_titles(t: Tables) -> DataFrame:
    from ..sources.html import html_title

    return t.pages.select("page_id", html_title(F.col("html")).alias("title"))


@query("body_paragraphs", r"SELECT page_id, k, p AS paragraph FROM (SELECT page_id, unnest(range(len(l))) AS k, unnest(l) AS p FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<article(?:\s[^>]*)?>(.*?)</article>', 1), '(?s)<p(?:\s[^>]*)?>(.*?)</p>', 1) AS l FROM pages))")
def body_paragraphs(t: Tables) -> DataFrame:
    from ..sources.files import body_paragraphs as paragraphs

    return t.pages.select("page_id", F.posexplode(paragraphs(F.col("html"), "article")).alias("k", "paragraph")).withColumn("k", F.col("k").cast("long"))


@query("thesis_summaries")
def thesis_summaries(t: Tables) -> DataFrame:
    """Conversations as files, turns as pages; the first page after the system's is headed as a summary."""
    from ..operators.pages import summaries

    pages = t.conversations.select(F.col("conv_id").alias("file"), F.col("turn").alias("pseudo_pagenum"), F.concat(F.when(F.col("turn") == 1, "Summary\n").otherwise(""), F.col("text")).alias("text"))
    return summaries(pages)


@query("scanned_files", "SELECT conv_id, avg((length(trim(text)) = 0)::INT) > 0.5 AS scanned FROM conversations GROUP BY conv_id")
def scanned_files(t: Tables) -> DataFrame:
    from ..operators.pages import is_scan

    return is_scan(t.conversations, "conv_id", "text")


# --- guidelines -----------------------------------------------------------------------------------------


def _guidelines(t: Tables) -> DataFrame:
    """Documents as guidelines of the eighteen sources, in turn."""
    names = F.array(*[F.lit(n) for n in sorted(G.SOURCES)])
    source = F.element_at(names, (F.pmod("doc_id", F.lit(len(G.SOURCES))) + 1).cast("int"))
    title = F.substring_index("text", "\n", 1)
    return t.documents.select(source.alias("source"), F.col("doc_id").alias("position"), title.alias("title"), F.col("text"), F.concat(F.lit("http://example.org/"), "doc_id").alias("url"), F.lit(None).cast("string").alias("overview"))


@query("guidelines")
def guidelines(t: Tables) -> DataFrame:
    return G.process_guidelines(_guidelines(t))


@query("guideline_ids", """
    WITH g AS (SELECT doc_id, ['aafp', 'cco', 'cdc', 'cdc_diseases', 'cma', 'cma_pdfs', 'cps', 'drugs', 'gc', 'icrc', 'idsa', 'magic', 'mayo', 'nice', 'rch', 'spor', 'who', 'wikidoc'][doc_id % 18 + 1] AS source FROM documents)
    SELECT doc_id, source, sha1(source || (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)) AS id FROM g
""")
def guideline_ids(t: Tables) -> DataFrame:
    return G.with_ids(_guidelines(t)).select(F.col("position").alias("doc_id"), "source", "id")


@query("combined_sources", "SELECT doc_id, source FROM documents WHERE length(text) > 10 AND (contains(source, 'src1') OR contains(source, '7'))")
def combined_sources(t: Tables) -> DataFrame:
    return G.combine_sources(t.documents.withColumnRenamed("text", "clean_text"), only=["src1", "7"]).select("doc_id", "source")


@query("dataset_card", f"""
    SELECT '---' || chr(10) || 'language: [' || array_to_string(list_sort(list(DISTINCT lang)), ', ') || ']' || chr(10) || 'size_category: ' || CASE WHEN count(*) < 1000 THEN 'n<1K' WHEN count(*) < 100000 THEN '1K<n<100K' ELSE 'n>100K' END || chr(10) || '---' || chr(10)
           || '# corpus' || chr(10) || chr(10) || 'Invented prose.' || chr(10) || chr(10) || '| documents | words | sources |' || chr(10) || '|---|---|---|' || chr(10)
           || '| ' || count(*) || ' | ' || sum(len({words_of("text")})) || ' | ' || count(DISTINCT source) || ' |' || chr(10) AS card FROM documents
""")
def dataset_card(t: Tables) -> DataFrame:
    from ..sinks.files import dataset_card as card

    return card(t.documents, "corpus", "Invented prose.")


@query("foreign_lines", """
    WITH l AS (SELECT conv_id, CASE WHEN regexp_matches(text, '[éèñçüß]') THEN 'xx' ELSE 'en' END AS lang FROM conversations)
    SELECT conv_id, avg((lang <> 'en')::INT::DOUBLE) AS foreign_ FROM l GROUP BY conv_id HAVING avg((lang <> 'en')::INT::DOUBLE) <= 0.5
""")
def foreign_lines(t: Tables) -> DataFrame:
    from ..operators.filters import foreign_share

    lang = F.when(F.col("text").rlike("[éèñçüß]"), "xx").otherwise("en")
    return foreign_share(t.conversations.select("conv_id", lang.alias("lang")), "conv_id", "lang", "en").withColumnRenamed("foreign", "foreign_")


@query("column_cleaning", "SELECT c_custkey, upper(c_name) AS c_name, upper(c_mktsegment) AS c_mktsegment FROM customer")
def column_cleaning(t: Tables) -> DataFrame:
    """A function over every text column, as a step of a pipeline."""
    from ..operators.pipeline import Pipeline, over_text_columns

    steps = [("narrow", lambda d: d.select("c_custkey", "c_name", "c_mktsegment")), ("upper", lambda d: over_text_columns(d, F.upper))]
    return Pipeline(steps).fit_transform(t.customer)


@query("line_documents", f"SELECT doc_id || '_' || pos AS id, line AS text FROM (SELECT doc_id, unnest(range(len({LINES}))) AS pos, unnest({LINES}) AS line FROM documents)")
def line_documents(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("pos", "text")).select(F.concat_ws("_", "doc_id", "pos").alias("id"), "text")
