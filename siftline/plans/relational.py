"""Queries on projections, joins, aggregates, windows, samples and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import relational as O
from .registry import LINES, NONWORD, WORDS, Tables, query

# --- projections ------------------------------------------------------------------------------


@query("stitched_fields", """
    SELECT o_orderkey, concat_ws(chr(10), nullif(o_orderstatus, 'P'), nullif(c_mktsegment, ''), o_orderpriority) AS joined,
           coalesce('Status: ' || nullif(o_orderstatus, 'P') || '; ', '') || coalesce('Segment: ' || c_mktsegment || '; ', '') AS stitched,
           'Status: ' || coalesce(nullif(o_orderstatus, 'P'), '') || ' Segment: ' || coalesce(c_mktsegment, '') AS template,
           coalesce(CASE WHEN length(o_orderpriority) > 8 THEN o_orderpriority END, CASE WHEN length(c_mktsegment) > 8 THEN c_mktsegment END, c_name) AS chosen,
           replace('code_' || o_orderstatus, '_', coalesce(c_mktsegment, '')) AS placed, CAST(o_orderdate AS DATE) AS day, year(o_orderdate)::INT AS y, CAST(trunc(o_totalprice) AS BIGINT) AS price
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey
""")
def stitched_fields(t: Tables) -> DataFrame:
    status, segment = F.nullif(F.col("o_orderstatus"), F.lit("P")), F.col("c_mktsegment")
    labelled = [F.coalesce(F.concat(F.lit(n), c, F.lit("; ")), F.lit("")) for n, c in (("Status: ", status), ("Segment: ", segment))]
    long = lambda c: F.when(F.length(c) > 8, F.col(c))
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        "o_orderkey", F.concat_ws("\n", status, F.nullif(segment, F.lit("")), "o_orderpriority").alias("joined"), F.concat(*labelled).alias("stitched"),
        F.format_string("Status: %s Segment: %s", F.coalesce(status, F.lit("")), F.coalesce(segment, F.lit(""))).alias("template"), F.coalesce(long("o_orderpriority"), long("c_mktsegment"), "c_name").alias("chosen"),
        F.replace(F.concat(F.lit("code_"), "o_orderstatus"), F.lit("_"), F.coalesce(segment, F.lit(""))).alias("placed"), F.to_date("o_orderdate").alias("day"), F.year("o_orderdate").alias("y"), F.col("o_totalprice").cast("long").alias("price"),
    )


@query("array_shapes", """
    SELECT doc_id, CASE WHEN len(a) = 1 THEN a[1] WHEN len(a) = 2 THEN a[2] || ':' || a[1] ELSE a[3] || ':' || a[2] || ':' || a[1] END AS shaped
    FROM (SELECT doc_id, string_split(text, ' ')[1:3] AS a FROM documents)
""")
def array_shapes(t: Tables) -> DataFrame:
    a = F.slice(X.words_space(F.col("text")), 1, 3)
    return t.documents.select("doc_id", F.array_join(F.reverse(a), ":").alias("shaped"))


@query("qa_pack_unpack", """
    WITH p AS (SELECT conv_id, turn, role, text AS q, lead(text) OVER w AS a, lead(role) OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    k AS (SELECT conv_id, turn, q || '|SPLIT|' || a AS packed FROM p WHERE role = 'user' AND r = 'assistant'),
    u AS (SELECT conv_id, turn, string_split(packed, '|SPLIT|') AS s FROM k)
    SELECT conv_id, turn, s[1] AS question, s[2] AS answer, len(string_split(s[2], ' '))::BIGINT AS words FROM u WHERE len(s) = 2
""")
def qa_pack_unpack(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = t.conversations.withColumns({"a": F.lead("text").over(w), "r": F.lead("role").over(w)}).where("role = 'user' AND r = 'assistant'")
    packed = pairs.select("conv_id", "turn", F.split(F.concat("text", F.lit("|SPLIT|"), "a"), r"\|SPLIT\|", -1).alias("s")).where(F.size("s") == 2)
    return packed.select("conv_id", "turn", F.col("s")[0].alias("question"), F.col("s")[1].alias("answer"), F.size(X.words_space(F.col("s")[1])).cast("long").alias("words"))


@query("multiple_choice", """
    SELECT p_partkey, p_brand || ',' || p_type AS options, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS answer FROM part
""")
def multiple_choice(t: Tables) -> DataFrame:
    options = F.create_map(F.lit("A"), F.col("p_brand"), F.lit("B"), F.col("p_type"))
    rows = t.part.select("p_partkey", options.alias("o"), F.when(F.col("p_size") % 2 == 0, "A").otherwise("B").alias("key"))
    return rows.select("p_partkey", F.array_join(F.map_values("o"), ",").alias("options"), F.element_at("o", F.col("key")).alias("answer"))


@query("section_markdown", """
    SELECT conv_id, string_agg('# ' || role || chr(10) || chr(10) || text, '' ORDER BY turn) AS text FROM conversations WHERE contains(role, 'user') OR NOT regexp_matches(role, 'system|team|update') GROUP BY conv_id
""")
def section_markdown(t: Tables) -> DataFrame:
    sections = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("s"))
    kept = F.filter("s", lambda x: F.contains(x["role"], F.lit("user")) | ~x["role"].rlike("system|team|update"))
    text = F.array_join(F.transform(kept, lambda x: F.concat(F.lit("# "), x["role"], F.lit("\n\n"), x["text"])), "")
    return sections.where(F.size(kept) > 0).select("conv_id", text.alias("text"))


@query("prompts", """
    SELECT doc_id, concat_ws(',', lang, source) AS meta, '{''instruction'': ''clean'',''text_to_transform'': ''' || text || '''}' AS request, 'Read: ' || text || '. Answer: x' AS filled FROM documents
""")
def prompts(t: Tables) -> DataFrame:
    from ..operators.models import after_marker, fill_template, prompt

    head = F.col("text")
    rows = t.documents.select("doc_id", F.concat_ws(",", "lang", "source").alias("meta"), prompt(F.lit("clean"), head).alias("request"), fill_template("Read: [INPUT]. Answer: x", head).alias("filled"))
    return rows.withColumn("filled", F.concat(F.substring_index("filled", "Answer:", 1), F.lit("Answer:"), after_marker(F.col("filled"), "Answer:")))


@query("exploded_steps", "SELECT doc_id, k, CASE k WHEN 0 THEN upper(text) ELSE reverse(upper(text)) END AS text FROM (SELECT doc_id, replace(text, 'ß', 'ss') AS text FROM documents WHERE text <> '') CROSS JOIN (SELECT unnest([0, 1])::BIGINT AS k)")
def exploded_steps(t: Tables) -> DataFrame:
    from ..operators.models import ModelSettings, run_model

    rows = t.documents.where("text <> ''").select("doc_id", F.replace("text", F.lit("ß"), F.lit("ss")).alias("text"))
    out = run_model(rows, "text", ModelSettings(instructions=("upper", "reverse")))
    return out.select("doc_id", F.posexplode("steps").alias("k", "text")).withColumn("k", F.col("k").cast("long"))


@query("flattened_meta", "SELECT event_id, user_id AS meta_user, event_type AS meta_kind_name, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events")
def flattened_meta(t: Tables) -> DataFrame:
    from ..sinks.files import flatten

    meta = F.struct(F.col("user_id").alias("user"), F.struct(F.col("event_type").alias("name")).alias("kind"))
    return flatten(t.events.select("event_id", meta.alias("meta"), F.from_json("props", "k long").alias("props")))


# --- joins --------------------------------------------------------------------------------------


@query("resume_antijoin", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def resume_antijoin(t: Tables) -> DataFrame:
    done = t.labels.withColumn("error_message", F.when(F.col("toxic") != 0, "failed"))
    return O.not_done(t.documents, done, "doc_id", "error_message").select("doc_id", "source")


@query("resume_ordered", "SELECT event_id FROM events WHERE event_id > (SELECT max(event_id) FROM events WHERE event_id IN (SELECT doc_id FROM labels))")
def resume_ordered(t: Tables) -> DataFrame:
    done = t.labels.select(F.col("doc_id").alias("event_id"))
    return O.after_done(t.events, done, "event_id", "event_id").select("event_id")


@query("label_join_quality", """
    SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(d.source, 'none') || ':' || coalesce(l.quality::VARCHAR, '-') AS combined
    FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id
""")
def label_join_quality(t: Tables) -> DataFrame:
    combined = F.concat(F.coalesce("source", F.lit("none")), F.lit(":"), F.coalesce(F.col("quality").cast("string"), F.lit("-")))
    return O.outer_combine(t.documents, t.labels, ["doc_id"], {"combined": combined})


@query("inner_on_index", "SELECT d.doc_id, quality, toxic FROM documents d JOIN labels l USING (doc_id)")
def inner_on_index(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id")


@query("asof_nearest_event", """
    WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), r AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'),
    b AS (SELECT l.event_id, l.user_id, l.ts, max_by(struct_pack(ts := r.ts, v := r.value), (r.ts, r.event_id)) AS h FROM l LEFT JOIN r ON l.user_id = r.user_id AND r.ts <= l.ts GROUP BY ALL),
    a AS (SELECT l.event_id, min_by(struct_pack(ts := r.ts, v := r.value), (r.ts, r.event_id)) AS h FROM l LEFT JOIN r ON l.user_id = r.user_id AND r.ts >= l.ts GROUP BY ALL)
    SELECT b.event_id, b.user_id, b.ts, CASE WHEN b.h.ts IS NOT NULL AND (a.h.ts IS NULL OR epoch_us(b.ts) - epoch_us(b.h.ts) <= epoch_us(a.h.ts) - epoch_us(b.ts)) THEN b.h.v ELSE a.h.v END AS near_value,
           CASE WHEN b.h.ts IS NOT NULL AND (a.h.ts IS NULL OR epoch_us(b.ts) - epoch_us(b.h.ts) <= epoch_us(a.h.ts) - epoch_us(b.ts)) THEN b.h.ts ELSE a.h.ts END AS near_value_ts
    FROM b JOIN a USING (event_id)
""")
def asof_nearest_event(t: Tables) -> DataFrame:
    left = t.events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    right = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    return O.asof_nearest(left, right, "user_id", "ts", "value", "event_id")


@query("lookup_default", "SELECT c_custkey, coalesce(n_name, 'Unknown') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON c_nationkey = n_nationkey")
def lookup_default(t: Tables) -> DataFrame:
    nations = t.nation.where("n_nationkey % 2 = 0").withColumnRenamed("n_nationkey", "c_nationkey")
    return O.lookup(t.customer, nations, "c_nationkey", "n_name").select("c_custkey", "n_name")


@query("cosine_seed_filter", """
    SELECT v.vec_id, s.vec_id AS seed, round(list_cosine_similarity(v.embedding::DOUBLE[], s.embedding::DOUBLE[]), 6) AS cosine
    FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id < 5) s WHERE list_cosine_similarity(v.embedding::DOUBLE[], s.embedding::DOUBLE[]) >= 0.5
""")
def cosine_seed_filter(t: Tables) -> DataFrame:
    seeds = t.embeddings.where("vec_id < 5").select(F.col("vec_id").alias("seed"), F.col("embedding").alias("s"))
    c = O.cosine(F.col("embedding"), F.col("s"))
    return t.embeddings.crossJoin(F.broadcast(seeds)).select("vec_id", "seed", c.alias("c")).where("c >= 0.5").select("vec_id", "seed", F.round("c", 6).alias("cosine"))


@query("overwrite_sources", "SELECT doc_id, source, 'old' AS state FROM documents WHERE source NOT IN ('src1', 'src2') UNION ALL SELECT doc_id + 1000000, source, 'new' FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en'")
def overwrite_sources(t: Tables) -> DataFrame:
    old = t.documents.select("doc_id", "source", F.lit("old").alias("state"))
    new = t.documents.where("source IN ('src1', 'src2') AND lang = 'en'").select((F.col("doc_id") + 1000000).alias("doc_id"), "source", F.lit("new").alias("state"))
    touched = t.documents.where("source IN ('src1', 'src2')").select("doc_id", "source").withColumn("state", F.lit("new"))
    return O.overwrite_sources(O.overwrite_sources(old, touched).where("state = 'old'"), new)


@query("manifest_changes", "SELECT url AS path, md5(html) AS md5 FROM pages EXCEPT SELECT url, CASE WHEN page_id % 3 = 0 THEN md5(html) ELSE '' END FROM pages")
def manifest_changes(t: Tables) -> DataFrame:
    local = t.pages.select(F.col("url").alias("path"), F.md5("html").alias("md5"))
    remote = t.pages.select(F.col("url").alias("path"), F.when(F.col("page_id") % 3 == 0, F.md5("html")).otherwise("").alias("md5"))
    return O.manifest_changes(local, remote).distinct()


# --- aggregates -----------------------------------------------------------------------------------


@query("conversation_concat", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def conversation_concat(t: Tables) -> DataFrame:
    return O.concat_groups(t.conversations, ["conv_id"], ["turn"], "text")


@query("two_level_concat", """
    SELECT user_id, string_agg(t, chr(10) ORDER BY day) AS text FROM (SELECT user_id, CAST(ts AS DATE) AS day, string_agg(event_type, '; ' ORDER BY event_id) AS t FROM events GROUP BY ALL) GROUP BY user_id
""")
def two_level_concat(t: Tables) -> DataFrame:
    days = O.concat_groups(t.events.withColumn("day", F.to_date("ts")), ["user_id", "day"], ["event_id"], "event_type", "; ", "t")
    return O.concat_groups(days, ["user_id"], ["day"], "t")


_STATS = f"count(*) AS documents, sum(len({LINES}))::BIGINT AS lines, sum(len({WORDS}))::BIGINT AS words, sum(length(text))::BIGINT AS chars, round(avg(len({LINES})), 6) AS mean_lines, round(avg(len({WORDS})), 6) AS mean_words"


@query("doc_stats_by_source", f"SELECT source, {_STATS} FROM documents GROUP BY ROLLUP (source)")
def doc_stats_by_source(t: Tables) -> DataFrame:
    return O.corpus_stats(t.documents, "source")


@query("corpus_vocab", f"SELECT count(*) AS words, count(DISTINCT w) AS vocabulary FROM (SELECT unnest({NONWORD}) AS w FROM documents) WHERE w <> ''")
def corpus_vocab(t: Tables) -> DataFrame:
    return O.vocabulary(t.documents)


@query("length_histogram", "SELECT CASE WHEN n < 0 THEN 0 WHEN n >= 10000 THEN 51 ELSE floor(n / 200)::BIGINT + 1 END AS bin, count(*) AS n FROM (SELECT length(text) AS n FROM documents) GROUP BY 1")
def length_histogram(t: Tables) -> DataFrame:
    return O.histogram(t.documents, F.length("text"), 0, 10000, 50)


@query("null_counts", "SELECT count(*) FILTER (lang IS NULL) AS lang, count(*) FILTER (source IS NULL) AS source, count(*) FILTER (text IS NULL) AS text FROM documents")
def null_counts(t: Tables) -> DataFrame:
    return O.null_counts(t.documents, ["lang", "source", "text"])


@query("condition_totals", "SELECT count(*) AS n, sum((lang = 'en')::INT)::BIGINT AS english, sum((n_chars > 1000)::INT)::BIGINT AS long, sum((lang = 'en' AND n_chars > 1000)::INT)::BIGINT AS kept FROM documents")
def condition_totals(t: Tables) -> DataFrame:
    en, long = F.col("lang") == "en", F.col("n_chars") > 1000
    return t.documents.agg(F.count("*").alias("n"), *[F.sum(c.cast("long")).alias(n) for n, c in (("english", en), ("long", long), ("kept", en & long))])


@query("topic_frequency", "SELECT topic, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS topic FROM part) GROUP BY topic")
def topic_frequency(t: Tables) -> DataFrame:
    return t.part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))


@query("type_counts", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL")
def type_counts(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", "user_id").agg(F.count("*").alias("n"))


@query("usage_totals", f"SELECT sum(len({WORDS}))::BIGINT AS tokens, round(sum(length(text) * 0.00002::DOUBLE), 6) AS cost, round(avg(length(text)), 6) AS mean_chars FROM documents")
def usage_totals(t: Tables) -> DataFrame:
    from ..operators.models import running_cost

    return t.documents.agg(F.sum(F.size(X.words_ws(F.col("text")))).alias("tokens"), F.round(F.sum(running_cost(F.col("text"))), 6).alias("cost"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))


@query("association_pairs", """
    WITH b AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS i FROM lineitem), n AS (SELECT count(DISTINCT k) AS total FROM b), o AS (SELECT i, count(*) AS c FROM b GROUP BY i),
    p AS (SELECT x.i AS a, y.i AS b, count(*) AS n FROM b x JOIN b y ON x.k = y.k AND x.i <> y.i GROUP BY ALL)
    SELECT a, b, p.n, round(p.n / total::DOUBLE, 6) AS support, round(p.n / oa.c::DOUBLE, 6) AS confidence, round(p.n * total / (oa.c * ob.c)::DOUBLE, 6) AS lift
    FROM p JOIN o oa ON oa.i = a JOIN o ob ON ob.i = b, n WHERE oa.c >= total * 0.0002 AND ob.c >= total * 0.0002 AND round(p.n / total::DOUBLE, 6) >= 0.0002 AND round(p.n / oa.c::DOUBLE, 6) >= 0.05
""")
def association_pairs(t: Tables) -> DataFrame:
    return O.pair_rules(t.lineitem, "l_orderkey", "l_suppkey", 0.0002, 0.05)


@query("frequent_sets", """
    WITH b AS (SELECT DISTINCT l_orderkey AS k, l_suppkey::VARCHAR AS i FROM lineitem), n AS (SELECT count(DISTINCT k) AS total FROM b)
    SELECT items, freq FROM (SELECT i AS items, count(*) AS freq FROM b GROUP BY i UNION ALL SELECT x.i || ',' || y.i, count(*) FROM b x JOIN b y ON x.k = y.k AND x.i < y.i GROUP BY ALL), n WHERE freq >= total * 0.0025
""")
def frequent_sets(t: Tables) -> DataFrame:
    sets, _ = O.frequent_itemsets(t.lineitem.select("l_orderkey", F.col("l_suppkey").cast("string").alias("i")), "l_orderkey", "i")
    return sets.where(F.size("items") <= 2).select(F.array_join(F.array_sort("items"), ",").alias("items"), "freq")


@query("pooled_vectors", """
    WITH d AS (SELECT label, unnest(range(64)) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings)
    SELECT label, list(m ORDER BY d) AS mean, list(h ORDER BY d) AS median, list(t ORDER BY d) AS highest
    FROM (SELECT label, d, round(avg(x), 6) AS m, round(median(x), 6) AS h, round(max(x), 6) AS t FROM d GROUP BY ALL) GROUP BY label
""")
def pooled_vectors(t: Tables) -> DataFrame:
    pools = [O.pool_vectors(t.embeddings, "label", "embedding", how).withColumnRenamed("embedding", name) for how, name in (("mean", "mean"), ("median", "median"), ("max", "highest"))]
    return pools[0].join(pools[1], "label").join(pools[2], "label")


# --- windows --------------------------------------------------------------------------------------


@query("cumcount_events", "SELECT event_id, user_id || '_' || row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS key FROM events")
def cumcount_events(t: Tables) -> DataFrame:
    rows = O.running_number(t.events, ["user_id"], ["ts", "event_id"])
    return rows.select("event_id", F.concat_ws("_", "user_id", "n").alias("key"))


@query("ffill_events", "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM events")
def ffill_events(t: Tables) -> DataFrame:
    rows = t.events.withColumn("value", F.when(F.col("event_type") == "click", F.col("value")))
    return O.fill_forward(rows, ["user_id"], ["ts", "event_id"], ["value"]).select("event_id", "value")


_BUFFER = f"""
    WITH l AS (SELECT doc_id, unnest(range(len({LINES}))) AS pos, unnest({LINES}) AS line FROM documents), f AS (SELECT *, regexp_matches(line, '[:;.]')::INT AS e FROM l),
    b AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS buffer FROM f)
    SELECT doc_id, buffer, string_agg(line, '' ORDER BY pos) AS text FROM b GROUP BY doc_id, buffer
"""


@query("sentence_buffer", _BUFFER)
def sentence_buffer(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("pos", "text"))
    return O.sentence_buffer(rows, "doc_id", "pos", "text")


@query("bad_transitions", """
    SELECT conv_id, turn, role, before FROM (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), 'START') AS before FROM conversations)
    WHERE before || '>' || role NOT IN ('START>system', 'system>user', 'user>assistant', 'assistant>user')
""")
def bad_transitions(t: Tables) -> DataFrame:
    allowed = {("START", "system"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}
    return O.bad_transitions(t.conversations, "conv_id", "turn", "role", allowed).select("conv_id", "turn", "role", "before")


# --- samples, splits, order -------------------------------------------------------------------------


@query("sample_k", "SELECT doc_id FROM documents ORDER BY md5(doc_id || '|7'), doc_id LIMIT 50")
def sample_k(t: Tables) -> DataFrame:
    return O.sample_k(t.documents, "doc_id", 50, 7).select("doc_id")


@query("sample_fraction", "SELECT doc_id FROM documents WHERE ('0x' || md5(doc_id || '|3')[1:8])::BIGINT < 0.1 * 4294967296")
def sample_fraction(t: Tables) -> DataFrame:
    return O.sample_fraction(t.documents, "doc_id", 0.1, 3).select("doc_id")


@query("sample_replacement")
def sample_replacement(t: Tables) -> DataFrame:
    return O.sample_with_replacement(t.embeddings.select("vec_id"), 0.5, 11)


@query("stratified_sample", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || '|5'), doc_id) AS r FROM documents) WHERE r <= 5")
def stratified_sample(t: Tables) -> DataFrame:
    return O.sample_per_group(t.documents, "source", "doc_id", 5, 5).select("doc_id", "source")


@query("split_90_5_5", """
    SELECT doc_id, CASE WHEN r <= floor(n * 0.05) THEN 'validation' WHEN r <= 2 * floor(n * 0.05) THEN 'test' ELSE 'train' END AS split
    FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || '|9'), doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)
""")
def split_90_5_5(t: Tables) -> DataFrame:
    return O.split_sets(t.documents, "source", "doc_id", seed=9).select("doc_id", "split")


@query("balanced_groups", """
    SELECT c_custkey, slot, (n * 2 + slot) % 7 AS "group" FROM (SELECT c_custkey, row_number() OVER (ORDER BY md5(c_custkey || '|1'), c_custkey) - 1 AS n FROM customer) CROSS JOIN (SELECT unnest([0, 1])::BIGINT AS slot)
""")
def balanced_groups(t: Tables) -> DataFrame:
    return O.balanced_groups(t.customer, "c_custkey", 7, seed=1)


@query("topk_knn", """
    SELECT vec_id, round(list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS distance FROM embeddings WHERE vec_id <> 0 ORDER BY distance, vec_id LIMIT 10
""")
def topk_knn(t: Tables) -> DataFrame:
    q = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))
    rows = t.embeddings.where("vec_id <> 0").crossJoin(F.broadcast(q))
    return O.nearest(rows, F.col("q"), "embedding", "vec_id", 10)


@query("line_parts", "SELECT doc_id, floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 10)::BIGINT AS part FROM documents")
def line_parts(t: Tables) -> DataFrame:
    from ..sinks.files import line_parts as parts

    rows = O.running_number(t.documents, ["source"], ["doc_id"], "line").withColumn("line", F.col("line") - 1)
    return parts(rows, "line", 10).select("doc_id", "part")


# --- sets ------------------------------------------------------------------------------------------


@query("unionall_sources", "SELECT c_custkey AS key, c_name AS name, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier")
def unionall_sources(t: Tables) -> DataFrame:
    suppliers = t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"))
    return t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit("customer").alias("kind")).unionByName(suppliers)


@query("distinct_links", "SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages")
def distinct_links(t: Tables) -> DataFrame:
    return t.pages.select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host")).distinct()


@query("set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").exceptAll(t.labels.select("doc_id")).distinct()


@query("term_union", "SELECT o_orderkey, list_sort(list_distinct(list_concat([o_orderstatus, 'x'], [o_orderpriority, 'x']))) AS terms FROM orders")
def term_union(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.array_sort(F.array_union(F.array("o_orderstatus", F.lit("x")), F.array("o_orderpriority", F.lit("x")))).alias("terms"))
