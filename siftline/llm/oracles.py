"""DuckDB SQL for the queries of this subpackage that SQL can express."""

ORACLES: dict[str, str] = {
    "op3_exact_dedup": """
        SELECT text, any_value(w.doc_id) AS doc_id, any_value(w.lang) AS lang, any_value(w.source) AS source,
               any_value(w.n_chars) AS n_chars, any_value(n) AS copies
        FROM (SELECT text, arg_min(struct_pack(doc_id := doc_id, lang := lang, source := source, n_chars := n_chars), doc_id) AS w,
                     count(*) AS n FROM documents GROUP BY text)
        GROUP BY text
    """,
    "op4_warc_revisits": """
        WITH r AS (SELECT DISTINCT page_id, url, coalesce(html, '') AS html, 'sha1:' || sha1(coalesce(html, '')) AS digest FROM pages),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY page_id::VARCHAR NULLS LAST, url NULLS LAST) AS k,
                          first_value(page_id) OVER w AS o_page, first_value(url) OVER w AS o_url
                   FROM r WINDOW w AS (PARTITION BY digest ORDER BY page_id::VARCHAR NULLS LAST, url NULLS LAST)),
        named AS (
          SELECT *, md5(concat_ws(' ', digest, coalesce(o_page::VARCHAR, ''), coalesce(o_url, ''), '', 'response')) AS o,
                 octet_length(encode(html)) AS bytes FROM ranked),
        ided AS (
          SELECT *, '<urn:uuid:' || o[1:8] || '-' || o[9:12] || '-' || o[13:16] || '-' || o[17:20] || '-' || o[21:32] || '>' AS o_id FROM named),
        own AS (
          SELECT *, CASE WHEN k > 1 THEN md5(concat_ws(' ', digest, coalesce(page_id::VARCHAR, ''), coalesce(url, ''), '', 'revisit', o_id)) END AS m FROM ided)
        SELECT page_id, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS type,
               CASE WHEN k = 1 THEN o_id ELSE '<urn:uuid:' || m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] || '>' END AS record_id,
               url, digest, CASE WHEN k > 1 THEN o_id END AS refers_to, CASE WHEN k > 1 THEN o_url END AS refers_to_uri,
               CAST(CASE WHEN k > 1 THEN 19 ELSE 17 + 40 + 16 + length(bytes::VARCHAR) + 4 + bytes END AS BIGINT) AS content_length,
               CASE WHEN k = 1 THEN html END AS payload
        FROM own
    """,
    "op9_line_dedup": """
        WITH lines AS (
          SELECT doc_id, p - 1 AS pos, l[p] AS line, len(l) AS n
          FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) d, unnest(range(1, len(l) + 1)) AS u(p)),
        wins AS (
          SELECT doc_id, pos, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS win
          FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
        later AS (
          SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS k FROM wins WHERE win IS NOT NULL) WHERE k > 1),
        gone AS (SELECT DISTINCT doc_id, pos + i AS pos FROM later, range(3) r(i)),
        kept AS (
          SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM lines ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
        SELECT d.doc_id, k.text, d.lang, d.source, CAST(length(k.text) AS BIGINT) AS n_chars
        FROM documents d JOIN kept k USING (doc_id)
    """,
    "op8_topk_search": """
        WITH words AS (
          SELECT doc_id, unnest(regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS w FROM documents),
        lengths AS (SELECT doc_id, count(*) AS len FROM words GROUP BY doc_id),
        corpus AS (SELECT count(*) AS n, sum(len)::DOUBLE / count(*) AS mean FROM lengths),
        asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS w FROM benchmark),
        tf AS (SELECT doc_id, w, count(*) AS tf FROM words WHERE w IN (SELECT w FROM asked) GROUP BY doc_id, w),
        idf AS (SELECT w, ln(1 + (n - count(*)::DOUBLE + 0.5) / (count(*)::DOUBLE + 0.5)) AS idf FROM tf, corpus GROUP BY w, n),
        impact AS (
          SELECT doc_id, w, floor(idf * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean)) * 1000 + 0.5)::BIGINT AS weight
          FROM tf JOIN idf USING (w) JOIN lengths USING (doc_id), corpus),
        score AS (SELECT item_id, doc_id, sum(weight)::BIGINT AS score FROM asked JOIN impact USING (w) WHERE weight > 0 GROUP BY item_id, doc_id)
        SELECT item_id, rank::INT AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score) WHERE rank <= 10
    """,
}
