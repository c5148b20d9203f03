"""Registered retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.functions.text import snippet
from pagelake.functions.urls import title_from_url
from pagelake.functions.vectors import cosine_distance
from pagelake.operators import retrieval as R
from pagelake.plans.registry import V, query, rnd6, sql_ts, ts_str, with_views

_LATEST_PV = """latest_pv AS (
    SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, id DESC) AS rn
                    FROM page_versions) WHERE rn = 1)"""

_COS = """(1 - list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])
          / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[]))))"""

_RETRIEVED = with_views("page_versions", "chunks_v", "queries_all") + f""",
{_LATEST_PV},
scored AS (
    SELECT q.query_id, c.chunk_id, c.page_id, c.chunk_index, c.chunk_text,
           {_COS.format(a='q.embedding', b='c.embedding')} AS distance
    FROM queries_all q CROSS JOIN chunks_v c
    WHERE c.page_id IN (SELECT id FROM latest_pv)),
ranked AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank
                   FROM scored) WHERE rank <= 5),
retrieved AS (SELECT r.*, p.url FROM ranked r JOIN page_versions p ON p.id = r.page_id),
labeled AS (
    SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY first_rank) AS citation
    FROM (SELECT *, min(rank) OVER (PARTITION BY query_id, url) AS first_rank FROM retrieved))
"""


def _retrieved(spark, sf, k=5):
    pv = V(spark, sf, "page_versions")
    return R.retrieve(V(spark, sf, "queries_all"), V(spark, sf, "chunks_v"), pv, k)


def _labeled(spark, sf, k=5):
    return R.label_sources(_retrieved(spark, sf, k))


@query("R2_retrieve_topk", _RETRIEVED + """
SELECT query_id, CAST(rank AS BIGINT) AS rank, chunk_id, page_id, url, CAST(chunk_index AS BIGINT) AS chunk_index,
       CAST(citation AS BIGINT) AS citation, round(distance, 6) AS distance
FROM labeled""")
def r2(spark, sf):
    """Flagship: 5 nearest current chunks per query vector with citation numbers."""
    return _labeled(spark, sf).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "page_id", "url",
        F.col("chunk_index").cast("long").alias("chunk_index"), F.col("citation").cast("long").alias("citation"),
        rnd6("distance").alias("distance"))


@query("R1_cosine_distance", with_views("chunks_v") + f"""
SELECT a.chunk_id AS a_id, b.chunk_id AS b_id, round({_COS.format(a='a.embedding', b='b.embedding')}, 6) AS distance
FROM chunks_v a JOIN chunks_v b ON b.chunk_id = a.chunk_id + 1""")
def r1(spark, sf):
    """Cosine distance between consecutive vectors (a pure Catalyst expression)."""
    c = V(spark, sf, "chunks_v")
    a = c.select(F.col("chunk_id").alias("a_id"), F.col("embedding").alias("ea"))
    b = c.select(F.col("chunk_id").alias("b_id"), F.col("embedding").alias("eb"))
    return a.join(b, b.b_id == a.a_id + 1).select("a_id", "b_id", rnd6(cosine_distance("ea", "eb")).alias("distance"))


@query("R8_sources", _RETRIEVED + """
SELECT query_id, CAST(citation AS BIGINT) AS citation, url, chunk_text FROM labeled WHERE rank = first_rank""")
def r8(spark, sf):
    return R.sources(_labeled(spark, sf)).select(
        "query_id", F.col("citation").cast("long").alias("citation"), "url", "chunk_text")


@query("R9_prompts", _RETRIEVED + """
SELECT l.query_id,
       concat('Sources:' || chr(10),
              string_agg('[' || citation || '] ' || chunk_text, chr(10) || chr(10) ORDER BY rank),
              chr(10) || chr(10) || 'Question: ', max(q.query)) AS prompt
FROM labeled l JOIN queries_all q ON q.query_id = l.query_id
GROUP BY l.query_id""")
def r9(spark, sf):
    return R.build_prompts(_labeled(spark, sf), V(spark, sf, "queries_all")).select("query_id", "prompt")


@query("R10_ask_batch", _RETRIEVED + """
SELECT q.query_id,
       CASE WHEN p.prompt IS NULL THEN 'No relevant content has been indexed yet, so I can''t answer this from the scraped sources.' END AS answer,
       CAST(coalesce(p.n_sources, 0) AS BIGINT) AS n_sources, p.prompt
FROM queries_all q LEFT JOIN (
    SELECT l.query_id, max(citation) AS n_sources,
           concat('Sources:' || chr(10),
                  string_agg('[' || citation || '] ' || chunk_text, chr(10) || chr(10) ORDER BY rank),
                  chr(10) || chr(10) || 'Question: ', max(q.query)) AS prompt
    FROM labeled l JOIN queries_all q ON q.query_id = l.query_id GROUP BY l.query_id) p ON p.query_id = q.query_id""")
def r10(spark, sf):
    return R.ask_batch(V(spark, sf, "queries_all"), V(spark, sf, "chunks_v"), V(spark, sf, "page_versions"), 5)


@query("R11_citations", with_views("answers_v") + """
SELECT query_id, CAST(pos - 1 AS BIGINT) AS pos, CAST(n AS BIGINT) AS citation
FROM (SELECT query_id, unnest(nums) AS n, unnest(generate_series(1, len(nums))) AS pos
      FROM (SELECT query_id,
                   flatten(list_transform(regexp_extract_all(answer, '\\[\\s*\\d+(?:\\s*,\\s*\\d+)*\\s*\\]'),
                                          lambda b: regexp_extract_all(b, '\\d+'))) AS nums
            FROM answers_v))""")
def r11(spark, sf):
    return R.parse_citations(V(spark, sf, "answers_v")).select(
        "query_id", F.col("pos").cast("long").alias("pos"), "citation")


@query("R11_dangling_citations", _RETRIEVED + """,
answers AS (SELECT vec_id AS query_id, concat('Fact [1], both [1, 3] and [ ', vec_id % 7, ' ].') AS answer
            FROM embeddings),
parsed AS (SELECT query_id, unnest(nums) AS citation, unnest(generate_series(0, len(nums) - 1)) AS pos
           FROM (SELECT query_id,
                        flatten(list_transform(regexp_extract_all(answer, '\\[\\s*\\d+(?:\\s*,\\s*\\d+)*\\s*\\]'),
                                               lambda b: regexp_extract_all(b, '\\d+'))) AS nums FROM answers))
SELECT query_id, CAST(pos AS BIGINT) AS pos, CAST(citation AS BIGINT) AS citation FROM parsed p
WHERE NOT EXISTS (SELECT 1 FROM labeled l WHERE l.query_id = p.query_id AND l.citation = CAST(p.citation AS BIGINT))""")
def r11b(spark, sf):
    parsed = R.parse_citations(V(spark, sf, "answers_v"))
    srcs = R.sources(_labeled(spark, sf)).withColumn("citation", F.col("citation").cast("long"))
    return R.dangling_citations(parsed, srcs).select("query_id", F.col("pos").cast("long").alias("pos"), "citation")


# --- keyword search ------------------------------------------------------------

# The keyword queries of the registered search (one per language
# of the corpus, one with a LIKE wildcard, one phrase).
KEYWORDS = ["the", "que", "und", "les", "th_n", "revised"]

_KW_SQL = with_views("page_versions", "processed_v") + f""",
{_LATEST_PV},
qs AS (SELECT * FROM (VALUES {", ".join(f"('{q}')" for q in KEYWORDS)}) AS t(q)),
hits AS (
    SELECT qs.q, pr.id, pr.page_id, pr.text,
           row_number() OVER (PARTITION BY qs.q ORDER BY pr.page_id, pr.id) AS hit_no
    FROM processed_v pr JOIN qs ON pr.text ILIKE '%' || qs.q || '%'
    WHERE pr.page_id IN (SELECT id FROM latest_pv))
SELECT h.q AS query, CAST(h.hit_no AS BIGINT) AS hit_no, h.page_id, p.url,
       CASE WHEN strpos(lower(h.text), lower(h.q)) = 0 THEN substr(h.text, 1, 160)
            ELSE concat(CASE WHEN strpos(lower(h.text), lower(h.q)) - 1 - 80 > 0 THEN '...' ELSE '' END,
                        substr(h.text, greatest(0, strpos(lower(h.text), lower(h.q)) - 1 - 80) + 1,
                               least(length(h.text), strpos(lower(h.text), lower(h.q)) - 1 + length(h.q) + 80)
                               - greatest(0, strpos(lower(h.text), lower(h.q)) - 1 - 80)),
                        CASE WHEN least(length(h.text), strpos(lower(h.text), lower(h.q)) - 1 + length(h.q) + 80)
                                  < length(h.text) THEN '...' ELSE '' END) END AS snippet
FROM hits h JOIN page_versions p ON p.id = h.page_id
WHERE h.hit_no <= 10"""


@query("R3_keyword_search", _KW_SQL)
def r3(spark, sf):
    """Keyword search with snippets (R3 + R4) over the latest processed text."""
    return R.keyword_search(V(spark, sf, "processed_v"), V(spark, sf, "page_versions"), KEYWORDS, limit=10)


_KW_TABLE_SQL = _KW_SQL[:_KW_SQL.index("qs AS (")] + """qs AS (SELECT DISTINCT split_part(text, ' ', 1) AS q FROM benchmark
       WHERE split_part(text, ' ', 1) <> ''),
""" + _KW_SQL[_KW_SQL.index("hits AS ("):]


@query("R3_keyword_query_table", _KW_TABLE_SQL)
def r3_table(spark, sf):
    """Keyword search for a table of queries: the words that benchmark texts begin with."""
    asked = V(spark, sf, "benchmark").select(F.split_part("text", F.lit(" "), F.lit(1)).alias("query"))
    return R.keyword_search_table(V(spark, sf, "processed_v"), V(spark, sf, "page_versions"), asked)


@query("R4_snippet", """
SELECT doc_id,
       CASE WHEN strpos(lower(text), lower(source)) = 0 THEN substr(text, 1, 160)
            ELSE concat(CASE WHEN strpos(lower(text), lower(source)) - 1 - 80 > 0 THEN '...' ELSE '' END,
                        substr(text, greatest(0, strpos(lower(text), lower(source)) - 1 - 80) + 1,
                               least(length(text), strpos(lower(text), lower(source)) - 1 + length(source) + 80)
                               - greatest(0, strpos(lower(text), lower(source)) - 1 - 80)),
                        CASE WHEN least(length(text), strpos(lower(text), lower(source)) - 1 + length(source) + 80)
                                  < length(text) THEN '...' ELSE '' END) END AS snippet
FROM (SELECT doc_id, text, split_part(text, ' ', 3) AS source FROM documents)""")
def r4(spark, sf):
    """Snippet around the third word of each document (whole texts)."""
    d = V(spark, sf, "documents").withColumn("q", F.split_part(F.col("text"), F.lit(" "), F.lit(3)))
    return d.select("doc_id", snippet(F.col("text"), F.col("q")).alias("snippet"))


@query("R5_list_pages", with_views("page_versions") + f"""
SELECT id, url, sha256(extracted_text) AS content_hash, {sql_ts('fetched_at')} AS fetched_at,
       (SELECT count(*) FROM page_versions) AS total
FROM page_versions ORDER BY fetched_at DESC, id DESC LIMIT 20 OFFSET 40""")
def r5(spark, sf):
    from pagelake.plans.registry import page_log

    out = R.list_pages(page_log(spark, sf), limit=20, offset=40)
    return out.select("id", "url", "content_hash", ts_str("fetched_at").alias("fetched_at"),
                      F.col("total").cast("long").alias("total"))


@query("R6_list_processed", with_views("processed_v") + f"""
SELECT id, page_id, {sql_ts('processed_at')} AS processed_at, (SELECT count(*) FROM processed_v) AS total
FROM processed_v ORDER BY processed_at DESC, id DESC LIMIT 20 OFFSET 0""")
def r6(spark, sf):
    out = R.list_processed(V(spark, sf, "processed_v"), limit=20, offset=0)
    return out.select("id", "page_id", ts_str("processed_at").alias("processed_at"),
                      F.col("total").cast("long").alias("total"))


@query("R7_get_page", with_views("page_versions") + f"""
SELECT id, url, {sql_ts('fetched_at')} AS fetched_at, extracted_text FROM page_versions
WHERE id = (SELECT max(id) FROM page_versions)""")
def r7(spark, sf):
    pv = V(spark, sf, "page_versions")
    target = pv.agg(F.max("id").alias("id"))
    return pv.join(target, "id", "left_semi").select("id", "url", ts_str("fetched_at").alias("fetched_at"),
                                                     "extracted_text")


# The highlight query of the registered run.
HIGHLIGHT_Q = " the "


@query("R12_highlight", """
SELECT doc_id, regexp_replace(text, '(?i)the', '<mark>\\0</mark>', 'g') AS highlighted FROM documents""")
def r12(spark, sf):
    return R.highlight_matches(V(spark, sf, "documents"), "text", HIGHLIGHT_Q).select("doc_id", "highlighted")


@query("R13_title_from_url", with_views("product_pages") + """
SELECT url, CASE WHEN len(words) = 0 THEN url
                 ELSE array_to_string(list_transform(words, lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') END
            AS title
FROM (SELECT url, list_filter(string_split_regex(regexp_replace(
                 coalesce(list_filter(string_split(regexp_replace(url, '/index\\.html?$', ''), '/'), lambda x: x <> '')[-1], url),
                 '_[0-9]+$', ''), '[-_]'), lambda x: x <> '') AS words
      FROM (SELECT url FROM product_pages UNION ALL SELECT url FROM pages))""")
def r13(spark, sf):
    urls = V(spark, sf, "product_pages").select("url").unionByName(V(spark, sf, "pages").select("url"))
    return urls.select("url", title_from_url("url").alias("title"))
