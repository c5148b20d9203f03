"""Registered processing-pipeline queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pagelake.functions.html import html_text, strip_ws
from pagelake.operators import pipeline as PL
from pagelake.operators.planning import classify_fetch, resolve_attempts
from pagelake.plans import sqlfrag as S
from pagelake.plans.q_columns import _ALL_PAGES_TAIL, _TABLE_ROWS_TAIL
from pagelake.plans.registry import V, page_observations, query, rnd6, with_views
from pagelake.sources import tables as io


@query("P1_pending", with_views("page_versions", "processed_v", "chunks_v") + """
SELECT id, page_id FROM processed_v WHERE page_id NOT IN (SELECT page_id FROM chunks_v)""")
def p1(spark, sf):
    """Processed page versions that still have no chunks (work to resume)."""
    return PL.pending(V(spark, sf, "processed_v"), V(spark, sf, "chunks_v"), key="page_id").select("id", "page_id")


@query("P2_validate", f"""
SELECT doc_id AS page_id, CASE WHEN length(t) >= 1 THEN 'valid' ELSE 'rejected' END AS status,
       CASE WHEN length(t) >= 1 THEN NULL ELSE 'text: String should have at least 1 character' END AS error
FROM (SELECT doc_id, regexp_replace({S.strip('text')}, '^[^ ]{{1,4}}$', '') AS t FROM documents)""")
def p2(spark, sf):
    """Records whose text is the stripped document; a text of one short word
    stands for a page that lost its body (emptied) and must be rejected."""
    d = V(spark, sf, "documents")
    rec = d.select(F.col("doc_id").alias("page_id"),
                   F.regexp_replace(strip_ws("text"), "^[^ ]{1,4}$", "").alias("text"),
                   F.array().cast("array<array<struct<key:string,value:string>>>").alias("tables"))
    valid, rejected = PL.validate(rec, passthrough=("page_id",))
    return valid.select("page_id", F.lit("valid").alias("status"), F.lit(None).cast("string").alias("error")) \
        .unionByName(rejected.select("page_id", F.lit("rejected").alias("status"), "error"))


def _product_processed(spark, sf):
    pp = V(spark, sf, "product_pages")
    pages = pp.select(F.col("page_id").alias("id"), "url", F.col("html").alias("raw_html"),
                      html_text("html").alias("extracted_text"))
    return PL.process_pages(pages)


_PP = with_views("product_pages", "listing_pages") + _ALL_PAGES_TAIL + _TABLE_ROWS_TAIL


@query("P3_process_pages", _PP + """
SELECT p.page_id, p.extracted_text AS text, CAST(coalesce(t.n_tables, 0) AS BIGINT) AS n_tables,
       CAST(coalesce(t.n_facts, 0) AS BIGINT) AS n_facts
FROM parsed p LEFT JOIN (SELECT page_id, count(DISTINCT table_idx) AS n_tables, count(*) AS n_facts FROM facts
                         GROUP BY page_id) t ON t.page_id = p.page_id
WHERE p.src = 'product_pages'""")
def p3(spark, sf):
    pr = _product_processed(spark, sf)
    return pr.select("page_id", "text", F.size("tables").cast("long").alias("n_tables"),
                     F.aggregate("tables", F.lit(0), lambda a, t: a + F.size(t)).cast("long").alias("n_facts"))


@query("P6_chunk_pages", _PP + f""",
body AS (SELECT page_id, {S.strip('extracted_text')} AS s FROM parsed WHERE src = 'product_pages'),
starts AS (SELECT page_id, s, unnest(generate_series(0, CAST(greatest(0, ceil((length(s) - 500) / 425)) AS BIGINT))) AS k
           FROM body WHERE length(s) > 0),
pieces AS (SELECT page_id, 0 AS part, k, {S.strip('substr(s, k * 425 + 1, 500)')} AS chunk_text FROM starts),
tabchunks AS (SELECT page_id, 1 AS part, table_idx AS k, string_agg(key || ': ' || value, chr(10) ORDER BY row_idx) AS chunk_text
         FROM facts GROUP BY page_id, table_idx),
allc AS (SELECT * FROM pieces WHERE chunk_text <> '' UNION ALL SELECT * FROM tabchunks WHERE chunk_text <> '')
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY part, k) - 1 AS BIGINT) AS chunk_index, chunk_text
FROM allc""")
def p6(spark, sf):
    c = PL.chunk_pages(_product_processed(spark, sf))
    return c.select("page_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_text")


_EMBED_SQL = f"""
WITH t AS (SELECT doc_id, {S.strip('text')} AS s FROM documents),
starts AS (SELECT doc_id, s, unnest(generate_series(0, CAST(greatest(0, ceil((length(s) - 500) / 425)) AS BIGINT))) AS k
           FROM t WHERE length(s) > 0),
pieces AS (SELECT doc_id, k, {S.strip('substr(s, k * 425 + 1, 500)')} AS chunk_text FROM starts),
chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk_index, chunk_text
           FROM pieces WHERE chunk_text <> ''),
toks AS (SELECT doc_id, chunk_index, unnest(list_filter(string_split_regex(lower(chunk_text), '[^\\p{{L}}\\p{{N}}]+'),
                                                       lambda x: x <> '')) AS tok FROM chunks),
counts AS (SELECT doc_id, chunk_index, CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % 64 AS dim, count(*) AS c
           FROM toks GROUP BY ALL),
norms AS (SELECT doc_id, chunk_index, sqrt(sum(c * c)) AS n FROM counts GROUP BY ALL)
SELECT c.doc_id, CAST(c.chunk_index AS BIGINT) AS chunk_index, CAST(c.dim AS BIGINT) AS dim,
       round(CAST(CAST(c.c / n.n AS FLOAT) AS DOUBLE), 6) AS value
FROM counts c JOIN norms n USING (doc_id, chunk_index)"""


@query("P7_embed", _EMBED_SQL)
def p7(spark, sf):
    """Default (hashing) embedder over every chunk of every document; the
    non-zero coordinates are listed."""
    from pagelake.functions.html import unnest
    from pagelake.functions.text import chunk_windows

    d = V(spark, sf, "documents")
    ch = unnest(d, ["doc_id"], chunk_windows("text"), "chunk_index", "chunk_text")
    e = PL.embed(ch, "chunk_text")
    x = unnest(e, ["doc_id", "chunk_index"], "embedding", "dim", "value").filter("value <> 0")
    return x.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"),
                    F.col("dim").cast("long").alias("dim"), rnd6(F.col("value").cast("double")).alias("value"))


@query("P8_attach_url", with_views("attempts_v", "page_versions") + """,
cls AS (SELECT *, CASE WHEN status = 429 OR (status >= 500 AND status < 600) THEN 'retryable'
                       WHEN status >= 400 AND status < 500 THEN 'permanent' ELSE 'ok' END AS outcome FROM attempts_v),
term AS (SELECT job_id, min(attempt) AS t FROM cls WHERE outcome <> 'retryable' OR attempt >= 6 GROUP BY job_id),
dead AS (SELECT t.job_id FROM term t JOIN cls c ON c.job_id = t.job_id AND c.attempt = t.t WHERE c.outcome <> 'ok')
SELECT d.job_id AS page_id, p.url FROM dead d LEFT JOIN page_versions p ON p.id = d.job_id""")
def p8(spark, sf):
    """Dead jobs (job id = page version id) get their URL when the page is known."""
    a = V(spark, sf, "attempts_v").withColumn("outcome", classify_fetch(F.col("status")))
    dead = resolve_attempts(a).filter(F.col("state") == "dead").select(F.col("job_id").alias("page_id"))
    return PL.attach_url(dead, V(spark, sf, "page_versions")).select("page_id", "url")


@query("P9_dedup_by_page", with_views("page_versions", "processed_v") + """
SELECT id, page_id FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY processed_at DESC, id DESC) AS rn
                         FROM processed_v) WHERE rn = 1""")
def p9(spark, sf):
    return PL.dedup_by_page(V(spark, sf, "processed_v")).select("id", "page_id")


_P10_SQL = with_views("page_versions") + f""",
log AS (SELECT id, url, extracted_text, sha256(extracted_text) AS h, fetched_at FROM page_versions),
versions AS (SELECT * FROM (SELECT *, lag(h) OVER (PARTITION BY url ORDER BY fetched_at, id) AS prev FROM log)
             WHERE prev IS NULL OR prev <> h),
t AS (SELECT id AS page_id, {S.strip('extracted_text')} AS s FROM versions),
starts AS (SELECT page_id, s, unnest(generate_series(0, CAST(greatest(0, ceil((length(s) - 500) / 425)) AS BIGINT))) AS k
           FROM t WHERE length(s) > 0),
pieces AS (SELECT page_id, k, {S.strip('substr(s, k * 425 + 1, 500)')} AS chunk_text FROM starts)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS BIGINT) AS chunk_index, chunk_text
FROM pieces WHERE chunk_text <> ''"""


@query("P10_run_pipeline", _P10_SQL)
def p10(spark, sf):
    """The whole chain over the crawl log, run twice (the replay writes nothing
    new); the chunk table is read back."""
    obs = page_observations(spark, sf)
    paths = PL.pipeline_paths(spark, "p10")
    as_of = dt.datetime(2024, 2, 1)
    PL.run_pipeline(spark, obs, paths, as_of)
    PL.run_pipeline(spark, obs, paths, as_of)
    chunks = PL.read_output(spark, paths, "chunks")
    return chunks.select("page_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_text")

