"""Registered versioning queries (V1–V7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.operators import versions as Vs
from pagelake.plans.registry import V, page_log, query, sql_ts, ts_str, with_views

_LOG = with_views("page_versions") + """,
log AS (SELECT id, url, sha256(extracted_text) AS content_hash, fetched_at FROM page_versions)
"""


@query("V1_latest_versions", _LOG + f"""
SELECT id, url, content_hash, {sql_ts('fetched_at')} AS fetched_at FROM (
    SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, id DESC) AS rn FROM log) WHERE rn = 1""")
def v1(spark, sf):
    return Vs.latest_versions(page_log(spark, sf)).select(
        "id", "url", "content_hash", ts_str("fetched_at").alias("fetched_at"))


@query("V2_latest_page", _LOG + f"""
SELECT id, url, content_hash, {sql_ts('fetched_at')} AS fetched_at FROM log
WHERE url = (SELECT url FROM pages WHERE page_id = (SELECT min(page_id) FROM pages WHERE page_id % 7 = 0 AND page_id > 0))
ORDER BY fetched_at DESC, id DESC LIMIT 1""")
def v2(spark, sf):
    """Latest version of one URL (one whose newest two crawls share a timestamp)."""
    pages = V(spark, sf, "pages")
    target = pages.filter((F.col("page_id") % 7 == 0) & (F.col("page_id") > 0)).agg(F.min("page_id").alias("page_id"))
    url = pages.join(target, "page_id", "left_semi").select("url")
    log = page_log(spark, sf).join(url, "url", "left_semi")
    return Vs.latest_page(log, F.col("url")).select("id", "url", "content_hash", ts_str("fetched_at").alias("fetched_at"))


@query("V3_latest_processed", with_views("page_versions", "processed_v") + f"""
SELECT id, page_id, url, {sql_ts('processed_at')} AS processed_at FROM (
    SELECT pr.id, pr.page_id, pv.url, pr.processed_at,
           row_number() OVER (PARTITION BY pv.url ORDER BY pr.processed_at DESC, pr.id DESC) AS rn
    FROM processed_v pr JOIN page_versions pv ON pv.id = pr.page_id) WHERE rn = 1""")
def v3(spark, sf):
    out = Vs.latest_processed(V(spark, sf, "processed_v"), V(spark, sf, "page_versions"))
    return out.select("id", "page_id", "url", ts_str("processed_at").alias("processed_at"))


_COLLAPSED = _LOG + """,
lagged AS (SELECT *, lag(content_hash) OVER (PARTITION BY url ORDER BY fetched_at, id) AS prev FROM log),
versions AS (SELECT id, url, content_hash, fetched_at FROM lagged WHERE prev IS NULL OR prev <> content_hash)
"""


@query("V4_collapse_unchanged", _COLLAPSED + f"""
SELECT id, url, content_hash, {sql_ts('fetched_at')} AS fetched_at FROM versions""")
def v4(spark, sf):
    out = Vs.collapse_unchanged(page_log(spark, sf))
    return out.select("id", "url", "content_hash", ts_str("fetched_at").alias("fetched_at"))


@query("V5_new_versions", _COLLAPSED + f"""
SELECT id, url, content_hash, {sql_ts('fetched_at')} AS fetched_at FROM versions
WHERE fetched_at >= TIMESTAMP '2024-01-03 00:00:00'""")
def v5(spark, sf):
    """Incremental: versions of the crawls from 2024-01-03 on, against the
    stored log of the earlier crawls."""
    log = page_log(spark, sf)
    cut = F.col("fetched_at") < F.lit("2024-01-03 00:00:00").cast("timestamp")
    stored = Vs.collapse_unchanged(log.filter(cut))
    out = Vs.new_versions(stored, log.filter(~cut))
    return out.select("id", "url", "content_hash", ts_str("fetched_at").alias("fetched_at"))


@query("V6_version_history", _COLLAPSED + f"""
SELECT id, url, {sql_ts('fetched_at')} AS fetched_at,
       CAST(row_number() OVER (PARTITION BY url ORDER BY fetched_at, id) AS BIGINT) AS version_no,
       CAST(count(*) OVER (PARTITION BY url) AS BIGINT) AS n_versions
FROM versions""")
def v6(spark, sf):
    hist = Vs.version_history(Vs.collapse_unchanged(page_log(spark, sf)))
    return hist.select("id", "url", ts_str("fetched_at").alias("fetched_at"),
                       F.col("version_no").cast("long").alias("version_no"),
                       F.col("n_versions").cast("long").alias("n_versions"))


@query("V7_restrict_to_latest", with_views("page_versions", "chunks_v") + """
SELECT chunk_id, page_id FROM chunks_v WHERE page_id IN (
    SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, id DESC) AS rn
                    FROM page_versions) WHERE rn = 1)""")
def v7(spark, sf):
    out = Vs.restrict_to_latest(V(spark, sf, "chunks_v"), V(spark, sf, "page_versions"))
    return out.select("chunk_id", "page_id")
