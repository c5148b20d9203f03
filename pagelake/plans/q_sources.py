"""Registered source/sink round trips."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pagelake.plans.q_pipeline import p8
from pagelake.plans.registry import V, page_observations, query, sql_ts, ts_str, with_views
from pagelake.sources import tables as io


@query("S1_read_pages", "SELECT page_id AS id, url, html AS raw_html FROM pages")
def s1(spark, sf):
    return io.read_pages(spark, sf)


def _obs(spark, sf):
    return page_observations(spark, sf)


@query("S2_append_pages", with_views("page_versions") + f"""
SELECT id, url, sha256(extracted_text) AS content_hash, {sql_ts('fetched_at')} AS fetched_at FROM page_versions""")
def s2(spark, sf):
    """Two appends (earlier and later crawls) read back as one log."""
    path = io.scratch_path(spark, "s2-pages")
    obs = _obs(spark, sf)
    cut = F.col("fetched_at") < F.lit("2024-01-03").cast("timestamp")
    io.append_pages(obs.filter(cut), path)
    io.append_pages(obs.filter(~cut), path)
    back = io.read_sink(spark, path, io.PAGE_LOG_SCHEMA)
    return back.select("id", "url", "content_hash", ts_str("fetched_at").alias("fetched_at"))


@query("S3_append_processed", with_views("page_versions", "processed_v") + f"""
SELECT id, page_id, {sql_ts('processed_at')} AS processed_at, CAST(0 AS BIGINT) AS n_tables FROM processed_v""")
def s3(spark, sf):
    path = io.scratch_path(spark, "s3-processed")
    pr = V(spark, sf, "processed_v").withColumn(
        "tables", F.array().cast("array<array<struct<key:string,value:string>>>"))
    io.append_processed(pr.select("id", "page_id", "text", "tables", "processed_at"), path)
    back = io.read_sink(spark, path, io.PROCESSED_SCHEMA)
    return back.select("id", "page_id", ts_str("processed_at").alias("processed_at"),
                       F.size("tables").cast("long").alias("n_tables"))


@query("S4_append_chunks", with_views("chunks_v") + """
SELECT chunk_id AS id, page_id, CAST(chunk_index AS BIGINT) AS chunk_index, chunk_text, CAST(i - 1 AS BIGINT) AS dim,
       round(CAST(embedding[i] AS DOUBLE), 6) AS value
FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM chunks_v)""")
def s4(spark, sf):
    """Chunks read back with every coordinate of their vectors."""
    path = io.scratch_path(spark, "s4-chunks")
    c = V(spark, sf, "chunks_v").select(F.col("chunk_id").alias("id"), "page_id", "chunk_text", "embedding",
                                        "chunk_index", F.lit(dt.datetime(2024, 2, 1)).alias("created_at"))
    io.append_chunks(c, path)
    back = io.read_sink(spark, path, io.CHUNK_SCHEMA).select(
        F.col("id").cast("long").alias("id"), "page_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_text",
        F.posexplode("embedding").alias("dim", "value"))
    return back.withColumn("dim", F.col("dim").cast("long")).withColumn("value", F.round(F.col("value").cast("double"), 6))


@query("S5_append_dead_letters", with_views("attempts_v", "page_versions") + """,
cls AS (SELECT *, CASE WHEN status = 429 OR (status >= 500 AND status < 600) THEN 'retryable'
                       WHEN status >= 400 AND status < 500 THEN 'permanent' ELSE 'ok' END AS outcome FROM attempts_v),
term AS (SELECT job_id, min(attempt) AS t FROM cls WHERE outcome <> 'retryable' OR attempt >= 6 GROUP BY job_id),
dead AS (SELECT t.job_id FROM term t JOIN cls c ON c.job_id = t.job_id AND c.attempt = t.t WHERE c.outcome <> 'ok')
SELECT p.url, 'crawl_url' AS task_name, 'permanent fetch error' AS error, CAST(1 AS BIGINT) AS attempt_count
FROM dead d LEFT JOIN page_versions p ON p.id = d.job_id""")
def s5(spark, sf):
    """Dead jobs land in the dead-letter table; a second write to an unusable
    location fails quietly (it must not mask the original failure)."""
    path = io.scratch_path(spark, "s5-dead")
    dead = p8(spark, sf).select(
        F.col("page_id").alias("id"), "url", F.lit("crawl_url").alias("task_name"),
        F.lit("permanent fetch error").alias("error"), F.lit(dt.datetime(2024, 2, 1)).alias("failed_at"),
        F.lit(1).alias("attempt_count"))
    assert io.append_dead_letters(dead, path)
    assert not io.append_dead_letters(dead.withColumn("extra", F.lit(1)), path)
    back = io.read_sink(spark, path, io.DEAD_LETTER_SCHEMA)
    return back.select("url", "task_name", "error", F.col("attempt_count").cast("long").alias("attempt_count"))


@query("S6_reset_table", with_views("page_versions") + """
SELECT id, url FROM page_versions WHERE fetched_at >= TIMESTAMP '2024-01-03 00:00:00'""")
def s6(spark, sf):
    """A filled page table, reset before a timed run and filled again, holds the later crawls only."""
    path = io.scratch_path(spark, "s6-pages")
    obs = _obs(spark, sf)
    cut = F.col("fetched_at") < F.lit("2024-01-03").cast("timestamp")
    io.append_pages(obs.filter(cut), path)
    io.reset_table(spark, path, io.PAGE_LOG_SCHEMA)
    io.append_pages(obs.filter(~cut), path)
    return io.read_sink(spark, path, io.PAGE_LOG_SCHEMA).select("id", "url")
