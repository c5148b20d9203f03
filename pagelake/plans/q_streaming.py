"""Registered streaming queries (T1–T4); results equal their batch twins."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from pagelake.functions.html import content_hash
from pagelake.operators import pipeline as PL
from pagelake.plans.q_pipeline import _P10_SQL
from pagelake.plans.q_versions import _COLLAPSED
from pagelake.plans.registry import V, page_observations, query, sql_ts, ts_str, with_views
from pagelake.session import drop_stages, stages_recorded
from pagelake.sources import tables as io
from pagelake.streaming import pipeline as ST

# The arrival cut of the observation stream, and the date of the runs.
CUTS = ("2024-01-03 00:00:00",)
AS_OF = dt.datetime(2024, 2, 1)


def _observations(spark, sf):
    return page_observations(spark, sf)


def _arrivals(spark, sf, incoming, made=lambda part: part):
    """Appends the observations to ``incoming``, a part each step.  What they are made of is dropped when the last part is there."""
    with stages_recorded() as stages:
        parts = list(ST.arrivals(_observations(spark, sf), cuts=CUTS))
    for n, part in enumerate(parts, 1):
        io.append(made(part), incoming)
        if n == len(parts):
            drop_stages(spark, stages)
        yield


@query("T1_stream_pipeline", _P10_SQL)
def t1(spark, sf):
    """Observations arrive in two parts; each is a micro-batch of the pipeline.
    The stream is then restarted on the same checkpoint (nothing new)."""
    base = io.scratch_path(spark, "t1")
    paths = PL.table_paths(base)
    for _ in _arrivals(spark, sf, f"{base}/incoming"):
        ST.stream_pipeline(spark, f"{base}/incoming", paths, f"{base}/_checkpoint", AS_OF, clean=True)
    ST.stream_pipeline(spark, f"{base}/incoming", paths, f"{base}/_checkpoint", AS_OF, clean=True)
    chunks = PL.read_output(spark, paths, "chunks")
    return chunks.select("page_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_text")


@query("T2_stream_versions", _COLLAPSED + f"""
SELECT id, url, content_hash, {sql_ts('fetched_at')} AS fetched_at FROM versions""")
def t2(spark, sf):
    """Change detection over two arrivals equals the batch collapse (V4)."""
    base = io.scratch_path(spark, "t2")
    for part in ST.arrivals(_observations(spark, sf), cuts=CUTS):
        io.append(part, f"{base}/incoming")
        ST.stream_versions(spark, f"{base}/incoming", f"{base}/versions", f"{base}/_checkpoint")
    v = ST.read_versions(spark, f"{base}/versions")
    return v.select("id", "url", "content_hash", ts_str("fetched_at").alias("fetched_at"))


class Crash(Exception):
    """Stands for the loss of the driver."""


def _crash_in(epoch_lost: int):
    def hook(epoch: int) -> None:
        if epoch == epoch_lost:
            raise Crash(f"lost in epoch {epoch}")
    return hook


@query("T3_replay", _COLLAPSED + "SELECT id, url, content_hash FROM versions")
def t3(spark, sf):
    """The second micro-batch dies when its tables are written but not committed; every observation in it comes twice.
    After the restart Spark delivers it again, and one row per version is stored."""
    base = io.scratch_path(spark, "t3")
    paths, incoming, checkpoint = PL.table_paths(base), f"{base}/incoming", f"{base}/_checkpoint"
    # Both copies of an observation are written side by side, where they compress as one.
    twice = lambda part: part.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("_copy")).drop("_copy")
    for _ in _arrivals(spark, sf, incoming, made=twice):
        try:
            ST.stream_pipeline(spark, incoming, paths, checkpoint, AS_OF, before_commit=_crash_in(1), clean=True)
        except StreamingQueryException:
            ST.stream_pipeline(spark, incoming, paths, checkpoint, AS_OF, clean=True)
    return PL.read_output(spark, paths, "pages").select("id", "url", "content_hash")


@query("T4_dead_letters", with_views("page_versions") + """,
log AS (SELECT id, url, fetched_at, CASE WHEN id % 9 = 0 THEN '' ELSE extracted_text END AS txt FROM page_versions),
versions AS (SELECT * FROM (SELECT *, lag(txt) OVER (PARTITION BY url ORDER BY fetched_at, id) AS prev FROM log)
             WHERE prev IS NULL OR prev <> txt)
SELECT url, 'process_page' AS task_name, 'text: String should have at least 1 character' AS error, CAST(1 AS BIGINT) AS attempt_count
FROM versions WHERE txt = ''
UNION ALL
SELECT url, 'embed_page', 'ValueError: no vector for a revised text', CAST(1 AS BIGINT) FROM versions WHERE txt LIKE '%(revised)%'""")
def t4(spark, sf):
    """Pages without text are rejected and pages with a revised text fail in the embedder, in both micro-batches; the
    stream goes on.  The dead letters are read back."""
    def no_revised(texts):
        if any("(revised)" in t for t in texts):
            raise ValueError("no vector for a revised text")
        return [[float(len(t)), 1.0] for t in texts]

    base = io.scratch_path(spark, "t4")
    paths = PL.table_paths(base)
    obs = _observations(spark, sf)
    obs = obs.withColumn("extracted_text", F.when(F.col("id") % 9 == 0, "").otherwise(F.col("extracted_text")))
    obs = obs.withColumn("content_hash", content_hash("extracted_text"))
    for part in ST.arrivals(obs, cuts=CUTS):
        io.append(part, f"{base}/incoming")
        ST.stream_pipeline(spark, f"{base}/incoming", paths, f"{base}/_checkpoint", AS_OF, embedder=no_revised, dim=2)
    dead = PL.read_output(spark, paths, "dead_letters")
    return dead.select("url", "task_name", "error", F.col("attempt_count").cast("long").alias("attempt_count"))
