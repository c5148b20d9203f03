"""Registered queries: one per inventory operator, each with the DuckDB SQL that
states the same result independently (the oracle).

Every query reads the driver tables (or views Spark derives from them, see
:mod:`pagelake.sources.fixtures`), so its work grows with the tables.  Output
columns are scalar (bigint / string / double rounded to 6 places); timestamps
are rendered as ``yyyy-MM-dd HH:mm:ss.SSSSSS`` strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.sources.fixtures import versions_with_html, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def ts_str(c) -> F.Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sql_ts(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


def rnd6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def V(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return view(spark, sf, name)


def page_log(spark: SparkSession, sf: str) -> DataFrame:
    """The page-version log with a content hash (from ``page_versions``)."""
    from pagelake.functions.html import content_hash

    return V(spark, sf, "page_versions").withColumn("content_hash", content_hash("extracted_text"))


def page_observations(spark: SparkSession, sf: str) -> DataFrame:
    """The log with raw HTML: that of the page table, a plain body for URLs it lacks."""
    from pagelake.functions.html import content_hash

    body = F.concat(F.lit("<html><body>"), "extracted_text", F.lit("</body></html>"))
    return versions_with_html(spark, sf).select(
        "id", "url", F.coalesce("raw_html", body).alias("raw_html"), "extracted_text",
        content_hash("extracted_text").alias("content_hash"), "fetched_at")


# Import the query modules so that they register themselves.
from pagelake.plans import q_columns, q_pipeline, q_planning, q_retrieval, q_sources, q_streaming, q_versions  # noqa: E402,F401,I001

__all__ = ["QUERIES", "ORACLE", "query", "with_views"]
