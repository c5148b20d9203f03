"""Scans and append-only sinks."""

from __future__ import annotations

import logging
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.session import TABLE_CODEC, ensure_checkpoint_dir, shuffles_dropped

log = logging.getLogger(__name__)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

PAGE_LOG_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("raw_html", T.StringType(), False),
    T.StructField("extracted_text", T.StringType(), False),
    T.StructField("content_hash", T.StringType(), False),
    T.StructField("fetched_at", T.TimestampType(), False),
])

TABLE_ENTRY = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])

PROCESSED_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("page_id", T.LongType(), False),
    T.StructField("text", T.StringType(), False),
    T.StructField("tables", T.ArrayType(T.ArrayType(TABLE_ENTRY)), False),
    T.StructField("processed_at", T.TimestampType(), False),
])

CHUNK_SCHEMA = T.StructType([
    T.StructField("id", T.DecimalType(38, 0), False),
    T.StructField("page_id", T.LongType(), False),
    T.StructField("chunk_text", T.StringType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType(), False), False),
    T.StructField("chunk_index", T.IntegerType(), False),
    T.StructField("created_at", T.TimestampType(), False),
])

DEAD_LETTER_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("url", T.StringType(), True),
    T.StructField("task_name", T.StringType(), False),
    T.StructField("error", T.StringType(), False),
    T.StructField("failed_at", T.TimestampType(), False),
    T.StructField("attempt_count", T.IntegerType(), False),
])


# A session may ask that every table be dealt to so many partitions after its scan (tests and benches do,
# whose files hold one row group each); unset, tables are read as they are.
SCAN_PARTITIONS = "pagelake.scan.partitions"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    n = spark.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(n)) if n else df


def dealt(df: DataFrame) -> DataFrame:
    """Narrow rows dealt evenly to the shuffle partitions, ahead of expressions that cost much per row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw page table as ``(id, url, raw_html)``."""
    return read_table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), "url", F.col("html").alias("raw_html"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local
    on a cluster: ``spark.checkpoint.dir`` names shared storage)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "pagelake-tables", f"{name}-{uuid.uuid4().hex}")


def conform(df: DataFrame, schema: T.StructType | None) -> DataFrame:
    if schema is None:
        return df
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns for sink: {missing}")
    extra = [c for c in df.columns if c not in schema.fieldNames()]
    if extra:
        raise ValueError(f"unknown columns for sink: {extra}")
    def cast(f):
        cur = df.schema[f.name].dataType
        if cur.simpleString() == f.dataType.simpleString():  # differs at most in nullability
            return F.col(f.name)
        return F.col(f.name).cast(f.dataType).alias(f.name)

    return df.select(*[cast(f) for f in schema.fields])


def append(df: DataFrame, path: str, schema: T.StructType | None = None) -> None:
    """Append one batch as one job: the batch becomes visible whole or not at all."""
    with shuffles_dropped(df.sparkSession):
        conform(df, schema).write.mode("append").option("compression", TABLE_CODEC).parquet(path)


def append_pages(df: DataFrame, path: str) -> None:
    """Append page versions; never overwrite."""
    append(df, path, PAGE_LOG_SCHEMA)


def append_processed(df: DataFrame, path: str) -> None:
    """S3: append processed pages."""
    append(df, path, PROCESSED_SCHEMA)


def append_chunks(df: DataFrame, path: str) -> None:
    """Append chunks; the whole chunk list of a batch lands in one commit."""
    append(df, path, CHUNK_SCHEMA)


def _quiet(write, path: str) -> bool:
    try:
        write()
        return True
    except Exception:  # noqa: BLE001 - deliberate: never mask the original failure
        log.exception("dead-letter write to %s failed", path)
        return False


def append_dead_letters(df: DataFrame, path: str) -> bool:
    """Append dead letters in their own job.  A failing write is logged
    and swallowed so that it never masks the failure that caused it."""
    return _quiet(lambda: append(df, path, DEAD_LETTER_SCHEMA), path)


def write_dead_letters(df: DataFrame, path: str) -> bool:
    """S5 for one epoch: the same, replacing what an uncommitted run left."""
    def write():
        with shuffles_dropped(df.sparkSession):
            conform(df, DEAD_LETTER_SCHEMA).write.mode("overwrite").option("compression", TABLE_CODEC).parquet(path)

    return _quiet(write, path)


def reset_table(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Replace a table with an empty one of the same schema."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def read_sink(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)
