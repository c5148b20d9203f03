"""Structured Streaming (T1–T4): the crawl → process → embed chain as a file
stream, and change detection per URL across micro-batches.

* T1: ``stream_pipeline`` — a file-source stream of observations whose micro-batches are epochs of
  :func:`run_pipeline`.
* T3: a micro-batch that Spark delivers again (the checkpoint marks it done only after the sink) is run again from the
  start and replaces what it had written, or is left alone if the ledger has it (see :mod:`pagelake.sources.ledger`).
* T4: pages that fail in a micro-batch go to the dead letters or the retry queue of their epoch; the stream goes on.
* T2: ``stream_versions`` — the same change detection alone.  Its state is the table of heads per URL, and the rows of
  a batch are compared by the skew-safe ordered scan, so no URL's rows meet in one group.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.operators.pipeline import ingest, run_pipeline
from pagelake.operators.versions import PLACE
from pagelake.sources import tables as io
from pagelake.sources.ledger import Ledger

OBS_SCHEMA = io.PAGE_LOG_SCHEMA


def read_observations(spark: SparkSession, in_dir: str, max_files_per_trigger: int | None = None, clean: bool = False) -> DataFrame:
    """Observation files (Parquet, page-log schema) as a stream, each row with its place in them (``PLACE``).  With ``clean`` the files
    of a micro-batch that is done are deleted when the next one begins."""
    r = spark.readStream.schema(OBS_SCHEMA)
    if clean:
        r = r.option("cleanSource", "delete")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    file, row = PLACE
    return r.parquet(in_dir).select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))


def _drain(obs: DataFrame, each, checkpoint: str):
    q = (obs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def stream_pipeline(spark: SparkSession, in_dir: str, paths: dict[str, str], checkpoint: str,
                    as_of: dt.datetime, max_files_per_trigger: int | None = None, embedder=None,
                    dim: int | None = None, before_commit=None, clean: bool = False):
    """Run the pipeline over every available observation file
    (``trigger(availableNow=True)``) and stop; returns the finished query.  The checkpoint folder names the source.
    ``clean`` deletes files that an earlier micro-batch is done with, for folders that serve this stream alone."""
    more = {} if dim is None else {"dim": dim}

    def each(batch: DataFrame, epoch_id: int) -> None:
        run_pipeline(batch.sparkSession, batch, paths, as_of, embedder=embedder, source=checkpoint, batch=epoch_id,
                     before_commit=before_commit, **more)

    return _drain(read_observations(spark, in_dir, max_files_per_trigger, clean), each, checkpoint)


VERSION_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("content_hash", T.StringType()), T.StructField("fetched_at", T.TimestampType())])


def stream_versions(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, max_files_per_trigger: int | None = None):
    """Page versions of a stream of observations, in epoch tables under ``out_dir``: an observation is kept only when
    its hash differs from the head of its URL at that time.  Runs over the available files and stops."""
    paths = version_paths(out_dir)

    def each(batch: DataFrame, epoch_id: int) -> None:
        ledger = Ledger(batch.sparkSession, paths)
        if not ledger.has(checkpoint, epoch_id):
            epoch = ledger.last() + 1
            n = ingest(ledger, batch, epoch).count()
            ledger.commit(epoch, checkpoint, epoch_id, {"pages": n}, True)

    return _drain(read_observations(spark, in_dir, max_files_per_trigger), each, checkpoint)


def version_paths(out_dir: str) -> dict[str, str]:
    return {"pages": f"{out_dir}/pages", "state": f"{out_dir}/state"}


def read_versions(spark: SparkSession, out_dir: str) -> DataFrame:
    """The committed versions of :func:`stream_versions`."""
    return Ledger(spark, version_paths(out_dir)).committed("pages", io.PAGE_LOG_SCHEMA).select(VERSION_SCHEMA.fieldNames())


def arrivals(df: DataFrame, split_col: str = "fetched_at", cuts=()):
    """The observations in parts that arrive one after the other."""
    bounds = [None, *cuts, None]
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        part = df
        if lo is not None:
            part = part.filter(F.col(split_col) >= F.lit(lo).cast("timestamp"))
        if hi is not None:
            part = part.filter(F.col(split_col) < F.lit(hi).cast("timestamp"))
        yield part
