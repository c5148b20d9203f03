"""Processing pipeline (P1–P10): pending work, validation, normalisation,
chunking, embedding, dead letters and the whole chain as one batch job.

Every stage is an anti-join against what already exists, so re-running a
batch (or replaying it after a crash) writes nothing twice.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.functions.html import let, unnest
from pagelake.functions.text import CHUNK_OVERLAP, CHUNK_SIZE, chunk_windows, serialize_table
from pagelake.operators.extract import tables_column
from pagelake.operators.versions import PLACE, heads_of, latest_ids, versions_on_arrival
from pagelake.session import drop_stages, materialize, stages_recorded
from pagelake.sources import tables as io
from pagelake.sources.ledger import COUNTED, Ledger

# Embedding dimension of the default embedder, and the factor of the
# chunk id (page_id * CHUNK_ID_SPAN + index, a 38-digit decimal: any page id and any
# chunk index fit).
DEFAULT_DIM = 64
CHUNK_ID_SPAN = 10_000_000_000

TOKEN_SPLIT_RE = r"[^\p{L}\p{N}]+"


def pending(left: DataFrame, done: DataFrame, key: str = "page_id", left_key: str | None = None) -> DataFrame:
    """Rows of ``left`` that have no row in ``done`` yet (anti-join)."""
    lk = left_key or key
    d = done.select(F.col(key).alias(lk)).distinct()
    return left.join(d, lk, "left_anti")


RECORD_FIELDS = ("text", "tables")


def _text_ok(text: str) -> Column:
    return F.col(text).isNotNull() & (F.length(text) >= 1)


def _fault(text_ok: Column) -> Column:
    """What is wrong with a rejected record."""
    return F.when(~text_ok, F.lit("text: String should have at least 1 character")).otherwise(
        F.lit("tables: keys and values must be strings"))


def validate(df: DataFrame, passthrough: tuple[str, ...] = ("id", "page_id")) -> tuple[DataFrame, DataFrame]:
    """Split processed records into (valid, rejected).

    Valid: ``text`` has at least one character and every table key and value
    is a string.  Unknown fields are a schema error raised before any job
    (records with extra fields are never valid)."""
    extra = [c for c in df.columns if c not in RECORD_FIELDS and c not in passthrough]
    if extra:
        raise ValueError(f"processed record has unknown fields: {extra}")
    text_ok = _text_ok("text")
    tables = F.coalesce(F.col("tables"), F.array())
    tables_ok = F.forall(tables, lambda t: F.forall(t, lambda e: e["key"].isNotNull() & e["value"].isNotNull()))
    ok = text_ok & tables_ok
    valid = df.filter(ok)
    rejected = df.filter(~F.coalesce(ok, F.lit(False))).withColumn("error", _fault(text_ok))
    return valid, rejected


def process_pages(pages: DataFrame) -> DataFrame:
    """Processed record per stored page — its stored text (not re-stripped)
    and the key/value tables of its HTML."""
    return pages.select(F.col("id").alias("page_id"), F.col("extracted_text").alias("text"),
                        tables_column(F.col("raw_html")).alias("tables"))


def chunk_text(df: DataFrame, col: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
               key: str = "page_id") -> DataFrame:
    """P4 on a DataFrame: ``(key, chunk_index, chunk_text)`` overlap chunks of one text column."""
    return unnest(df, [key], chunk_windows(F.col(col), size, overlap), "chunk_index", "chunk_text")


def chunk_column(text, tables, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Body chunks, then one unsplit chunk per non-empty table."""
    tabs = F.filter(F.transform(F.coalesce(tables, F.array().cast("array<array<struct<key:string,value:string>>>")),
                                serialize_table), lambda s: s != "")
    return F.concat(chunk_windows(text, size, overlap), tabs)


def chunk_pages(processed: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``(page_id, chunk_index, chunk_text)``; the index is contiguous from 0
    after empty pieces are dropped."""
    return unnest(processed, ["page_id"], chunk_column(F.col("text"), F.col("tables"), size, overlap), "chunk_index", "chunk_text")


# Bytes as tokens have them: ASCII letters in lower case and digits stay, other ASCII becomes a blank, all else is left alone.
_TOKEN_BYTES = np.array([b if b >= 128 or chr(b).islower() or chr(b).isdigit() else b + 32 if chr(b).isupper() else 32
                         for b in range(256)], np.uint8)


def _token_counts(texts: pa.Array, dim: int) -> np.ndarray:
    """How many tokens of each text (a row) fall into each of ``dim`` buckets."""
    def parts(column):
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
        return at - at[0], np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0]: at[-1]]

    at, data = parts(texts.cast(pa.large_binary()))
    plain = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(at), pa.py_buffer(_TOKEN_BYTES[data])])
    lists = pc.split_pattern(plain, b" ")
    tokens = lists.flatten().dictionary_encode()
    ends, data = parts(tokens.dictionary)
    ends, data = ends.tolist(), data.tobytes()
    marks = b"".join([md5(data[a:b], usedforsecurity=False).digest() for a, b in zip(ends, ends[1:], strict=False)])
    # Empty pieces stand between blanks; they go to a bucket of their own.
    buckets = np.where(np.diff(ends) > 0, np.frombuffer(marks, ">u4")[::4].astype(np.int64) % dim, dim)
    row = np.repeat(np.arange(len(texts)) * (dim + 1), np.diff(lists.offsets.to_numpy()))
    return np.bincount(row + buckets[tokens.indices.to_numpy()], minlength=len(texts) * (dim + 1)).reshape(-1, dim + 1)[:, :dim]


def hashing_vector(text, dim: int = DEFAULT_DIM) -> Column:
    """Default embedder: lower-cased letter/digit tokens hashed into ``dim``
    buckets by the first 32 bits of their MD5, counted and L2-normalised.
    Reproducible; not a language model.  Tokens are cut by expressions and counted in Arrow batches; ``dim`` at most 20,000."""
    if not 1 <= dim <= 20_000:
        raise ValueError("dim must be from 1 to 20000")
    rows = max(1, (1 << 20) // dim)  # texts counted at once

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def vectors(texts):
            counts = _token_counts(texts, dim).astype(np.float64)
            length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            return np.divide(counts, length, out=counts, where=length > 0).astype(np.float32).ravel()

        for batch in batches:
            missing = batch.is_null().to_numpy(zero_copy_only=False)
            offsets = np.append(np.cumsum(~missing) - ~missing, (~missing).sum()).astype(np.int32) * np.int32(dim)
            held = batch.drop_null()
            flat = [vectors(held.slice(i, rows)) for i in range(0, len(held), rows)]
            flat = np.concatenate(flat) if flat else np.empty(0, np.float32)
            yield pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(missing, False)), pa.array(flat, pa.float32()))

    # Blanks between tokens are all that Python cuts at; ASCII texts are brought to that form by their bytes, which is much cheaper.
    plain = lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(F.regexp_replace(F.lower(t), TOKEN_SPLIT_RE, " "))
    return counted(plain(F.col(text) if isinstance(text, str) else text))


def embed(df: DataFrame, col: str = "chunk_text", embedder=None, dim: int = DEFAULT_DIM,
          out: str = "embedding") -> DataFrame:
    """Attach a vector to every chunk.

    ``embedder=None`` uses :func:`hashing_vector`.  Otherwise ``embedder`` is a
    function ``list[str] -> array (n, dim)`` called once per Arrow batch through
    ``mapInPandas`` (batched, never per row); text and vector stay paired
    strictly (a length mismatch fails the task)."""
    if embedder is None:
        return df.withColumn(out, hashing_vector(col, dim))
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.FloatType(), False), False)])

    def fn(it):
        for pdf in it:
            vecs = np.asarray(embedder(pdf[col].tolist()), dtype=np.float32)
            if vecs.shape != (len(pdf), dim):
                raise ValueError(f"embedder returned {vecs.shape}, expected {(len(pdf), dim)}")
            pdf = pdf.copy()
            pdf[out] = list(vecs)
            yield pdf

    return df.mapInPandas(fn, schema)


# Errors of an embedder that may go away by themselves.
RETRYABLE = (ConnectionError, TimeoutError)


def _vectors(embedder, texts: list[str], dim: int) -> list[tuple]:
    """(vector, error, retryable) per text; a failing batch is halved until the failing texts stand alone."""
    try:
        vecs = np.asarray(embedder(texts), dtype=np.float32)
        if vecs.shape != (len(texts), dim):
            raise ValueError(f"embedder returned {vecs.shape}, expected {(len(texts), dim)}")
    except Exception as e:  # noqa: BLE001 - any failure of the hook becomes a dead letter of its page
        if len(texts) == 1:
            return [(None, f"{type(e).__name__}: {e}", isinstance(e, RETRYABLE))]
        half = len(texts) // 2
        return _vectors(embedder, texts[:half], dim) + _vectors(embedder, texts[half:], dim)
    sound = np.isfinite(vecs).all(axis=1)
    return [(v, None, None) if ok else (None, "vector has an entry that is not finite", False) for v, ok in zip(vecs, sound, strict=True)]


def try_embed(df: DataFrame, col: str, embedder, dim: int = DEFAULT_DIM) -> DataFrame:
    """P7 with failures as rows: adds ``embedding``, ``error`` and ``retryable``; either a vector or an error is set."""
    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType(), False)),
                           T.StructField("error", T.StringType()), T.StructField("retryable", T.BooleanType())])

    def fn(it):
        for pdf in it:
            rows = _vectors(embedder, pdf[col].tolist(), dim) if len(pdf) else []
            yield pdf.assign(embedding=pd.Series([r[0] for r in rows], index=pdf.index, dtype=object),
                             error=pd.Series([r[1] for r in rows], index=pdf.index, dtype=object),
                             retryable=pd.Series([r[2] for r in rows], index=pdf.index, dtype=object))

    return df.mapInPandas(fn, schema)


def attach_url(dead: DataFrame, pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Add the page URL to failures that only know a ``page_id`` (null when unknown)."""
    urls = pages.select(F.col("id").alias(key), F.col("url").alias("url"))
    return dead.join(urls, key, "left")


def dedup_by_page(processed: DataFrame) -> DataFrame:
    """One processed record per page version — the newest by
    ``processed_at DESC, id DESC`` (aggregation, so redelivery storms on one
    page are combined map-side).  The ids of superseded records are written first, so that the
    whole records are shuffled only where these are too many to broadcast."""
    keep = latest_ids(processed, key="page_id", order=("processed_at", "id"))
    superseded = materialize(processed.select("id").distinct().join(keep, "id", "left_anti"), "superseded")
    return processed.where(F.col("id").isNotNull()).join(superseded, "id", "left_anti")


def dead_letters(rejected: DataFrame, task_name: str, as_of: dt.datetime, attempt_count: int | Column = 1) -> DataFrame:
    """Rows for the dead-letter table (``rejected`` carries url and error)."""
    attempts = F.lit(attempt_count) if isinstance(attempt_count, int) else attempt_count
    return rejected.select(
        F.xxhash64(F.lit(task_name), *[F.col(c) for c in ("page_id", "url") if c in rejected.columns],
                   F.col("error")).alias("id"), "url",
        F.lit(task_name).alias("task_name"), "error", F.lit(as_of).cast("timestamp").alias("failed_at"),
        attempts.cast("int").alias("attempt_count"))


# Fixed value: a failing embedding is tried again this often before its page is given up.
MAX_RETRIES = 5
# Every so many epochs the heads are written whole; in between, only those that changed.
HEADS_EVERY = 16

ARRIVAL_SCHEMA = T.StructType([T.StructField("id", T.LongType(), False)])
HEAD_SCHEMA = T.StructType([T.StructField("url", T.StringType()), T.StructField("fetched_at", T.TimestampType()),
                            T.StructField("id", T.LongType()), T.StructField("content_hash", T.StringType())])
QUEUE_SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("page_epoch", T.LongType()),
                             T.StructField("attempts", T.IntegerType())])


def read_heads(ledger: Ledger, epoch: int) -> DataFrame:
    """The head of every URL before ``epoch``: the last whole table and the changes since, ``HEADS_EVERY`` folders at most."""
    first = max(epoch - 1, 0) // HEADS_EVERY * HEADS_EVERY
    return heads_of(ledger.epochs("heads", HEAD_SCHEMA, range(first, epoch)))


def unseen_rows(ledger: Ledger, obs: DataFrame, epoch: int) -> DataFrame:
    """Observations whose id has not arrived in an earlier epoch.  Only arrivals within the batch's range of ids are
    read, which Parquet statistics narrow to few files where ids grow with time."""
    if not epoch:
        return obs
    low, high = obs.agg(F.min("id"), F.max("id")).first()
    arrived = ledger.committed("arrivals", ARRIVAL_SCHEMA).where(F.col("id").between(low, high))
    return obs.join(arrived, "id", "left_anti")


def ingest(ledger: Ledger, obs: DataFrame, epoch: int) -> DataFrame:
    """The versions among new observations, written with the arrivals and heads of the epoch; reads no stored page.  Only narrow
    columns are compared and shuffled: whole observations are taken by their place in files (``PLACE``), if they tell it, or by id."""
    place = PLACE if set(PLACE) <= set(obs.columns) else ()
    unseen = unseen_rows(ledger, obs.select("id", "url", "fetched_at", "content_hash", *place), epoch)
    heads = read_heads(ledger, epoch)
    with stages_recorded() as stages:
        ledger.write(versions_on_arrival(unseen, heads, whole=obs), "pages", epoch, io.PAGE_LOG_SCHEMA)
    drop_stages(ledger.spark, stages)
    ledger.write(unseen.select("id").distinct(), "arrivals", epoch, ARRIVAL_SCHEMA)
    pages = ledger.epochs("pages", io.PAGE_LOG_SCHEMA, [epoch])
    now = heads_of(heads.unionByName(pages.select(*heads.columns)))
    if epoch % HEADS_EVERY:
        changed = pages.select("url").distinct()
        now = now.join(changed, "url", "left_semi")
    ledger.write(now, "heads", epoch, HEAD_SCHEMA)
    return pages


def run_pipeline(spark: SparkSession, obs: DataFrame, paths: dict[str, str], as_of: dt.datetime,
                 embedder=None, dim: int = DEFAULT_DIM, source: str | None = None, batch: int | None = None,
                 before_commit=None) -> dict[str, int]:
    """P10: raw observations → page versions → processed pages → chunks with vectors, failures to dead letters.

    One call is one epoch (see :mod:`pagelake.sources.ledger`): all tables of it become visible together, and a call that
    died is repeated exactly.  ``source`` and ``batch`` name a micro-batch, which runs once however often it is delivered;
    observations whose id has arrived before add nothing in any batch.  An epoch reads the heads of the URLs, ids of
    earlier arrivals and the pages waiting for another try, never stored HTML.

    A page whose text or tables are not valid goes to the dead letters.  Where ``embedder`` fails for a chunk, the page
    gets no chunks at all: a connection error or time-out puts it on the queue of the next epoch, ``MAX_RETRIES`` times; other
    failures, and the last of these, are dead letters with the number of tries.  Other pages of the batch are not touched.

    ``obs``: (id, url, raw_html, extracted_text, content_hash, fetched_at).  ``paths``: table folders for keys pages,
    processed, chunks, dead_letters.  ``before_commit(epoch)`` is called when all tables are written, before the ledger
    names them.  Returns the rows of each table over all epochs."""
    ledger = Ledger(spark, paths)
    if source is not None and ledger.has(source, batch):
        return ledger.totals()
    epoch = ledger.last() + 1
    pages = ingest(ledger, obs, epoch)

    valid, _ = validate(process_pages(pages), passthrough=("page_id",))
    valid = valid.select(F.col("page_id").alias("id"), "page_id", "text", "tables", F.lit(as_of).cast("timestamp").alias("processed_at"))
    ledger.write(valid, "processed", epoch, io.PROCESSED_SCHEMA)
    # Every page is parsed once: those that are not among the valid ones are rejected.
    done = ledger.epochs("processed", io.PROCESSED_SCHEMA, [epoch]).select("page_id")
    rejected = pages.select(F.col("id").alias("page_id"), _text_ok("extracted_text").alias("ok")).join(done, "page_id", "left_anti")
    rejected = rejected.select("page_id", _fault(F.col("ok")).alias("error"))
    dead = dead_letters(attach_url(rejected, pages), "process_page", as_of)

    waiting = ledger.epochs("queue", QUEUE_SCHEMA, [epoch - 1] if epoch else [])
    old = [r[0] for r in waiting.select("page_epoch").distinct().collect()]  # at most MAX_RETRIES epochs back
    again = ledger.epochs("processed", io.PROCESSED_SCHEMA, old).join(waiting, "page_id", "left_semi")
    to_embed = dedup_by_page(ledger.epochs("processed", io.PROCESSED_SCHEMA, [epoch]).unionByName(again))
    pieces = chunk_pages(to_embed)
    if embedder is None:
        chunks, queue = embed(pieces, "chunk_text", dim=dim), spark.createDataFrame([], QUEUE_SCHEMA)
    else:
        tried = materialize(try_embed(pieces, "chunk_text", embedder, dim), "embedded")
        failed = tried.where("error is not null").groupBy("page_id").agg(
            F.min(F.struct("chunk_index", "error"))["error"].alias("error"), F.bool_and("retryable").alias("retryable"))
        failed = materialize(failed.join(waiting, "page_id", "left").select(
            "page_id", "error", "retryable", F.coalesce("page_epoch", F.lit(epoch)).alias("page_epoch"),
            (F.coalesce("attempts", F.lit(0)) + 1).alias("attempts")), "failed-pages")
        chunks = tried.join(failed.select("page_id"), "page_id", "left_anti")
        more = F.col("retryable") & (F.col("attempts") <= MAX_RETRIES)
        queue = failed.where(more).select("page_id", "page_epoch", "attempts")
        urls = pages.select("id", "url").unionByName(ledger.epochs("pages", io.PAGE_LOG_SCHEMA, old).select("id", "url"))
        dead = dead.unionByName(dead_letters(attach_url(failed.where(~more), urls), "embed_page", as_of, F.col("attempts")))
    chunks = chunks.select((F.col("page_id").cast("decimal(38,0)") * F.lit(CHUNK_ID_SPAN) + F.col("chunk_index")).cast("decimal(38,0)").alias("id"),
                           "page_id", "chunk_text", "embedding", "chunk_index", F.lit(as_of).cast("timestamp").alias("created_at"))
    ledger.write(chunks, "chunks", epoch, io.CHUNK_SCHEMA)
    ledger.write(queue, "queue", epoch, QUEUE_SCHEMA)
    written = io.write_dead_letters(dead, f"{paths['dead_letters']}/epoch={epoch}")

    counts = {t: ledger.epochs(t, s, [epoch]).count() for t, s in TABLE_SCHEMAS.items() if written or t != "dead_letters"}
    if before_commit is not None:
        before_commit(epoch)
    ledger.commit(epoch, source, batch, counts, written)
    return ledger.totals()


TABLE_SCHEMAS = dict(zip(COUNTED, (io.PAGE_LOG_SCHEMA, io.PROCESSED_SCHEMA, io.CHUNK_SCHEMA, io.DEAD_LETTER_SCHEMA), strict=True))


def read_output(spark: SparkSession, paths: dict[str, str], table: str) -> DataFrame:
    """The committed rows of one of the pipeline's tables."""
    return Ledger(spark, paths).committed(table, TABLE_SCHEMAS[table])


def pipeline_paths(spark: SparkSession, name: str = "pipeline") -> dict[str, str]:
    return table_paths(io.scratch_path(spark, name))


def table_paths(base: str) -> dict[str, str]:
    return {k: f"{base}/{k}" for k in (*COUNTED, "state")}


__all__ = ["pending", "validate", "process_pages", "chunk_text", "chunk_pages", "chunk_column", "hashing_vector", "embed", "try_embed",
           "attach_url", "dedup_by_page", "run_pipeline", "read_output", "pipeline_paths", "table_paths", "dead_letters"]
