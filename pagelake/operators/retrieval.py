"""Retrieval: exact k-nearest chunks, keyword search, paging, citations and
prompts (R2, R3, R5–R11).

Exact kNN never materialises query × chunk pairs as rows.  Vectors of both sides
are packed as tiles; a pair of tiles is one matrix product, a task keeps the best
of the tiles it has seen, and a final per-query top-k (WindowGroupLimit) merges
those partial results.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagelake.functions.html import let
from pagelake.functions.text import highlight, snippet
from pagelake.operators.versions import among, latest_ids, restrict_to_latest
from pagelake.session import materialize

# Default k and the answer given when nothing was retrieved.
DEFAULT_K = 5
NO_CONTENT_ANSWER = (
    "No relevant content has been indexed yet, so I can't answer this from the scraped sources."
)

# Rows of a tile of query and of chunk vectors: one matrix product each pair.
QUERY_TILE = 1024
CHUNK_TILE = 4096
# Query tiles up to this many bytes (measured first) go to every task; beyond it, groups of query tiles meet all chunk tiles.
BROADCAST_BYTES = 8 << 20
# Beyond it, the query tiles of a task: this many bytes at most, on the average.
GROUP_BYTES = 16 << 20
# A task hands on what it holds when its best candidates exceed this many rows.
HELD_ROWS = 1 << 20


def _tiles(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """Vectors of ``df`` (id, embedding) packed as tiles of at most ``rows``: (tile, ids, vectors)."""
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("tile", T.LongType()), T.StructField("ids", T.ArrayType(id_type)),
                           T.StructField("vectors", T.BinaryType())])

    def pack(it):
        from pyspark import TaskContext

        first, n = TaskContext.get().partitionId() << 32, 0
        for batch in it:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                sizes = pc.list_value_length(part.column(1))
                if pc.min(sizes).as_py() != pc.max(sizes).as_py():
                    raise ValueError("vectors of one tile differ in length")
                ids, flat = part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False)
                packed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([first + n]), packed, pa.array([flat.astype(np.float64).tobytes()], pa.binary())], names=["tile", "ids", "vectors"])
                n += 1

    return df.select(id_col, "embedding").where("embedding is not null").mapInArrow(pack, schema)


def _nearest_in_tile(q_mat: np.ndarray, c_mat: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, chunk row, distance) of the ``k`` nearest chunks per query; of equal distances the first rows."""
    with np.errstate(divide="ignore", invalid="ignore"):
        dist = 1.0 - (q_mat @ c_mat.T) / np.outer(np.linalg.norm(q_mat, axis=1), np.linalg.norm(c_mat, axis=1))
    dist[np.isnan(dist)] = np.inf
    k = min(k, dist.shape[1])
    edge = np.partition(dist, k - 1, axis=1)[:, k - 1:k]
    keep = dist < edge
    ties = dist == edge
    room = k - keep.sum(axis=1, keepdims=True)
    keep |= ties & (np.cumsum(ties, axis=1, dtype=np.int32) <= room)
    rows, cols = np.nonzero(keep)
    return rows, cols, dist[rows, cols]


def _kernel(k: int, dtypes):
    """Pairs of tiles → candidates (query_id, chunk_id, distance), the best of all tiles that the task has seen."""
    names = ["query_id", "chunk_id", "distance"]

    def scan(it):
        best, held, schema = {}, 0, None
        for batch in it:
            kinds = [batch.schema.field(c).type.value_type for c in ("q_ids", "ids")]
            schema = pa.schema(list(zip(names, [*kinds, pa.float64()], strict=True)))
            for r in batch.to_pylist():
                q_ids, c_ids = (np.array(r[c], dtype=t) for c, t in zip(("q_ids", "ids"), dtypes, strict=True))
                q_mat = np.frombuffer(r["q_vectors"]).reshape(len(q_ids), -1)
                c_mat = np.frombuffer(r["vectors"]).reshape(len(c_ids), -1)
                order = np.argsort(c_ids, kind="stable")
                rows, cols, dist = _nearest_in_tile(q_mat, c_mat[order], k)
                new = pd.DataFrame(dict(zip(names, (q_ids[rows], c_ids[order][cols], dist), strict=True)))
                old = best.get(r["q_tile"])
                if old is not None:
                    held -= len(old)
                    new = pd.concat([old, new], ignore_index=True).sort_values(names[::2] + names[1:2], kind="mergesort")
                    new = new.groupby("query_id", sort=False).head(k)
                best[r["q_tile"]] = new
                held += len(new)
                if held > HELD_ROWS:
                    yield from (pa.RecordBatch.from_pandas(b, schema, preserve_index=False) for b in best.values())
                    best, held = {}, 0
        yield from (pa.RecordBatch.from_pandas(b, schema, preserve_index=False) for b in best.values())

    return scan


def _paired(q_tiles: DataFrame, c_tiles: DataFrame, k: int, broadcast_bytes: int) -> DataFrame:
    """Every query tile beside every chunk tile."""
    size, n_queries = q_tiles.agg(F.coalesce(F.sum(F.length("q_vectors")), F.lit(0)), F.coalesce(F.sum(F.size("q_ids")), F.lit(0))).first()
    if size <= broadcast_bytes:
        return c_tiles.crossJoin(F.broadcast(q_tiles))
    groups = max(-(-size // GROUP_BYTES), -(-2 * n_queries * k // HELD_ROWS), 1)
    streams = -(-2 * q_tiles.sparkSession.sparkContext.defaultParallelism // groups)
    # The right side of the product is held by a task, the left one passes by.
    return materialize(c_tiles, "chunk-tiles").coalesce(streams).hint("shuffle_replicate_nl").crossJoin(q_tiles.repartition(groups))


def knn(queries: DataFrame, chunks: DataFrame, k: int = DEFAULT_K,
        payload_cols: tuple[str, ...] = ("page_id", "chunk_index", "chunk_text"),
        broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Exact top-k chunks per query by cosine distance, ties broken by chunk_id.

    ``queries``: (query_id, embedding); ``chunks``: (chunk_id, embedding, payload…), chunk ids unique.  Both sides are packed
    as tiles of vectors, and every pair of tiles is one matrix product.  Query tiles of a measured size are broadcast;
    of larger sets, groups of query tiles of a bounded size are dealt to the tasks, and the written chunk tiles pass by each
    group in one stream (in a few, where there are fewer groups than cores).  So the vectors of the queries are shuffled once, those of the
    chunks never, and a query has ``k`` candidates per stream, however many chunks there are.  Payload is joined to the top k at the end.  Returns (query_id, rank, chunk_id, distance, payload…)."""
    if k < 1:
        raise ValueError("k must be >= 1")
    q_type, c_type = queries.schema["query_id"].dataType, chunks.schema["chunk_id"].dataType
    out = T.StructType([T.StructField("query_id", q_type), T.StructField("chunk_id", c_type), T.StructField("distance", T.DoubleType())])
    q_tiles = materialize(_tiles(queries.select("query_id", "embedding").distinct(), "query_id", QUERY_TILE), "query-tiles")
    q_tiles = q_tiles.toDF("q_tile", "q_ids", "q_vectors")
    c_tiles = _tiles(chunks, "chunk_id", CHUNK_TILE)
    pairs = _paired(q_tiles, c_tiles, k, broadcast_bytes)
    dtypes = [np.int64 if isinstance(t, T.LongType) else object for t in (q_type, c_type)]
    cands = pairs.select("q_tile", "q_ids", "q_vectors", "ids", "vectors").mapInArrow(_kernel(k, dtypes), out)
    w = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    top = cands.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.join(chunks.select("chunk_id", *payload_cols), "chunk_id").select("query_id", "chunk_id", "distance", *payload_cols, "rank")


def retrieve(queries: DataFrame, chunks: DataFrame, pages: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """R2: k nearest chunks of *current* page versions per query, closest first,
    no cap per URL.  Returns (query_id, rank, chunk_id, page_id, url,
    chunk_text, chunk_index, distance)."""
    current = restrict_to_latest(chunks, pages)
    top = knn(queries, current, k)
    urls = pages.select(F.col("id").alias("page_id"), "url")
    return top.join(urls, "page_id").select(
        "query_id", "rank", "chunk_id", "page_id", "url", "chunk_text", "chunk_index", "distance")


def label_sources(retrieved: DataFrame) -> DataFrame:
    """Citation numbers 1..N per URL in order of first appearance by rank.

    Adds ``citation`` and ``is_source`` (the first chunk of each URL)."""
    by_url = Window.partitionBy("query_id", "url")
    first = F.min("rank").over(by_url)
    labeled = retrieved.withColumn("_first", first)
    cit = F.dense_rank().over(Window.partitionBy("query_id").orderBy("_first"))
    return labeled.withColumn("citation", cit).withColumn("is_source", F.col("rank") == F.col("_first")) \
        .drop("_first")


def sources(labeled: DataFrame) -> DataFrame:
    """One row per (query, citation) with the URL and first chunk's text."""
    return labeled.filter("is_source").select("query_id", "citation", "url", "chunk_text")


def build_prompts(labeled: DataFrame, queries: DataFrame) -> DataFrame:
    """Context blocks ``[n] text`` in rank order, joined by blank lines, and
    the prompt ``Sources:\\n<context>\\n\\nQuestion: <query>``."""
    blocks = labeled.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("["), F.col("citation").cast("string"),
                                                               F.lit("] "), F.col("chunk_text")).alias("b"))))
        .alias("_blocks"))
    ctx = F.array_join(F.transform("_blocks", lambda x: x["b"]), "\n\n")
    return blocks.join(queries.select("query_id", "query"), "query_id").select(
        "query_id", ctx.alias("context"),
        F.concat(F.lit("Sources:\n"), ctx, F.lit("\n\nQuestion: "), F.col("query")).alias("prompt"))


def ask_batch(queries: DataFrame, chunks: DataFrame, pages: DataFrame, k: int = DEFAULT_K,
              generator=None) -> DataFrame:
    """Answer a batch of queries.

    Queries without any retrieved chunk get the fixed no-content answer and no
    generator call.  ``generator`` (optional) is a function ``pd.Series of
    prompts -> pd.Series of answers`` run through ``mapInPandas`` in Arrow
    batches; without it the answer stays null and the prompt is returned."""
    # read three times below, so written once
    labeled = materialize(label_sources(retrieve(queries, chunks, pages, k)), "labeled")
    prompts = build_prompts(labeled, queries)
    n_src = labeled.groupBy("query_id").agg(F.max("citation").alias("n_sources"))
    base = queries.select("query_id").join(prompts, "query_id", "left").join(n_src, "query_id", "left")
    with_prompt = base.filter(F.col("prompt").isNotNull())
    empty = base.filter(F.col("prompt").isNull()).select(
        "query_id", F.lit(NO_CONTENT_ANSWER).alias("answer"), F.lit(0).cast("long").alias("n_sources"),
        F.lit(None).cast("string").alias("prompt"))
    if generator is None:
        answered = with_prompt.select("query_id", F.lit(None).cast("string").alias("answer"),
                                      F.col("n_sources").cast("long"), "prompt")
    else:
        schema = T.StructType([queries.schema["query_id"], *T.StructType.fromDDL("answer string, n_sources long, prompt string").fields])

        def gen(it):
            for pdf in it:
                yield pd.DataFrame({"query_id": pdf["query_id"], "answer": generator(pdf["prompt"]),
                                    "n_sources": pdf["n_sources"], "prompt": pdf["prompt"]})

        answered = with_prompt.select("query_id", "n_sources", "prompt").mapInPandas(gen, schema)
    return answered.unionByName(empty)


def keyword_search(processed: DataFrame, pages: DataFrame, queries, limit: int = 10,
                   literal: bool = False) -> DataFrame:
    """R3 (+R4): ILIKE ``%q%`` over the latest-version processed text, with URL
    and snippet; at most ``limit`` hits per query, ordered by page_id.

    ``queries`` is one string or a list of strings (the list travels inside
    the plan as a literal array, so matching is one pass over the text)."""
    qs = [queries] if isinstance(queries, str) else list(queries)
    if not qs or any(not q for q in qs):
        raise ValueError("query must be non-empty")
    if not 1 <= limit <= 50:
        raise ValueError("limit must be within 1..50")
    current = restrict_to_latest(processed, pages)

    def pat(q):
        # A backslash stands for itself; only the wildcards keep their meaning in the default mode.
        q = q.replace("\\", "\\\\")
        if literal:
            q = q.replace("%", "\\%").replace("_", "\\_")
        return F.lit(f"%{q}%")

    hits = current.select(
        "id", "page_id", "text",
        F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(q).alias("q"), pat(q).alias("p"))
                                     for i, q in enumerate(qs)]),
                           lambda s: F.ilike(F.col("text"), s["p"]))).alias("_q"))
    w = Window.partitionBy("_q.i").orderBy("page_id", "id")
    top = hits.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit)
    urls = pages.select(F.col("id").alias("page_id"), "url")
    return top.join(urls, "page_id").select(
        F.col("_q.q").alias("query"), F.col("_r").cast("long").alias("hit_no"), "page_id", "url",
        snippet(F.col("text"), F.col("_q.q")).alias("snippet"))


def _like_pattern(query: Column, literal: bool) -> Column:
    # A backslash stands for itself; only the wildcards keep their meaning in the default mode.
    out = F.replace(query, F.lit("\\"), F.lit("\\\\"))
    if literal:
        out = F.replace(F.replace(out, F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_"))
    return F.concat(F.lit("%"), out, F.lit("%"))


def keyword_search_table(processed: DataFrame, pages: DataFrame, queries: DataFrame, limit: int = 10,
                         literal: bool = False, gram: int = 3) -> DataFrame:
    """R3 (+R4) for a table of queries (column ``query``): the hits of :func:`keyword_search` for each distinct query.

    The texts that hold each character n-gram (up to ``gram``) of a query are counted.  Of each query the n-gram that the
    fewest texts hold finds its candidates, for which an inverted index of these n-grams alone is written, and ``ILIKE``
    decides on them, so a text meets only the queries that share a rare n-gram with it.  Queries without any literal
    character meet all texts.  Null and empty queries have no hits."""
    if not 1 <= limit <= 50:
        raise ValueError("limit must be within 1..50")
    asked = queries.select("query").where(F.coalesce(F.col("query"), F.lit("")) != "").distinct()
    # n-grams that a match must hold: those of the pieces between wildcards; of a shorter piece the piece itself.
    lowered = F.lower("query")
    pieces = F.array(lowered) if literal else F.split(lowered, "[%_]")
    grams = F.array_distinct(F.flatten(F.transform(pieces, lambda p: _ngrams(p, F.least(F.length(p), F.lit(gram))))))
    wanted = asked.select("query", _like_pattern(F.col("query"), literal).alias("pattern"),
                          F.explode(F.when(F.size(grams) > 0, grams).otherwise(F.array(F.lit("")))).alias("gram"))
    wanted = materialize(wanted, "query-grams")
    # Read by every step below, so written once; the texts of other versions are never shuffled.
    current = materialize(among(processed.select("id", "page_id", "text"), "page_id", latest_ids(pages)), "latest-texts")
    counts = _held(current, wanted.select("gram").distinct(), gram, count=True)
    # A query with an n-gram that no text holds has no hit.
    rarest = materialize(wanted.join(counts, "gram", "left").groupBy("query", "pattern").agg(
        F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("rare")).select(
        "query", "pattern", F.col("rare.gram").alias("gram")), "rarest-grams")
    postings = materialize(_held(current, rarest.select("gram").distinct(), gram), "postings")
    candidates = rarest.join(postings, "gram").select("query", "pattern", "id")
    hits = candidates.join(current, "id").where(F.ilike(F.col("text"), F.col("pattern"))).select("query", "page_id", "id")
    # At most ``limit`` rows a query: once written, the shuffle of the texts is gone, and only texts of hits are read again.
    top = materialize(hits.withColumn("hit_no", F.row_number().over(Window.partitionBy("query").orderBy("page_id", "id"))).where(
        F.col("hit_no") <= limit), "top-hits")
    urls = pages.select(F.col("id").alias("page_id"), "url")
    texts = among(current.select("id", "text"), "id", top.select("id"))
    return top.join(texts, "id").join(urls, "page_id").select(
        "query", F.col("hit_no").cast("long").alias("hit_no"), "page_id", "url",
        snippet(F.col("text"), F.col("query")).alias("snippet"))


def _held(texts: DataFrame, grams: DataFrame, longest: int, count: bool = False, known_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, gram): which of ``grams`` each lower-cased text holds, each once; with ``count`` (gram, texts), how many texts hold it.

    A table of n-grams that is measured to be small goes to every task, where each window of a text is looked up;
    a larger one is joined to the n-grams of all texts."""
    if (grams.agg(F.sum(F.octet_length("gram") + 8)).first()[0] or 0) > known_bytes:
        held = F.array_distinct(let(F.split(F.lower("text"), ""), lambda letters: F.concat(
            F.array(F.lit("")), *[_windows(letters, n) for n in range(1, longest + 1)])))
        found = texts.select("id", F.explode(held).alias("gram")).join(grams, "gram", "left_semi")
        return found.groupBy("gram").agg(F.count("*").alias("texts")) if count else found
    by_length = {}
    for r in grams.collect():
        by_length.setdefault(len(r["gram"]), set()).add(r["gram"])

    def held_in(text):
        out = []
        for n, known in by_length.items():
            if n == 0:
                out.append("")
            else:
                out.extend(known.intersection(map("".join, zip(*(text[k:] for k in range(n)), strict=False)) if n > 1 else text))
        return out

    def index(it):
        for batch in it:
            found = [held_in(t) for t in batch.column(1).to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([g for f in found for g in f], pa.string())], names=["id", "gram"])

    def counted(it):
        n = Counter()
        for batch in it:
            for t in batch.column(1).to_pylist():
                n.update(held_in(t))
        yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], names=["gram", "texts"])

    lowered = texts.where("text is not null").select("id", F.lower("text").alias("text"))
    if count:
        return lowered.mapInArrow(counted, "gram string, texts long").groupBy("gram").agg(F.sum("texts").alias("texts"))
    return lowered.mapInArrow(index, T.StructType([texts.schema["id"], T.StructField("gram", T.StringType())]))


def _windows(letters: Column, n: int) -> Column:
    """All n-grams of an array of characters, in one pass; at the end also shorter ones."""
    if n == 1:
        return letters
    return F.transform(letters, lambda c, i: F.concat(c, *[F.coalesce(F.get(letters, i + k), F.lit("")) for k in range(1, n)]))


def _ngrams(text: Column, n: Column) -> Column:
    """The n-grams of a text, repeated ones included; none of an empty text, or of one shorter than n."""
    starts = F.when((F.length(text) >= n) & (n > 0), F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(
        F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i, n))


def _page_list(df: DataFrame, order: list, cols: list[str], limit: int, offset: int) -> DataFrame:
    if not 1 <= limit <= 100:
        raise ValueError("limit must be within 1..100")
    if offset < 0:
        raise ValueError("offset must be >= 0")
    spark: SparkSession = df.sparkSession
    page = df.select(*cols).orderBy(*order).offset(offset).limit(limit)
    return spark.sql("SELECT p.*, (SELECT count(*) FROM {src}) AS total FROM {page} p", src=df.select(), page=page)


def list_pages(pages: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """All versions, newest first (``fetched_at DESC, id DESC``), with total."""
    return _page_list(pages, [F.col("fetched_at").desc(), F.col("id").desc()],
                      ["id", "url", "content_hash", "fetched_at"], limit, offset)


def list_processed(processed: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Processed pages by ``processed_at DESC, id DESC``, with total."""
    return _page_list(processed, [F.col("processed_at").desc(), F.col("id").desc()],
                      ["id", "page_id", "processed_at"], limit, offset)


def get_by_id(df: DataFrame, id_value, id_col: str = "id") -> DataFrame:
    """Point lookup (pushed to the Parquet scan); empty result = not found."""
    return df.filter(F.col(id_col) == F.lit(id_value))


def get_page(pages: DataFrame, page_id) -> DataFrame:
    """One raw page by id (empty = not found)."""
    return get_by_id(pages, page_id)


def get_processed(processed: DataFrame, processed_id) -> DataFrame:
    """One processed page by id (empty = not found)."""
    return get_by_id(processed, processed_id)


def parse_citations(answers: DataFrame) -> DataFrame:
    """(query_id, pos, citation) for every citation number in an answer."""
    from pagelake.functions.text import citation_numbers

    return answers.select("query_id", F.posexplode(citation_numbers("answer")).alias("pos", "citation"))


def dangling_citations(parsed: DataFrame, srcs: DataFrame) -> DataFrame:
    """R11 re-aim: cited numbers that match no source of the same query."""
    return parsed.join(srcs.select("query_id", "citation"), ["query_id", "citation"], "left_anti")


def highlight_matches(df: DataFrame, text_col: str, q) -> DataFrame:
    """R12 over a table."""
    return df.withColumn("highlighted", highlight(F.col(text_col), q))


__all__ = ["knn", "retrieve", "label_sources", "sources", "build_prompts", "ask_batch", "keyword_search", "keyword_search_table",
           "list_pages", "list_processed", "get_by_id", "get_page", "get_processed", "parse_citations", "dangling_citations",
           "highlight_matches", "latest_ids", "DEFAULT_K", "NO_CONTENT_ANSWER"]
