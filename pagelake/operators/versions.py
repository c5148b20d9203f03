"""Versioning over the append-only page log (V1–V8).

"Current version" is a query, never a stored flag.  Latest-per-key is an
aggregation (``max`` of an ``(order…, id)`` struct) rather than a window, so a
URL with a huge number of versions is combined map-side instead of landing in
one task.  Previous-row comparisons (V4/V5/V6) use the skew-safe ordered scan
in :mod:`pagelake.plans.scan`.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions.text import common_prefix_len
from pagelake.plans.scan import ordered_scan
from pagelake.session import materialize

# Columns of observations that are rows of files: the file, and the number of the row in it.
PLACE = ("_file", "_row")
# Bitmaps (4 KB, for 32,768 rows of a file or ids each) that are broadcast at most: 64 MB.
MOST_BITMAPS = 1 << 14


def latest_ids(pages: DataFrame, key: str = "url", order: tuple[str, ...] = ("fetched_at", "id"),
               id_col: str = "id") -> DataFrame:
    """Ids of the newest row per ``key`` by ``order`` descending (ties → id)."""
    best = F.max(F.struct(*[F.col(c) for c in order], F.col(id_col).alias("_id")))
    return pages.groupBy(key).agg(best.alias("_m")).select(F.col("_m._id").alias(id_col))


def latest_versions(pages: DataFrame) -> DataFrame:
    """V1: the latest version row of every URL (``fetched_at DESC, id DESC``)."""
    return pages.join(latest_ids(pages), "id", "left_semi")


def latest_page(pages: DataFrame, url) -> DataFrame:
    """V2: the latest version of one URL (zero or one row)."""
    cond = F.col("url") == (F.lit(url) if isinstance(url, str) else url)
    return pages.filter(cond).orderBy(F.col("fetched_at").desc(), F.col("id").desc()).limit(1)


def latest_page_for(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """V2 in batch form: the latest version for each URL of ``urls`` (unknown → no row)."""
    return latest_versions(pages.join(urls.select("url").distinct(), "url", "left_semi"))


def latest_processed(processed: DataFrame, pages: DataFrame) -> DataFrame:
    """V3: latest processed record per URL by ``processed_at DESC, id DESC``.

    Joined through the page table; it may lag behind V1 when the newest page
    version has not been processed yet."""
    joined = processed.join(pages.select(F.col("id").alias("page_id"), "url"), "page_id")
    keep = latest_ids(joined, key="url", order=("processed_at", "id"))
    return joined.join(keep, "id", "left_semi")


def collapse_unchanged(obs: DataFrame, key: str = "url", order: tuple[str, ...] = ("fetched_at", "id"),
                       hash_col: str = "content_hash") -> DataFrame:
    """V4: keep an observation only when its hash differs from the previous
    observation of the same URL (A→B→A is three versions).  An id delivered twice counts once."""
    # scan only the narrow columns; wide rows (HTML, text) are kept by id afterwards
    obs = one_delivery(obs)
    narrow = obs.select(key, *dict.fromkeys([*order, "id"]), hash_col)
    scanned = ordered_scan(narrow, key=key, order=list(order), lag_cols=[hash_col])
    prev = F.col(f"prev_{hash_col}")
    kept = scanned.filter(prev.isNull() | (prev != F.col(hash_col))).select("id")
    return obs.join(kept, "id", "left_semi")


def one_delivery(df: DataFrame, id_col: str = "id") -> DataFrame:
    """One row per id: a message delivered twice in a batch counts once."""
    return df.dropDuplicates([id_col])


def heads_of(stored: DataFrame, key: str = "url", order: tuple[str, ...] = ("fetched_at", "id"),
             hash_col: str = "content_hash") -> DataFrame:
    """The head of every URL: key, hash and order columns of its latest stored version (one aggregation)."""
    columns = list(dict.fromkeys([*order, hash_col]))
    best = F.max(F.struct(*[F.col(c) for c in columns])).alias("_m")
    return stored.groupBy(key).agg(best).select(key, *[F.col(f"_m.{c}").alias(c) for c in columns])


def rows_at(rows: DataFrame, places: DataFrame) -> DataFrame:
    """The ``rows`` whose ``PLACE`` is one of ``places``, without that; the places travel as bitmaps, a bit for each row of the
    files, so that no row is shuffled.  Too many bitmaps for a broadcast are joined instead."""
    file, row = PLACE
    block, bit = F.bitmap_bucket_number(F.col(row) + 1), F.bitmap_bit_position(F.col(row) + 1)
    maps = materialize(places.groupBy(file, block.alias("_block")).agg(F.bitmap_construct_agg(bit).alias("_bits")), "places")
    if maps.count() > MOST_BITMAPS:
        return rows.join(places.select(*PLACE), [*PLACE], "left_semi").drop(*PLACE)
    return _marked(rows.withColumn("_block", block), maps, [file, "_block"], bit).drop(*PLACE)


def _marked(rows: DataFrame, maps: DataFrame, keys: list[str], bit: Column) -> DataFrame:
    """The ``rows`` whose ``bit`` is set in their bitmap among ``maps``, which go to every task."""
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return rows.join(F.broadcast(maps), keys).where(F.getbit(byte, (bit % 8).cast("int")) == 1).drop("_block", "_bits")


def among(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The ``rows`` whose ``key`` is one of ``ids`` (a column), as a semi-join finds them.  Whole numbers travel as bitmaps, a bit for
    each, so that no row is shuffled; other ids, and such as need too many bitmaps for a broadcast, are joined."""
    ids = materialize(ids.toDF(key).distinct(), "ids")
    whole = {rows.schema[key].dataType.simpleString(), ids.schema[key].dataType.simpleString()} <= {"int", "bigint"}
    block, bit = F.bitmap_bucket_number(F.col(key)), F.bitmap_bit_position(F.col(key))
    if not whole or ids.select(block).distinct().limit(MOST_BITMAPS + 1).count() > MOST_BITMAPS:
        return rows.join(ids, key, "left_semi").select(*rows.columns)
    # The ids of a block are brought together first, so that each bitmap is made once, whole.
    maps = materialize(ids.select(block.alias("_block"), bit.alias("_bit")).repartition("_block").groupBy("_block").agg(
        F.bitmap_construct_agg("_bit").alias("_bits")), "bitmaps")
    return _marked(rows.withColumn("_block", block), maps, ["_block"], bit).select(*rows.columns)


def versions_on_arrival(unseen: DataFrame, heads: DataFrame, key: str = "url", order: tuple[str, ...] = ("fetched_at", "id"),
                        hash_col: str = "content_hash", whole: DataFrame | None = None) -> DataFrame:
    """The rows of ``unseen`` that become versions, given the ``heads`` (see :func:`heads_of`) before they arrive.

    A row is compared with the head on arrival.  Rows older than the stored head (late ones) leave it as it is, so each
    is compared with that head; of the others the first is compared with the head and every further one with its
    predecessor.  Only narrow columns are scanned; wide rows are kept by id at the end, where one shuffle by id serves the
    join and the choice of one delivery.  Of rows with equal id but other content the least by (key, order, hash) counts.

    ``unseen`` may be narrow if ``whole`` has the wide rows: the versions are then taken from these.  No wide row is shuffled where
    ``unseen`` and ``whole`` tell the ``PLACE`` of their rows; else only those are that share their id with another."""
    placed_rows = whole is not None and set(PLACE) <= set(whole.columns)
    columns = list(dict.fromkeys([key, *order, "id", hash_col, *(PLACE if placed_rows else ())]))
    narrow = unseen.groupBy("id").agg(F.min(F.struct(*columns)).alias("_r"), F.count("*").alias("_copies")).select("_r.*", "_copies")
    known = heads.select(F.col(key), F.col(hash_col).alias("_head_hash"), F.struct(*order).alias("_head"))
    placed = narrow.join(known, key, "left")
    late = F.col("_head").isNotNull() & (F.struct(*order) < F.col("_head"))
    placed = placed.withColumn("_late", late)
    scanned = ordered_scan(placed.where("not _late").select(*columns, "_copies", "_head_hash"), key=key, order=list(order), lag_cols=[hash_col])
    before = F.when(F.col("_rn") == 1, F.col("_head_hash")).otherwise(F.col(f"prev_{hash_col}"))
    kept = scanned.where(before.isNull() | (before != F.col(hash_col))).select(*columns, "_copies")
    kept = kept.unionByName(placed.where(F.col("_late") & (F.col(hash_col) != F.col("_head_hash"))).select(*columns, "_copies"))
    if whole is None:
        return _same_rows(unseen, kept.select(columns))
    kept = kept.dropna(subset=columns)   # null equals nothing, as in the join of _same_rows
    if placed_rows:
        return rows_at(whole, kept)
    kept = materialize(kept, "kept")
    out = among(whole, "id", kept.where("_copies = 1").select("id"))
    several = kept.where("_copies > 1").select(columns)
    if several.limit(1).count():
        out = out.unionByName(_same_rows(among(whole, "id", several.select("id")), several))
    return out


def _same_rows(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """One of the ``rows`` for each id that equals the row of ``kept`` with this id in all columns of that."""
    # The other columns are compared as ranges, so that the join, like one_delivery, is by id alone.  A semi-join would be pushed
    # below the joins that ``rows`` come from, and shuffle what these leave out; ids of ``kept`` are distinct, so this is the same.
    columns = kept.columns
    kept = kept.toDF(*[f"_kept_{c}" for c in columns])
    same = [F.col(c).between(F.col(f"_kept_{c}"), F.col(f"_kept_{c}")) for c in columns if c != "id"]
    return one_delivery(rows.join(kept, reduce(and_, same, F.col("id") == F.col("_kept_id"))).select(*rows.columns))


def new_versions(stored: DataFrame, incoming: DataFrame, key: str = "url",
                 order: tuple[str, ...] = ("fetched_at", "id"), hash_col: str = "content_hash",
                 seen: DataFrame | None = None) -> DataFrame:
    """V5: versions of an incoming batch against the stored log.

    The first incoming observation of a URL is compared with the latest stored version, later ones with their
    predecessor inside the batch, and an observation that arrives late (older than the stored head) with that head.
    Replays add nothing.  ``seen`` names the ids that have arrived before, stored or skipped as unchanged, and so tells a
    replay from a late arrival.  Without it only stored ids are known, and a late observation that equals the version before
    its own time is taken for the replay of one that was skipped."""
    known = stored.select("id") if seen is None else stored.select("id").unionByName(seen.select("id"))
    unseen = incoming.join(known, "id", "left_anti")
    heads = heads_of(stored, key, order, hash_col)
    kept = versions_on_arrival(unseen, heads, key, order, hash_col)
    if seen is not None:
        return kept
    columns = list(dict.fromkeys([key, *order, "id", hash_col]))
    late = kept.join(heads.select(F.col(key), F.struct(*order).alias("_head")), key).where(F.struct(*order) < F.col("_head"))
    log = late.select(*columns, F.lit(True).alias("_late")).unionByName(
        stored.join(late.select(key).distinct(), key, "left_semi").select(*columns, F.lit(False).alias("_late")))
    between = ordered_scan(log, key=key, order=list(order), lag_cols=[hash_col])
    again = between.where(F.col("_late") & (F.col(f"prev_{hash_col}") == F.col(hash_col))).select("id")
    return kept.join(again, "id", "left_anti")


def version_history(pages: DataFrame, key: str = "url", order: tuple[str, ...] = ("fetched_at", "id")) -> DataFrame:
    """V6: version number (1 = oldest) and version count per URL."""
    narrow = pages.select(key, *dict.fromkeys([*order, "id"]))
    numbers = ordered_scan(narrow, key=key, order=list(order), lag_cols=[]).select(
        "id", F.col("_rn").alias("version_no"))
    counts = pages.groupBy(key).agg(F.count(F.lit(1)).alias("n_versions"))
    return pages.join(numbers, "id").join(counts, key)


def restrict_to_latest(df: DataFrame, pages: DataFrame, page_key: str = "page_id") -> DataFrame:
    """V7: keep rows whose ``page_id`` is the latest version of its URL."""
    ids = latest_ids(pages).withColumnRenamed("id", page_key)
    return df.join(ids, page_key, "left_semi")


def prefix_overlap(df: DataFrame, a: str, b: str, remove_from_b: str | None = None) -> DataFrame:
    """V8: common-prefix length of two renderings and its share of the shorter
    text in percent, after removing a known boilerplate string from ``b``."""
    bcol: Column = F.col(b)
    if remove_from_b:
        bcol = F.replace(bcol, F.lit(remove_from_b), F.lit(""))
    shorter = F.least(F.length(a), F.length(bcol))
    plen = common_prefix_len(F.col(a), bcol)
    pct = F.when(shorter > 0, F.lit(100.0) * plen / shorter).otherwise(F.lit(0.0))
    return df.withColumn("prefix_len", plen).withColumn("shorter_len", shorter.cast("bigint")) \
        .withColumn("overlap_pct", pct)
