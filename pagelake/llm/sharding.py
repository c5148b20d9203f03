"""Operator 3: a uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

1. Equal rows are counted and numbered, so that each copy is a row of its own.  Rows are dealt into blocks by a hash of
   their content and copy number, and the blocks are counted.
2. The matrix of block-to-shard counts is drawn from the multivariate hypergeometric law: row sums are the block sizes,
   column sums the exact shard sizes (at most one apart).  It is drawn in two steps: the driver draws the counts of
   ``SUPERBLOCKS`` groups of blocks at most, and tasks divide those of each group among its blocks by the same law, so blocks
   stay at about ``BLOCK_ROWS`` rows however many there are.
3. Each block is permuted locally, and its ranks are cut by its row of the matrix.
4. The rows are exchanged, and permuted again within their shard: a shard is cut into pieces by a random key, the
   pieces are counted, and a row's slot is its piece's offset plus its rank there.  So neither permutation needs
   a whole shard in one task.

Every draw is seeded and every rank ordered by content and copy, so a task that runs again gives the same rows.
Defined results: null and empty texts are rows like others; the copies of a row are spread like any rows (-0.0 and 0.0
are equal, and come back as 0.0), maps included; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelake.llm.common import fresh, q, read
from pagelake.session import materialize

SEED = 3
SHARDS = 16
BLOCK_ROWS = 20_000
SUPERBLOCKS = 4096


def hypergeometric(rng, good: int, bad: int, sample: int) -> int:
    """One exact draw; beyond numpy's range by inversion around the mode."""
    if min(good, bad, sample) == 0 or good + bad == sample:
        return good if sample >= good + bad else 0 if good == 0 or sample == 0 else sample
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, sample))
    n = good + bad
    mean, sd = sample * good / n, math.sqrt(sample * (good / n) * (bad / n) * (n - sample) / max(1, n - 1))
    low = max(0, sample - bad, int(mean - 40 * sd - 40))
    k = np.arange(low, min(good, sample, int(mean + 40 * sd + 40)) + 1, dtype=float)
    step = np.log(good - k[:-1]) + np.log(sample - k[:-1]) - np.log(k[1:]) - np.log(bad - sample + k[1:])
    logs = np.concatenate([[0.0], np.cumsum(step)])
    cdf = np.cumsum(np.exp(logs - logs.max()))
    return int(low + np.searchsorted(cdf, rng.random() * cdf[-1], "right"))


def shard_sizes(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def communication_matrix(blocks: list[int], room: list[int], seed) -> list[list[int]]:
    """Block-to-shard counts of a uniform shuffle into shards of the sizes ``room`` (which sum up like the blocks)."""
    room = list(room)
    rng = np.random.default_rng(seed)
    matrix = []
    for size in blocks:
        row, left, rest = [], size, sum(room)
        for s in range(len(room)):
            got = hypergeometric(rng, room[s], rest - room[s], left)
            rest -= room[s]
            room[s] -= got
            left -= got
            row.append(got)
        matrix.append(row)
    return matrix


def block_cuts(sizes: DataFrame, total: int, shards: int, seed: int) -> DataFrame:
    """(block, cuts) for ``sizes`` (block, n): the running sums of each block's row of the matrix, written."""
    grouped = sizes.select("block", "n", F.pmod("block", F.lit(SUPERBLOCKS)).alias("superblock"))
    supers = sorted(tuple(r) for r in grouped.groupBy("superblock").agg(F.sum("n")).collect())
    drawn = communication_matrix([n for _, n in supers], shard_sizes(total, shards), seed)
    rows = [(s, row) for (s, _), row in zip(supers, drawn, strict=True)]
    # At most SUPERBLOCKS rows of one integer per shard.
    rooms = F.broadcast(sizes.sparkSession.createDataFrame(rows, "superblock int, room array<bigint>"))

    def divide(key, blocks):
        blocks = blocks.sort_values("block")
        made = communication_matrix(blocks["n"].tolist(), [int(x) for x in blocks["room"].iloc[0]], [seed, int(key[0])])
        return pd.DataFrame({"block": blocks["block"], "cuts": [[int(x) for x in np.cumsum(row)] for row in made]})

    return materialize(grouped.join(rooms, "superblock").groupBy("superblock").applyInPandas(
        divide, "block int, cuts array<bigint>"), "shard-cuts")


def numbered(df: DataFrame, mark: str, copy: str, seed: int) -> tuple[DataFrame, int]:
    """``df`` with ``mark`` (a hash of the row) and ``copy`` (0, 1, ... among equal rows), and its number of rows.  Equal
    rows are folded before the shuffle and written with their count; long counts are unfolded in many tasks."""
    n, low = fresh(df.withColumn(mark, F.lit(0)).withColumn(copy, F.lit(0)), "n", "low")
    columns = [q(c) for c in df.columns]
    # Maps have no hash; their text has.
    marked = [F.to_json(F.struct(q(f.name))) if "map<" in f.dataType.simpleString() else q(f.name) for f in df.schema.fields]
    mark_of = F.xxhash64(F.lit(seed), *marked) if df.columns else F.lit(0).cast("long")
    held = materialize(df.withColumn(mark, mark_of).groupBy(*columns, q(mark)).agg(F.count("*").alias(n)), "shard-rows")
    total, most = held.agg(F.sum(q(n)), F.max(q(n))).first()
    runs = held.withColumn(low, F.lit(0).cast("long"))
    if (most or 0) > BLOCK_ROWS:
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rest = held.where(q(n) > BLOCK_ROWS).withColumn(
            low, F.explode(F.sequence(F.lit(BLOCK_ROWS).cast("long"), q(n) - 1, F.lit(BLOCK_ROWS).cast("long"))))
        runs = runs.unionByName(rest.repartition(tasks, q(mark), q(low)))
    last = F.least(q(low) + BLOCK_ROWS, q(n)) - 1
    return runs.select(*columns, q(mark), F.explode(F.sequence(q(low), last)).alias(copy)), total or 0


def shard(df: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``df`` with ``shard`` and ``slot`` (underscored if taken)."""
    shard_, slot, mark, copy, block, cuts, rank, piece, first = fresh(
        df, "shard", "slot", "mark", "copy", "block", "cuts", "rank", "piece", "first")
    columns = [q(c) for c in df.columns]
    rows, total = numbered(df, mark, copy, seed)
    draw = lambda k: F.xxhash64(q(mark), q(copy), F.lit(k))
    n_blocks = max(1, math.ceil(total / BLOCK_ROWS))
    placed = rows.withColumn(block, F.pmod(draw(1), F.lit(n_blocks)).cast("int"))
    sizes = placed.groupBy(q(block).alias("block")).agg(F.count("*").alias("n"))
    table = block_cuts(sizes, total, shards, seed).select(F.col("block").alias(block), F.col("cuts").alias(cuts))
    local = Window.partitionBy(q(block)).orderBy(draw(2), q(mark), q(copy))
    ranked = placed.withColumn(rank, F.row_number().over(local) - 1).join(table, block)
    sent = ranked.withColumn(shard_, F.size(F.filter(q(cuts), lambda c: c <= q(rank))).cast("int"))
    pieces = max(1, math.ceil(total / shards / BLOCK_ROWS))
    sent = sent.withColumn(piece, F.pmod(draw(3), F.lit(pieces)).cast("int"))
    again = Window.partitionBy(q(shard_), q(piece)).orderBy(draw(4), q(mark), q(copy))
    sent = sent.select(*columns, q(mark), q(copy), q(shard_), q(piece))
    # Narrow recount of the same draw: rows per (shard, piece), then running offsets within each shard.
    narrow = placed.select(q(mark), q(copy), q(block)).withColumn(rank, F.row_number().over(local) - 1).join(table, block)
    counts = narrow.select(
        F.size(F.filter(q(cuts), lambda c: c <= q(rank))).cast("int").alias(shard_),
        F.pmod(draw(3), F.lit(pieces)).cast("int").alias(piece),
    ).groupBy(q(shard_), q(piece)).agg(F.count("*").alias("n")).withColumn(
        first, F.sum("n").over(Window.partitionBy(q(shard_)).orderBy(q(piece)).rowsBetween(
            Window.unboundedPreceding, -1))).select(q(shard_), q(piece), F.coalesce(q(first), F.lit(0)).alias(first))
    inside = sent.withColumn(slot, F.row_number().over(again) - 1)
    return inside.join(counts, [shard_, piece]).select(
        *columns, q(shard_).alias(shard_), (q(first) + q(slot)).cast("long").alias(slot))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                              F.lit(None).cast("int").alias("grown_shard"))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with their shard and slot."""
    return shard(docs)
