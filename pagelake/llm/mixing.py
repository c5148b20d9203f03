"""Operator 4: mixing sources to target weights by Poisson replication.

Each source's target repetition rate is (its target weight x all bytes) / (its own bytes).  A document's
count is the inverse of the Poisson distribution function with that mean, at a number seeded by the
document's hash; the document is exploded by its count and the copies are shuffled globally (partition and
order within it both come from a hash of document and copy).  Expected bytes by source follow the weights
exactly, and a rerun gives the same rows.

Defined results: a null source is a source of its own; sources without a weight get weight 0; null and
empty texts count one byte; repeated rows get equal counts; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm.common import fresh, q, read, uniform

SEED = 4
TEMPERATURE = 0.5     # default weights: bytes of a source to this power
SMALL_TABLE_ROWS = 10_000


def source_rates(df: DataFrame, source: str = "source", text: str = "text", weights: dict | None = None,
                 size: float = 1.0) -> DataFrame:
    """(source, rate): one row per source.  ``weights`` are relative; without them the bytes of each source
    to the power ``TEMPERATURE`` are taken.  ``size`` is the total of the mix against the input."""
    held = df.groupBy(q(source).alias("source")).agg(
        F.sum(F.coalesce(F.octet_length(q(text)), F.lit(0)).cast("long") + 1).alias("bytes"))
    if weights is None:
        weight = F.pow(F.col("bytes").cast("double"), F.lit(TEMPERATURE))
    else:
        pairs = [F.lit(v) for k, w in sorted(weights.items(), key=lambda x: str(x[0])) for v in (k, float(w))]
        weight = F.coalesce(F.element_at(F.create_map(*pairs), F.coalesce(F.col("source"), F.lit(""))), F.lit(0.0)) if pairs else F.lit(0.0)
    total = held.select("*", weight.alias("weight")).groupBy().agg(
        F.sum("bytes").alias("all_bytes"), F.sum("weight").alias("all_weight"))
    rate = F.try_divide(F.col("weight") * F.col("all_bytes") * F.lit(float(size)), F.col("all_weight") * F.col("bytes"))
    # ``total`` is one row.
    return held.select("*", weight.alias("weight")).join(F.broadcast(total)).select(
        "source", F.round(F.coalesce(rate, F.lit(0.0)), 9).alias("rate"))


def poisson_count(rate: Column, u: Column) -> Column:
    """The least k whose Poisson distribution function at mean ``rate`` exceeds ``u``.  Large means are split
    into equal parts of at most 30 (sums of Poisson counts are Poisson), each with its own number, so the first
    term never underflows."""
    def one(mean: Column, at: Column) -> Column:
        last = (F.ceil(mean + 12 * F.sqrt(mean)) + 20).cast("int")
        start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"), F.lit(0).alias("k"))
        def step(acc, k):
            p = acc["p"] * mean / k
            return F.when(acc["cdf"] > at, acc).otherwise(F.struct(p.alias("p"), (acc["cdf"] + p).alias("cdf"), k.alias("k")))
        return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["k"])
    parts = F.greatest(F.lit(1), F.ceil(rate / 30).cast("int"))
    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda acc, i: acc + one(
        rate / parts, F.when(i == 1, u).otherwise(uniform(u, i, seed=SEED + 1))))


def replicate(df: DataFrame, rates: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
              seed: int = SEED) -> DataFrame:
    """``df`` with ``n_copies`` (underscored if taken), before the explosion.  The rate table is broadcast if it
    has at most ``SMALL_TABLE_ROWS`` rows; beyond, source and rate are joined by shuffle, which AQE splits at a
    hot source."""
    out, rate, held = fresh(df, "n_copies", "rate", "rate_source")
    side = rates.select(F.col("source").alias(held), F.col("rate").alias(rate))
    if side.limit(SMALL_TABLE_ROWS + 1).count() <= SMALL_TABLE_ROWS:
        side = F.broadcast(side)
    u = uniform(q(key), F.md5(F.coalesce(q(text), F.lit(""))), seed=seed)
    return df.join(side, q(source).eqNullSafe(q(held))).select(
        *[q(c) for c in df.columns], poisson_count(q(rate), u).cast("long").alias(out))


def mix_sources(df: DataFrame, weights: dict | None = None, key: str = "doc_id", source: str = "source",
                text: str = "text", size: float = 1.0, seed: int = SEED) -> DataFrame:
    """The mixed and shuffled rows: columns of ``df`` and ``copy`` (0, 1, ...; underscored if taken)."""
    counted = replicate(df, source_rates(df, source, text, weights, size), key, source, text, seed)
    n_copies = counted.columns[-1]
    copy, place = fresh(counted, "copy", "place")
    copies = counted.where(q(n_copies) > 0).select(
        *[q(c) for c in df.columns], F.explode(F.sequence(F.lit(0).cast("long"), q(n_copies) - 1)).alias(copy))
    shuffled = copies.withColumn(place, F.xxhash64(F.lit(seed), q(key), q(text), q(copy)))
    # Adaptive execution may join small partitions of this exchange; it never orders them by content.
    return shuffled.repartition(q(place)).sortWithinPartitions(F.xxhash64(q(place)), q(key)).drop(place)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "source", "copy")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mix, with the columns of the documents (a document appears once per copy)."""
    return mix_sources(docs).select(*[q(c) for c in docs.columns])


def oracle_sql() -> str:
    u = ("CAST('0x' || substr(md5('{seed}|' || {key}), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0")
    first = u.format(seed=SEED, key="coalesce(doc_id::VARCHAR, '~') || '|' || md5(coalesce(text, ''))")
    return f"""
WITH RECURSIVE held AS (SELECT source, sum(coalesce(strlen(text), 0) + 1) AS bytes FROM documents GROUP BY source),
     w AS (SELECT *, pow(bytes::DOUBLE, {TEMPERATURE}) AS weight FROM held),
     rates AS (SELECT source, round(weight * (SELECT sum(bytes) FROM w) / ((SELECT sum(weight) FROM w) * bytes), 9) AS rate FROM w),
     cdf AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
             UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < 150),
     d AS (SELECT doc_id, source, {first} AS u FROM documents),
     n AS (SELECT d.doc_id, d.source, count(*) FILTER (WHERE c <= u) AS copies FROM d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source GROUP BY ALL)
SELECT doc_id, source, unnest(range(copies))::BIGINT AS copy FROM n"""
