"""Operator 2: n-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles (words: lower-cased runs of letters and digits).  Texts of equal sets are one
class; the work goes on with one text per class.

1. Each class gets a MinHash signature of ``HASHES`` values.  Classes that agree on one of the ``BANDS`` bands are
   candidates (at similarity 0.8 a pair is missed with probability below 1e-7); candidate classes are connected to
   clusters by bucket edges, never by pairs.
2. A cluster is cut into blocks, and every pair of blocks is one unit of work.  Inside, signatures are compared
   ``STEP`` values at a time, and a pair is dropped when the posterior probability (uniform prior) that its
   similarity reaches the threshold falls below ``TOLERANCE``.  The rest is verified exactly on whole texts.
3. A unit returns one row per class: how many classes and documents it links, and the least class of its local
   component.  So no pair is ever a row.  Links are summed, and the local components joined to groups.

Defined results: a text of fewer than five words is one shingle; a null text, or one without words, links with
nothing and is a group by itself; rows with equal id and text are copies of each other.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm import textscan as ts
from pagelake.llm.common import add_columns, fresh, q, read
from pagelake.llm.links import components
from pagelake.session import materialize

WIDTH, THRESHOLD = 5, 0.8
HASHES, BANDS, STEP = 128, 32, 32
TOLERANCE = 1e-6
BLOCK = 512
UNIT_BYTES = 8 << 20

_rng = np.random.default_rng(20100711)
_MULTIPLY = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingle_sets(column, width: int = WIDTH):
    """The sorted distinct shingle hashes of each text of a string column."""
    for _, off, raw in ts.slices(column):
        words = ts.Words(off, ts.LOWER[raw], ts.ALNUM)
        h = words.hashes()
        doc, shingle = ts.windows(h, words.doc, width)
        edges = np.searchsorted(doc, np.arange(words.n_docs + 1))
        first = np.cumsum(words.per_doc) - words.per_doc
        for d in range(words.n_docs):
            n = words.per_doc[d]
            if n >= width:
                yield np.unique(shingle[edges[d]: edges[d + 1]])
            elif n:
                own = h[first[d]: first[d] + n]
                whole = own[:1]
                for k in range(1, n):
                    whole = ts.mix(whole * np.uint64(3) + own[k: k + 1])
                yield whole
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(shingles), 1024):
        part = shingles[a: a + 1024, None] * _MULTIPLY[None, :]
        part += _ADD
        np.minimum(least, part.min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def fingerprint(shingles: np.ndarray) -> bytes:
    """128 bits that identify a set of shingles."""
    a, b = ts.mix(shingles), ts.mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return np.array([a.sum(), b.sum()], np.uint64).tobytes()


def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(values compared, matches a pair needs to stay): the posterior of similarity >= threshold after m of k
    matches, with a uniform prior, is the probability of at most m successes in k + 1 trials at the threshold."""
    out = []
    for k in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        while m <= k:
            total += math.comb(k + 1, m) * threshold ** m * (1 - threshold) ** (k + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append((k, m))
    return out


def linked_pairs(sig: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray,
                 threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """Index pairs (one of ``left``, one of ``right``; each pair once) whose similarity reaches the threshold."""
    a, b = np.meshgrid(left, right, indexing="ij")
    keep = a < b if left is right else np.ones(a.shape, bool)
    a, b = a[keep], b[keep]
    matches, done = np.zeros(len(a), np.int32), 0
    for k, needed in least_matches(threshold, tolerance):
        for s in range(0, len(a), 1 << 15):
            matches[s: s + (1 << 15)] += (sig[a[s: s + (1 << 15)], done:k] == sig[b[s: s + (1 << 15)], done:k]).sum(1, dtype=np.int32)
        stay = matches >= needed
        a, b, matches, done = a[stay], b[stay], matches[stay], k
    if not len(a):
        return np.zeros((0, 2), int)
    return _verify(sets, a, b, threshold)


def _verify(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Exact similarity of the pairs, through products of incidence matrices over the shared shingles."""
    rows = np.unique(np.concatenate([a, b]))
    place = {int(r): i for i, r in enumerate(rows)}
    size = np.array([len(sets[r]) for r in rows])
    if len(a) < 4 * len(rows):
        both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)])
    else:
        every = np.concatenate([sets[r] for r in rows])
        owner = np.repeat(np.arange(len(rows)), size)
        _, number, times = np.unique(every, return_inverse=True, return_counts=True)
        shared = times[number] > 1
        renumber = np.cumsum(times > 1) - 1
        number, owner = renumber[number[shared]], owner[shared]
        common = np.zeros((len(rows), len(rows)), np.float32)
        for c in range(0, int(number.max(initial=-1)) + 1, 8192):
            some = (number >= c) & (number < c + 8192)
            x = np.zeros((len(rows), 8192), np.float32)
            x[owner[some], number[some] - c] = 1
            common += x @ x.T
        both = common[[place[int(x)] for x in a], [place[int(y)] for y in b]].astype(np.int64)
    total = size[[place[int(x)] for x in a]] + size[[place[int(y)] for y in b]] - both
    ok = both >= threshold * total - 1e-9
    return np.stack([a[ok], b[ok]], axis=1)


def _unit(sig, sets, block, first: int, second: int):
    if first == second:
        rows = np.arange(len(sets))
        return linked_pairs(sig, sets, rows, rows)
    return linked_pairs(sig, sets, np.flatnonzero(block == first), np.flatnonzero(block == second))


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for (_, first, second), unit in pdf.groupby(["cluster", "first", "second"], sort=True):
        unit = unit.sort_values("text_class").reset_index(drop=True)
        sets = list(shingle_sets(pa.array(unit["text"], pa.string())))
        sig = np.stack([np.frombuffer(s, np.uint32) for s in unit["signature"]])
        pairs = _unit(sig, sets, unit["block"].to_numpy(), first, second)
        n = len(unit)
        weight = unit["n_docs"].to_numpy()
        texts, docs, root = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
        np.add.at(texts, pairs.ravel(), 1)
        np.add.at(docs, pairs[:, 0], weight[pairs[:, 1]])
        np.add.at(docs, pairs[:, 1], weight[pairs[:, 0]])
        changed = len(pairs) > 0
        while changed:
            before = root.copy()
            low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
            np.minimum.at(root, pairs[:, 0], low)
            np.minimum.at(root, pairs[:, 1], low)
            root = root[root]
            changed = not np.array_equal(before, root)
        some = np.flatnonzero(texts)
        out.append(pd.DataFrame({"text_class": unit["text_class"].to_numpy()[some], "texts": texts[some], "docs": docs[some],
                                 "root": unit["text_class"].to_numpy()[root[some]]}))
    return pd.concat(out) if out else pd.DataFrame({"text_class": [], "texts": [], "docs": [], "root": []})


def similar_groups(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``df``: its ``key``; ``text_mark`` (a hash of the text, which tells rows of one key apart);
    ``text_class`` (16 bytes, null for texts without words); ``group_id``, the least key of all rows linked with it
    over any number of steps; ``n_links``, the other rows with similarity of at least 0.8, copies included; ``n_text_links``, the
    same without copies; ``keeps``, true for rows with the least key of the group."""
    if threshold != THRESHOLD:
        raise ValueError(f"bands and signature are laid out for a threshold of {THRESHOLD}")

    def compute(columns):
        for column in columns:
            sets = list(shingle_sets(column))
            yield [pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary()),
                   pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())]

    plain = df.select(q(key).alias("key"), q(text).alias("text"))
    marked = add_columns(plain, "text", compute, {"text_class": "binary", "signature": "binary"}).select(
        "key", F.xxhash64("text").alias("text_mark"), "text_class", "signature")
    marked = materialize(marked, "signatures")
    held = marked.where(F.col("text_class").isNotNull()).groupBy("text_class").agg(
        F.count("*").alias("n_docs"), F.min(F.struct("key", "text_mark")).alias("chosen"), F.min("signature").alias("signature"))
    classes = materialize(held, "classes")

    width = 4 * HASHES // BANDS
    bands = classes.select("text_class", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.xxhash64(
        j, F.substring("signature", j * width + 1, F.lit(width))))).alias("bucket"))
    heads = bands.groupBy("bucket").agg(F.count("*").alias("n"), F.min("text_class").alias("head")).where(F.col("n") > 1)
    edges = bands.join(heads, "bucket").where(F.col("text_class") != F.col("head")).select(
        F.col("text_class").alias("a"), F.col("head").alias("b"))
    clusters = components(edges)
    sizes = clusters.groupBy("root").agg(F.count("*").alias("members"))
    members = clusters.join(sizes, "root").join(classes, F.col("node") == F.col("text_class")).select(
        F.col("root").alias("cluster"), "text_class", "signature", "n_docs", "chosen",
        F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    members = members.withColumn("block", F.pmod(F.xxhash64("text_class"), F.col("blocks")).cast("int"))
    whole = plain.withColumn("text_mark", F.xxhash64("text")).join(
        members, F.col("key").eqNullSafe(F.col("chosen")["key"]) & (F.col("text_mark") == F.col("chosen")["text_mark"]))
    whole = whole.select("cluster", "text_class", "signature", "n_docs", "block", "blocks", "text").dropDuplicates(["text_class"])
    units = whole.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cluster", "text_class", "signature", "n_docs", "block", "text",
        F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    load = members.agg(F.sum(F.col("blocks").cast("long") * 4096)).first()[0] or 0
    tasks = max(1, -(-int(load) // UNIT_BYTES))
    links = units.withColumn("unit", F.pmod(F.xxhash64("cluster", "first", "second"), F.lit(tasks))).groupBy(
        "unit").applyInPandas(_compare, "text_class binary, texts long, docs long, root binary")
    links = materialize(links, "links")
    groups = components(links.select(F.col("text_class").alias("a"), F.col("root").alias("b")))
    per_class = links.groupBy("text_class").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    least = groups.join(classes, F.col("node") == F.col("text_class")).groupBy("root").agg(F.min("chosen").alias("chosen"))
    linked = groups.join(least, "root").join(per_class, F.col("node") == F.col("text_class"), "left").select(
        F.col("node").alias("text_class"), F.col("chosen").alias("group"), "texts", "docs")
    every = classes.select("text_class", "n_docs", F.col("chosen").alias("own")).join(linked, "text_class", "left").select(
        "text_class", "n_docs", F.coalesce("group", "own").alias("group"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"), F.coalesce("docs", F.lit(0)).alias("docs"))
    none = F.col("n_docs").isNull()
    return marked.drop("signature").join(every, "text_class", "left").select(
        F.col("key").alias(key), "text_mark", "text_class",
        F.when(none, F.col("key")).otherwise(F.col("group")["key"]).alias("group_id"),
        F.when(none, 0).otherwise(F.col("docs") + F.col("n_docs") - 1).cast("long").alias("n_links"),
        F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links"),
        (none | F.col("group")["key"].eqNullSafe(F.col("key")) & (F.col("group")["text_mark"] == F.col("text_mark"))).alias("keeps"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = similar_groups(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.col("group_id").alias("class_id"), "n_links", "n_text_links")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group, the one with the least id, with the columns of the documents."""
    groups = similar_groups(docs)
    mark, extra_id, extra_mark = fresh(docs, "row_mark", "extra_id", "extra_mark")
    extra = groups.where(~F.col("keeps")).select(F.col("doc_id").alias(extra_id), F.col("text_mark").alias(extra_mark)).distinct()
    left = docs.withColumn(mark, F.xxhash64("text")).join(
        extra, F.col("doc_id").eqNullSafe(q(extra_id)) & (q(mark) == q(extra_mark)), "left_anti")
    # Rows with equal id and text are copies of each other; those without words are no copies.
    words = F.coalesce(F.regexp_replace("text", "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", ""), F.lit("")) != ""
    again = left.groupBy("doc_id", q(mark)).count().where(F.col("count") > 1).limit(1).count() > 0
    if again:
        whole = left.where(~words).select(*[q(c) for c in docs.columns])
        return left.where(words).dropDuplicates(["doc_id", mark]).select(*[q(c) for c in docs.columns]).unionByName(whole)
    return left.select(*[q(c) for c in docs.columns])
