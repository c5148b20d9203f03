"""Operator 9: benchmark decontamination by training suffix arrays.

The corpus is cut into shards of a bounded number of words.  Each shard's words become numbers of the benchmark's
vocabulary (a word that no benchmark text holds is 0 and ends every match), and its suffixes are sorted into a
suffix array, to the depth of a window.  A suffix that meets a 0 before the shortest window can match nothing, so only the others are
sorted; that loses no match.  Every benchmark suffix, cut to its window, is then binary-searched in the array, which gives the
places where its window occurs.

The benchmark's own suffixes are sorted to their ends.  The shard's suffix at each place is binary-searched among them: the longest
common prefix is with a neighbour of the place where it would stand.  Lengths are compared by prefix hashes, so a match costs the
logarithm of its length.  The longest match of a document is the longest run of its words that one benchmark text holds as they
stand, at least a window long (or a whole shorter text); ``longest_place`` says where it starts in the document, in
which text, and where in that text.  Among several of that length it is the first in the document.

The benchmark is sent to the workers in blocks of at most ``BLOCK_WORDS`` words (or one single longer text), each a
pass over the corpus; hits of several blocks are merged by document.

Defined results: a null text has no words and no hits; a benchmark text without words has no window; one with
fewer than ``WINDOW`` words is one window; repeated documents are judged alike, row by row; an empty benchmark hits
nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm import textscan as ts
from pagelake.llm.common import add_columns, fresh, q, read

WINDOW = 13
PERCENT = 5            # a document is contaminated if hit words are this percentage of its words
BLOCK_WORDS = 2_000_000


class Benchmark:
    """Windows of one block of benchmark texts, as rows of vocabulary numbers grouped by length."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids = [str(i) for i in ids]
        hashes, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for row, off, raw in ts.slices(pa.array(texts, pa.string())):
            words = ts.Words(off, ts.LOWER[raw], ts.ALNUM)
            hashes.append(words.hashes())
            owner.append(words.doc + row)
        word, item = np.concatenate(hashes), np.concatenate(owner)
        self.vocabulary = np.unique(word)
        number = (np.searchsorted(self.vocabulary, word) + 1).astype(np.int32)
        found: dict[int, dict[bytes, list[int]]] = {}
        edges = np.searchsorted(item, np.arange(len(texts) + 1))
        self.number, self.item = number, item.astype(np.int32)
        self.start = edges[:-1]
        self.left = (edges[1:][item] - np.arange(len(item))).astype(np.int32)      # words to the end of the text
        self.suffixes = suffix_array(number, self.left)
        self.sums = hash_sums(number)
        for k in range(len(texts)):
            run = number[edges[k]: edges[k + 1]]
            size = min(WINDOW, len(run))
            for s in range(len(run) - size + 1 if size else 0):
                found.setdefault(size, {}).setdefault(run[s: s + size].tobytes(), []).append(k)
        # By length: distinct windows in suffix order, and the texts that hold each.
        self.short = {key: holders[0] for size, table in found.items() if size < WINDOW for key, holders in table.items()}
        self.lengths = {}
        for size, table in sorted(found.items()):
            rows = np.array([np.frombuffer(key, np.int32) for key in table]).reshape(len(table), size)
            order = np.lexsort(rows.T[::-1])
            holders = list(table.values())
            self.lengths[size] = (rows[order], [sorted(set(holders[i])) for i in order])

    def longest(self, number: np.ndarray, run: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per place of a shard: the most words from there on that a benchmark text holds, and where in ``self.number``."""
        sums = hash_sums(number)
        low, high = np.zeros(len(places), np.int64), np.full(len(places), len(self.suffixes), np.int64)
        while (low < high).any():
            open_ = np.flatnonzero(low < high)
            mid = (low[open_] + high[open_]) // 2
            here, there = places[open_], self.suffixes[mid]
            same = self._common(sums, run, here, there)
            # A text that ends comes before one that goes on.
            ended, stopped = same == self.left[there], same == run[here]
            inner = ~ended & ~stopped
            below = ended.copy()
            below[inner] = self.number[(there + same)[inner]] < number[(here + same)[inner]]
            low[open_[below]] = mid[below] + 1
            high[open_[~below]] = mid[~below]
        best, where = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        for side in (low - 1, low):
            known = np.flatnonzero((side >= 0) & (side < len(self.suffixes)))
            there = self.suffixes[side[known]]
            same = self._common(sums, run, places[known], there)
            better = same > best[known]
            best[known[better]], where[known[better]] = same[better], there[better]
        return best, where

    def _common(self, sums: np.ndarray, run: np.ndarray, here: np.ndarray, there: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of shard suffixes and benchmark suffixes."""
        low, high = np.zeros(len(here), np.int64), np.minimum(run[here], self.left[there]).astype(np.int64)
        inverse = ts.powers(max(len(sums), len(self.sums)))[1]
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = (sums[here + mid] - sums[here]) * inverse[here] == (self.sums[there + mid] - self.sums[there]) * inverse[there]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def matches(self, number: np.ndarray, doc: np.ndarray, run: np.ndarray):
        """(window length, positions, window numbers) for every occurrence of a window in one shard."""
        if not self.lengths or not len(number):
            return
        for size, (windows, _) in self.lengths.items():
            suffix = np.flatnonzero(run >= size)
            if not len(suffix):
                continue
            text = number[suffix[:, None] + np.arange(size)]
            order = np.lexsort(text.T[::-1])               # the suffix array, to the depth of the window
            suffix, text = suffix[order], text[order]
            keys = np.ascontiguousarray(text.astype(">i4")).view(f"V{4 * size}").ravel()
            tests = np.ascontiguousarray(windows.astype(">i4")).view(f"V{4 * size}").ravel()
            low = _search(keys, tests, "left")
            high = _search(keys, tests, "right")
            counts = high - low
            hit = np.repeat(np.arange(len(tests)), counts)
            places = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
            yield size, suffix[places], hit


def hash_sums(number: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial in the mixed numbers; differences are hashes of runs of words."""
    sums = np.zeros(len(number) + 1, np.uint64)
    np.cumsum(ts.mix(number.astype(np.uint64) + np.uint64(1)) * ts.powers(len(number) + 1)[0][: len(number)], out=sums[1:])
    return sums


def suffix_array(number: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Places in the order of the words from there to the end of their text, by doubling the depth that is sorted."""
    n, depth, rank = len(number), 1, number.astype(np.int64)
    while True:
        further = np.zeros(n, np.int64)
        inside = np.flatnonzero(left > depth)
        further[inside] = rank[inside + depth]
        order = np.lexsort((further, rank))
        new = np.concatenate([[1], (np.diff(rank[order]) != 0) | (np.diff(further[order]) != 0)]) if n else np.zeros(0, np.int64)
        rank = np.zeros(n, np.int64)
        rank[order] = np.cumsum(new)
        depth *= 2
        if new.all() or depth >= left.max(initial=0):
            return order


def words_ahead(number: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Words until the next unknown word or the end of the document."""
    n = len(number)
    if not n:
        return np.zeros(0, np.int64)
    at = np.flatnonzero((number == 0) | np.concatenate([doc[1:] != doc[:-1], [True]]))
    end = at[np.searchsorted(at, np.arange(n))]
    return end - np.arange(n) + (number[end] != 0)


def _search(keys: np.ndarray, tests: np.ndarray, side: str) -> np.ndarray:
    """Binary search of byte strings of one width in a sorted array of them, all tests at once."""
    low, high = np.zeros(len(tests), np.int64), np.full(len(tests), len(keys), np.int64)
    k = keys.view(np.uint8).reshape(len(keys), -1)
    t = tests.view(np.uint8).reshape(len(tests), -1)
    while (low < high).any():
        open_ = np.flatnonzero(low < high)
        mid = (low[open_] + high[open_]) // 2
        a, b = k[mid], t[open_]
        differ = a != b
        first = differ.argmax(1)
        rows = np.arange(len(open_))
        below = a[rows, first] < b[rows, first]
        if side == "right":
            below |= ~differ.any(1)
        low[open_[below]] = mid[below] + 1
        high[open_[~below]] = mid[~below]
    return low


def _scan_shard(column, bench: Benchmark):
    """Per text: words, hit spans (word positions, half open), texts hit, longest match and its place."""
    n_words, spans, items, longest, where = [], [], [], [], []
    for _, off, raw in ts.slices(column):
        words = ts.Words(off, ts.LOWER[raw], ts.ALNUM)
        number = (ts.member(words.hashes(), bench.vocabulary) + 1).astype(np.int32)
        n = words.n_docs
        first = np.cumsum(words.per_doc) - words.per_doc
        cover = np.zeros(len(number) + 1, np.int64)
        held: dict[int, set] = {}
        run = words_ahead(number, words.doc)
        whole = np.zeros(len(number), np.int64)     # the longest window at each place
        for size, place, window in bench.matches(number, words.doc, run):
            whole[place] = np.maximum(whole[place], size)
            np.add.at(cover, place, 1)
            np.add.at(cover, place + size, -1)
            for d, w in np.unique(np.stack([words.doc[place], window]), axis=1).T.tolist():
                held.setdefault(d, set()).update(bench.lengths[size][1][w])
        best, at = _best(bench, number, run, whole, words.doc, first, n)
        hit = np.cumsum(cover)[:-1] > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
        found: dict[int, list] = {}
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            while a < b:      # spans of neighbouring documents may touch
                d = int(words.doc[a])
                end = min(b, int(first[d] + words.per_doc[d]))
                found.setdefault(d, []).append((a - int(first[d]), end - int(first[d])))
                a = end
        n_words += words.per_doc.tolist()
        longest += best.tolist()
        where += at
        spans += [found.get(d, []) for d in range(n)]
        items += [sorted({bench.ids[k] for k in held.get(d, ())}) for d in range(n)]
    return n_words, spans, items, longest, where


def _best(bench: Benchmark, number, run, whole, doc, first, n: int):
    """Per document of a slice: length and place of the longest match."""
    best, at = np.zeros(n, np.int64), [None] * n
    places = np.flatnonzero(whole)
    if len(places):
        length, there = bench.longest(number, run, places)
        # A piece of a longer text counts from a window on; a shorter text counts as a whole.
        short = length < WINDOW
        length[short] = whole[places[short]]
        order = np.lexsort((places, -length, doc[places]))
        docs, top = np.unique(doc[places][order], return_index=True)
        for d, k in zip(docs.tolist(), order[top].tolist(), strict=True):
            best[d] = length[k]
            if short[k]:
                owner, item_at = bench.short[number[places[k]: places[k] + int(length[k])].tobytes()], 0
            else:
                owner = int(bench.item[there[k]])
                item_at = int(there[k] - bench.start[owner])
            at[d] = {"at": int(places[k] - first[d]), "item": bench.ids[owner], "item_at": item_at}
    return best, at


def _blocks(benchmark: DataFrame, item: str, text: str):
    """Benchmark texts in blocks of a bounded number of words, read one block after the other."""
    sized = benchmark.select(q(item).cast("string").alias("item"), q(text).alias("text")).where(F.col("text").isNotNull())
    total = sized.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    # A word takes two bytes at least, with the blank after it; twice as many blocks keep uneven ones small.
    n = max(1, -(-int(total) // BLOCK_WORDS))
    for b in range(n):
        rows = sized.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b).collect()
        rows = sorted((r["item"] if r["item"] is not None else "", r["text"]) for r in rows)
        yield Benchmark([r[0] for r in rows], [r[1] for r in rows])


ADDED = {"n_words": "bigint", "hit_spans": "array<struct<a:bigint,b:bigint>>", "hit_items": "array<string>",
         "longest_match": "bigint", "longest_place": "struct<at:bigint,item:string,item_at:bigint>"}


def find_contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                       benchmark_text: str = "text") -> DataFrame:
    """``df`` with ``n_words``, ``hit_spans``, ``hit_items``, ``longest_match``, ``longest_place`` (underscored if taken)."""
    spark, done = df.sparkSession, None
    for block in _blocks(benchmark, item, benchmark_text):
        shipped = spark.sparkContext.broadcast(block)

        def compute(columns, shipped=shipped):
            for column in columns:
                n_words, spans, items, longest, where = _scan_shard(column, shipped.value)
                yield [pa.array(n_words, pa.int64()),
                       pa.array([[{"a": a, "b": b} for a, b in s] for s in spans],
                                pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                       pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int64()),
                       pa.array(where, pa.struct([("at", pa.int64()), ("item", pa.string()), ("item_at", pa.int64())]))]

        if done is None:
            done, names = add_columns(df, text, compute, ADDED), fresh(df, *ADDED)
            continue
        # A further block: the same rows pass once more, and its hits are joined to those of the blocks before.
        more = fresh(done, *ADDED)
        done = add_columns(done, text, compute, ADDED)
        merged = {
            names[0]: q(names[0]),
            names[1]: F.array_sort(F.array_union(q(names[1]), q(more[1]))),
            names[2]: F.array_sort(F.array_union(q(names[2]), q(more[2]))),
            names[3]: F.greatest(q(names[3]), q(more[3])),
            names[4]: F.when((q(more[3]) > q(names[3])) | (q(more[3]) == q(names[3])) & (q(more[4])["at"] < q(names[4])["at"]),
                             q(more[4])).otherwise(q(names[4])),
        }
        done = done.select(*[q(c) for c in df.columns], *[v.alias(k) for k, v in merged.items()])
    return done


def hit_words(spans):
    """Words in the union of sorted spans."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(spans, zero, lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0).cast("long"), s["b"] - F.greatest(s["a"], acc["end"]))).alias("n"),
        F.greatest(acc["end"], s["b"]).alias("end")), lambda acc: acc["n"])


def judge(found: DataFrame, names: list[str]) -> tuple:
    """(hit words, contaminated) of a result of :func:`find_contamination`."""
    n_hit = hit_words(q(names[1]))
    return n_hit, (n_hit > 0) & (n_hit * 100 >= q(names[0]) * PERCENT)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, read(spark, sf_dir, "benchmark"))
    n_hit, contaminated = judge(found, list(ADDED))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), contaminated.alias("contaminated"),
        "longest_match")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are not contaminated, with their own columns."""
    found = find_contamination(docs, read(spark, sf_dir, "benchmark"))
    return found.where(~judge(found, fresh(docs, *ADDED))[1]).select(*[q(c) for c in docs.columns])


def oracle_sql() -> str:
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({lower.format("coalesce(text, '')")}, '{word}') AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all({lower.format("coalesce(text, '')")}, '{word}') AS w FROM benchmark),
     bw AS (SELECT item_id, least({WINDOW}, len(w)) AS m, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i, w FROM b WHERE len(w) > 0),
     k AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM bw),
     sizes AS (SELECT DISTINCT m FROM k),
     dw AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i, w FROM d, sizes WHERE len(w) >= m),
     h AS (SELECT dw.doc_id, dw.i, dw.m, k.item_id FROM dw JOIN k ON dw.m = k.m AND array_to_string(dw.w[dw.i:dw.i + dw.m - 1], ' ') = k.g),
     n AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id),
     o AS (SELECT item_id, m, i AS o, array_to_string(w[i:i + m - 1], ' ') AS g FROM bw),
     run AS (SELECT doc_id, max(c) AS c FROM (SELECT doc_id, m - 1 + count(*) AS c FROM (
               SELECT doc_id, item_id, m, i - o AS line, i - row_number() OVER (PARTITION BY doc_id, item_id, m, i - o ORDER BY i) AS g FROM (
                 SELECT DISTINCT dw.doc_id, dw.i, dw.m, o.item_id, o.o FROM dw JOIN o ON dw.m = o.m AND array_to_string(dw.w[dw.i:dw.i + dw.m - 1], ' ') = o.g))
               GROUP BY doc_id, item_id, m, line, g) GROUP BY doc_id),
     t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS s FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.s, '')) AS items_sha256, coalesce(n.n, 0) > 0 AND 20 * coalesce(n.n, 0) >= len(d.w) AS contaminated,
       coalesce(run.c, 0)::BIGINT AS longest_match
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN run USING (doc_id)"""
