"""Operator 6: interpolated modified Kneser-Ney language model of any order (``ORDER``, 3 by default).

Texts are cut into batches of a bounded size, written once as tokens: the hashes of a batch's distinct words, and which of them each
token is.  An n-gram is a 56-bit hash, that of its first n-1 words chained with that of its last word.  Every batch counts its distinct n-grams of the highest order and sends them, sorted, to shards, which are ranges of
hashes: so no key is hot, whatever its share of the text, and the number of shards follows the input.  A shard adds up what it
gets into one sorted hash array with its counts (the model), and tells, for each distinct n-gram, its count to one of the
batches that sent it.  That batch knows the words behind the hash, so it adds the n-gram to the statistics of its first n-1
words (as context) and of its last n-1 (as continuation), which are the n-grams of the next lower order; and so on down to words.

Scoring sends the sorted distinct hashes of a batch to the shards, a part of the shards after the other; a shard's task maps its arrays into
memory and answers by binary search.  No worker holds the whole model, and each hash travels once per batch.  Messages hold at least one hash, so
there are never more of them than distinct n-grams in the batches.  (The arrays reach a task through Spark, and are mapped from an unnamed
file, which the system removes with the task; a folder of named files would not be seen by other executors.)

With f the count of an n-gram (highest order) or the number of distinct words before it (lower orders), D the discounts of the
order by f (1, 2, 3 and more) and h' the context without its first word:
p(w|h) = max(f(hw) - D, 0) / f(h.) + g(h) * p(w|h'), and for words alone max(f(w) - D, 0) / f(.) + g / (V + 1).  Unknown words share the
last term; a context that training never saw leaves p(w|h').  The end symbol fills the contexts before a text.

Defined results: a null or empty text is its end symbol alone; equal rows are scored alike, row by row, whatever their keys; a text longer
than a batch is a batch of its own; without training texts every probability is 1; an empty table gives no rows.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm import textscan as ts
from pagelake.llm.common import fold, q, read
from pagelake.session import materialize

ORDER = 3
BATCH_BYTES = 4 << 20      # text per batch
SHARD_BYTES = 8 << 20      # text per shard of the model
ROUNDS = 4                 # scoring asks a part of the shards at a time, so that fewer messages and arrays are on disk at once
BITS = 56                  # of a hash
MASK = np.uint64((1 << BITS) - 1)
END = np.uint64(0x5BD1E9955BD1E9)
_U8 = np.dtype("<u8")
CODED = {"texts": "long", "distinct_words": "long", "counts": "binary", "known": "binary", "at": "binary"}    # columns of a batch of tokens


def planes(rows) -> bytes:
    """Rows of numbers as byte planes, each after the number of its planes."""
    out = []
    for row in rows:
        row = np.ascontiguousarray(row, _U8)
        width = max(1, (int(row.max(initial=0)).bit_length() + 7) // 8)
        out.append(bytes([width]) + np.ascontiguousarray(row.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return b"".join(out)


def unplanes(raw: bytes, width: int, n: int) -> np.ndarray:
    """``width`` rows of ``n`` numbers."""
    out, at = np.zeros((width, n, 8), np.uint8), 0
    for row in out:
        size = raw[at]
        row[:, :size] = np.frombuffer(raw, np.uint8, size * n, at + 1).reshape(size, n).T
        at += 1 + size * n
    return out.view(_U8).reshape(width, n).astype(np.int64)


def lay(rows) -> bytes:
    """Counts, which are mostly small, compressed."""
    import zstandard

    return zstandard.compress(planes(rows), 1)


def lift(raw: bytes, width: int, n: int) -> np.ndarray:
    import zstandard

    return unplanes(zstandard.decompress(raw), width, n)


def pack(keys: np.ndarray) -> bytes:
    """Sorted hashes: their number and the byte planes of their differences, of which the highest, mostly zeros, is compressed."""
    import zstandard

    raw = planes([np.diff(keys, prepend=np.uint64(0))])
    cut = 1 + (raw[0] - 1) * len(keys)
    return len(keys).to_bytes(4, "little") + raw[:cut] + zstandard.compress(raw[cut:], 1)


def unpack(raw: bytes) -> np.ndarray:
    import zstandard

    n = int.from_bytes(raw[:4], "little")
    cut = 5 + (raw[4] - 1) * n
    return np.cumsum(unplanes(raw[4:cut] + zstandard.decompress(raw[cut:]), 1, n)[0]).astype(np.uint64)


def bounds(shards: int) -> np.ndarray:
    """First hash of every shard but the first."""
    return np.array([(s << BITS) // shards for s in range(1, shards)], np.uint64)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """First positions of the runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))


def tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text, its end counted, and the hashes of all of them."""
    words, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, off, raw in ts.slices(texts):
        found = ts.Words(off, ts.LOWER[raw], ts.NOT_BLANK)
        count = found.per_doc + 1
        word = np.full(int(count.sum()), END)
        inner = np.ones(len(word), bool)
        inner[np.cumsum(count) - 1] = False
        word[inner] = found.hashes() >> np.uint64(64 - BITS)
        words.append(word)
        counts.append(count)
    return np.concatenate(counts), np.concatenate(words)


def coded(count: np.ndarray, word: np.ndarray) -> list:
    """Tokens compressed: the numbers of texts and of distinct hashes, the tokens of each text, the distinct hashes, the frequent ones first, and the number of each token's hash."""
    order = np.argsort(word)
    first = runs(word[order])
    times = np.diff(first, append=len(word))
    rank = np.argsort(-times, kind="stable")
    number = np.empty(len(first), np.int64)
    number[rank] = np.arange(len(first))
    at = np.empty(len(word), np.int64)
    at[order] = np.repeat(number, times)
    # Hashes are sorted among those that are as frequent, so most differences are small; the others are taken modulo 2^BITS.
    steps = np.diff(word[order[first[rank]]], prepend=np.uint64(0)) & MASK
    return [len(count), len(steps), lay([count]), lay([steps]), lay([at])]


def decoded(texts: int, distinct: int, counts: bytes, known: bytes, at: bytes) -> tuple[np.ndarray, np.ndarray]:
    count = lift(counts, 1, texts)[0]
    hashes = np.cumsum(lift(known, 1, distinct)[0].view(np.uint64)) & MASK
    return count, hashes[lift(at, 1, int(count.sum()))[0]]


class Grams:
    """The n-grams of a batch: ``keys[n][p]`` ends at token p, and the last entry is the n-gram of end symbols alone;
    ``before[p]`` is the token before p, or that last entry."""

    def __init__(self, texts, order: int, held: tuple[np.ndarray, np.ndarray] | None = None):
        self.count, word = held or tokens(texts)
        word = np.concatenate([word, [END]]).astype(np.uint64)
        self.n, self.order = len(word) - 1, order
        self.before = np.arange(-1, self.n)
        self.before[(np.cumsum(self.count) - self.count)] = self.n
        self.before[self.n] = self.n
        self.keys = {1: word}
        for n in range(2, order + 1):
            self.keys[n] = ts.mix(self.keys[n - 1][self.before] * np.uint64(3) + word) >> np.uint64(64 - BITS)

    def asked(self, n: int, low: int = 0, high: int = 1 << BITS) -> np.ndarray:
        """Sorted distinct hashes that scoring needs, from ``low`` to below ``high``."""
        keys = self.wanted(n)
        keys = np.sort(keys[(keys >= np.uint64(low)) & (keys < np.uint64(high))])
        return keys[runs(keys)]

    def wanted(self, n: int) -> np.ndarray:
        return self.keys[n] if n < self.order else self.keys[n][: self.n]

    def numbered(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """``asked(n)``, and where each n-gram is in it."""
        order = np.argsort(self.wanted(n))
        keys = self.wanted(n)[order]
        first = runs(keys)
        at = np.empty(len(keys), np.int64)
        at[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(keys)))
        return keys[first], at


class Tally:
    """What a batch sends for one order: sorted hashes, rows of numbers, and a token where each n-gram ends."""

    def __init__(self, keys: np.ndarray, place: np.ndarray, values: list[np.ndarray]):
        order = np.argsort(keys)
        keys = keys[order]
        first = runs(keys)
        self.keys, self.place = keys[first], place[order][first]
        self.values = [np.add.reduceat(v[order], first, dtype=np.int64) if len(first) else v[:0] for v in values]


def tallied(grams: Grams, n: int, told: dict[int, dict[int, bytes]], cuts: np.ndarray) -> Tally:
    """The tally of order ``n``, from the counts that the shards of the higher orders told this batch."""
    if n == grams.order:
        return Tally(grams.keys[n][: grams.n], np.arange(grams.n), [np.ones(grams.n, np.int8)])
    above = tallied(grams, n + 1, told, cuts)
    times = spread(above.keys, cuts, told[n + 1], 1)[0]
    owned = times > 0
    place, times = above.place[owned], times[owned]
    keys, nothing, one = grams.keys[n], np.zeros(len(place), np.int8), np.ones(len(place), np.int8)
    context = [nothing, times, (times == 1).view(np.int8), (times == 2).view(np.int8), (times >= 3).view(np.int8)]
    follow = [one, nothing, nothing, nothing, nothing]
    parts = [(keys[grams.before[place]], grams.before[place], context), (keys[place], place, follow)]
    if n == 1:      # words have their counts besides
        none = np.zeros(grams.n, np.int8)
        parts = [(k, p, [nothing, *v]) for k, p, v in parts]
        parts.append((keys[: grams.n], np.arange(grams.n), [none + 1, *[none] * 5]))
    return Tally(np.concatenate([k for k, _, _ in parts]), np.concatenate([p for _, p, _ in parts]),
                 [np.concatenate([v[i] for _, _, v in parts]) for i in range(len(parts[0][2]))])


def width_of(n: int, order: int) -> int:
    """Highest order: count.  Lower ones: distinct words before, and as a context the sum over what follows, and how much of it
    was seen 1, 2, 3 and more times.  Words: their count before these."""
    return 1 if n == order else 6 if n == 1 else 5


def by_shard(keys: np.ndarray, cuts: np.ndarray):
    """(shard, slice of the sorted hashes) of every shard that has any."""
    shard = np.searchsorted(cuts, keys, "right")
    first = runs(shard).tolist()
    for a, b in zip(first, [*first[1:], len(keys)], strict=False):
        yield int(shard[a]), slice(a, b)


def spread(keys: np.ndarray, cuts: np.ndarray, answers: dict[int, bytes], width: int) -> np.ndarray:
    """The numbers that the shards gave for ``keys``."""
    out = np.zeros((width, len(keys)), np.int64)
    for shard, part in by_shard(keys, cuts):
        out[:, part] = lift(answers[shard], width, part.stop - part.start)
    return out


def swapped(values: np.ndarray) -> np.ndarray:
    """The numbers of a lower order with what was seen once replaced by what the sum has besides it, which is mostly 0 and takes
    less room; and back again."""
    values[-3] = values[-4] - values[-3] - 2 * values[-2] - 3 * values[-1]
    return values


def _rows(rows, names, types):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


MESSAGE = "shard int, batch long, k binary, v binary"
_MESSAGE = ["shard", "batch", "k", "v"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
ASK = "n int, shard int, batch long, k binary"
_ASK = ["n", "shard", "batch", "k"], [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
ANSWER = "n int, shard int, batch long, v binary"
_ANSWER = ["n", "shard", "batch", "v"], [pa.int32(), pa.int32(), pa.int64(), pa.binary()]


class Model:
    """Numbers that every task needs; the arrays stay in ``tables`` (by order: shard, k, v)."""

    def __init__(self, order: int, shards: int):
        self.order, self.shards, self.tables, self.discounts = order, shards, {}, {}
        self.n_tokens = self.n_words = self.n_pairs = 0
        self.low_rest = 1.0

    def numbers(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "tables"}

    def discard(self) -> None:
        """Deletes the arrays, after the last ``score`` (which has its answers written when it returns)."""
        for table in self.tables.values():
            discard(table)
        self.tables = {}


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts; where a count of counts is zero the plain discount stands in."""
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2 * y]
    return tuple(min(max(d, 0.05), k) for d, k in zip(found, (0.95, 1.95, 2.95), strict=True))


def discard(stage: DataFrame) -> None:
    """Deletes the folder of a written stage that nothing reads any more."""
    files = stage.inputFiles()
    if files:
        sc = stage.sparkSession.sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def gather(rows, most: int):
    """Rows (key, text) → rows (keys, and the columns ``CODED``): batches of at most ``most`` bytes (or one longer text), as ``coded``
    tokens, so that no later step cuts and hashes the words again."""

    def packed(parts):
        keys = pa.concat_arrays([k for k, _ in parts])
        texts = pa.concat_arrays([t for _, t in parts])
        lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
        return pa.RecordBatch.from_arrays([lists, *[pa.array([x]) for x in coded(*tokens(texts))]], names=["keys", *CODED])

    parts, held = [], 0
    for batch in rows:
        keys, texts = batch.column(0), batch.column(1).cast(pa.large_string())
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        a = 0
        while a < len(texts):
            # An end symbol counts as a byte, so empty texts fill batches too.
            b = int(np.searchsorted(off + np.arange(len(off)), off[a] + a + most - held, "right")) - 1
            if b <= a and parts:
                yield packed(parts)
                parts, held = [], 0
                continue
            b = max(b, a + 1)
            parts.append((keys.slice(a, b - a), texts.slice(a, b - a)))
            held += int(off[b] - off[a]) + b - a
            a = b
    if parts:
        yield packed(parts)


def opened(batch, i: int, order: int) -> Grams:
    """The n-grams of row ``i`` of Arrow rows with the columns ``CODED``."""
    return Grams(None, order, decoded(*[batch[c][i].as_py() for c in CODED]))


def batched(df: DataFrame, key: str | None, text: str, name: str) -> DataFrame:
    """(keys, the columns ``CODED``, batch), written once, so that a batch is the same to every later step."""
    most = BATCH_BYTES
    plain = df.select((q(key) if key else F.lit(0)).alias("key"), F.coalesce(q(text), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("keys", T.ArrayType(plain.schema["key"].dataType)), *[T.StructField(c, T._parse_datatype_string(kind)) for c, kind in CODED.items()]])
    return materialize(plain.mapInArrow(lambda rows: gather(rows, most), schema).withColumn("batch", F.monotonically_increasing_id()), name)


def train(texts: DataFrame, text: str = "text", order: int = ORDER) -> Model:
    """Counts ``texts`` and writes the model's arrays to the shared checkpoint folder."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    size = texts.agg(F.sum(F.octet_length(q(text)).cast("long"))).first()[0] or 0
    model = Model(order, max(1, -(-int(size) // SHARD_BYTES)))
    cuts = bounds(model.shards)
    batches = batched(texts, None, text, "lm-train").select("batch", *CODED)
    told = None

    def messages(batch: int, grams: Grams, n: int, answers: dict):
        tally = tallied(grams, n, answers, cuts)
        return [(shard, batch, pack(tally.keys[part]), lay([v[part] for v in tally.values])) for shard, part in by_shard(tally.keys, cuts)]

    def count(rows):
        for row in rows:
            for i, batch in enumerate(row["batch"].to_pylist()):
                yield _rows(messages(batch, opened(row, i, order), order, {}), *_MESSAGE)

    # Every step below is written within its round, so its functions see the round's numbers.
    for n in range(order, 0, -1):
        width = width_of(n, order)

        def lower(held, answered):
            answers: dict = {above: {} for above in range(n + 1, order + 1)}
            for level, shard, v in zip(answered["n"].to_pylist(), answered["shard"].to_pylist(), answered["v"], strict=True):
                answers[level][shard] = v.as_py()
            grams = opened(held, 0, order)
            return pa.Table.from_batches([_rows(messages(held["batch"][0].as_py(), grams, n, answers), *_MESSAGE)])

        def merge(key, table):
            shard = int(key[0].as_py())
            keys = [unpack(k.as_py()) for k in table["k"]]
            sizes = [len(k) for k in keys]
            values = np.concatenate([lift(v.as_py(), width, s) for v, s in zip(table["v"], sizes, strict=True)], axis=1)
            keys = np.concatenate(keys)
            order_ = np.argsort(keys, kind="stable")      # made for sorted runs
            first = runs(keys[order_])
            sums = [np.add.reduceat(v[order_], first) for v in values]
            f = sums[1 if n == 1 else 0]
            rows = [(shard, None, pack(keys[order_[first]]), lay(sums))]
            if n > 1:     # the count goes to one batch that sent the n-gram, all others hear 0
                heard = np.zeros(len(keys), np.int64)
                heard[order_[first]] = f
                ends = np.cumsum(sizes)
                rows += [(shard, batch, None, lay([heard[e - s: e]])) for batch, s, e in zip(table["batch"].to_pylist(), sizes, ends, strict=True)]
            out = pa.Table.from_batches([_rows(rows, *_MESSAGE)])
            stats = {**{f"n{i}": int((f == i).sum()) for i in (1, 2, 3, 4)}, "big": int((f >= 3).sum()), "total": int(f.sum()),
                     "tokens": int(sums[0].sum()) if n == 1 else 0, "words": int((sums[0] > 0).sum()) if n == 1 else 0}
            for name, value in stats.items():
                out = out.append_column(name, pa.array([value] + [0] * (len(rows) - 1), pa.int64()))
            return out

        sent = batches.mapInArrow(count, MESSAGE) if n == order else batches.groupBy("batch").cogroup(
            told.groupBy("batch")).applyInArrow(lower, MESSAGE)
        merged = materialize(sent.groupBy("shard").applyInArrow(
            merge, MESSAGE + ", n1 long, n2 long, n3 long, n4 long, big long, total long, tokens long, words long"), f"lm-order{n}")
        model.tables[n] = merged.where(F.col("batch").isNull()).select("shard", "k", "v")
        answers = merged.where(F.col("batch").isNotNull()).select(F.lit(n).alias("n"), "shard", "batch", "v")
        told = answers if told is None else told.unionByName(answers)
        r = merged.agg(*[F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4", "big", "total", "tokens", "words")]).first()
        d = model.discounts[n] = discounts(*[int(r[f"n{i}"] or 0) for i in (1, 2, 3, 4)])
        if n == 1:
            model.n_tokens, model.n_words, model.n_pairs = int(r["tokens"] or 0), int(r["words"] or 0), int(r["total"] or 0)
            if model.n_pairs:
                model.low_rest = (d[0] * r["n1"] + d[1] * r["n2"] + d[2] * r["big"]) / model.n_pairs
    discard(batches)
    return model


def mapped(array: np.ndarray) -> np.ndarray:
    """The array, memory-mapped from an unnamed file of this task."""
    if not array.size:
        return array
    with tempfile.TemporaryFile() as f:
        array.tofile(f)
        f.flush()
        return np.memmap(f, dtype=array.dtype, mode="r", shape=array.shape)


def log_probabilities(grams: Grams, places: dict, values: dict, m: dict):
    """Per token: training count, log10 of the base, log10 of the model."""
    at = places[1]
    times = values[1][0][at[:-1]]
    base = np.log10((times + 0.1) / (m["n_tokens"] + 0.1 * (m["n_words"] + 1)))

    def kept(f, n):
        return np.maximum(f - np.array([0.0, *m["discounts"][n]])[np.minimum(f, 3)], 0)

    p = (kept(values[1][1], 1) / max(1, m["n_pairs"]) + m["low_rest"] / (m["n_words"] + 1))[at[:-1]]
    for n in range(2, m["order"] + 1):
        context = at[grams.before[:-1]]
        total, seen = values[n - 1][-4][context], values[n - 1][-3:]
        rest = (np.array(m["discounts"][n]) @ seen)[context]
        at = places[n]
        f = kept(values[n][0], n)[at[: grams.n]]
        p = np.where(total > 0, (f + rest * p) / np.maximum(total, 1), p)
    return times, base, np.log10(p)


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: ``key``, n_tokens, n_known, base_score, score."""
    m, order, cuts = model.numbers(), model.order, bounds(model.shards)
    batches = batched(df, key, text, "lm-batches")
    answers = None
    tables = [model.tables[n].withColumn("n", F.lit(n)) for n in range(1, order + 1)]
    rounds = min(ROUNDS, model.shards)
    for turn in range(rounds):
        # The shards of a round are neighbours, so a batch sorts each of its hashes in one round only.
        first, end = turn * model.shards // rounds, (turn + 1) * model.shards // rounds
        low, high = ((s << BITS) // model.shards for s in (first, end))

        def ask(rows):
            for row in rows:
                for i, batch in enumerate(row["batch"].to_pylist()):
                    grams, out = opened(row, i, order), []
                    for n in range(1, order + 1):
                        keys = grams.asked(n, low, high)
                        out += [(n, shard, batch, pack(keys[part])) for shard, part in by_shard(keys, cuts)]
                    yield _rows(out, *_ASK)

        def answer(asked, held):
            out, arrays = [], None
            if len(held) and len(asked):      # a shard is one row of the model
                keys, width = unpack(held["k"][0].as_py()), width_of(asked["n"][0].as_py(), order)
                arrays = mapped(keys), mapped(lift(held["v"][0].as_py(), width, len(keys)))
            for n, shard, batch, raw in zip(asked["n"].to_pylist(), asked["shard"].to_pylist(), asked["batch"].to_pylist(), asked["k"], strict=True):
                keys = unpack(raw.as_py())
                got = np.zeros((width_of(n, order), len(keys)), np.int64)
                if arrays is not None:
                    at = ts.member(keys, arrays[0])
                    got[:, at >= 0] = arrays[1][:, at[at >= 0]]
                out.append((n, shard, batch, lay(swapped(got) if n < order else got)))
            return pa.Table.from_batches([_rows(out, *_ANSWER)])

        held = tables[0]
        for table in tables[1:]:
            held = held.unionByName(table)
        found = materialize(batches.select("batch", *CODED).mapInArrow(ask, ASK).groupBy("n", "shard").cogroup(
            held.where(F.col("shard").between(first, end - 1)).groupBy("n", "shard")).applyInArrow(answer, ANSWER), f"lm-answers{turn}")
        answers = found if answers is None else answers.unionByName(found)

    def sum_up(held, answered):
        grams = opened(held, 0, order)
        given: dict = {n: {} for n in range(1, order + 1)}
        for n, shard, v in zip(answered["n"].to_pylist(), answered["shard"].to_pylist(), answered["v"], strict=True):
            given[n][shard] = v.as_py()
        places, values = {}, {}
        for n in given:
            keys, places[n] = grams.numbered(n)
            values[n] = spread(keys, cuts, given[n], width_of(n, order))
            if n < order:
                swapped(values[n])
        times, base, log_p = log_probabilities(grams, places, values, m)
        first = np.cumsum(grams.count) - grams.count
        keys = held["keys"].combine_chunks()
        return pa.table({"key": keys.values if isinstance(keys, pa.ListArray) else keys.chunk(0).values,
                         "n_tokens": pa.array(grams.count, pa.int64()),
                         "n_known": pa.array(np.add.reduceat((times > 0).astype(np.int64), first)),
                         "base_score": pa.array(np.add.reduceat(base, first)), "score": pa.array(np.add.reduceat(log_p, first))})

    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
                           T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(sum_up, schema).withColumnRenamed("key", key)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(fold("doc_id", 10) != 0))
    scored = score(docs, model)
    model.discard()
    return scored.select(
        "doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
