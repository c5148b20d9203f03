"""Removal of repeated byte strings by a depth-limited radix sort of suffixes, most significant digit first.

Only the first ``threshold`` bytes of a suffix count (a window).  Passes refine groups of equal leading digits and drop
suffixes that are alone, until equal groups are exactly the repeated windows:

1. Of all suffixes, those at minimizers take part: in every window one position is the least by a hash of the half
   window behind it, and equal windows have it at the same place.  The half window there is the first digit.  A digit
   that occurs once ends the run of window starts that its position stands for.  Digits are counted first, and the runs
   made again and kept if their digit recurs, so that no table of all runs is written.
2. The second digit is all text that the position's run of windows covers.  In a group with one such digit, all
   windows but the first member's are repeats, without a look at single windows.  Equal members are counted by a partial
   aggregation before the shuffle, so a passage that a third of all documents share is one row per task.
3. Groups with several second digits are settled on whole windows, of the first member of each.  They meet with the text
   they cover, in buckets of about ``BUCKET`` members; in a bucket, all but the first of equal windows are repeats.  Where a
   group has several buckets, the firsts of each meet once more, as single windows.

Digits are compared by fingerprints: 64 bits for the first, another 64 for the second, 128 for a whole window.  Order of
starts is (doc_id, position); null ids come first and are one document.  Every byte of a repeated window is removed.

Memory: a task holds slices of ``SLICE`` bytes; a longer text is read in slices that overlap by a window, and only its own
spans and mask are held whole.  Positions of one text meet in one row, bounded by its length.

Cases: null texts are empty; texts under ``threshold`` bytes have no window.  Rows with equal ids are one document: a
window at the same start of two of them is no repeat by itself, so equal rows get equal results.  Other columns pass
through ``remove_repeats`` under any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.common import fresh, q, read
from pagelake.llm.textscan import mix
from pagelake.session import materialize

THRESHOLD = 100
SLICE = (1 << 20) - 4096  # positions in a slice must fit 20 bits
BUCKET = 256


class _Fingerprints:
    """Polynomial fingerprints of substrings of one slice, from prefix sums modulo 2**64."""

    _powers: dict = {}

    def __init__(self, data: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        base = int(rng.integers(1 << 40, 1 << 62)) | 1
        if seed not in self._powers:
            steps = []
            for b in (base, pow(base, -1, 1 << 64)):
                run = np.full((1 << 20) + 1, b, np.uint64)
                run[0] = 1
                steps.append(np.cumprod(run))
            self._powers[seed] = steps
        power, self._inverse = self._powers[seed]
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * power[: len(data)], out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._inverse[start])

    def each(self, width: int) -> np.ndarray:
        """Of all substrings of ``width`` bytes."""
        n = len(self._sums) - width
        return mix((self._sums[width:] - self._sums[:n]) * self._inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


def _slices(column, threshold: int):
    """(row numbers, position in the text, start in the slice, window starts, bytes) for slices of whole texts, or of
    one long text in pieces that overlap by a window less a byte."""
    rows, starts, size, parts = [], [], 0, []
    for row, value in enumerate(column):
        raw = value.as_py() or b""
        if len(raw) < threshold:
            continue
        if size and size + len(raw) > SLICE:
            yield rows, [0] * len(rows), starts, [len(p) - threshold + 1 for p in parts], np.frombuffer(b"".join(parts), np.uint8)
            rows, starts, size, parts = [], [], 0, []
        if len(raw) > SLICE:
            step = SLICE - threshold + 1
            for at in range(0, len(raw) - threshold + 1, step):
                piece = np.frombuffer(raw, np.uint8)[at: at + SLICE]
                yield [row], [at], [0], [len(piece) - threshold + 1], piece
            continue
        rows.append(row)
        starts.append(size)
        parts.append(raw)
        size += len(raw)
    if size:
        yield rows, [0] * len(rows), starts, [len(p) - threshold + 1 for p in parts], np.frombuffer(b"".join(parts), np.uint8)


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... (count[i] of them) for all i."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)


def _runs(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, threshold: int):
    """Runs of window starts with one minimizer: (first start, windows, minimizer, first digit)."""
    half = threshold // 2
    width = threshold - half + 1
    digit = _Fingerprints(data, 1).each(half)
    least = (digit >> np.uint64(20) << np.uint64(20)) | np.arange(len(digit), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:len(least) - (width - span)], least[width - span:])
    at = _spread(starts, counts)
    place = (least[at] & np.uint64((1 << 20) - 1)).astype(np.int64)
    cut = np.flatnonzero(np.diff(place, prepend=-1))
    place = place[cut]
    return at[cut], np.diff(np.append(cut, len(at))), place, digit[place]


def _second(data: np.ndarray, first: np.ndarray, windows: np.ndarray, place: np.ndarray, threshold: int) -> np.ndarray:
    whole = _Fingerprints(data, 2).of(first, first + windows + (threshold - 1))
    return mix(whole ^ mix((place - first).astype(np.uint64) << np.uint64(32) | windows.astype(np.uint64)))


def _scan_digits(threshold: int):
    def scan(batches):
        for batch in batches:
            for _, _, starts, counts, data in _slices(batch.column(0), threshold):
                one = _runs(data, np.array(starts), np.array(counts), threshold)[3]
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64))], names=["one"])
    return scan


def _scan_runs(threshold: int):
    def scan(batches):
        for batch in batches:
            for rows, at, starts, counts, data in _slices(batch.column(2), threshold):
                starts, counts = np.array(starts), np.array(counts)
                first, windows, place, one = _runs(data, starts, counts, threshold)
                two = _second(data, first, windows, place, threshold)
                text = np.searchsorted(starts, first, "right") - 1
                row = pa.array(np.array(rows)[text])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row),
                     pa.array((first - starts[text] + np.array(at)[text]).astype(np.int32)), pa.array(windows.astype(np.int32)),
                     pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                    names=["doc", "mark", "start", "windows", "one", "two"])
    return scan


def _contexts(batches):
    """Rows (doc, mark, text, asked): each run asked for, with the text that it covers."""
    for batch in batches:
        asked = batch.column(3)
        runs, sizes = asked.flatten(), np.diff(asked.offsets.to_numpy())
        owner = np.repeat(np.arange(batch.num_rows), sizes)
        start, length = (runs.field(c).to_numpy(zero_copy_only=False) for c in ("start", "length"))
        size, parts, low = 0, [], 0
        texts = [t.as_py() for t in batch.column(2)]
        for i, (k, s, n) in enumerate(zip(owner.tolist(), start.tolist(), length.tolist(), strict=True)):
            parts.append(texts[k][s:s + n])
            size += n
            if size >= SLICE or i + 1 == len(owner):
                row = pa.array(owner[low:i + 1])
                mine = runs.slice(low, i + 1 - low)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), *[mine.field(c) for c in ("start", "one", "buckets")],
                     pa.array(parts, pa.binary())], names=["doc", "mark", "start", "one", "buckets", "covered"])
                size, parts, low = 0, [], i + 1


def _settle(threshold: int):
    """Rows (one, bucket, doc, mark, start, buckets, covered), a bucket's together: windows that are not the first of
    their bucket (``repeat``), and of buckets that have others beside them the firsts, with fingerprints."""
    def settled(t: pa.Table) -> pa.RecordBatch:
        covered = [c.as_py() for c in t["covered"]]
        size = np.array([len(c) for c in covered])
        begin = np.cumsum(size) - size
        data = np.frombuffer(b"".join(covered), np.uint8)
        count = size - threshold + 1
        at = _spread(begin, count)
        who = np.repeat(np.arange(len(size)), count)
        prints = [_Fingerprints(data, seed).of(at, at + threshold) for seed in (3, 4)]
        known = t["doc"].is_valid().to_numpy()
        doc = t["doc"].fill_null(0).to_numpy()
        start = t["start"].to_numpy()[who] + (at - begin[who])
        order = np.lexsort((start, doc[who], known[who], prints[1], prints[0]))
        w, s = who[order], start[order]
        one, two = prints[0][order], prints[1][order]
        new = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (s != s[head]) | (doc[w] != doc[w[head]]) | (known[w] != known[w[head]])
        keep = later | (t["buckets"].to_numpy()[w] > 1)
        w, s, later, one, two = w[keep], s[keep], later[keep], one[keep], two[keep]
        return pa.RecordBatch.from_arrays(
            [t["doc"].combine_chunks().take(pa.array(w)), t["mark"].combine_chunks().take(pa.array(w)), pa.array(s.astype(np.int32)),
             pa.array(later), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
            names=["doc", "mark", "start", "repeat", "one", "two"])

    def scan(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # the last bucket of a batch may go on in the next one
            key = np.stack([batch.column(i).to_numpy() for i in (0, 1)])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0))
            last = (held[-1].column(0)[-1], held[-1].column(1)[-1]) if held else None
            if held and last != (batch.column(0)[0], batch.column(1)[0]):
                yield from parts(pa.Table.from_batches(held))
                held = []
            if len(cut):
                at = int(cut[-1]) + 1
                yield from parts(pa.Table.from_batches([*held, batch.slice(0, at)]))
                held = [batch.slice(at)]
            else:
                held.append(batch)
        if held:
            yield from parts(pa.Table.from_batches(held))

    def parts(t: pa.Table):
        """Whole buckets of about ``SLICE`` / 2 covered bytes at a time."""
        key = np.stack([t[c].to_numpy() for c in ("one", "bucket")])
        cut = np.append(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, t.num_rows)
        total = np.cumsum([len(c.as_py()) for c in t["covered"]])
        low = 0
        for i, end in enumerate(cut.tolist()):
            used = total[end - 1] - (total[low - 1] if low else 0)
            if used >= SLICE // 2 or i + 1 == len(cut):
                yield settled(t.slice(low, end - low))
                low = end

    return scan


def _keyed(docs: DataFrame, doc_id: str, text: str, *more: Column) -> DataFrame:
    return docs.select(q(doc_id).alias("doc"), F.xxhash64(q(doc_id), q(text)).alias("mark"),
                       F.coalesce(q(text), F.lit("")).cast("binary").alias("raw"), *more)


def _start(doc: str = "doc", start: str = "start") -> Column:
    return F.struct(F.col(doc).alias("doc"), F.col(start).alias("start"))


def _same_text(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Join on (doc, mark), where a null doc equals a null doc."""
    right = b.withColumnsRenamed({"doc": "_doc", "mark": "_mark"})
    return a.join(right, (F.col("mark") == F.col("_mark")) & F.col("doc").eqNullSafe(F.col("_doc")), how).drop("_doc", "_mark")


def repeats(docs: DataFrame, doc_id: str, text: str, threshold: int = THRESHOLD) -> DataFrame:
    """Runs of repeated windows as rows (doc, mark, start, windows): windows of ``threshold`` bytes at ``windows``
    consecutive starts from ``start``, each of which also starts earlier.  ``mark`` tells texts of one id apart."""
    keyed = _keyed(docs, doc_id, text)
    digits = keyed.select("raw").mapInArrow(_scan_digits(threshold), "one long").groupBy("one").agg(F.count("*").alias("total"))
    shared = materialize(digits.where("total > 1").select("one"), "suffix-digits")
    runs = keyed.mapInArrow(_scan_runs(threshold), "doc long, mark long, start int, windows int, one long, two long")
    runs = materialize(runs.join(shared, "one"), "suffix-runs")
    groups = materialize(runs.groupBy("one", "two").agg(F.min(_start()).alias("first")), "suffix-groups")
    kinds = groups.groupBy("one").agg(F.count("*").alias("kinds"))
    found = runs.join(groups.join(kinds, "one"), ["one", "two"])
    later = _start() > F.col("first")
    found = materialize(found.select("doc", "mark", "start", "windows", "one", later.alias("repeat"), "kinds").where("repeat or kinds > 1"),
                        "suffix-found")
    # First members of groups with several second digits: by single windows.
    run = F.struct("start", (F.col("windows") + (threshold - 1)).alias("length"), "one", F.ceil(F.col("kinds") / BUCKET).alias("buckets"))
    asked = found.where("not repeat").groupBy("doc", "mark").agg(F.collect_set(run).alias("asked"))
    covered = _same_text(keyed, asked, "inner").mapInArrow(
        _contexts, "doc long, mark long, start int, one long, buckets long, covered binary")
    bucket = F.pmod(F.xxhash64("mark", "start"), "buckets")
    dealt = covered.select("one", bucket.alias("bucket"), "doc", "mark", "start", "buckets", "covered").repartition(
        "one", "bucket").sortWithinPartitions("one", "bucket")
    single = materialize(dealt.mapInArrow(_settle(threshold), "doc long, mark long, start int, repeat boolean, one long, two long"),
                         "suffix-windows")
    heads = single.where("not repeat")
    firsts = heads.groupBy("one", "two").agg(F.min(_start()).alias("first"), F.max(_start()).alias("last")).where("last > first")
    rest = heads.join(firsts.drop("last"), ["one", "two"]).where(_start() > F.col("first"))
    single = single.where("repeat").select("doc", "mark", "start").unionByName(rest.select("doc", "mark", "start"))
    return found.where("repeat").select("doc", "mark", "start", "windows").unionByName(single.withColumn("windows", F.lit(1)))


def remove_repeats(docs: DataFrame, doc_id: str, text: str, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with a column ``kept``, a struct: n_bytes, n_removed, n_spans (maximal removed runs), spans (start, end in
    bytes) and the remaining ``bytes`` (not always UTF-8, as strings are cut at bytes)."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    held = F.struct(*[q(c).alias(n) for c, n in zip(docs.columns, names, strict=True)]).alias("row")
    keyed = _keyed(docs, doc_id, text, held)
    spans = repeats(docs, doc_id, text, threshold).groupBy("doc", "mark").agg(
        F.collect_set(F.struct("start", "windows")).alias("found"))
    plain = _same_text(keyed, spans, "left").select("row", "raw", "found")
    schema = T.StructType([*plain.select("row").schema.fields, *T.StructType.fromDDL(KEPT).fields])

    def scan(batches):
        for batch in batches:
            out = [_cut(raw.as_py(), found, threshold) for raw, found in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _KEPT)], names=["row", "kept"])

    done = plain.mapInArrow(scan, schema)
    return done.select(*[F.col(f"row.{n}") for n in names], "kept").toDF(*docs.columns, *fresh(docs, "kept"))


KEPT = "kept struct<n_bytes: bigint, n_removed: bigint, n_spans: bigint, spans: array<struct<start: int, end: int>>, bytes: binary>"
_KEPT = pa.struct([*[(c, pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")],
                   ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("bytes", pa.binary())])


def _merged(found, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte spans covered by runs of windows."""
    runs = found.values
    if runs is None or not len(runs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = runs.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
    end = start + runs.field("windows").to_numpy(zero_copy_only=False) + threshold - 1
    order = np.argsort(start, kind="stable")
    start, far = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.append(True, start[1:] > far[:-1]))
    return start[new], far[np.append(new[1:], len(start)) - 1]


def _cut(raw: bytes, found, threshold: int) -> dict:
    start, end = _merged(found, threshold)
    edges = [0, *np.column_stack([start, end]).ravel().tolist(), len(raw)]
    rest = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
    return {"n_bytes": len(raw), "n_removed": len(raw) - len(rest), "n_spans": len(start),
            "spans": [{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist(), strict=True)], "bytes": rest}


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` without the bytes of strings of 100 bytes that also start earlier."""
    done = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return done.select("doc_id", "kept.n_bytes", "kept.n_removed", "kept.n_spans", F.sha2("kept.bytes", 256).alias("kept_sha256"))
