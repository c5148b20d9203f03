"""Alignment of two tokenizers over exact texts.

Documents are shuffled by their full text, so each distinct text is tokenised by both tokenizers and aligned once; its
pairs count as often as documents hold the text.  Places where a token of either ends cut a text into groups, and all
tokens of one group are linked.  A task packs the pairs of many texts into chunks: the distinct pairs of a chunk with
their weights (which meet, summed, in one count per pair) and each text's pairs as numbers of them.  Counts go back to
the chunks that hold the pair, where they become measures of each text, and those are joined to the documents by the
text's SHA-256.

Memory: a task holds one slice of texts (``SLICE`` bytes, or one longer text) and one chunk (``CHUNK`` pairs).  A text
whose groups hold very many pairs is spread over chunks by ranges of left ids, so a pair still counts once per text.
The highest count of each left id is broadcast: its size is bounded by the vocabulary.  The tokenizer files are read by
the driver and broadcast.

Cases: null and empty texts, and texts that the tokens of one tokenizer do not spell (with the leading space), have no
tokens, zero measures and an empty digest.  Repeated rows get one result row each.  Only ``doc_id`` and the text are
read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm.common import q, read
from pagelake.session import materialize

TOKENIZERS = "/opt/tokenizers"
SLICE = 1 << 20
CHUNK = 1 << 21
SPACE = "▁"
# Fixed value: the pattern by which byte-level vocabularies of this kind split a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

TEXT = pa.struct([("digest", pa.binary()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")],
                  ("groups_sha256", pa.string())])
PACKED = pa.schema([("chunk", pa.string()), ("texts", pa.list_(TEXT)), ("pairs", pa.list_(pa.int64())),
                    ("weights", pa.list_(pa.int64())), ("owners", pa.list_(pa.binary())), ("sizes", pa.binary()),
                    ("places", pa.binary()), ("links", pa.binary())])
PACKED_SQL = ("chunk string, texts array<struct<digest binary, n_a long, n_b long, n_groups long, n_links long, "
              "groups_sha256 string>>, pairs array<long>, weights array<long>, owners array<binary>, sizes binary, "
              "places binary, links binary")


class ByteLevel:
    """A byte-level BPE vocabulary in the JSON form of the tokenizers library; strings of special tokens are text."""

    def __init__(self, raw: bytes):
        import tiktoken

        spec = json.loads(raw)
        special = {t["content"] for t in spec["added_tokens"]}
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.table[i] = token
        # Ids follow the order of merges, so they serve as ranks.
        self._encoding = tiktoken.Encoding("left", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._encoding.encode_ordinary(" " + t) for t in texts]


class Pieces:
    """A sentencepiece model with byte fallback, which puts a space before a text."""

    def __init__(self, raw: bytes):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.table = []
        for i in range(self._model.get_piece_size()):
            piece = self._model.id_to_piece(i)
            self.table.append(bytes([int(piece[3:5], 16)]) if self._model.is_byte(i) else piece.replace(SPACE, " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


class Aligner:
    def __init__(self, left, right):
        self.left, self.right = left, right
        self._sizes = [np.array([len(t) for t in side.table], np.int64) for side in (left, right)]
        # An id followed by the mark for "more of this side", "end of side" (bar or semicolon).
        self._written = [f"{i}{mark}".encode() for end, side in (("|", left), (";", right))
                         for i in range(len(side.table)) for mark in (",", end)]

    def align(self, texts: list[str]):
        """Per text: (n_a, n_b, n_groups, n_links, digest), and the linked ids with the number of their links as
        pieces (text number, left ids, right ids, links), each pair of a text once."""
        sides = [side.encode(texts) for side in (self.left, self.right)]
        measures, good = [(0, 0, 0, 0, "")] * len(texts), []
        for i, text in enumerate(texts):
            whole = b" " + text.encode()
            if text and all(b"".join(map(side.table.__getitem__, ids[i])) == whole
                            for side, ids in zip((self.left, self.right), sides, strict=True)):
                good.append(i)
        if not good:
            return measures, []
        ids, ends, counts = [], [], []
        for side, sizes in zip(sides, self._sizes, strict=True):
            flat = np.concatenate([np.asarray(side[i], np.int64) for i in good])
            ids.append(flat)
            ends.append(np.cumsum(sizes[flat]))
            counts.append(np.array([len(side[i]) for i in good]))
        near = np.minimum(np.searchsorted(ends[1], ends[0]), len(ends[1]) - 1)
        cuts = ends[0][ends[1][near] == ends[0]]  # both rise, as no token is empty
        group = [np.searchsorted(cuts, e) for e in ends]
        per = [np.bincount(g, minlength=len(cuts)) for g in group]
        stop = np.cumsum(counts[0])
        first = np.concatenate([[0], group[0][stop - 1] + 1])  # first group of each text
        links = np.add.reduceat(per[0] * per[1], first[:-1])
        digests = self._digests(ids, group, per, first)
        for k, i in enumerate(good):
            measures[i] = (int(counts[0][k]), int(counts[1][k]), int(first[k + 1] - first[k]), int(links[k]), digests[k])
        return measures, self._pairs(good, ids, group, per, first)

    def _digests(self, ids, group, per, first):
        before = [np.concatenate([[0], np.cumsum(p)]) for p in per]
        n = len(ids[0]) + len(ids[1])
        sequence = np.empty(n, np.int64)
        base = 2 * len(self.left.table)
        for side, other, start in ((0, before[1][:-1], 0), (1, before[0][1:], base)):
            at = np.arange(len(ids[side])) + other[group[side]]
            last = np.zeros(len(ids[side]), np.int64)
            last[before[side][1:] - 1] = 1
            sequence[at] = start + 2 * ids[side] + last
        edges = (before[0] + before[1])[first]
        parts = sequence.tolist()
        written = self._written
        return [hashlib.sha256(b"".join(map(written.__getitem__, parts[a:b]))[:-1]).hexdigest()
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    def _pairs(self, good, ids, group, per, first):
        """Pieces of at most about ``CHUNK`` pairs before equal ones of a text are merged."""
        # Ids of one group and side merged with their number, so that a large group costs its distinct ids only.
        merged = []
        for side in (0, 1):
            key, times = np.unique(group[side] << 32 | ids[side], return_counts=True)
            merged.append((key >> 32, key & 0xFFFFFFFF, times))
        (ga, a, ta), (gb, b, tb) = merged
        starts = np.searchsorted(gb, np.arange(len(per[0]) + 1))
        width = starts[ga + 1] - starts[ga]
        owner = np.searchsorted(first, ga, "right") - 1
        order = np.lexsort((a, owner))
        total = np.concatenate([[0], np.cumsum(width[order])])
        # Cuts lie between left ids of a text, so that a pair of a text meets in one piece.
        fresh = np.flatnonzero((np.diff(owner[order], prepend=-1) != 0) | (np.diff(a[order], prepend=-1) != 0))
        at = 0
        while at < len(order):
            far = fresh[np.searchsorted(total[fresh], total[at] + CHUNK, "right") - 1] if total[-1] - total[at] > CHUNK else len(order)
            if far <= at:
                after = np.searchsorted(fresh, at, "right")
                far = fresh[after] if after < len(fresh) else len(order)
            take = order[at:far]
            reps = width[take]
            left = np.repeat(take, reps)
            right = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(starts[ga[take]], reps)
            pair = a[left] << 32 | b[right]
            who, weight = owner[left], ta[left] * tb[right]
            sort = np.lexsort((pair, who))
            who, pair, weight = who[sort], pair[sort], weight[sort]
            new = np.flatnonzero((np.diff(who, prepend=-1) != 0) | (np.diff(pair, prepend=-1) != 0))
            if len(new):
                yield np.asarray(good)[who[new]], pair[new], np.add.reduceat(weight, new)
            at = far


class _Chunk:
    """Pairs of several texts, packed: each text's pairs as rising numbers into the chunk's distinct pairs."""

    def __init__(self):
        self.texts, self.size, self.parts = [], 0, []

    def row(self, name: str) -> dict:
        digests = [p[0] for p in self.parts]
        sizes = np.array([len(p[2]) for p in self.parts], np.int64)
        pair = np.concatenate([p[2] for p in self.parts]) if digests else np.zeros(0, np.int64)
        known, place = np.unique(pair, return_inverse=True)
        times = np.repeat([p[1] for p in self.parts], sizes) if digests else np.zeros(0)
        weights = np.zeros(len(known), np.int64)
        np.add.at(weights, place, times.astype(np.int64))
        links = np.concatenate([p[3] for p in self.parts]) if digests else np.zeros(0, np.int64)
        return {"chunk": name, "texts": self.texts, "pairs": known, "weights": weights, "owners": digests,
                "sizes": sizes.tobytes(), "places": _squeeze(place.astype(np.uint32)), "links": _squeeze(links)}


def _squeeze(x: np.ndarray) -> bytes:
    """Bytes of whole numbers by planes, compressed."""
    wide = x.astype(np.uint64)
    planes = np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(8, "little") + bytes(pa.compress(planes.tobytes(), codec="zstd"))


def _widen(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], decompressed_size=8 * n, codec="zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel().astype(np.int64)


_LOADED: dict = {}


def _aligner(key, files) -> Aligner:
    if _LOADED.get("key") != key:
        left, right = files.value
        _LOADED.update(key=key, aligner=Aligner(ByteLevel(left), Pieces(right)))
    return _LOADED["aligner"]


def _packed(texts: DataFrame, files, key) -> DataFrame:
    """Chunks of the distinct texts (text, digest, times)."""
    def slices(batches):
        for batch in batches:
            rows, size = [], 0
            for text, digest, times in zip(*(batch.column(i) for i in range(3)), strict=True):
                rows.append((text.as_py(), digest.as_py(), times.as_py()))
                size += len(rows[-1][0])
                if size >= SLICE:
                    yield rows
                    rows, size = [], 0
            if rows:
                yield rows

    def scan(batches):
        aligner = _aligner(key, files)
        chunk, number = _Chunk(), 0

        def out():
            row = chunk.row(f"{TaskContext.get().partitionId()}-{number}")
            return pa.RecordBatch.from_pylist([row | {"pairs": row["pairs"].tolist(), "weights": row["weights"].tolist()}], schema=PACKED)

        for rows in slices(batches):
            measures, pieces = aligner.align([r[0] for r in rows])
            chunk.texts += [dict(zip(TEXT.names, (r[1], *m), strict=True)) for r, m in zip(rows, measures, strict=True)]
            for who, pair, links in pieces:
                edges = np.append(np.flatnonzero(np.diff(who, prepend=-1)), len(who))
                for s, e in zip(edges[:-1], edges[1:], strict=True):
                    chunk.parts.append((rows[who[s]][1], rows[who[s]][2], pair[s:e], links[s:e]))
                chunk.size += len(pair)
                if chunk.size >= CHUNK:
                    yield out()
                    chunk, number = _Chunk(), number + 1
        if chunk.texts or chunk.parts:
            yield out()

    return texts.select("text", "digest", "times").mapInArrow(scan, PACKED_SQL)


def _answer(key, chunks: pa.Table, counts: pa.Table) -> pa.Table:
    """Measures of the texts of one chunk from the counts of its pairs."""
    schema = pa.schema([("digest", pa.binary()), ("n_best", pa.int64()), ("count_sum", pa.int64())])
    if not chunks.num_rows or not counts.num_rows:
        return schema.empty_table()
    row = chunks.to_pylist()[0]
    order = np.argsort(counts["pair"].to_numpy())
    count = counts["n"].to_numpy()[order]
    best = counts["best"].to_numpy()[order]
    place, links = _widen(row["places"]), _widen(row["links"])
    starts = np.cumsum(sizes := np.frombuffer(row["sizes"], np.int64)) - sizes
    n_best = np.add.reduceat(links * (count[place] == best[place]), starts)
    total = np.add.reduceat(links * count[place], starts)
    return pa.table([pa.array(row["owners"], pa.binary()), pa.array(n_best, pa.int64()), pa.array(total, pa.int64())], schema=schema)


def align(docs: DataFrame, column: str, left: bytes, right: bytes) -> tuple[DataFrame, DataFrame]:
    """(measures, pairs): per distinct text digest, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum;
    and per linked id pair a, b, n (the documents that hold it linked).  ``left`` is a byte-level vocabulary file,
    ``right`` a sentencepiece model."""
    spark = docs.sparkSession
    files, key = spark.sparkContext.broadcast((left, right)), hashlib.sha256(left + right).hexdigest()
    texts = docs.select(q(column).alias("text")).where("text <> ''").groupBy("text").agg(F.count("*").alias("times"))
    texts = texts.withColumn("digest", F.unhex(F.sha2("text", 256)))
    chunks = materialize(_packed(texts, files, key), "aligned")
    counted = chunks.select(F.explode(F.arrays_zip("pairs", "weights")).alias("p")).groupBy(F.col("p.pairs").alias("pair"))
    counts = materialize(counted.agg(F.sum("p.weights").alias("n")), "pair-counts")
    a = F.shiftright("pair", 32)
    top = counts.groupBy(a.alias("a")).agg(F.max("n").alias("best"))  # at most one row for each id of the left vocabulary
    rated = counts.withColumn("a", a).join(F.broadcast(top), "a")
    asked = chunks.select(F.col("chunk").alias("asker"), F.explode("pairs").alias("pair")).join(rated.select("pair", "n", "best"), "pair")
    measured = chunks.select("chunk", "owners", "sizes", "places", "links").groupBy("chunk").cogroup(
        asked.groupBy("asker")).applyInArrow(_answer, "digest binary, n_best long, count_sum long")
    per_text = measured.groupBy("digest").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    plain = chunks.select(F.explode("texts").alias("t")).select("t.*")
    measures = plain.join(per_text, "digest", "left").withColumns({
        c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})
    return measures, rated.select(a.alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), "n")


MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def vocabularies(folder: str = TOKENIZERS) -> tuple[bytes, bytes]:
    """The files of tokenizers A and B."""
    out = []
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        with open(os.path.join(folder, name), "rb") as f:
            out.append(f.read())
    return out[0], out[1]


def op11_token_alignment(spark: SparkSession, sf_dir: str, folder: str = TOKENIZERS) -> DataFrame:
    """Measures of every row of ``documents``."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    measures, _ = align(docs, "text", *vocabularies(folder))
    rows = docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    found = rows.join(measures, "digest", "left")
    return found.select("doc_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in MEASURES],
                        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
