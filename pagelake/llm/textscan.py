"""Word scanning over Arrow text columns with numpy: boundaries, rolling hashes and windows.

A word's hash is a polynomial in its bytes, modulo 2**64 with an odd base, over a random byte table; one
cumulative sum per slice gives the hash of every word, and of every prefix of a word, without a loop.
Slices hold a bounded number of bytes (one longer text is a slice by itself), so memory stays bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _table(members) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(members)] = True
    return t


# The byte classes that make up a word.
NOT_BLANK = ~_table([0x20, *range(0x09, 0x0E)])
ALNUM = _table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LETTERS = _table([*range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0], _POWERS[1]


def slices(column, max_bytes: int = SLICE_BYTES):
    """(first row, offsets, bytes) for runs of rows of a string column; nulls are empty."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    row = 0
    for chunk in chunks:
        arr = pc.fill_null(chunk, "").cast(pa.large_string())
        n = len(arr)
        if n:
            off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset: arr.offset + n + 1]
            raw = arr.buffers()[2]
            data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
            a = 0
            while a < n:
                b = max(a + 1, int(np.searchsorted(off, off[a] + max_bytes, "right")) - 1)
                b = min(b, n)
                yield row + a, off[a: b + 1] - off[a], data[off[a]: off[b]]
                a = b
        row += n


def fold_case(data: np.ndarray) -> np.ndarray:
    """Lower-case ASCII and Latin-1 letters of UTF-8 bytes."""
    out = LOWER[data]
    if len(out) > 1:
        wide = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][wide] += 32
    return out


class Words:
    """Words of one slice: ``start``/``end`` byte positions, ``doc`` row within the slice, ``hash``."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, members: np.ndarray):
        n = len(data)
        inside = members[data]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        cuts = offsets[:-1]
        before[cuts[cuts < n]] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(n, bool)
        after[:-1] = inside[1:] & before[1:]
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.n_docs = len(offsets) - 1
        self.per_doc = np.bincount(self.doc, minlength=self.n_docs)
        power, self._inverse = powers(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * power[:n], out=self._sums[1:])

    def hashes(self) -> np.ndarray:
        return mix((self._sums[self.end] - self._sums[self.start]) * self._inverse[self.start])

    def prefix_hashes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, hashes) of the first ``size`` bytes of the words that are longer."""
        long = np.flatnonzero(self.end - self.start > size)
        s = self.start[long]
        return long, mix((self._sums[s + size] - self._sums[s]) * self._inverse[s])


def hash_words(words: list[str]) -> np.ndarray:
    """The same hash for given words."""
    if not words:
        return np.zeros(0, np.uint64)
    raw = [w.encode() for w in words]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[off[1:]] - sums[off[:-1]]) * inverse[off[:-1]])


def windows(hashes: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of ``width`` consecutive words of one document."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out = mix(out * np.uint64(3) + hashes[k: k + n])
    whole = np.flatnonzero(doc[:n] == doc[width - 1:])
    return doc[whole], out[whole]


def member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Position of each value in the sorted ``known``, or -1."""
    if not len(known):
        return np.full(len(values), -1)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return np.where(known[at] == values, at, -1)
