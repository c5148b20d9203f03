"""Removal of repeated strings against a table of all windows."""

import hashlib
import random

import numpy as np
import pytest

from pagelake.llm import suffix_sort as ss


def brute(rows, threshold):
    """(id, bytes, removed, spans, digest of the rest) per row, by the definition."""
    rows = [(i, (t or "").encode()) for i, t in rows]
    place = lambda i: (i is not None, i or 0)
    first = {}
    for i, raw in rows:
        for p in range(len(raw) - threshold + 1):
            window = raw[p:p + threshold]
            first[window] = min(first.get(window, ((True, 1 << 62), 0)), (place(i), p))
    out = []
    for i, raw in rows:
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - threshold + 1):
            if first[raw[p:p + threshold]] < (place(i), p):
                gone[p:p + threshold] = True
        rest = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((i, len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return out


def removed(spark, rows, threshold):
    df = spark.createDataFrame(rows, "id long, body string").repartition(3)
    got = ss.remove_repeats(df, "id", "body", threshold)
    assert got.columns == ["id", "body", "kept"]
    out = []
    for r in got.collect():
        k = r["kept"]
        raw = (r["body"] or "").encode()
        assert sum(s["end"] - s["start"] for s in k["spans"]) == k["n_removed"] == len(raw) - len(k["bytes"])
        out.append((r["id"], k["n_bytes"], k["n_removed"], k["n_spans"], hashlib.sha256(bytes(k["bytes"])).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r))


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("threshold", [12, 31])
def test_random_texts_with_copies(spark, seed, threshold):
    rng = random.Random(seed)
    letters = "ab" if seed % 2 else "abcdefghé"
    passages = ["".join(rng.choices(letters, k=rng.randint(5, 80))) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(6)]
        rows.append((rng.randint(0, 50) if rng.random() < 0.9 else None, "".join(parts)))
    rows += rows[:5] + [(99, None), (98, ""), (97, "a" * 300), (96, "ab" * 200)]
    assert order(removed(spark, rows, threshold)) == order(brute(rows, threshold))


def test_texts_longer_than_a_slice(spark, monkeypatch):
    rng = random.Random(9)
    long = "".join(rng.choices("abcdef ", k=4000))
    rows = [(3, long), (1, long[700:2900]), (2, long[100:160] + long[50:1000] + long[:40] * 9), (4, "z" * 900)]
    monkeypatch.setattr(ss, "SLICE", 500)
    # the scan functions run in this process, so that the small slice holds
    column = __import__("pyarrow").array([t.encode() for _, t in rows])
    for threshold in (20, 100):
        seen, found = {}, {}
        for numbers, at, starts, counts, data in ss._slices(column, threshold):
            first, windows, place, one = ss._runs(data, np.array(starts), np.array(counts), threshold)
            two = ss._second(data, first, windows, place, threshold)
            text = np.searchsorted(starts, first, "right") - 1
            for k, f, n in zip(text, first, windows, strict=True):
                for p in range(f, f + n):
                    found.setdefault(numbers[k], []).append(p - starts[k] + at[k])
            for d1, d2, f, n in zip(one, two, first, windows, strict=True):
                assert seen.setdefault((d1, d2), bytes(data[f:f + n + threshold - 1])) == bytes(data[f:f + n + threshold - 1])
        assert {k: sorted(v) for k, v in found.items()} == {k: list(range(len(t) - threshold + 1)) for k, (_, t) in enumerate(rows)}


def test_groups_of_several_buckets(spark, monkeypatch):
    # one passage in many surroundings: its group of second digits is dealt over buckets of two members
    rng = random.Random(4)
    passage = "".join(rng.choices("abcdefgh", k=45))
    rows = [(i, "".join(rng.choices("abcdefgh", k=rng.randint(0, 60))) + passage + "".join(rng.choices("abcdefgh", k=40))) for i in range(40)]
    rows += [(None, rows[3][1]), (7, rows[5][1])]
    monkeypatch.setattr(ss, "BUCKET", 2)
    assert order(removed(spark, rows, 30)) == order(brute(rows, 30))


def test_equal_windows_have_equal_first_digits():
    rng = random.Random(2)
    shared = "".join(rng.choices("abcd", k=400))
    a, b = (np.frombuffer(("".join(rng.choices("abcd", k=n)) + shared).encode(), np.uint8) for n in (37, 90))
    digits = []
    for data, lead in ((a, 37), (b, 90)):
        first, windows, _, one = ss._runs(data, np.array([0]), np.array([len(data) - 99]), 100)
        at = {}
        for f, n, d in zip(first, windows, one, strict=True):
            at.update(dict.fromkeys(range(f, f + n), d))
        digits.append([at[p] for p in range(lead, lead + 301)])
    assert digits[0] == digits[1]


def test_query_and_odd_rows(spark, odd, none, tmp_path):
    odd.write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    got = [tuple(r) for r in ss.op12_suffix_dedup(spark, str(tmp_path / "odd")).collect()]
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert order(got) == order(brute(rows, 100))
    none.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert ss.op12_suffix_dedup(spark, str(tmp_path / "none")).count() == 0
    wide = odd.withColumn("kept", odd.doc_id)
    assert ss.remove_repeats(wide, "doc_id", "text").columns == [*wide.columns, "_kept"]
