"""Tokenizer alignment against a walk over the tokens of another library's encoder."""

import collections
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from pagelake.llm import token_align as ta

pytestmark = pytest.mark.skipif(not os.path.isdir(ta.TOKENIZERS), reason="no tokenizer files")


@pytest.fixture(scope="module")
def encoders():
    import sentencepiece
    import tokenizers

    left = tokenizers.Tokenizer.from_file(f"{ta.TOKENIZERS}/byte_bpe_50k.json")
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=f"{ta.TOKENIZERS}/piece_bpe_32k.model")
    return (lambda t: left.encode(" " + t, add_special_tokens=False).ids), right.encode


def brute(texts, encoders):
    """Measures of each text, by its definition."""
    a, b = (side(raw) for side, raw in zip((ta.ByteLevel, ta.Pieces), ta.vocabularies(), strict=True))
    seen, out = collections.Counter(), []
    for text in texts:
        ids = [e(text or "") for e in encoders]
        if not text or any(b"".join(s.table[i] for i in x) != b" " + text.encode() for s, x in zip((a, b), ids, strict=True)):
            out.append(None)
            continue
        ends = []
        for side, x in zip((a, b), ids, strict=True):
            at, row = 0, []
            for i in x:
                at += len(side.table[i])
                row.append(at)
            ends.append(row)
        cuts, groups = sorted(set(ends[0]) & set(ends[1])), []
        for low, high in zip([0, *cuts], cuts, strict=False):
            groups.append([[i for i, e in zip(x, row, strict=True) if low < e <= high] for x, row in zip(ids, ends, strict=True)])
        links = collections.Counter((i, j) for g in groups for i in g[0] for j in g[1])
        seen.update(links.keys())
        digest = ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups)
        out.append((len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(digest.encode()).hexdigest()))
    best = collections.Counter()
    for (i, _), n in seen.items():
        best[i] = max(best[i], n)
    return [(0, 0, 0, 0, 0, 0, "") if m is None else
            (*m[:3], sum(m[3].values()), sum(n for p, n in m[3].items() if seen[p] == best[p[0]]),
             sum(n * seen[p] for p, n in m[3].items()), m[4]) for m in out]


def measured(spark, tmp_path, texts, name="t"):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, n_a string, digest string").repartition(3).write.parquet(
        str(tmp_path / name / "documents.parquet"))
    got = ta.op11_token_alignment(spark, str(tmp_path / name)).orderBy("doc_id").collect()
    return [tuple(r[c] for c in (*ta.MEASURES, "groups_sha256")) for r in got]


def texts():
    rng = random.Random(7)
    parts = ["the house", " walks", "'s", " don't", "…", "Ünïcode", "中文字", "😀", "  ", "\n\n", "\t", "1234", " <|endoftext|>", "<s>", "</s>",
             "▁", "<0x41>", "é", "é", "Ⅷ", "ﬁ", "​", "\x00", "-", "_x_", "qqqqqq", "ſ", "İ"]
    made = ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(150)]
    return [*made, *made[:40], *made[:10], None, "", " ", "a", "x▁y", "a" * 5000, "ab " * 3000]


def test_all_measures_equal_brute_force(spark, tmp_path, encoders):
    rows = texts()
    assert measured(spark, tmp_path, rows) == brute(rows, encoders)


def test_small_slices_and_chunks_change_nothing(encoders, monkeypatch):
    aligner = ta.Aligner(*(side(raw) for side, raw in zip((ta.ByteLevel, ta.Pieces), ta.vocabularies(), strict=True)))
    rows = [t or "" for t in texts()]
    measures, pieces = aligner.align(rows)

    def merged(pieces):
        out = {}
        for who, pair, links in pieces:
            for key, n in zip(zip(who.tolist(), pair.tolist(), strict=True), links.tolist(), strict=True):
                assert key not in out  # a pair of a text is in one piece
                out[key] = n
        return out

    whole = merged(pieces)
    monkeypatch.setattr(ta, "CHUNK", 7)
    pieces = list(aligner.align(rows)[1])
    assert len(pieces) > 50 and merged(pieces) == whole
    assert all(m[3] == sum(n for (i, _), n in whole.items() if i == k) for k, m in enumerate(measures))


def test_squeeze_round_trip():
    import numpy as np

    for x in ([], [0], [1, 255, 256, 1 << 40], list(range(1000))):
        assert ta._widen(ta._squeeze(np.array(x, np.int64))).tolist() == x


def test_empty_table_and_odd_rows(spark, odd, none, tmp_path):
    none.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert ta.op11_token_alignment(spark, str(tmp_path / "none")).count() == 0
    odd.write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    got = ta.op11_token_alignment(spark, str(tmp_path / "odd"))
    assert got.count() == 12
    by = {r["doc_id"]: r for r in got.where("doc_id is not null").collect()}
    assert by[4]["n_a"] == by[5]["n_links"] == 0 and by[5]["groups_sha256"] == ""
    assert by[1][1:] == by[2][1:] and by[6]["n_a"] > 60_000 and by[7]["n_a"] > 0


def test_pairs_count_documents(spark):
    docs = spark.createDataFrame([("hello world",)] * 3 + [("hello hello",), (None,)], "text string")
    _, pairs = ta.align(docs, "text", *ta.vocabularies())
    assert pairs.agg(F.max("n")).first()[0] == 4 and pairs.where("n < 1").count() == 0
