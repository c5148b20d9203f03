"""Retrieval, citations, prompts and the pipeline."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.operators import pipeline as PL
from pagelake.operators import retrieval as R


def pages_df(spark, rows):
    return spark.createDataFrame([(i, u, dt.datetime(2024, 1, d)) for i, u, d in rows],
                                 "id long, url string, fetched_at timestamp")


def one_hot(i, dim=8):
    v = [0.0] * dim
    v[i] = 1.0
    return v


def test_retrieve_latest_only_and_ties(spark):
    pages = pages_df(spark, [(1, "a", 1), (2, "a", 2), (3, "b", 1)])
    chunks = spark.createDataFrame(
        [(10, 1, 0, "old a", one_hot(0)), (20, 2, 0, "new a", one_hot(0)), (30, 3, 0, "b0", one_hot(0)),
         (31, 3, 1, "b1", one_hot(1))],
        "chunk_id long, page_id long, chunk_index int, chunk_text string, embedding array<float>")
    q = spark.createDataFrame([(1, "q", one_hot(0))], "query_id long, query string, embedding array<float>")
    got = R.retrieve(q, chunks, pages, k=2).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [20, 30]
    lab = R.label_sources(R.retrieve(q, chunks, pages, k=3)).orderBy("rank").collect()
    assert [r["citation"] for r in lab] == [1, 2, 2]
    prompt = R.build_prompts(R.label_sources(R.retrieve(q, chunks, pages, k=2)), q).first()["prompt"]
    assert prompt == "Sources:\n[1] new a\n\n[2] b0\n\nQuestion: q"


@pytest.mark.parametrize("bound", [0, 1 << 20])
def test_knn_equals_brute_force_with_tiles(spark, monkeypatch, bound):
    monkeypatch.setattr(R, "QUERY_TILE", 7)
    monkeypatch.setattr(R, "CHUNK_TILE", 16)
    monkeypatch.setattr(R, "HELD_ROWS", 100)
    rng = np.random.default_rng(0)
    c = rng.normal(size=(300, 16)).astype(np.float32)
    qv = rng.normal(size=(40, 16)).astype(np.float32)
    chunks = spark.createDataFrame([(i, i, 0, f"c{i}", c[i].tolist()) for i in range(300)],
                                   "chunk_id long, page_id long, chunk_index int, chunk_text string, "
                                   "embedding array<float>").repartition(5)
    q = spark.createDataFrame([(i, qv[i].tolist()) for i in range(40)], "query_id long, embedding array<float>")
    got = R.knn(q, chunks, k=4, broadcast_bytes=bound).collect()
    cd, qd = c.astype(np.float64), qv.astype(np.float64)
    dist = 1 - (qd @ cd.T) / np.outer(np.linalg.norm(qd, axis=1), np.linalg.norm(cd, axis=1))
    want = {(qi, int(j)) for qi in range(40) for j in np.lexsort((np.arange(300), dist[qi]))[:4]}
    assert {(r["query_id"], r["chunk_id"]) for r in got} == want


@pytest.mark.parametrize("bound", [0, 1 << 20])
def test_knn_ties_of_many_equal_vectors_and_wide_ids(spark, bound):
    chunks = spark.range(400).selectExpr("cast(10000000000000 * (399 - id) as decimal(38,0)) as chunk_id", "id as page_id",
                                         "0 as chunk_index", "'t' as chunk_text", "array(1f, 2f) as embedding").repartition(6)
    q = spark.createDataFrame([("x", [2.0, 4.0]), ("y", [0.0, 0.0]), ("z", None)], "query_id string, embedding array<float>")
    got = [(r["query_id"], int(r["chunk_id"]), r["rank"]) for r in R.knn(q, chunks, k=3, broadcast_bytes=bound).orderBy("query_id", "rank").collect()]
    assert got == [(i, n * 10 ** 13, n + 1) for i in "xy" for n in range(3)]


def test_ask_batch_no_content_and_generator(spark):
    pages = pages_df(spark, [(1, "a", 1)])
    empty = spark.createDataFrame([], "chunk_id long, page_id long, chunk_index int, chunk_text string, "
                                      "embedding array<float>")
    q = spark.createDataFrame([(1, "q", one_hot(0))], "query_id long, query string, embedding array<float>")
    r = R.ask_batch(q, empty, pages).first()
    assert r["answer"] == R.NO_CONTENT_ANSWER and r["n_sources"] == 0
    chunks = spark.createDataFrame([(10, 1, 0, "fact", one_hot(0))],
                                   "chunk_id long, page_id long, chunk_index int, chunk_text string, "
                                   "embedding array<float>")
    r = R.ask_batch(q, chunks, pages, generator=lambda s: s.str.len().astype(str)).first()
    assert r["answer"] == str(len("Sources:\n[1] fact\n\nQuestion: q"))


def test_keyword_search_and_paging(spark):
    pages = pages_df(spark, [(1, "a", 1), (2, "a", 2), (3, "b", 1)])
    processed = spark.createDataFrame([(1, 1, "An Old Lighthouse, first text"), (2, 2, "an old LIGHTHOUSE, second text"),
                                       (3, 3, "nothing here")], "id long, page_id long, text string")
    hits = R.keyword_search(processed, pages, "lighthouse").collect()
    assert [(h["page_id"], h["url"]) for h in hits] == [(2, "a")]
    with pytest.raises(ValueError):
        R.keyword_search(processed, pages, "")
    with pytest.raises(ValueError):
        R.list_pages(pages.withColumn("content_hash", F.lit("h")), limit=0)


def test_validate_chunk_and_pipeline_replay(spark):
    rec = spark.createDataFrame([(1, "", []), (2, " ", [[("k", None)]]), (3, "ok", [])],
                                "page_id long, text string, tables array<array<struct<key:string,value:string>>>")
    valid, rejected = PL.validate(rec, passthrough=("page_id",))
    assert sorted(r["page_id"] for r in valid.collect()) == [3]
    assert sorted(r["page_id"] for r in rejected.collect()) == [1, 2]
    with pytest.raises(ValueError):
        PL.validate(rec.withColumn("unexpected", F.lit(1)), passthrough=("page_id",))
    pr = spark.createDataFrame([(1, " One line of prose. ", [[("Height", "4 m"), ("Width", "2 m")], [], [("Made in", "Oslo")]])],
                               "page_id long, text string, tables array<array<struct<key:string,value:string>>>")
    assert [r["chunk_text"] for r in PL.chunk_pages(pr).orderBy("chunk_index").collect()] == [
        "One line of prose.", "Height: 4 m\nWidth: 2 m", "Made in: Oslo"]
    html = "<html><body><p>Body</p><table><tr><th>K</th><td>V</td></tr></table></body></html>"
    obs = spark.createDataFrame(
        [(1, "u", html, "Body " * 200, "h1", dt.datetime(2024, 1, 1)),
         (2, "u", html, "Body " * 200, "h1", dt.datetime(2024, 1, 2)),
         (3, "w", html, "", "h0", dt.datetime(2024, 1, 1))],
        "id long, url string, raw_html string, extracted_text string, content_hash string, fetched_at timestamp")
    paths = PL.pipeline_paths(spark, "test")
    c1 = PL.run_pipeline(spark, obs, paths, dt.datetime(2024, 2, 1))
    c2 = PL.run_pipeline(spark, obs, paths, dt.datetime(2024, 2, 1))
    assert c1 == c2 == {"pages": 2, "processed": 1, "chunks": 4, "dead_letters": 1}


def test_duplicate_deliveries_and_wide_ids(spark):
    row = (10 ** 13, "u", "<p>x</p>", "text", "h", dt.datetime(2024, 1, 1))
    obs = spark.createDataFrame([row, row], "id long, url string, raw_html string, extracted_text string, "
                                            "content_hash string, fetched_at timestamp")
    paths = PL.pipeline_paths(spark, "twice")
    counts = PL.run_pipeline(spark, obs, paths, dt.datetime(2024, 2, 1))
    assert counts == {"pages": 1, "processed": 1, "chunks": 1, "dead_letters": 0}
    assert int(spark.read.parquet(paths["chunks"]).first()["id"]) == 10 ** 23


def test_zero_vectors_rank_last_and_repeated_queries(spark):
    chunks = spark.createDataFrame([(1, 1, 0, "zero", [0.0, 0.0]), (2, 2, 0, "near", [1.0, 0.0])],
                                   "chunk_id long, page_id long, chunk_index int, chunk_text string, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0])] * 3, "query_id long, embedding array<float>")
    got = R.knn(q, chunks, k=2, broadcast_bytes=0).orderBy("rank").collect()
    assert [(r["query_id"], r["chunk_id"]) for r in got] == [(7, 2), (7, 1)]


def test_keyword_backslash(spark):
    pages = pages_df(spark, [(1, "a", 1)])
    processed = spark.createDataFrame([(1, 1, "path C:\\dir here")], "id long, page_id long, text string")
    assert R.keyword_search(processed, pages, "C:\\dir").count() == 1


def test_hashing_embedder_is_normalised(spark):
    df = spark.createDataFrame([("Hello hello world",), ("",)], "t string")
    v = [r["e"] for r in PL.embed(df, "t", out="e").collect()]
    assert abs(sum(x * x for x in v[0]) - 1) < 1e-6 and sum(v[1]) == 0
    e = PL.embed(df, "t", embedder=lambda texts: [[float(len(t))] * 4 for t in texts], dim=4).collect()
    assert e[0]["embedding"] == [17.0] * 4


def test_keyword_wildcards_and_literal_mode(spark):
    pages = pages_df(spark, [(1, "a", 1)])
    processed = spark.createDataFrame([(1, 1, "x" * 200 + " then more")], "id long, page_id long, text string")
    hit = R.keyword_search(processed, pages, "th_n").collect()
    assert len(hit) == 1 and hit[0]["snippet"] == "x" * 160  # no literal hit: first 160 chars
    assert R.keyword_search(processed, pages, "th_n", literal=True).count() == 0


def test_keyword_query_table_equals_single_searches(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices(["ab", "C", "é", "%", "_", "\\", " ", "İ", "x"], k=rng.randint(0, 12))) for _ in range(60)]
    pages = pages_df(spark, [(i, f"u{i % 50}", 1 + i % 28) for i in range(60)])
    processed = spark.createDataFrame([(100 + i, i, t) for i, t in enumerate(texts)] + [(999, 3, None)],
                                      "id long, page_id long, text string")
    asked = ["a", "bC", "abab", "x x", "É", "%", "_", "a%x", "\\", "c_b", "zzz", "b_", "%%é"]
    table = spark.createDataFrame([(x,) for x in [*asked, "a", "", None]], "query string")
    columns = ("query", "hit_no", "page_id", "url", "snippet")
    for literal in (False, True):
        want = sorted(tuple(r[c] for c in columns) for r in R.keyword_search(processed, pages, asked, literal=literal).collect())
        got = sorted(tuple(r[c] for c in columns) for r in R.keyword_search_table(processed, pages, table, literal=literal).collect())
        assert got == want and want
    assert R.keyword_search_table(processed, pages, table.where("1 = 0")).count() == 0


def test_keyword_query_table_reads_the_texts_once(spark, tmp_path):
    """What is left when the result is read needs the texts of hits only: the processed table, and its shuffles, are gone by then."""
    spark.createDataFrame([(k + 10, k, f"text {k} in kay") for k in range(40)], "id long, page_id long, text string").write.parquet(str(tmp_path / "p"))
    pages, table = pages_df(spark, [(k, f"u{k % 20}", 1 + k // 20) for k in range(40)]), spark.createDataFrame([("kay",)], "query string")
    found = R.keyword_search_table(spark.read.parquet(str(tmp_path / "p")), pages, table, limit=3)
    for part in tmp_path.glob("p/*.parquet"):
        part.write_bytes(b"not a table any more")
    assert sorted(tuple(r) for r in found.select("hit_no", "page_id", "url", "snippet").collect()) == [
        (k, 19 + k, f"u{k - 1}", f"text {19 + k} in kay") for k in (1, 2, 3)]


def test_named_entry_points(spark):
    pages = pages_df(spark, [(1, "a", 1), (2, "b", 1)])
    assert [r["url"] for r in R.get_page(pages, 2).collect()] == ["b"] and R.get_page(pages, 9).count() == 0
    docs = spark.createDataFrame([(1, "x" * 1200)], "page_id long, text string")
    assert [r["chunk_index"] for r in PL.chunk_text(docs).collect()] == [0, 1, 2]


def test_knn_of_many_queries_shuffles_no_vector(spark):
    vectors = spark.range(50).selectExpr("id as query_id", "id as chunk_id", "id as page_id", "0 as chunk_index", "'t' as chunk_text",
                                         "array(cast(id as float), 1f) as embedding")
    plan = R.knn(vectors, vectors, k=2, broadcast_bytes=0)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "explode" not in plan


def test_knn_candidates_do_not_grow_with_the_chunks(spark, monkeypatch):
    """Each query tile meets all chunk tiles in one task, so a query has k candidates, however many files the chunks fill."""
    monkeypatch.setattr(R, "QUERY_TILE", 1)
    monkeypatch.setattr(R, "CHUNK_TILE", 4)
    monkeypatch.setattr(R, "GROUP_BYTES", 16)
    n = 3 * spark.sparkContext.defaultParallelism
    vectors = spark.range(n).selectExpr("id as query_id", "id as chunk_id", "id as page_id", "0 as chunk_index", "'t' as chunk_text",
                                        "array(cast(id as float), 1f) as embedding").repartition(8)
    handed = []
    kernel = R._kernel

    def counted(k, dtypes):
        rows = spark.sparkContext.accumulator(0)
        handed.append(rows)
        scan = kernel(k, dtypes)

        def run(it):
            for batch in scan(it):
                rows.add(batch.num_rows)
                yield batch
        return run

    monkeypatch.setattr(R, "_kernel", counted)
    found = R.knn(vectors.select("query_id", "embedding"), vectors, k=2, broadcast_bytes=0).collect()
    assert len(found) == 2 * n and handed[0].value == 2 * n


@pytest.mark.parametrize("known", [0, 1 << 20])
def test_only_wanted_grams_are_held(spark, known):
    texts = spark.createDataFrame([(1, "The THE"), (2, None), (3, ""), (4, "ätherisch")], "id long, text string")
    grams = spark.createDataFrame([("the",), ("e",), ("",), ("zz",), ("\u00e4t",)], "gram string")
    got = sorted((r["id"], r["gram"]) for r in R._held(texts, grams, 3, known_bytes=known).collect())
    assert got == [(1, ""), (1, "e"), (1, "the"), (3, ""), (4, ""), (4, "e"), (4, "the"), (4, "\u00e4t")]
    counts = {r["gram"]: r["texts"] for r in R._held(texts, grams, 3, count=True, known_bytes=known).collect()}
    assert counts == {"": 3, "e": 2, "the": 2, "\u00e4t": 1}


def test_default_embedder_counts_tokens_of_any_text(spark):
    import hashlib
    import re

    texts = ["One two  TWO-three_9", "", None, "Éa ça É straße x", "  ,;  ", "z" * 3000 + " a b", "ǅ Ⅷ ٣ plain Words"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    for dim in (5, 20_000):
        got = {r.i: r.v for r in df.select("i", PL.hashing_vector("t", dim).alias("v")).collect()}
        for i, t in enumerate(texts):
            if t is None:
                assert got[i] is None
                continue
            counts = np.zeros(dim)
            for token in re.findall(r"[^\W_]+", t.lower()):
                counts[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim] += 1
            length = np.sqrt((counts * counts).sum())
            assert got[i] == (counts / (length or 1)).astype(np.float32).tolist()
    plan = PL.embed(df.select("i", F.col("t").alias("chunk_text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length" in plan  # texts of ASCII alone go without the regular expression
