"""Epochs, the ledger, recovery of micro-batches and isolation of failing pages."""

import datetime as dt
import glob
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from pagelake.operators import pipeline as PL
from pagelake.sources import tables as io
from pagelake.sources.ledger import Ledger
from pagelake.streaming import pipeline as ST

AS_OF = dt.datetime(2024, 2, 1)
SCHEMA = "id long, url string, raw_html string, extracted_text string, content_hash string, fetched_at timestamp"


def obs(spark, rows):
    """(id, url, text, day) as observations."""
    full = [(i, u, f"<table><tr><th>Day</th><td>{d}</td></tr></table>", t, f"h:{t}", dt.datetime(2024, 1, 1) + dt.timedelta(days=d))
            for i, u, t, d in rows]
    return spark.createDataFrame(full, SCHEMA)


def rows_of(spark, paths, table, *cols):
    return sorted(tuple(r) for r in PL.read_output(spark, paths, table).select(*cols).collect())


def paths_in(tmp_path):
    return PL.table_paths(str(tmp_path / "tables"))


FIRST = [(1, "u", "one", 1), (2, "v", "two", 1), (3, "u", "one", 2)]
SECOND = [(4, "u", "three", 3), (5, "v", "two", 3), (6, "w", "four", 3)]


def test_a_lost_epoch_is_invisible_and_repeated_exactly(spark, tmp_path):
    paths = paths_in(tmp_path)
    PL.run_pipeline(spark, obs(spark, FIRST), paths, AS_OF)
    before = {t: rows_of(spark, paths, t, "id") for t in PL.TABLE_SCHEMAS}

    def lost(epoch):
        assert epoch == 1
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        PL.run_pipeline(spark, obs(spark, SECOND), paths, AS_OF, before_commit=lost)
    assert spark.read.parquet(paths["pages"]).count() == 4  # written, not committed
    assert {t: rows_of(spark, paths, t, "id") for t in PL.TABLE_SCHEMAS} == before
    counts = PL.run_pipeline(spark, obs(spark, SECOND), paths, AS_OF)
    assert counts == {"pages": 4, "processed": 4, "chunks": 8, "dead_letters": 0}
    assert [r[0] for r in rows_of(spark, paths, "pages", "id")] == [1, 2, 4, 6]


def test_no_epoch_reads_stored_pages(spark, tmp_path):
    paths = paths_in(tmp_path)
    PL.run_pipeline(spark, obs(spark, FIRST), paths, AS_OF)
    for part in glob.glob(f"{paths['pages']}/epoch=0/*.parquet"):
        with open(part, "wb") as f:
            f.write(b"not a table any more")
    PL.run_pipeline(spark, obs(spark, SECOND), paths, AS_OF)
    assert sorted(r[0] for r in Ledger(spark, paths).epochs("pages", io.PAGE_LOG_SCHEMA, [1]).select("id").collect()) == [4, 6]


def test_heads_over_many_epochs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(PL, "HEADS_EVERY", 3)
    ledger, stored = Ledger(spark, paths_in(tmp_path)), {}
    for n in range(4):
        rows = [(10 * n + k, url, "AB"[(n // (k + 1)) % 2], n) for k, url in enumerate("uvw") if (n + k) % 3]
        PL.ingest(ledger, obs(spark, rows), n)
        ledger.commit(n, None, None, {}, True)
        for i, url, text, _ in rows:
            if not stored.get(url) or stored[url][-1][1] != text:
                stored.setdefault(url, []).append((i, text))
        heads = {r["url"]: (r["id"], r["content_hash"]) for r in PL.read_heads(ledger, n + 1).collect()}
        assert heads == {u: (v[-1][0], f"h:{v[-1][1]}") for u, v in stored.items()}
    assert sorted(r["id"] for r in ledger.committed("pages", io.PAGE_LOG_SCHEMA).collect()) == sorted(i for v in stored.values() for i, _ in v)


def test_replay_of_a_skipped_row_after_a_change(spark, tmp_path):
    paths = paths_in(tmp_path)
    ledger = Ledger(spark, paths)
    for n, rows in enumerate((FIRST, SECOND, [(3, "u", "one", 2)], [(7, "u", "one", 2)])):
        PL.ingest(ledger, obs(spark, rows), n)
        ledger.commit(n, None, None, {}, True)
    # 3 was skipped as unchanged and comes again: nothing; 7 is new, late and unlike the head: a version
    assert sorted(r["id"] for r in ledger.committed("pages", io.PAGE_LOG_SCHEMA).collect()) == [1, 2, 4, 6, 7]


def test_failing_pages_stand_alone(spark, tmp_path):
    def embed(texts):  # a closure, so that workers need not import this module
        if any("broken" in t for t in texts):
            raise ValueError("no vector")
        return [[float("nan") if "odd" in t else 1.0, 2.0] for t in texts]

    paths = paths_in(tmp_path)
    long = "fine " * 200
    rows = [(1, "a", "good", 1), (2, "b", "", 1), (3, "c", long + "broken", 1), (4, "d", "odd", 1), (5, "e", long, 1)]
    counts = PL.run_pipeline(spark, obs(spark, rows).coalesce(1), paths, AS_OF, embedder=embed, dim=2)
    # whole pages: page 3 has chunks without the failing word, and none of them is stored
    assert {r[0] for r in rows_of(spark, paths, "chunks", "page_id")} == {1, 5}
    dead = rows_of(spark, paths, "dead_letters", "url", "task_name", "error", "attempt_count")
    assert dead == [("b", "process_page", "text: String should have at least 1 character", 1),
                    ("c", "embed_page", "ValueError: no vector", 1), ("d", "embed_page", "vector has an entry that is not finite", 1)]
    assert counts["dead_letters"] == 3 and counts["processed"] == 4
    again = PL.run_pipeline(spark, obs(spark, [(6, "f", "good", 2)]), paths, AS_OF, embedder=embed, dim=2)
    assert again["dead_letters"] == 3 and {r[0] for r in rows_of(spark, paths, "chunks", "page_id")} == {1, 5, 6}


def test_retries_of_a_busy_embedder(spark, tmp_path, monkeypatch):
    def busy(texts):
        if any("busy" in t for t in texts):
            raise ConnectionError("try later")
        return [[1.0, 2.0]] * len(texts)

    monkeypatch.setattr(PL, "MAX_RETRIES", 2)
    paths = paths_in(tmp_path)
    PL.run_pipeline(spark, obs(spark, [(1, "a", "busy page", 1), (3, "c", "good", 1)]), paths, AS_OF, embedder=busy, dim=2)
    for n, late in ((0, []), (1, [(2, "b", "busy too", 1)])):
        waiting = Ledger(spark, paths).epochs("queue", PL.QUEUE_SCHEMA, [n]).collect()
        assert [tuple(r) for r in waiting] == [(1, 0, n + 1)] and rows_of(spark, paths, "dead_letters", "id") == []
        PL.run_pipeline(spark, obs(spark, late), paths, AS_OF, embedder=busy, dim=2)
    assert rows_of(spark, paths, "dead_letters", "url", "attempt_count", "error") == [("a", 3, "ConnectionError: try later")]
    PL.run_pipeline(spark, obs(spark, []), paths, AS_OF, embedder=lambda texts: [[1.0, 2.0]] * len(texts), dim=2)
    assert {r[0] for r in rows_of(spark, paths, "chunks", "page_id")} == {2, 3}


def test_wrong_number_of_vectors_fails_the_texts(spark):
    got = PL._vectors(lambda texts: [[1.0, 2.0]] * (len(texts) if "x" not in texts else 1), ["a", "b", "x", "c"], 2)
    assert [g[1] is None for g in got] == [True, True, True, True]  # alone, "x" has its vector
    got = PL._vectors(lambda texts: [[1.0]] * len(texts), ["a", "b"], 2)
    assert [g[1] for g in got] == ["ValueError: embedder returned (1, 1), expected (1, 2)"] * 2


def test_stream_recovers_a_batch(spark, tmp_path):
    paths, incoming, checkpoint = paths_in(tmp_path), str(tmp_path / "in"), str(tmp_path / "ck")

    def lost(epoch):
        if epoch == 1:
            raise RuntimeError("lost")

    obs(spark, FIRST).write.mode("append").parquet(incoming)
    ST.stream_pipeline(spark, incoming, paths, checkpoint, AS_OF, before_commit=lost)
    obs(spark, SECOND).write.mode("append").parquet(incoming)
    with pytest.raises(StreamingQueryException):
        ST.stream_pipeline(spark, incoming, paths, checkpoint, AS_OF, before_commit=lost)
    ST.stream_pipeline(spark, incoming, paths, checkpoint, AS_OF)
    assert [r[0] for r in rows_of(spark, paths, "pages", "id")] == [1, 2, 4, 6]
    # the checkpoint loses its last commit: Spark delivers the batch again, and the ledger knows it
    for name in ("1", ".1.crc"):
        os.remove(f"{checkpoint}/commits/{name}")
    before = Ledger(spark, paths).last()
    ST.stream_pipeline(spark, incoming, paths, checkpoint, AS_OF)
    assert Ledger(spark, paths).last() == before == 1
    assert [r[0] for r in rows_of(spark, paths, "pages", "id")] == [1, 2, 4, 6]
    # a second stream into the same tables is another source: its first batch is an epoch of its own, of known rows
    ST.stream_pipeline(spark, incoming, paths, str(tmp_path / "ck2"), AS_OF)
    assert Ledger(spark, paths).last() == 2 and [r[0] for r in rows_of(spark, paths, "pages", "id")] == [1, 2, 4, 6]


def test_failing_dead_letter_write_is_recorded(spark, tmp_path, monkeypatch):
    paths = paths_in(tmp_path)
    monkeypatch.setattr(io, "write_dead_letters", lambda df, path: io._quiet(lambda: 1 / 0, path))
    counts = PL.run_pipeline(spark, obs(spark, [(1, "a", "", 1), (2, "b", "text", 1)]), paths, AS_OF)
    assert counts == {"pages": 2, "processed": 1, "chunks": 2, "dead_letters": 0}
    assert [r["dead_letters_written"] for r in Ledger(spark, paths)._rows().collect()] == [False]


def test_stream_versions(spark, tmp_path):
    incoming, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in (FIRST, SECOND, [(9, "v", "late", 0)]):
        obs(spark, rows).write.mode("append").parquet(incoming)
        ST.stream_versions(spark, incoming, out, str(tmp_path / "ck"))
    assert sorted(r["id"] for r in ST.read_versions(spark, out).collect()) == [1, 2, 4, 6, 9]
    assert ST.read_versions(spark, out).where(F.col("url") == "v").count() == 2


def test_pages_are_shuffled_once_by_id(spark, monkeypatch):
    from pagelake.operators.versions import heads_of, versions_on_arrival

    rows = obs(spark, FIRST + FIRST + SECOND)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = versions_on_arrival(rows, heads_of(obs(spark, [])))
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert not any("fetched_at" in line for line in dealt)
    assert sum("hashpartitioning(id#" in line for line in dealt) == 2  # the pages, and ids with hashes of late ones
    assert sorted(r["id"] for r in out.collect()) == [1, 2, 4, 6]


def test_a_table_leaves_no_shuffle_files(spark, tmp_path):
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    io.append(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), str(tmp_path / "t"))
    assert tracker.shuffleStatuses().size() <= before


def test_superseded_records_go_without_a_shuffle_of_the_others(spark):
    rows = spark.createDataFrame([(1, 10, "a", 1), (2, 10, "b", 2), (3, 11, "c", 1), (None, 12, "d", 1)], "id long, page_id long, text string, processed_at int")
    out = PL.dedup_by_page(rows)
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["id"] for r in out.collect()) == [2, 3]


def test_rejected_pages_are_found_without_parsing_html_again(spark, tmp_path, monkeypatch):
    paths, plans = paths_in(tmp_path), []
    write = io.write_dead_letters

    def seen(df, path):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, path)

    monkeypatch.setattr(io, "write_dead_letters", seen)
    PL.run_pipeline(spark, obs(spark, [(1, "u", "", 1), (2, "v", "two", 1), (3, "w", "", 1)]), paths, AS_OF)
    assert plans and "regexp_replace" not in plans[0]
    assert rows_of(spark, paths, "dead_letters", "url", "error") == [
        (u, "text: String should have at least 1 character") for u in ("u", "w")]
    assert rows_of(spark, paths, "processed", "page_id") == [(2,)]


def test_an_epoch_shuffles_no_page_and_leaves_no_stage(spark, tmp_path, monkeypatch):
    from pagelake.session import stages_recorded

    plans, write = {}, Ledger.write

    def seen(self, df, table, *rest):
        plans.setdefault(table, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df, table, *rest)

    monkeypatch.setattr(Ledger, "write", seen)
    ledger = Ledger(spark, paths_in(tmp_path))
    for n, rows in enumerate((FIRST, FIRST, SECOND)):
        with stages_recorded() as stages:
            PL.ingest(ledger, obs(spark, rows).repartition(2), n)
        ledger.commit(n, None, None, {}, True)
        assert stages and not any(os.path.exists(p.removeprefix("file://")) for p in stages)
    assert sorted(r["id"] for r in ledger.committed("pages", io.PAGE_LOG_SCHEMA).collect()) == [1, 2, 4, 6]
    assert len(plans["pages"]) == 3 and not any("SortMergeJoin" in p or "hashpartitioning" in p for p in plans["pages"])


def test_files_of_done_batches_are_deleted(spark, tmp_path):
    for clean in (False, True):
        incoming, paths, checkpoint = (str(tmp_path / f"{name}-{clean}") for name in ("in", "tables", "checkpoint"))
        paths, arrived = PL.table_paths(paths), []
        for rows in (FIRST, SECOND, None):
            if rows is not None:
                io.append(obs(spark, rows).coalesce(1), incoming)
                arrived.append(set(glob.glob(f"{incoming}/*.parquet")) - set().union(*arrived))
            ST.stream_pipeline(spark, incoming, paths, checkpoint, AS_OF, clean=clean)
        assert [r[0] for r in rows_of(spark, paths, "pages", "id")] == [1, 2, 4, 6]
        left = set(glob.glob(f"{incoming}/*.parquet"))
        assert left == (arrived[1] if clean else arrived[0] | arrived[1]) and arrived[0]


def test_arrivals_drop_what_they_are_made_of(spark, tmp_path):
    """The documents joined with their HTML are gone once all observations are in files."""
    from pagelake.plans.registry import page_observations, q_streaming
    from pagelake.session import ensure_checkpoint_dir

    spark.createDataFrame([(k, f"text {k}") for k in range(9)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, "https://a.example.com/3", "<p>3</p>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    stages = f"{ensure_checkpoint_dir(spark).removeprefix('file://')}/pagelake-stages/documents-html-*"
    before, counts = set(glob.glob(stages)), []
    for _ in q_streaming._arrivals(spark, str(tmp_path), str(tmp_path / "in")):
        counts.append((len(set(glob.glob(stages)) - before), spark.read.parquet(str(tmp_path / "in")).count()))
    assert [n for n, _ in counts] == [1, 0] and 0 < counts[0][1] < counts[1][1] == 36
    want = sorted(tuple(r) for r in page_observations(spark, str(tmp_path)).collect())
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "in")).select("id", "url", "raw_html", "extracted_text", "content_hash", "fetched_at").collect()) == want
    got = q_streaming.t3(spark, str(tmp_path)).collect()
    assert len({r["id"] for r in got}) == len(got) > 9
