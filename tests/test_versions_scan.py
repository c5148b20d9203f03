"""Versioning and the skew-safe ordered scan against sequential references."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagelake.operators import versions as Vs
from pagelake.plans.scan import ordered_scan

T0 = dt.datetime(2024, 1, 1)


def obs_df(spark, rows):
    return spark.createDataFrame([(i, u, h, T0 + dt.timedelta(minutes=m)) for i, u, h, m in rows],
                                 "id long, url string, content_hash string, fetched_at timestamp")


def test_a_b_a_is_three_versions_and_ties_break_by_id(spark):
    rows = [(1, "u", "A", 0), (2, "u", "B", 1), (3, "u", "B", 2), (4, "u", "A", 3),
            (5, "v", "A", 0), (7, "v", "B", 5), (6, "v", "A", 5)]
    kept = sorted(r["id"] for r in Vs.collapse_unchanged(obs_df(spark, rows)).collect())
    assert kept == [1, 2, 4, 5, 7]  # 6 repeats hash A right after 5 (same url, ordered by time, id)
    latest = {r["url"]: r["id"] for r in Vs.latest_versions(obs_df(spark, rows)).collect()}
    assert latest == {"u": 4, "v": 7}


def test_incremental_equals_batch_and_replay_is_empty(spark):
    rng = random.Random(7)
    rows = [(i, f"u{rng.randint(0, 4)}", rng.choice("ABC"), i) for i in range(200)]
    df = obs_df(spark, rows)
    batch = sorted(r["id"] for r in Vs.collapse_unchanged(df).collect())
    early, late = df.filter("id < 120"), df.filter("id >= 120")
    stored = Vs.collapse_unchanged(early)
    inc = sorted([r["id"] for r in stored.collect()] + [r["id"] for r in Vs.new_versions(stored, late).collect()])
    assert inc == batch
    assert Vs.new_versions(Vs.collapse_unchanged(df), df).count() == 0


def test_ordered_scan_hot_key_across_partitions(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randint(0, 30)}"
        rows.append((i, key, float(rng.randint(0, 10_000)), rng.choice(["A", "B"])))
    df = spark.createDataFrame(rows, "id long, key string, a double, h string")
    out = ordered_scan(df, key="key", order=["a", "id"], lag_cols=["h"], cummax=[("cm", "a", 2.0)],
                       num_partitions=16).toPandas().sort_values("id").reset_index(drop=True)
    p = pd.DataFrame(rows, columns=["id", "key", "a", "h"]).sort_values(["key", "a", "id"])
    p["rn"] = p.groupby("key").cumcount() + 1
    p["prev"] = p.groupby("key")["h"].shift()
    p["cm"] = (p["a"] - 2.0 * p["rn"]).groupby(p["key"]).cummax()
    p = p.sort_values("id").reset_index(drop=True)
    assert (out["_rn"].values == p["rn"].values).all()
    assert [x if isinstance(x, str) else None for x in out["prev_h"]] == \
        [x if isinstance(x, str) else None for x in p["prev"]]
    assert (out["cm"].values == p["cm"].values).all()


def test_version_history_and_restrict(spark):
    rows = [(1, "u", "A", 0), (2, "u", "B", 1), (3, "v", "A", 0)]
    h = {r["id"]: (r["version_no"], r["n_versions"]) for r in Vs.version_history(obs_df(spark, rows)).collect()}
    assert h == {1: (1, 2), 2: (2, 2), 3: (1, 1)}
    chunks = spark.createDataFrame([(10, 1), (11, 2), (12, 3)], "chunk_id long, page_id long")
    assert sorted(r["chunk_id"] for r in Vs.restrict_to_latest(chunks, obs_df(spark, rows)).collect()) == [11, 12]
    pl = Vs.latest_page(obs_df(spark, rows), "u").collect()
    assert [r["id"] for r in pl] == [2] and Vs.latest_page(obs_df(spark, rows), "nope").count() == 0


def test_late_and_repeated_observations(spark):
    stored = obs_df(spark, [(1, "u", "A", 1), (2, "u", "B", 10)])
    late = obs_df(spark, [(3, "u", "C", 5), (3, "u", "C", 5), (4, "u", "A", 6), (5, "u", "B", 7), (6, "v", "A", 0)])
    # 5 equals the head
    assert sorted(r["id"] for r in Vs.new_versions(stored, late).collect()) == [3, 4, 6]
    again = obs_df(spark, [(7, "u", "A", 2), (1, "u", "A", 1)])      # equals the version before it: a replay
    assert Vs.new_versions(stored, again).count() == 0
    # told apart from a late arrival by the ids that arrived before
    none = spark.createDataFrame([], "id long")
    assert [r["id"] for r in Vs.new_versions(stored, again, seen=none).collect()] == [7]
    assert Vs.new_versions(stored, again, seen=spark.createDataFrame([(7,)], "id long")).count() == 0
    twice = obs_df(spark, [(1, "u", "A", 0), (1, "u", "A", 0), (2, "u", "B", 1)])
    assert sorted(r["id"] for r in Vs.collapse_unchanged(twice).collect()) == [1, 2]


def test_equal_ids_with_other_content_are_settled(spark):
    rows = [(1, "u", "B", 3), (1, "u", "A", 1), (1, "u", "A", 1), (2, "u", "C", 4)]
    for some in (rows, rows[::-1]):
        got = sorted((r["id"], r["content_hash"]) for r in Vs.new_versions(obs_df(spark, []), obs_df(spark, some)).collect())
        assert got == [(1, "A"), (2, "C")]


def test_late_rows_leave_the_head(spark):
    # arrivals one by one, by the rule: compare with the latest stored version, store if it differs
    rng = random.Random(11)
    stored, want, got = [], [], []
    none = spark.createDataFrame([], "id long")
    for batch in range(4):
        rows = [(100 * batch + i, rng.choice("uv"), rng.choice("ABC"), rng.randint(0, 40)) for i in range(12)]
        new = Vs.new_versions(obs_df(spark, stored), obs_df(spark, rows), seen=none).collect()
        got += [r["id"] for r in new]
        mine = []
        for url in "uv":
            old = [r for r in stored if r[1] == url]
            head = max(old, key=lambda r: (r[3], r[0]), default=None)
            last = head[2] if head else None
            for r in sorted((r for r in rows if r[1] == url), key=lambda r: (r[3], r[0])):
                if head and (r[3], r[0]) < (head[3], head[0]):
                    mine += [r] if r[2] != head[2] else []
                elif r[2] != last:
                    mine.append(r)
                    last = r[2]
        stored += mine
        want += [r[0] for r in mine]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("most", [1 << 14, 0])
def test_rows_of_files_are_taken_by_place_without_a_shuffle(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(Vs, "MOST_BITMAPS", most)
    spark.range(70_000).selectExpr("id", "concat('body ', id) AS raw_html").coalesce(1).write.parquet(str(tmp_path / "a"))
    spark.range(70_000, 70_050).selectExpr("id", "concat('body ', id) AS raw_html").coalesce(1).write.parquet(str(tmp_path / "b"))
    rows = spark.read.parquet(str(tmp_path / "a"), str(tmp_path / "b")).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    wanted = F.col("id").isin(0, 1, 7, 8, 32_767, 32_768, 32_769, 65_535, 65_536, 69_999, 70_000, 70_049) | (F.col("id") % 977 == 5)
    found = Vs.rows_at(rows, rows.where(wanted))
    assert found.columns == ["id", "raw_html"]
    assert sorted(found.collect()) == sorted(rows.where(wanted).select("id", "raw_html").collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not most or "hashpartitioning" not in plan


def test_a_stream_shuffles_no_page(spark, tmp_path, monkeypatch):
    from pagelake.operators import pipeline as PL
    from pagelake.sources import tables as io
    from pagelake.sources.ledger import Ledger
    from pagelake.streaming import pipeline as ST

    plans, write = {}, Ledger.write

    def seen(self, df, table, *rest):
        plans.setdefault(table, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df, table, *rest)

    monkeypatch.setattr(Ledger, "write", seen)
    day = lambda k: dt.datetime(2024, 1, 1 + k)
    parts = [[(1, "u", "<p>1</p>", "a", "a", day(0)), (2, "u", "<p>2</p>", "a", "a", day(1)), (3, "v", "<p>3</p>", "b", "b", day(0)),
              (3, "v", "<p>3</p>", "b", "b", day(0))],
             [(4, "u", "<p>4</p>", "c", "c", day(2)), (3, "v", "<p>3</p>", "b", "b", day(0)), (5, "v", "<p>5</p>", "b", "b", day(3))]]
    paths = PL.table_paths(str(tmp_path / "tables"))
    for part in parts:
        io.append(spark.createDataFrame(part, io.PAGE_LOG_SCHEMA).coalesce(1), str(tmp_path / "in"))
        ST.stream_pipeline(spark, str(tmp_path / "in"), paths, str(tmp_path / "checkpoint"), day(9))
    assert sorted(tuple(r) for r in PL.read_output(spark, paths, "pages").select("id", "raw_html").collect()) == [
        (1, "<p>1</p>"), (3, "<p>3</p>"), (4, "<p>4</p>")]
    assert len(plans["pages"]) == 2 and not any("SortMergeJoin" in p or "hashpartitioning" in p for p in plans["pages"])


def test_versions_by_place_equal_those_by_id(spark, tmp_path):
    rng, rows = random.Random(5), []
    for i in range(300):
        gap = rng.randrange(12)
        rows.append((None if gap == 0 else rng.randrange(250), None if gap == 1 else f"u{rng.randrange(20)}", f"<p>{i}</p>",
                     None if gap == 2 else rng.choice("ab"), None if gap == 3 else T0 + dt.timedelta(hours=rng.randrange(400))))
    schema = "id long, url string, raw_html string, content_hash string, fetched_at timestamp"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    obs = spark.read.schema(schema).parquet(str(tmp_path / "in"))
    heads = spark.createDataFrame([("u1", T0 + dt.timedelta(hours=200), 900, "a")], "url string, fetched_at timestamp, id long, content_hash string")
    placed = obs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    narrow = ["id", "url", "content_hash", "fetched_at"]
    whole = Vs.versions_on_arrival(placed.drop("raw_html"), heads, whole=placed)
    plain = Vs.versions_on_arrival(obs, heads)
    assert whole.columns == obs.columns
    assert sorted(whole.select(narrow).collect()) == sorted(plain.select(narrow).collect()) != []


@pytest.mark.parametrize("most", [1 << 14, 3])
def test_rows_among_ids_equal_a_semi_join(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(Vs, "MOST_BITMAPS", most)
    ids = [None, -(1 << 63), -(1 << 15), -5, -1, 0, 1, 7, 8, 9, 32_767, 32_768, 32_769, 65_536, 65_537, 5_000_000, (1 << 63) - 1]
    rows = [(i, f"text {k} of {i}") for i in ids for k in range(3)]
    spark.createDataFrame(rows, "id long, text string").coalesce(1).write.parquet(str(tmp_path / "rows"))
    table = spark.read.parquet(str(tmp_path / "rows")).select("text", "id")
    for wanted in (ids, ids[::2], ids[1::2], [], [None], [3]):
        asked = spark.createDataFrame([(i,) for i in wanted * 2], "wanted long")
        found = Vs.among(table, "id", asked)
        assert found.columns == ["text", "id"]
        assert sorted(found.collect()) == sorted((t, i) for i, t in rows if i is not None and i in wanted)
        if most > 3:
            assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    words = table.select(F.col("id").cast("string").alias("id"), "text")
    assert Vs.among(words, "id", spark.createDataFrame([("7",), ("x",)], "id string")).count() == 3


def test_versions_of_narrow_rows_equal_those_of_whole_ones(spark, tmp_path, monkeypatch):
    """Rows without a place in files are taken by id; only those that share their id are shuffled."""
    rng, rows = random.Random(6), []
    for i in range(300):
        gap = rng.randrange(12)
        rows.append((None if gap == 0 else rng.randrange(400), None if gap == 1 else f"u{rng.randrange(20)}", f"<p>{i}</p>",
                     None if gap == 2 else rng.choice("ab"), None if gap == 3 else T0 + dt.timedelta(hours=rng.randrange(400))))
    rows += [r for r in rows if r[0] and r[0] % 7 == 0]
    schema = "id long, url string, raw_html string, content_hash string, fetched_at timestamp"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    obs = spark.read.schema(schema).parquet(str(tmp_path / "in"))
    heads = spark.createDataFrame([("u1", T0 + dt.timedelta(hours=200), 900, "a")], "url string, fetched_at timestamp, id long, content_hash string")
    narrow = ["id", "url", "content_hash", "fetched_at"]
    for some in (obs, obs.where("id % 5 = 0"), obs.where("1 = 0")):
        whole = Vs.versions_on_arrival(some.select(narrow), heads, whole=obs)
        plain = Vs.versions_on_arrival(some, heads)
        assert whole.columns == obs.columns
        assert sorted(whole.select(narrow).collect()) == sorted(plain.select(narrow).collect())
        assert {tuple(r) for r in whole.collect()} <= set(rows)
    once = obs.groupBy("id").agg(F.count("*").alias("n")).where("n = 1").select("id").collect()
    unique = obs.where(F.col("id").isin([r["id"] for r in once]))
    plan = Vs.versions_on_arrival(unique.select(narrow), heads, whole=unique)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "raw_html" in plan
