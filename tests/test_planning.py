"""Robots, politeness, walks and retries against sequential references."""

import datetime as dt
import random
from urllib.robotparser import RobotFileParser

from pyspark.sql import functions as F

from pagelake.operators import planning as P

ROBOTS = "User-agent: *\nDisallow: /admin/\nAllow: /"


def allowed(spark, robots_rows, urls, agent="*"):
    robots = spark.createDataFrame(robots_rows, "origin string, status int, body string")
    u = spark.createDataFrame([(x,) for x in urls], "url string")
    return {r["url"]: r["allowed"] for r in P.robots_filter(u, robots, agent).collect()}


def test_robots_basic_and_status_codes(spark):
    got = allowed(spark, [("https://e.com", 200, ROBOTS), ("https://f.com", 404, ""), ("https://g.com", 403, ""),
                          ("https://h.com", 503, "")],
                  ["https://e.com/admin/x", "https://e.com/ok", "https://f.com/admin/", "https://g.com/a",
                   "https://h.com/a", "https://none.com/a"])
    assert got == {"https://e.com/admin/x": False, "https://e.com/ok": True, "https://f.com/admin/": True,
                   "https://g.com/a": False, "https://h.com/a": False, "https://none.com/a": True}


def test_robots_matches_stdlib_parser(spark):
    body = ("# c\nUser-agent: badbot\nDisallow: /\n\nUser-agent: *\nDisallow: /a/b\nAllow: /a\nDisallow: /a\n"
            "Disallow:\n\nUser-agent: *\nDisallow: /x\n\nUser-agent: other\nUser-agent: more\nCrawl-delay: 3\n")
    urls = [f"https://e.com{p}" for p in ["/", "/a", "/a/b/c", "/x", "/a/c?q=1", "/zz"]]
    for agent in ["pagelake/1.0", "BadBot/2", "Other-agent", "more"]:
        rp = RobotFileParser()
        rp.parse(body.splitlines())
        want = {u: rp.can_fetch(agent, u) for u in urls}
        assert allowed(spark, [("https://e.com", 200, body)], urls, agent) == want, agent


def test_robots_compare_percent_decoded(spark):
    paths = ["/a%20b", "/a b", "/café", "/caf%C3%A9", "/x?y=%2f", "/a%2Fb", "/b;c", "/q?a=1&b=<>", "/p+q", "/100%", "/e?", "/t~*"]
    urls = [f"https://e.com{p}" for p in [*paths, "/a/b/c", "/ab", "/x?y=/z", "/p%2Bq", "/p q", "/100%25", "/e?x=1", "/t%7E*"]]
    for rule in paths:
        body = f"User-agent: *\nDisallow: {rule}\n"
        rp = RobotFileParser()
        rp.parse(body.splitlines())
        assert allowed(spark, [("https://e.com", 200, body)], urls) == {u: rp.can_fetch("*", u) for u in urls}, rule


def test_politeness_schedule_equals_sequential_loop(spark):
    rng = random.Random(1)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, f"d{rng.randint(0, 3)}", t0 + dt.timedelta(milliseconds=rng.randint(0, 20_000))) for i in range(500)]
    df = spark.createDataFrame(rows, "request_id long, domain string, ts timestamp")
    got = {r["request_id"]: r["start_at"] for r in P.politeness_schedule(df, 1.5).collect()}
    last = {}
    for rid, d, ts in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        start = ts if d not in last else max(ts, last[d] + dt.timedelta(seconds=1.5))
        last[d] = start
        assert got[rid] == start


def test_walk_store_and_enqueue_flavours(spark):
    p1, p2 = "https://e.com/c/page-1.html", "https://e.com/c/page-2.html"
    a, b, c = "https://e.com/c/a/index.html", "https://e.com/c/b/index.html", "https://e.com/c/c/index.html"
    listings = spark.createDataFrame([(p1, p2), (p2, None)], "url string, next_url string")
    details = spark.createDataFrame([(p1, 0, a), (p1, 1, b), (p2, 0, c)], "url string, link_idx int, link_url string")
    starts = spark.createDataFrame([(p1,)], "url string")

    def seq(df, col="seq_no"):
        return [r["url"] for r in df.orderBy(col).collect()]

    assert seq(P.walk_pages(listings, details, starts, 10)) == [p1, a, b, p2, c]
    assert seq(P.walk_pages(listings, details, starts, 2)) == [p1, a]
    ok = spark.createDataFrame([(a, False), (p2, True)], "url string, allowed boolean")
    assert seq(P.walk_pages(listings, details, starts, 10, ok)) == [p1, b, p2, c]
    stop = spark.createDataFrame([(p2, False)], "url string, allowed boolean")
    assert seq(P.walk_pages(listings, details, starts, 10, stop)) == [p1, a, b]
    assert seq(P.plan_crawl(listings, details, starts, 4, ok), "job_no") == [p1, a, b, p2]
    cyc = spark.createDataFrame([(p1, p2), (p2, p1)], "url string, next_url string")
    assert seq(P.walk_pages(cyc, details, starts, 7)) == [p1, a, b, p2, c, p1, a]


def _sequential_walk(listings, details, start, max_pages, barred, skip_barred_details):
    out, url = [], start
    while url in listings and url not in barred and len(out) < max_pages:
        out.append(url)
        out += [link for link in details.get(url, []) if not (skip_barred_details and link in barred)]
        url = listings[url]
    return out[:max_pages]


def test_walks_equal_a_sequential_walk(spark):
    """Chains, cycles, joined chains, dead links, listings of very unequal size, barred listings and details, many limits."""
    rng = random.Random(4)
    urls = [f"u{i}" for i in range(60)]
    listings = {u: rng.choice([*urls, *urls, None, "gone"]) for u in urls}
    listings |= {f"c{i}": f"c{i + 1}" for i in range(40)}
    details = {u: [f"{u}/d{i}" for i in range(rng.choice([0, 0, 1, 3, 30]))] for u in listings}
    barred = {"u7", "c33", *(d for ds in details.values() for d in ds if rng.random() < 0.2)}
    frames = (spark.createDataFrame(list(listings.items()), "url string, next_url string"),
              spark.createDataFrame([(u, i, d) for u, ds in details.items() for i, d in enumerate(ds)], "url string, link_idx int, link_url string"),
              spark.createDataFrame([(u,) for u in [*listings, "nowhere", None, "u3"]], "url string"))
    allowed = spark.createDataFrame([(u, False) for u in barred] + [("u1", True), ("u2", None)], "url string, allowed boolean")
    for limit in (0, 1, 2, 7, 33, 64):
        for verdicts, bad in ((None, set()), (allowed, barred)):
            for build, col, skip in ((P.walk_pages, "seq_no", True), (P.plan_crawl, "job_no", False)):
                got = {}
                for r in sorted(build(*frames, limit, verdicts).collect(), key=lambda r: r[col]):
                    got.setdefault(r["start_url"], []).append((r[col], r["url"]))
                want = {u: _sequential_walk(listings, details, u, limit, bad, skip) for u in listings}
                assert got == {u: list(enumerate(w, 1)) for u, w in want.items() if w}


def test_resolve_attempts(spark):
    rows = [(1, 1, 503), (1, 2, 200), (2, 1, 503), (2, 2, 503), (3, 1, 404), (3, 2, 200), (4, 1, 429)]
    df = spark.createDataFrame(rows, "job_id long, attempt int, status int").withColumn(
        "outcome", P.classify_fetch(F.col("status")))
    r5 = {r["job_id"]: (r["state"], r["attempt_count"]) for r in P.resolve_attempts(df, 5).collect()}
    assert r5 == {1: ("succeeded", 2), 2: ("retrying", 2), 3: ("dead", 1), 4: ("retrying", 1)}
    r1 = {r["job_id"]: (r["state"], r["attempt_count"]) for r in P.resolve_attempts(df, 1).collect()}
    assert r1[2] == ("dead", 2)
    e = spark.createDataFrame([(None, "timeout"), (None, "bad url"), (200, None)], "s int, e string")
    assert [r["c"] for r in e.select(P.classify_fetch(F.col("s"), F.col("e")).alias("c")).collect()] == [
        "retryable", "permanent", "ok"]
    b = spark.createDataFrame([(1, 0, dt.datetime(2024, 1, 1)), (1, 9, dt.datetime(2024, 1, 1))],
                              "job_id long, retries int, at timestamp")
    assert [r["countdown_s"] for r in P.next_attempt_at(b).collect()] == [1.0, 300.0]


def test_stage_specific_retry_sets(spark):
    rows = [("process", "db_connectivity"), ("process", "validation"), ("embed", "request_error"),
            ("embed", "db_connectivity"), ("embed", "bad_vector"), ("process", None)]
    df = spark.createDataFrame(rows, "stage string, e string")
    got = []
    for stage, e in rows:
        r = df.filter((F.col("stage") == stage) & (F.col("e").eqNullSafe(F.lit(e)))).select(
            P.classify_stage(stage, F.lit(None).cast("int"), F.col("e")).alias("o")).first()["o"]
        got.append(r)
    assert got == ["retryable", "permanent", "retryable", "retryable", "permanent", "ok"]


def test_backoff_jitter_is_bounded_and_deterministic(spark):
    rows = [(j, r, dt.datetime(2024, 1, 1)) for j in range(50) for r in range(0, 10)]
    df = spark.createDataFrame(rows, "job_id long, retries int, at timestamp")
    a = {(x["job_id"], x["retries"]): x["countdown_s"] for x in P.next_attempt_at(df, jitter_seed=7).collect()}
    b = {(x["job_id"], x["retries"]): x["countdown_s"] for x in P.next_attempt_at(df, jitter_seed=7).collect()}
    assert a == b
    for (_, r), c in a.items():
        assert 0 <= c <= min(300, 2 ** r) and c == int(c)


def test_made_pages_are_parsed_in_many_tasks(spark, tmp_path):
    from pagelake.sources.fixtures import view

    spark.range(100).selectExpr("id as p_partkey", "concat('a ', id) as p_name", "'t' as p_type", "'b' as p_brand", "1.5 as p_retailprice") \
        .coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    for name, n in (("product_pages", 100), ("listing_pages", 34)):
        pages = view(spark, str(tmp_path), name)
        assert pages.rdd.getNumPartitions() == 8 and pages.count() == n
