"""Registered crawl-planning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.operators import extract as X
from pagelake.operators import planning as P
from pagelake.plans import sqlfrag as S
from pagelake.plans.registry import V, query, rnd6, sql_ts, ts_str, with_views
from pagelake.session import materialize

_LB = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"

_RULES_TAIL = f""",
lines AS (SELECT origin, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS ln
          FROM (SELECT origin, string_split_regex(coalesce(body, ''), {S.lit(_LB)}) AS l FROM robots_v)),
cls AS (SELECT origin, ln, line, {S.strip("regexp_replace(line, '#.*$', '')")} AS content FROM lines),
k AS (SELECT origin, ln,
             CASE WHEN line = '' THEN 'B'
                  WHEN content = '' OR strpos(content, ':') = 0 THEN 'X'
                  WHEN lower({S.strip("split_part(content, ':', 1)")}) = 'user-agent' THEN 'U'
                  WHEN lower({S.strip("split_part(content, ':', 1)")}) = 'disallow' THEN 'D'
                  WHEN lower({S.strip("split_part(content, ':', 1)")}) = 'allow' THEN 'A'
                  WHEN lower({S.strip("split_part(content, ':', 1)")}) IN ('crawl-delay', 'request-rate') THEN 'M'
                  ELSE 'X' END AS kind,
             {S.strip("regexp_replace(content, '^[^:]*:', '')")} AS value
      FROM cls),
st AS (SELECT *, last_value(CASE WHEN kind IN ('U', 'B') THEN kind END IGNORE NULLS)
                   OVER (PARTITION BY origin ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_ub,
              lag(kind) OVER (PARTITION BY origin ORDER BY ln) AS prev_kind
       FROM k WHERE kind <> 'X'),
grp AS (SELECT *, sum(CASE WHEN kind = 'U' AND (prev_kind IS NULL OR prev_kind <> 'U') THEN 1 ELSE 0 END)
                    OVER (PARTITION BY origin ORDER BY ln ROWS UNBOUNDED PRECEDING) AS group_no FROM st),
agents AS (SELECT origin, group_no, list(value ORDER BY ln) AS agents FROM grp WHERE kind = 'U' GROUP BY origin, group_no),
rules0 AS (SELECT origin, group_no, ln,
                  CASE WHEN kind = 'M' THEN NULL WHEN kind = 'A' THEN true WHEN value = '' THEN true ELSE false END AS allow,
                  CASE WHEN kind = 'M' THEN NULL ELSE value END AS path
           FROM grp WHERE kind IN ('D', 'A', 'M') AND last_ub = 'U'),
rules1 AS (SELECT r.*, a.agents, list_contains(a.agents, '*') AS is_default FROM rules0 r JOIN agents a USING (origin, group_no)),
rules AS (SELECT origin, group_no, agents, is_default, row_number() OVER (PARTITION BY origin, group_no ORDER BY ln) AS rule_no,
                 allow, path
          FROM (SELECT *, min(CASE WHEN is_default THEN group_no END) OVER (PARTITION BY origin) AS first_star FROM rules1)
          WHERE NOT is_default OR group_no = first_star)
"""
_RULES_SQL = with_views("robots_v") + _RULES_TAIL


@query("C1_robots_rules", _RULES_SQL + """
SELECT origin, CAST(group_no AS BIGINT) AS group_no, array_to_string(agents, ',') AS agents,
       CAST(is_default AS BIGINT) AS is_default, CAST(rule_no AS BIGINT) AS rule_no,
       CASE WHEN allow IS NULL THEN 'meta' WHEN allow THEN 'allow' ELSE 'disallow' END AS rule, path
FROM rules""")
def c1(spark, sf):
    r = P.robots_rules(V(spark, sf, "robots_v"))
    return r.select("origin", F.col("group_no").cast("long").alias("group_no"),
                    F.array_join("agents", ",").alias("agents"), F.col("is_default").cast("long").alias("is_default"),
                    F.col("rule_no").cast("long").alias("rule_no"),
                    F.when(F.col("allow").isNull(), "meta").when(F.col("allow"), "allow").otherwise("disallow")
                    .alias("rule"), "path")


# The agents of the registered robots check.
AGENTS = ["pagelake-bot/0.1", "BadBot/2.0"]


def _c2_urls(spark, sf):
    lp = V(spark, sf, "listing_pages")
    details = X.extract_links(lp, scope="product_pod").select(F.col("link_url").alias("url"))
    return (V(spark, sf, "pages").select("url").unionByName(lp.select("url"))
            .unionByName(V(spark, sf, "product_pages").select("url")).unionByName(details))


_C2_SQL = with_views("robots_v", "listing_pages", "product_pages") + _RULES_TAIL + f""",
urls AS (SELECT url FROM pages UNION ALL SELECT url FROM listing_pages UNION ALL SELECT url FROM product_pages
         UNION ALL SELECT 'https://shop.example.com/catalogue/item_' || (3 * n + j) || '/index.html'
                   FROM (SELECT page_id AS n FROM listing_pages) CROSS JOIN (VALUES (0), (1), (2)) AS t(j)),
agents_in AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{a.split('/')[0].lower()}')" for a in AGENTS)}) AS t(agent, token)),
choice AS (SELECT ag.agent, g.origin,
                  coalesce(min(CASE WHEN NOT g.is_default AND list_bool_or(list_transform(g.agents, lambda a: strpos(ag.token, lower(a)) > 0))
                                    THEN g.group_no END),
                           min(CASE WHEN g.is_default THEN g.group_no END)) AS group_no
           FROM (SELECT DISTINCT origin, group_no, agents, is_default FROM rules) g CROSS JOIN agents_in ag
           GROUP BY ag.agent, g.origin),
targets AS (SELECT ag.agent, u.url,
                   {S.url_part('u.url', 'scheme')} || '://' || {S.url_part('u.url', 'netloc')} AS origin,
                   {S.url_part('u.url', 'path')}
                   || CASE WHEN strpos(regexp_replace(u.url, '#.*$', ''), '?') > 0 AND {S.url_part('u.url', 'query')} <> ''
                           THEN '?' || {S.url_part('u.url', 'query')} ELSE '' END
                   || CASE WHEN strpos(u.url, '#') > 0 AND {S.url_part('u.url', 'fragment')} <> ''
                           THEN '#' || {S.url_part('u.url', 'fragment')} ELSE '' END AS target0
            FROM urls u CROSS JOIN agents_in ag),
firsthit AS (SELECT t.agent, t.url, t.origin, CASE WHEN t.target0 = '' THEN '/' ELSE t.target0 END AS target
             FROM targets t),
matched AS (SELECT f.agent, f.url, f.origin, f.target,
                   (SELECT r.allow FROM rules r JOIN choice c ON c.origin = r.origin AND c.group_no = r.group_no
                    WHERE c.agent = f.agent AND r.origin = f.origin AND r.path IS NOT NULL AND starts_with(f.target, r.path)
                    ORDER BY r.rule_no LIMIT 1) AS rule_allow
            FROM firsthit f)
SELECT m.agent, m.url,
       CAST(CASE WHEN rb.status IS NULL THEN true WHEN rb.status IN (401, 403) THEN false
                 WHEN rb.status >= 400 AND rb.status < 500 THEN true
                 WHEN rb.status >= 200 AND rb.status < 300 THEN coalesce(m.rule_allow, true) ELSE false END AS BIGINT)
         AS allowed
FROM matched m LEFT JOIN robots_v rb ON rb.origin = m.origin"""


@query("C2_robots_filter", _C2_SQL)
def c2(spark, sf):
    urls = _c2_urls(spark, sf)
    robots = V(spark, sf, "robots_v")
    out = None
    for a in AGENTS:
        r = P.robots_filter(urls, robots, a).select(F.lit(a).alias("agent"), "url",
                                                    F.col("allowed").cast("long").alias("allowed"))
        out = r if out is None else out.unionByName(r)
    return out


_SCHED_SQL = with_views("requests_v") + """,
a AS (SELECT request_id, worker, domain, ts, epoch_us(ts) AS a_us FROM requests_v)
"""


def _sched_sql(keys: str) -> str:
    return _SCHED_SQL + f""",
n AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY a_us, request_id) AS rn FROM a),
s AS (SELECT *, rn * 1500000 + max(a_us - rn * 1500000) OVER (PARTITION BY {keys} ORDER BY a_us, request_id
                                                              ROWS UNBOUNDED PRECEDING) AS start_us FROM n)
SELECT request_id, domain, CAST(worker AS BIGINT) AS worker, {sql_ts('make_timestamp(CAST(start_us AS BIGINT))')} AS start_at,
       round((start_us - a_us) / 1e6, 6) AS wait_s
FROM s"""


def _sched(spark, sf, by):
    out = P.politeness_schedule(V(spark, sf, "requests_v"), 1.5, by=by)
    return out.select("request_id", "domain", F.col("worker").cast("long").alias("worker"),
                      ts_str("start_at").alias("start_at"), rnd6("wait_s").alias("wait_s"))


@query("C3_politeness_schedule", _sched_sql("domain"))
def c3(spark, sf):
    return _sched(spark, sf, ("domain",))


@query("C4_politeness_per_worker", _sched_sql("worker, domain"))
def c4(spark, sf):
    return _sched(spark, sf, ("worker", "domain"))


@query("C5_rate_violations", _SCHED_SQL + """,
l AS (SELECT *, lag(a_us) OVER (PARTITION BY domain ORDER BY a_us, request_id) AS prev_us FROM a)
SELECT request_id, domain, round((a_us - prev_us) / 1e6, 6) AS gap_s FROM l
WHERE prev_us IS NOT NULL AND (a_us - prev_us) / 1e6 < 1.5""")
def c5(spark, sf):
    out = P.rate_violations(V(spark, sf, "requests_v"), 1.5)
    return out.select("request_id", "domain", rnd6("gap_s").alias("gap_s"))


def _walk_inputs(spark, sf):
    lp = V(spark, sf, "listing_pages")
    # one pass over the listing HTML extracts both the next link and the detail links
    parsed = materialize(lp.select("url", X.next_link(F.col("html"), F.col("url")).alias("next_url"),
                                   X.link_column(F.col("html"), F.col("url")).alias("links")), "listings")
    listings = parsed.select("url", "next_url")
    details = parsed.select("url", F.posexplode("links").alias("link_idx", "link_url"))
    starts = listings.join(listings.select(F.col("next_url").alias("url")).where("url IS NOT NULL"), "url",
                           "left_anti").select("url")
    return listings, details, starts


MAX_PAGES = 90

_WALK_SQL = with_views("listing_pages") + f""",
lst AS (SELECT page_id AS n, url, CASE WHEN n % 40 = 39 THEN NULL
                                  ELSE 'https://shop.example.com/catalogue/page-' || (n + 1) || '.html' END AS next_url
        FROM listing_pages),
starts AS (SELECT url FROM lst WHERE url NOT IN (SELECT next_url FROM lst WHERE next_url IS NOT NULL)),
walk AS (SELECT * FROM (
    WITH RECURSIVE w(start_url, url, next_url, n, depth) AS (
        SELECT s.url, l.url, l.next_url, l.n, 1 FROM starts s JOIN lst l ON l.url = s.url
        UNION ALL
        SELECT w.start_url, l.url, l.next_url, l.n, w.depth + 1 FROM w JOIN lst l ON l.url = w.next_url
        WHERE w.depth < {MAX_PAGES})
    SELECT * FROM w)),
items AS (
    SELECT start_url, depth, 0 AS kind_no, 0 AS link_idx, url FROM walk
    UNION ALL
    SELECT start_url, depth, 1, j, 'https://shop.example.com/catalogue/item_' || (3 * n + j) || '/index.html'
    FROM walk CROSS JOIN (VALUES (0), (1), (2)) AS t(j))
"""


@query("C6_walk_pages", _WALK_SQL + f"""
SELECT start_url, CAST(seq_no AS BIGINT) AS seq_no, url, CASE WHEN kind_no = 0 THEN 'listing' ELSE 'detail' END AS kind
FROM (SELECT *, row_number() OVER (PARTITION BY start_url ORDER BY depth, kind_no, link_idx) AS seq_no
      FROM items WHERE kind_no = 0 OR NOT starts_with(url, 'https://shop.example.com/catalogue/item_1'))
WHERE seq_no <= {MAX_PAGES}""")
def c6(spark, sf):
    listings, details, starts = _walk_inputs(spark, sf)
    allowed = P.robots_filter(listings.select("url").unionByName(details.select(F.col("link_url").alias("url"))),
                              V(spark, sf, "robots_v"), AGENTS[0])
    allowed = materialize(allowed.select("url", "allowed"), "allowed")  # read by the walk cut and the detail filter
    out = P.walk_pages(listings, details, starts, MAX_PAGES, allowed)
    return out.select("start_url", F.col("seq_no").cast("long").alias("seq_no"), "url", "kind")


@query("C7_plan_crawl", _WALK_SQL + f"""
SELECT start_url, CAST(job_no AS BIGINT) AS job_no, url, 'books' AS site_key
FROM (SELECT *, row_number() OVER (PARTITION BY start_url ORDER BY depth, kind_no, link_idx) AS job_no FROM items)
WHERE job_no <= {MAX_PAGES}""")
def c7(spark, sf):
    listings, details, starts = _walk_inputs(spark, sf)
    allowed = P.robots_filter(listings.select("url"), V(spark, sf, "robots_v"), AGENTS[0])
    out = P.plan_crawl(listings, details, starts, MAX_PAGES, allowed)
    return out.select("start_url", F.col("job_no").cast("long").alias("job_no"), "url", "site_key")


_JOBS_SQL = """
WITH jobs AS (SELECT page_id, url,
                     CASE regexp_extract(url, '^[a-z]+://[^/?#]*/([a-z]{2})/', 1)
                          WHEN 'en' THEN 'quotes_static' WHEN 'fr' THEN 'quotes_js' WHEN 'de' THEN 'books'
                          ELSE 'site_' || regexp_extract(url, '^[a-z]+://[^/?#]*/([a-z]{2})/', 1) END AS site_key
              FROM pages),
sites AS (SELECT * FROM (VALUES ('quotes_static', 'static'), ('quotes_js', 'rendered'), ('books', 'static'))
          AS t(site_key, fetch_strategy))
"""


def _jobs(spark, sf):
    lang = F.regexp_extract("url", r"^[a-z]+://[^/?#]*/([a-z]{2})/", 1)
    key = (F.when(lang == "en", "quotes_static").when(lang == "fr", "quotes_js").when(lang == "de", "books")
           .otherwise(F.concat(F.lit("site_"), lang)))
    return V(spark, sf, "pages").select("page_id", "url", key.alias("site_key"))


@query("C8_attach_site", _JOBS_SQL + """
SELECT j.page_id, j.site_key, s.fetch_strategy,
       CASE WHEN s.site_key IS NULL THEN 'unknown site key: ' || j.site_key END AS error
FROM jobs j LEFT JOIN sites s ON s.site_key = j.site_key""")
def c8(spark, sf):
    ok, bad = P.attach_site(_jobs(spark, sf), P.sites_table(spark))
    return ok.select("page_id", "site_key", "fetch_strategy", F.lit(None).cast("string").alias("error")).unionByName(
        bad.select("page_id", "site_key", F.lit(None).cast("string").alias("fetch_strategy"), "error"))


_ATT_SQL = with_views("attempts_v") + """,
cls AS (SELECT *, CASE WHEN status = 429 OR (status >= 500 AND status < 600) THEN 'retryable'
                       WHEN status >= 400 AND status < 500 THEN 'permanent' ELSE 'ok' END AS outcome
        FROM attempts_v)
"""


def _attempts(spark, sf):
    a = V(spark, sf, "attempts_v")
    return a.withColumn("outcome", P.classify_fetch(F.col("status")))


@query("C9_classify_fetch", _ATT_SQL + "SELECT job_id, CAST(attempt AS BIGINT) AS attempt, outcome FROM cls")
def c9(spark, sf):
    return _attempts(spark, sf).select("job_id", F.col("attempt").cast("long").alias("attempt"), "outcome")


def _resolve_sql(max_retries: int) -> str:
    return _ATT_SQL + f""",
term AS (SELECT job_id, min(attempt) AS t FROM cls WHERE outcome <> 'retryable' OR attempt >= {max_retries + 1}
         GROUP BY job_id),
lastv AS (SELECT job_id, max(attempt) AS last_attempt FROM cls GROUP BY job_id)
SELECT l.job_id,
       CASE WHEN t.t IS NULL THEN 'retrying' WHEN c.outcome = 'ok' THEN 'succeeded' ELSE 'dead' END AS state,
       CAST(coalesce(t.t, l.last_attempt) AS BIGINT) AS attempt_count,
       CAST(coalesce(c.status, c2.status) AS BIGINT) AS last_status
FROM lastv l LEFT JOIN term t ON t.job_id = l.job_id
LEFT JOIN cls c ON c.job_id = t.job_id AND c.attempt = t.t
LEFT JOIN cls c2 ON c2.job_id = l.job_id AND c2.attempt = l.last_attempt"""


def _resolve(spark, sf, max_retries):
    r = P.resolve_attempts(_attempts(spark, sf), max_retries=max_retries)
    return r.select("job_id", "state", F.col("attempt_count").cast("long").alias("attempt_count"),
                    F.col("last_status").cast("long").alias("last_status"))


@query("C10_resolve_attempts", _resolve_sql(5))
def c10(spark, sf):
    return _resolve(spark, sf, 5)


@query("C10_resolve_attempts_max1", _resolve_sql(1))
def c10b(spark, sf):
    return _resolve(spark, sf, 1)


@query("C11_next_attempt_at", _ATT_SQL + f"""
SELECT job_id, CAST(attempt AS BIGINT) AS attempt, least(300.0, pow(2.0, attempt - 1)) AS countdown_s,
       {sql_ts('make_timestamp(epoch_us("at") + CAST(least(300.0, pow(2.0, attempt - 1)) * 1000000 AS BIGINT))')} AS next_at
FROM cls WHERE outcome = 'retryable'""")
def c11(spark, sf):
    a = _attempts(spark, sf).filter(F.col("outcome") == "retryable").withColumn("retries", F.col("attempt") - 1)
    out = P.next_attempt_at(a)
    return out.select("job_id", F.col("attempt").cast("long").alias("attempt"), "countdown_s",
                      ts_str("next_at").alias("next_at"))


@query("C12_crawl_progress", with_views("page_versions", "listing_pages") + f""",
plan AS (SELECT url FROM pages UNION ALL SELECT url FROM listing_pages),
stored AS (SELECT * FROM page_versions WHERE url IN (SELECT url FROM plan))
SELECT (SELECT count(*) FROM plan) AS planned, count(*) AS stored,
       {sql_ts('min(fetched_at)')} AS first_at, {sql_ts('max(fetched_at)')} AS last_at,
       round((epoch_us(max(fetched_at)) - epoch_us(min(fetched_at))) / 1e6, 6) AS elapsed_s,
       round((epoch_us(max(fetched_at)) - epoch_us(min(fetched_at))) / 1e6 / count(*), 6) AS s_per_page
FROM stored""")
def c12(spark, sf):
    plan = V(spark, sf, "pages").select("url").unionByName(V(spark, sf, "listing_pages").select("url"))
    out = P.crawl_progress(plan, V(spark, sf, "page_versions"))
    return out.select(F.col("planned").cast("long").alias("planned"), F.col("stored").cast("long").alias("stored"),
                      ts_str("first_at").alias("first_at"), ts_str("last_at").alias("last_at"),
                      rnd6("elapsed_s").alias("elapsed_s"), rnd6("s_per_page").alias("s_per_page"))


_STAGED_SQL = with_views("attempts_v") + """,
staged AS (SELECT *, CASE job_id % 3 WHEN 0 THEN 'crawl' WHEN 1 THEN 'process' ELSE 'embed' END AS stage,
                  CASE WHEN job_id % 3 = 0 THEN NULL
                       ELSE CASE status WHEN 503 THEN 'db_connectivity' WHEN 429 THEN 'request_error'
                                        WHEN 404 THEN 'validation' END END AS error_kind
           FROM attempts_v),
cls AS (SELECT *, CASE WHEN stage = 'crawl' THEN
                         CASE WHEN status = 429 OR (status >= 500 AND status < 600) THEN 'retryable'
                              WHEN status >= 400 AND status < 500 THEN 'permanent' ELSE 'ok' END
                       WHEN error_kind IS NULL THEN 'ok'
                       WHEN stage = 'process' AND error_kind = 'db_connectivity' THEN 'retryable'
                       WHEN stage = 'embed' AND error_kind IN ('request_error', 'db_connectivity') THEN 'retryable'
                       ELSE 'permanent' END AS outcome
        FROM staged),
term AS (SELECT job_id, min(attempt) AS t FROM cls WHERE outcome <> 'retryable' OR attempt >= 6 GROUP BY job_id),
lastv AS (SELECT job_id, max(attempt) AS last_attempt FROM cls GROUP BY job_id)
SELECT l.job_id, (SELECT max(stage) FROM cls c3 WHERE c3.job_id = l.job_id) AS stage,
       CASE WHEN t.t IS NULL THEN 'retrying' WHEN c.outcome = 'ok' THEN 'succeeded' ELSE 'dead' END AS state,
       CAST(coalesce(t.t, l.last_attempt) AS BIGINT) AS attempt_count
FROM lastv l LEFT JOIN term t ON t.job_id = l.job_id
LEFT JOIN cls c ON c.job_id = t.job_id AND c.attempt = t.t"""


@query("C10_resolve_attempts_per_stage", _STAGED_SQL)
def c10c(spark, sf):
    """Crawl, process and embed jobs: each stage retries its own error kinds."""
    a = V(spark, sf, "attempts_v")
    stage = F.when(F.col("job_id") % 3 == 0, "crawl").when(F.col("job_id") % 3 == 1, "process").otherwise("embed")
    err = (F.when(F.col("status") == 503, "db_connectivity").when(F.col("status") == 429, "request_error")
           .when(F.col("status") == 404, "validation"))
    a = a.withColumn("stage", stage).withColumn("error_kind", F.when(stage != "crawl", err))  # crawl: by status
    a = a.withColumn("outcome", P.classify_stage_col(F.col("stage"), F.col("status"), F.col("error_kind")))
    r = P.resolve_attempts(a, max_retries=5)
    stages = a.groupBy("job_id").agg(F.max("stage").alias("stage"))
    return r.join(stages, "job_id").select("job_id", "stage", "state",
                                            F.col("attempt_count").cast("long").alias("attempt_count"))
