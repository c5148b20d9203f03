"""Crawl planning over tables (C1–C12): robots rules, politeness schedules,
pagination walks, site strategies, fetch outcomes, retries and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelake.functions.html import strip_ws
from pagelake.functions.urls import origin as url_origin
from pagelake.functions.urls import quote, unquote, url_part
from pagelake.plans.scan import ordered_scan
from pagelake.session import materialize

# Politeness delay (seconds) and retry policy.
DEFAULT_DELAY_SECONDS = 1.5
MAX_RETRIES = 5
RETRY_BACKOFF_MAX_SECONDS = 300

# The site registry (key → fetch strategy).
SITES = [
    ("quotes_static", "quotes.toscrape.com (static)", "static", None),
    ("quotes_js", "quotes.toscrape.com (JS-rendered)", "rendered", ".quote"),
    ("books", "books.toscrape.com (static, paginated)", "static", None),
]

# Line breaks recognised by str.splitlines().
_LINE_BREAK = "\r\n|[\n\r\\x{0b}\\x{0c}\\x{1c}\\x{1d}\\x{1e}\\x{85}\\x{2028}\\x{2029}]"


# --- C1/C2: robots.txt -------------------------------------------------------

def robots_lines(robots: DataFrame) -> DataFrame:
    """Classify every line of every stored robots.txt body.

    ``robots``: (origin, status, body).  Returns (origin, ln, kind, value) with
    kind in U (user-agent), D (disallow), A (allow), M (crawl-delay /
    request-rate), B (empty line), X (ignored)."""
    lines = robots.select("origin", F.posexplode(F.split(F.coalesce("body", F.lit("")), _LINE_BREAK))
                          .alias("ln", "line"))
    content = strip_ws(F.regexp_replace("line", "#.*$", ""))
    key = F.lower(strip_ws(F.split_part(content, F.lit(":"), F.lit(1))))
    value = strip_ws(F.regexp_replace(content, "^[^:]*:", ""))
    kind = (F.when(F.col("line") == "", "B")
            .when((content == "") | ~content.contains(":"), "X")
            .when(key == "user-agent", "U")
            .when(key == "disallow", "D")
            .when(key == "allow", "A")
            .when(key.isin("crawl-delay", "request-rate"), "M")
            .otherwise("X"))
    return lines.select("origin", "ln", kind.alias("kind"), value.alias("value"))


def robots_rules(robots: DataFrame) -> DataFrame:
    """The rule table ``(origin, group_no, agents, is_default, rule_no, allow, path)``.

    Follows the standard-library parser: a blank line or a user-agent line after
    rules closes a group; rules before any user-agent are ignored; groups
    without rules are dropped; of the groups naming ``*`` only the first is
    kept (as the default group).  Rule order is kept (first match wins).
    Meta lines (crawl-delay, request-rate) keep a group alive with a null path.
    Windows run per origin: one robots file is small and bounded."""
    lines = robots_lines(robots).filter(F.col("kind") != "X")
    w = Window.partitionBy("origin").orderBy("ln")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    ub = F.when(F.col("kind").isin("U", "B"), F.col("kind"))
    prev_kind = F.lag("kind").over(w)
    x = (lines.withColumn("_last_ub", F.last(ub, ignorenulls=True).over(before))
         .withColumn("_start", ((F.col("kind") == "U") & (prev_kind.isNull() | (prev_kind != "U"))).cast("int")))
    x = x.withColumn("group_no", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    agents = x.filter(F.col("kind") == "U").groupBy("origin", "group_no").agg(
        F.array_sort(F.collect_list(F.struct("ln", "value"))).alias("_a"))
    agents = agents.select("origin", "group_no", F.transform("_a", lambda s: s["value"]).alias("agents"))
    rules = x.filter(F.col("kind").isin("D", "A", "M") & (F.col("_last_ub") == "U")).select(
        "origin", "group_no", "ln",
        F.when(F.col("kind") == "M", F.lit(None)).when(F.col("kind") == "A", F.lit(True))
        .when(F.col("value") == "", F.lit(True)).otherwise(F.lit(False)).alias("allow"),
        F.when(F.col("kind") == "M", F.lit(None).cast("string")).otherwise(F.col("value")).alias("path"))
    g = rules.join(agents, ["origin", "group_no"])
    star = F.array_contains("agents", "*")
    first_star = F.min(F.when(star, F.col("group_no"))).over(Window.partitionBy("origin"))
    g = g.withColumn("is_default", star).withColumn("_first_star", first_star) \
        .filter(~F.col("is_default") | (F.col("group_no") == F.col("_first_star"))).drop("_first_star")
    rn = F.row_number().over(Window.partitionBy("origin", "group_no").orderBy("ln"))
    return g.withColumn("rule_no", rn).select("origin", "group_no", "agents", "is_default", "rule_no", "allow", "path")


def _url_target(url: Column) -> Column:
    path = F.concat(url_part(url, "path"),
                    F.when(F.regexp_replace(url, "#.*$", "").contains("?") & (url_part(url, "query") != ""),
                           F.concat(F.lit("?"), url_part(url, "query"))).otherwise(F.lit("")),
                    F.when(url.contains("#") & (url_part(url, "fragment") != ""),
                           F.concat(F.lit("#"), url_part(url, "fragment"))).otherwise(F.lit("")))
    return F.when(path == "", F.lit("/")).otherwise(path)


def _without_empty_parts(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "#$", ""), r"\?(#|$)", "$1")


def robots_filter(urls: DataFrame, robots: DataFrame, agent: str, url_col: str = "url") -> DataFrame:
    """Add ``allowed`` to every URL, consulting robots once per origin.

    401/403 → all disallowed; other 4xx or no stored robots row → all allowed;
    other non-2xx (unread) → disallowed; otherwise the first matching rule of
    the applicable group wins, no match → allowed.  Rules and URLs are compared
percent-decoded and encoded anew, so ``/a%20b`` is ``/a b``.  The per-origin rule list is
    compiled into one row and joined (AQE broadcasts it when small), so the
    URL side is never multiplied by the rules."""
    token = agent.split("/")[0].lower()
    rules = robots_rules(robots)
    applies = F.exists("agents", lambda a: F.lit(token).contains(F.lower(a)))
    per_group = rules.select("origin", "group_no", "is_default", applies.alias("_applies")).distinct()
    chosen = per_group.groupBy("origin").agg(
        F.coalesce(F.min(F.when(~F.col("is_default") & F.col("_applies"), F.col("group_no"))),
                   F.min(F.when(F.col("is_default"), F.col("group_no")))).alias("group_no"))
    compiled = rules.join(chosen, ["origin", "group_no"]).groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("rule_no", "allow", quote(_without_empty_parts(unquote("path"))).alias("path")))).alias("_rules"))
    table = robots.select("origin", "status").join(compiled, "origin", "left")
    u = urls.withColumn("_origin", url_origin(F.col(url_col))).withColumn("_target", quote(_url_target(unquote(url_col))))
    j = u.join(table.withColumnRenamed("origin", "_origin"), "_origin", "left")
    hit = F.filter(F.coalesce("_rules", F.array().cast("array<struct<rule_no:int,allow:boolean,path:string>>")),
                   lambda r: r["path"].isNotNull() & F.col("_target").startswith(r["path"]))
    by_rules = F.coalesce(F.try_element_at(hit, F.lit(1))["allow"], F.lit(True))
    st = F.col("status")
    allowed = (F.when(st.isNull(), True).when(st.isin(401, 403), False)
               .when((st >= 400) & (st < 500), True).when((st >= 200) & (st < 300), by_rules).otherwise(False))
    return j.withColumn("allowed", allowed).drop("_origin", "_target", "status", "_rules")


# --- C3–C5: politeness -------------------------------------------------------

def politeness_schedule(reqs: DataFrame, delay: float = DEFAULT_DELAY_SECONDS, by=("domain",),
                        ts_col: str = "ts", id_col: str = "request_id") -> DataFrame:
    """Start time per request, ``start = max(arrival, previous start + delay)``
    per key, in closed form ``n·d + max_{j≤n}(a_j − j·d)`` evaluated with the
    skew-safe ordered scan in integer microseconds (exact)."""
    d_us = int(round(delay * 1_000_000))
    a = reqs.withColumn("_a_us", F.unix_micros(F.col(ts_col).cast("timestamp")))
    scanned = ordered_scan(a, key=list(by), order=["_a_us", id_col], cummax=[("_cm", "_a_us", float(d_us))])
    start_us = (F.col("_rn") * F.lit(d_us) + F.col("_cm")).cast("long")
    return (scanned.withColumn("start_us", start_us)
            .withColumn("start_at", F.timestamp_micros("start_us"))
            .withColumn("wait_s", (F.col("start_us") - F.col("_a_us")) / F.lit(1e6))
            .drop("_cm", "_rn", "_a_us", "start_us"))


def rate_violations(log: DataFrame, delay: float = DEFAULT_DELAY_SECONDS, by=("domain",),
                    ts_col: str = "ts", id_col: str = "request_id") -> DataFrame:
    """Requests closer than ``delay`` to the previous request of their key."""
    a = log.withColumn("_a_us", F.unix_micros(F.col(ts_col).cast("timestamp")))
    scanned = ordered_scan(a, key=list(by), order=["_a_us", id_col], lag_cols=["_a_us"])
    gap = (F.col("_a_us") - F.col("prev__a_us")) / F.lit(1e6)
    return scanned.withColumn("gap_s", gap).filter(F.col("gap_s") < F.lit(delay)).drop(
        "_a_us", "prev__a_us", "_rn")


# --- C6/C7: pagination walks -------------------------------------------------

def _walk(listings: DataFrame, details: DataFrame, starts: DataFrame, max_pages: int,
          allowed: DataFrame | None) -> DataFrame:
    """Listings visited from every start URL with their depth and the number of items (listings and ``details``) before
    them: (start_url, url, depth, before), with ``before < max_pages``.

    List ranking by pointer doubling on the next-link function: ``J_k(u)`` is the listing ``2^k`` steps after ``u``, with the
    items on the way (``J_{k+1} = J_k ∘ J_k``, the counts add up).  A jump over ``max_pages`` items or more is no use to any walk
    and is left out.  Walks are then unfolded from the widest jump to the narrowest: every listing reached so far also
    reaches the one a jump ahead, if its count stays under ``max_pages``.  So a listing is generated once per walk that visits it,
    nothing behind the end of a walk ever is, and there are ``2 ⌈log2 max_pages⌉`` joins, independent of the data.

    A missing next link, or one to a page absent from the table, ends a walk; a cycle is followed until ``max_pages`` (as a
    sequential walk would); the walk stops before the first disallowed listing."""
    levels = max(1, (max(1, max_pages) - 1).bit_length())
    nodes = listings.select(F.col("url").alias("_u"), F.col("next_url").alias("_v")) \
        .filter(F.col("_u").isNotNull()).dropDuplicates(["_u"])
    if allowed is not None:
        nodes = nodes.join(_barred(allowed), F.col("_u") == F.col("_barred"), "left_anti")
    items = details.groupBy(F.col("url").alias("_l")).agg(F.count("*").alias("_n"))
    # The node table is read by the first jumps twice and by the starts: written once, lineage cut.
    nodes = materialize(nodes.join(items, F.col("_u") == F.col("_l"), "left").select(
        "_u", "_v", (F.coalesce("_n", F.lit(0)) + 1).cast("long").alias("_c")), "listings")
    known = nodes.select(F.col("_u").alias("_v"))
    # ended jumps are left out, so nulls never gather in one join partition
    hops = [nodes.filter(F.col("_v").isNotNull() & (F.col("_c") < max_pages)).join(known, "_v", "left_semi")]
    for _ in range(1, levels):
        a, b = hops[-1].alias("a"), hops[-1].alias("b")
        # each level is written once: the next level and the expansion read it,
        # and the plan stays linear instead of doubling with every level
        hops.append(materialize(a.join(b, F.col("a._v") == F.col("b._u")).select(
            F.col("a._u").alias("_u"), F.col("b._v").alias("_v"), (F.col("a._c") + F.col("b._c")).alias("_c"))
            .filter(F.col("_c") < max_pages), "jump"))
    rows = starts.select(F.col("url").alias("start_url")).distinct().join(
        known, F.col("start_url") == F.col("_v"), "left_semi").select(
        "start_url", F.col("start_url").alias("url"), F.lit(1).cast("long").alias("depth"), F.lit(0).cast("long").alias("before"))
    for k in reversed(range(levels)):
        here = F.struct("url", "depth", "before")
        ahead = F.struct(F.col("_v").alias("url"), (F.col("depth") + (1 << k)).alias("depth"),
                         (F.col("before") + F.col("_c")).alias("before"))
        reached = F.col("_v").isNotNull() & (F.col("before") + F.col("_c") < max_pages)
        rows = rows.join(hops[k], F.col("url") == F.col("_u"), "left").select("start_url", F.explode(
            F.when(reached, F.array(here, ahead)).otherwise(F.array(here))).alias("_at")).select("start_url", "_at.*")
    return rows.filter(F.lit(0) < max_pages)


def _barred(allowed: DataFrame) -> DataFrame:
    """URLs with a row that disallows them; URLs without a verdict are allowed."""
    return allowed.filter(~F.col("allowed")).select(F.col("url").alias("_barred")).distinct()


def _numbered(walk: DataFrame, details: DataFrame, max_pages: int, number: str) -> DataFrame:
    """(start_url, number, url, kind) of listings and details.  Details are ranked once per listing, not per walk."""
    rank = F.row_number().over(Window.partitionBy("url").orderBy("link_idx"))
    ranked = details.select("url", "link_url", rank.alias("_r")).filter(F.col("_r") < max_pages)
    items_l = walk.select("start_url", (F.col("before") + 1).alias(number), "url", F.lit("listing").alias("kind"))
    items_d = walk.join(ranked, "url").select(
        "start_url", (F.col("before") + 1 + F.col("_r")).alias(number), F.col("link_url").alias("url"), F.lit("detail").alias("kind"))
    return items_l.unionByName(items_d).filter(F.col(number) <= max_pages).withColumn(number, F.col(number).cast("int"))


def walk_pages(listings: DataFrame, details: DataFrame, starts: DataFrame, max_pages: int,
               allowed: DataFrame | None = None) -> DataFrame:
    """C6 (store flavour): listing, its detail pages, then the next listing, until
    ``max_pages`` pages are stored.  A disallowed detail is skipped and not
    counted; a disallowed listing ends the walk.

    ``listings``: (url, next_url); ``details``: (url, link_idx, link_url);
    ``starts``: (url); ``allowed``: (url, allowed) or None (all allowed).
    Returns (start_url, seq_no, url, kind)."""
    if allowed is not None:
        details = details.join(_barred(allowed), F.col("link_url") == F.col("_barred"), "left_anti")
    walk = _walk(listings, details, starts, max_pages, allowed)
    return _numbered(walk, details, max_pages, "seq_no")


def plan_crawl(listings: DataFrame, details: DataFrame, starts: DataFrame, max_pages: int,
               allowed: DataFrame | None = None, site_key: str = "books") -> DataFrame:
    """C7 (enqueue flavour): every emitted job counts; listings are
    robots-checked (a disallowed one ends the walk), details are not.
    Returns (start_url, job_no, url, site_key)."""
    walk = _walk(listings, details, starts, max_pages, allowed)
    return _numbered(walk, details, max_pages, "job_no").select("start_url", "job_no", "url", F.lit(site_key).alias("site_key"))


# --- C8–C12: jobs, outcomes, retries, progress --------------------------------

def sites_table(spark) -> DataFrame:
    """The site registry as a small dimension table."""
    return spark.createDataFrame(SITES, "site_key string, site_name string, fetch_strategy string, "
                                        "wait_selector string")


def attach_site(jobs: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs with their fetch strategy, rejected jobs with an error).

    The registry is the caller's table; the planner broadcasts it when it is small."""
    j = jobs.join(sites, "site_key", "left")
    ok = j.filter(F.col("site_name").isNotNull())
    bad = j.filter(F.col("site_name").isNull()).select(
        *jobs.columns, F.concat(F.lit("unknown site key: "), F.col("site_key")).alias("error"))
    return ok, bad


def classify_fetch(status: Column, error: Column | None = None) -> Column:
    """C9: 'retryable' (timeout, connection error, 429, 5xx), 'permanent'
    (other 4xx, other request errors) or 'ok'."""
    e = F.lower(error) if error is not None else F.lit(None).cast("string")
    return (F.when(e.isin("timeout", "connection"), "retryable")
            .when(e.isNotNull() & (e != ""), "permanent")
            .when((status == 429) | ((status >= 500) & (status < 600)), "retryable")
            .when((status >= 400) & (status < 500), "permanent")
            .otherwise("ok"))


# Error kinds each pipeline stage retries (others are permanent).
STAGE_RETRYABLE = {
    "process": ("db_connectivity",),
    "embed": ("request_error", "db_connectivity"),
}


def classify_stage(stage: str, status: Column, error: Column | None = None) -> Column:
    """C10 helper: outcome of one attempt of a pipeline stage.

    ``crawl`` uses the fetch rules of :func:`classify_fetch`; ``process`` and
    ``embed`` retry only their transient error kinds, every other error is
    permanent, no error is ok."""
    if stage == "crawl":
        return classify_fetch(status, error)
    kinds = STAGE_RETRYABLE[stage]
    e = F.lower(error) if error is not None else F.lit(None).cast("string")
    return (F.when(e.isNull() | (e == ""), "ok").when(e.isin(*kinds), "retryable").otherwise("permanent"))


def classify_stage_col(stage: Column, status: Column, error: Column) -> Column:
    """:func:`classify_stage` with the stage given per row."""
    out = F.when(stage == "crawl", classify_fetch(status, error))
    for st in STAGE_RETRYABLE:
        out = out.when(stage == st, classify_stage(st, status, error))
    return out.otherwise(F.lit(None).cast("string"))


def resolve_attempts(attempts: DataFrame, max_retries: int = MAX_RETRIES, outcome_col: str = "outcome",
                     job_col: str = "job_id") -> DataFrame:
    """Per job → succeeded / retrying / dead with ``attempt_count``.

    Only retryable outcomes retry, at most ``max_retries`` times; a permanent
    error dies at once; attempts after the first terminal one are ignored.
    One grouped aggregation (map-side partial), so a job with many attempts
    never lands whole in one task."""
    o = F.col(outcome_col)
    terminal = (o != "retryable") | (F.col("attempt") >= max_retries + 1)
    agg = attempts.groupBy(job_col).agg(
        F.min(F.when(terminal, F.struct("attempt", o.alias("o"), "status"))).alias("_t"),
        F.max(F.struct("attempt", "status")).alias("_last"))
    state = (F.when(F.col("_t").isNull(), "retrying").when(F.col("_t.o") == "ok", "succeeded").otherwise("dead"))
    return agg.select(job_col, state.alias("state"),
                      F.coalesce(F.col("_t.attempt"), F.col("_last.attempt")).alias("attempt_count"),
                      F.coalesce(F.col("_t.status"), F.col("_last.status")).alias("last_status"))


def next_attempt_at(df: DataFrame, base: float = 1.0, cap: float = RETRY_BACKOFF_MAX_SECONDS,
                    jitter_seed: int | None = None, retries_col: str = "retries", at_col: str = "at",
                    key_cols=("job_id",)) -> DataFrame:
    """C11: exponential backoff ``min(cap, base·2^retries)``; with a seed, full
    jitter ``floor(u·(countdown+1))`` where ``u`` is a hash-derived fraction."""
    countdown = F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), F.col(retries_col)))
    if jitter_seed is not None:
        u = (F.pmod(F.xxhash64(F.lit(jitter_seed), *[F.col(c) for c in key_cols], F.col(retries_col)),
                    F.lit(1 << 30)) / F.lit(float(1 << 30)))
        countdown = F.floor(u * (countdown + 1)).cast("double")
    return df.withColumn("countdown_s", countdown).withColumn(
        "next_at", F.timestamp_micros(F.unix_micros(F.col(at_col).cast("timestamp"))
                                      + (F.col("countdown_s") * 1e6).cast("long")))


def crawl_progress(plan: DataFrame, pages: DataFrame) -> DataFrame:
    """Planned vs stored URLs, elapsed seconds and seconds per page."""
    stored_pages = pages.join(plan.select("url").distinct(), "url", "left_semi")
    s = stored_pages.agg(F.count(F.lit(1)).alias("stored"), F.min("fetched_at").alias("first_at"),
                         F.max("fetched_at").alias("last_at"))
    spark = plan.sparkSession
    out = spark.sql("SELECT (SELECT count(*) FROM {plan}) AS planned, s.* FROM {s} s", plan=plan.select(), s=s)
    elapsed = (F.unix_micros(F.col("last_at").cast("timestamp")) - F.unix_micros(F.col("first_at").cast("timestamp"))) / 1e6
    return out.withColumn("elapsed_s", elapsed).withColumn(
        "s_per_page", F.when(F.col("stored") > 0, F.col("elapsed_s") / F.col("stored")))
