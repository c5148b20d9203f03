"""Page extraction as projections over the page table.

All of it is Catalyst expressions over the HTML column (regex based, see
:mod:`pagelake.functions.html` for what is approximated); nothing shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions.html import (content_hash, decode_entities, html_text, html_title, let,
                                     node_text_stripped, strip_junk, strip_ws, unnest)
from pagelake.functions.urls import domain, origin, resolve_url

from pagelake.functions.patterns import (A_HREF_RE, ARTICLE_RE, DEEP_TABLE_RE, DEEP_TD_RE, DEEP_TH_RE,  # noqa: E402
                                         DEEP_TR_RE, H3_RE, HAS_TABLE_RE, NEXT_LI_RE, TABLE_CUT_RE, TABLE_RE, TABLE_TAG_RE, TD_RE,
                                         TH_RE, TR_SPLIT_RE)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_pages(pages: DataFrame, html_col: str = "raw_html") -> DataFrame:
    """Add ``title``, ``extracted_text`` and ``content_hash``."""
    return (pages.withColumn("title", html_title(html_col))
            .withColumn("extracted_text", html_text(html_col))
            .withColumn("content_hash", content_hash("extracted_text")))


def _dedup_entries(entries: Column) -> Column:
    """Dict semantics on an ordered entry list: a repeated key keeps its first
    position and takes the last value.  The list and its keys are bound once
    (they are read inside per-element lambdas)."""
    def body(es):
        return let(F.transform(es, lambda e: e["key"]), lambda keys: F.transform(
            F.filter(es, lambda e, i: F.array_position(keys, e["key"]) == i + 1),
            lambda e: F.struct(e["key"].alias("key"),
                               F.element_at(F.filter(es, lambda x: x["key"] == e["key"]), -1)["value"]
                               .alias("value"))))

    return let(entries, body)


def _with_depth(html: Column) -> Column:
    """Table tags renamed to carry the depth of their table: the pieces between table tags are scanned with a counter."""
    def scan(pieces):
        step = lambda p: F.when(p.rlike(r"(?i)^<table[\s/>]"), 1).when(p.rlike(r"(?i)^</table[\s/>]"), -1).otherwise(0)
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("depths"))
        # the depth of a piece: of its own table after an opener, of the table that it closes at an end tag
        depths = F.aggregate(pieces, start, lambda s, p: let(step(p), lambda d: F.struct(
            F.greatest(s["at"] + d, F.lit(0)).alias("at"),
            F.array_append(s["depths"], F.when(d < 0, s["at"]).otherwise(s["at"] + d)).alias("depths"))))["depths"]

        def renamed(p, d):
            name = lambda text, depth: F.regexp_replace(text, F.lit(TABLE_TAG_RE), F.concat(F.lit("<$1$2_"), depth.cast("string")))
            closes = p.rlike(r"(?i)^</table[\s/>]")
            return F.when(closes, F.concat(F.lit("</table_"), d.cast("string"), name(F.substring(p, 8, F.length(p)), F.greatest(d - 1, F.lit(0))))
                          ).otherwise(name(p, d))

        return F.array_join(F.zip_with(pieces, depths, renamed), "")

    return let(F.split(html, TABLE_CUT_RE), scan)


def tables_column(html) -> Column:
    """``array<array<struct<key,value>>>`` — per ``<table>``, per ``<tr>``,
    the first ``th`` text → key and the first ``td`` text → value; rows missing
    either are skipped and tables without any pair are dropped.

    Tables inside tables count by themselves, and their rows and text also belong to the tables around them."""
    def cells(tables, rows_of, th, td, group):
        cell = lambda r, pattern: F.when(r.rlike(pattern), F.regexp_extract(r, pattern, group))
        return F.transform(tables, lambda t: F.filter(
            F.transform(rows_of(t), lambda r: F.array(cell(r, th), cell(r, td))), lambda p: p[0].isNotNull() & p[1].isNotNull()))

    def body(clean):
        flat = cells(F.regexp_extract_all(clean, F.lit(TABLE_RE), 1), lambda t: F.slice(F.split(t, TR_SPLIT_RE), 2, 1 << 30), TH_RE, TD_RE, 1)
        deep = cells(F.regexp_extract_all(_with_depth(clean), F.lit(DEEP_TABLE_RE), 2),
                     lambda t: F.regexp_extract_all(t, F.lit(DEEP_TR_RE), 2), DEEP_TH_RE, DEEP_TD_RE, 2)
        ends = F.array_join(F.regexp_extract_all(clean, F.lit(r"(?i)<(/?t)able[\s/>]"), 1), "")
        return F.when(F.lower(ends).contains("tt"), deep).otherwise(flat)

    def facts(rows):
        texts = F.transform(rows, lambda p: F.transform(p, node_text_stripped))
        return _dedup_entries(F.transform(texts, lambda p: F.struct(p[0].alias("key"), p[1].alias("value"))))

    def parsed(page):
        return F.transform(F.filter(let(strip_junk(page), body), lambda t: F.size(t) > 0), facts)

    # Removed junk leaves a blank, so no table tag comes into being by it: a page without one is not parsed.
    none = F.array().cast("array<array<struct<key:string,value:string>>>")
    return let(_col(html), lambda page: F.when(~page.rlike(HAS_TABLE_RE), none).otherwise(parsed(page)))


def extract_tables(df: DataFrame, html_col: str = "raw_html", out: str = "tables") -> DataFrame:
    """E4 on a DataFrame."""
    return df.withColumn(out, tables_column(F.col(html_col)))


def tables_as_maps(df: DataFrame, col: str = "tables") -> DataFrame:
    """E4 as ``array<map<string,string>>`` (entry order kept)."""
    return df.withColumn(col, F.transform(col, lambda t: F.map_from_entries(t)))


def table_facts(df: DataFrame, id_col: str = "page_id", tables_col: str = "tables") -> DataFrame:
    """E5: ``(page_id, table_idx, row_idx, key, value)`` relational rows."""
    t = unnest(df, [id_col], tables_col, "table_idx", "_t")
    return unnest(t, [id_col, "table_idx"], "_t", "row_idx", "_e").select(
        id_col, "table_idx", "row_idx", F.col("_e.key").alias("key"), F.col("_e.value").alias("value"))


def next_link(html, page_url) -> Column:
    """Absolute URL of the first ``li.next a[href]``; null on the last page."""
    block = F.regexp_extract(strip_junk(html), NEXT_LI_RE, 1)
    href = href_value(F.regexp_extract(block, A_HREF_RE, 1))
    return let(href, lambda h: F.when(h != "", resolve_url(h, _col(page_url))))


def href_value(raw) -> Column:
    """An attribute value as matched → without quotes, decoded, trimmed."""
    plain = F.when(F.substring(raw, 1, 1).isin('"', "'"), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    return strip_ws(decode_entities(plain))


def _hrefs(fragment) -> Column:
    return F.regexp_extract_all(fragment, F.lit(A_HREF_RE), 1)


def link_column(html, page_url, scope: str | None = "product_pod") -> Column:
    """Absolute link URLs in document order, not deduplicated.

    ``scope="product_pod"`` = ``article.product_pod h3 a[href]``; ``None`` = every
    ``<a href>`` of the page."""
    clean = strip_junk(html)
    if scope is None:
        hrefs = _hrefs(clean)
    else:
        arts = F.regexp_extract_all(clean, F.lit(ARTICLE_RE), 1)
        h3s = F.flatten(F.transform(arts, lambda a: F.regexp_extract_all(a, F.lit(H3_RE), 1)))
        hrefs = F.flatten(F.transform(h3s, _hrefs))
    hrefs = F.filter(F.transform(hrefs, href_value), lambda h: h != "")
    return F.transform(hrefs, lambda h: resolve_url(h, _col(page_url)))


def extract_links(df: DataFrame, html_col: str = "html", url_col: str = "url", id_col: str = "page_id",
                  scope: str | None = "product_pod") -> DataFrame:
    """E7 on a DataFrame → ``(page_id, link_idx, url)``."""
    return unnest(df, [id_col], link_column(F.col(html_col), F.col(url_col), scope), "link_idx", "link_url")


def domains(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``domain`` (netloc) and ``origin`` (scheme://netloc)."""
    return df.withColumn("domain", domain(url_col)).withColumn("origin", origin(url_col))
