"""URL expressions: split, resolve relative links, domain keys, slug titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake.functions.html import let

# RFC 3986 appendix B splitter; the scheme must look like a scheme, as in
# Python's urlsplit.
URL_RE = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def url_part(url, part: str) -> Column:
    """One component of a URL: scheme (lower-cased), netloc, path, query,
    fragment.  Missing parts are ''; ``has_netloc``/``has_query`` tell a missing
    part from an empty one."""
    u = _col(url)
    idx = {"scheme": 1, "netloc": 2, "path": 3, "query": 4, "fragment": 5}[part]
    v = F.regexp_extract(u, URL_RE, idx)
    return F.lower(v) if part == "scheme" else v


def _has(url, marker_re: str) -> Column:
    return _col(url).rlike(marker_re)


def domain(url) -> Column:
    """Host with port (Python ``urlparse(url).netloc``)."""
    return url_part(url, "netloc")


def origin(url) -> Column:
    """Scheme://netloc."""
    return F.concat(url_part(url, "scheme"), F.lit("://"), url_part(url, "netloc"))


def _remove_dot_segments(segments: Column) -> Column:
    """``segments`` must be a bound (lambda) variable: it is read twice."""
    resolved = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1))
                                .otherwise(acc))
        .when(seg == ".", acc)
        .otherwise(F.concat(acc, F.array(seg))),
    )
    last = F.element_at(segments, -1)
    resolved = F.when(last.isin(".", ".."), F.concat(resolved, F.array(F.lit("")))).otherwise(resolved)
    return let(F.array_join(resolved, "/"), lambda j: F.when(j == "", F.lit("/")).otherwise(j))


_SCHEME_PREFIX = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def _parts(u: Column) -> Column:
    """All pieces of a URL in one struct (each regex evaluated once)."""
    return F.struct(
        url_part(u, "scheme").alias("scheme"), url_part(u, "netloc").alias("net"),
        url_part(u, "path").alias("path"), url_part(u, "query").alias("query"),
        url_part(u, "fragment").alias("frag"), u.rlike(_SCHEME_PREFIX).alias("has_scheme"),
        F.regexp_replace(u, _SCHEME_PREFIX, "").startswith("//").alias("has_net"),
        F.regexp_replace(u, r"#.*$", "").contains("?").alias("has_query"), u.contains("#").alias("has_frag"))


def resolve_url(href, base) -> Column:
    """``urllib.parse.urljoin(base, href)`` for http(s)-style URLs."""
    pair = F.struct(_parts(_trimmed(_col(href))).alias("h"), _parts(_trimmed(_col(base))).alias("b"), _col(href).alias("href"),
                    _col(base).alias("base"))
    return let(pair, lambda s: _resolve(s["h"], s["b"], s["href"], s["base"]))


def _trimmed(u: Column) -> Column:
    """Without leading blanks and control characters, and without tabs and line breaks anywhere, as urlsplit reads it."""
    return F.regexp_replace(F.regexp_replace(u, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def unquote(text) -> Column:
    """Percent-decoding as UTF-8 (``urllib.parse.unquote``): a plus sign and a malformed escape stay."""
    escaped = F.regexp_replace(F.regexp_replace(_col(text), "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.try_url_decode(escaped)


def quote(text) -> Column:
    """Percent-encoding of all but letters, digits and ``_.-~/`` (``urllib.parse.quote``)."""
    out = F.url_encode(_col(text))
    for encoded, plain in ((r"\+", "%20"), (r"\*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.regexp_replace(out, encoded, plain)
    return out


def _resolve(h: Column, b: Column, hr: Column, br: Column) -> Column:
    scheme = F.when(h["has_scheme"], h["scheme"]).otherwise(b["scheme"])
    query_sfx = F.when(h["has_query"] & (h["query"] != ""), F.concat(F.lit("?"), h["query"])).otherwise(F.lit(""))
    frag_sfx = F.when(h["has_frag"] & (h["frag"] != ""), F.concat(F.lit("#"), h["frag"])).otherwise(F.lit(""))
    prefix = F.when(b["has_net"] | (b["net"] != ""), F.concat(scheme, F.lit("://"), b["net"])).otherwise(
        F.concat(scheme, F.lit(":")))

    base_parts = let(F.split(b["path"], "/"), lambda bp: F.when(F.element_at(bp, -1) != "",
                                                                 F.slice(bp, 1, F.size(bp) - 1)).otherwise(bp))
    rel = let(F.concat(base_parts, F.split(h["path"], "/")),
              lambda r: F.filter(r, lambda x, i: (i == 0) | (i == F.size(r) - 1) | (x != "")))
    segments = F.when(h["path"].startswith("/"), F.split(h["path"], "/")).otherwise(rel)
    merged_path = let(segments, _remove_dot_segments)
    merged_path = let(merged_path, lambda m: F.when(m.startswith("/"), m).otherwise(F.concat(F.lit("/"), m)))

    same_doc_query = F.when(h["has_query"] & (h["query"] != ""), F.concat(F.lit("?"), h["query"])).when(
        b["has_query"] & (b["query"] != ""), F.concat(F.lit("?"), b["query"])).otherwise(F.lit(""))
    return (
        F.when(hr.isNull() | br.isNull(), F.lit(None).cast("string"))
        .when(br == "", hr)
        .when(hr == "", br)
        .when(h["has_scheme"] & (h["scheme"] != b["scheme"]), hr)
        .when(h["net"] != "", F.concat(scheme, F.lit("://"), h["net"], h["path"], query_sfx, frag_sfx))
        .when(h["path"] == "", F.concat(prefix, b["path"], same_doc_query, frag_sfx))
        .otherwise(F.concat(prefix, merged_path, query_sfx, frag_sfx))
    )


def title_from_url(url) -> Column:
    """Readable title from the last URL slug; each word's first letter
    upper-cased, the rest kept as is."""
    u = _col(url)
    trimmed = F.regexp_replace(u, r"/index\.html?$", "")
    segs = F.filter(F.split(trimmed, "/"), lambda x: x != "")
    slug = F.coalesce(F.try_element_at(segs, F.lit(-1)), u)
    words = F.filter(F.split(F.regexp_replace(slug, r"_[0-9]+$", ""), "[-_]"), lambda x: x != "")
    titled = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)),
                                                                F.substring(w, 2, 1 << 30))), " ")
    return F.when(F.size(words) == 0, u).otherwise(titled)
