"""DuckDB SQL fragments used by the oracle statements.

They state the rules for the well-formed markup of the test tables with patterns of their
own, in DuckDB's dialect; malformed markup is covered by hand-written expectations in tests/.  Each takes a *column reference*; callers
compose them through subqueries so that expressions are not duplicated.
"""

from __future__ import annotations

from pagelake.functions.html import WS

# The oracle's own patterns, for the well-formed markup of the test tables only (RE2).
# Page-level structure.
JUNK_RE = (r"(?is)<!--.*?(?:-->|\z)"
           r"|<script\b[^>]*>.*?(?:</script\s*>|\z)"
           r"|<style\b[^>]*>.*?(?:</style\s*>|\z)")
TAG_RE = r"<[A-Za-z/!?][^>]*>"
BODY_OPEN_RE = r"(?i)<body\b"
BODY_RE = r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)"
HEAD_RE = r"(?is)<head\b[^>]*>.*?(?:</head\s*>|\z)"
TITLE_RE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"

# Tables, next link and product links.
TABLE_RE = r"(?is)<table\b[^>]*>(.*?)</table\s*>"
TR_SPLIT_RE = r"(?i)<tr\b[^>]*>"
TH_RE = r"(?is)<th\b[^>]*>(.*?)</th\s*>"
TD_RE = r"(?is)<td\b[^>]*>(.*?)</td\s*>"
NEXT_LI_RE = (r"(?is)<li\b[^>]*\bclass\s*=\s*[\"'](?:[^\"']*\s)?next(?:\s[^\"']*)?[\"'][^>]*>(.*?)</li\s*>")
A_HREF_RE = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"
ARTICLE_RE = (r"(?is)<article\b[^>]*\bclass\s*=\s*[\"'](?:[^\"']*\s)?product_pod(?:\s[^\"']*)?[\"'][^>]*>"
              r"(.*?)</article\s*>")
H3_RE = r"(?is)<h3\b[^>]*>(.*?)</h3\s*>"

# The named references that occur in the test tables.
NAMED_ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": "\u00a0",
    "&copy;": "©", "&reg;": "®", "&trade;": "™", "&middot;": "·",
    "&pound;": "£", "&euro;": "€", "&yen;": "¥", "&cent;": "¢",
    "&sect;": "§", "&para;": "¶", "&deg;": "°", "&times;": "×",
    "&divide;": "÷", "&hellip;": "…", "&mdash;": "—", "&ndash;": "–",
    "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”",
    "&laquo;": "«", "&raquo;": "»", "&bull;": "•",
}


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"regexp_replace({c}, {lit(f'^{WS}+|{WS}+$')}, '', 'g')"


def collapse(c: str) -> str:
    return strip(f"regexp_replace({c}, {lit(WS + '+')}, ' ', 'g')")


def decode_entities(c: str) -> str:
    out = c
    for ent, ch in NAMED_ENTITIES.items():
        out = f"replace({out}, {lit(ent)}, {lit(ch)})"
    numeric = (
        f"array_to_string(list_transform(string_split({out}, '&#'), lambda p, i: CASE WHEN i = 1 THEN p "
        "WHEN regexp_matches(p, '^[0-9]{1,7};') THEN chr(CAST(regexp_extract(p, '^([0-9]{1,7});', 1) AS INTEGER))"
        " || regexp_replace(p, '^[0-9]{1,7};', '') "
        "WHEN regexp_matches(p, '^[xX][0-9a-fA-F]{1,6};') THEN "
        "chr(CAST(('0x' || regexp_extract(p, '^[xX]([0-9a-fA-F]{1,6});', 1)) AS INTEGER))"
        " || regexp_replace(p, '^[xX][0-9a-fA-F]{1,6};', '') ELSE '&#' || p END), '')")
    return f"replace(CASE WHEN strpos({out}, '&#') > 0 THEN {numeric} ELSE {out} END, '&amp;', '&')"


def strip_junk(c: str) -> str:
    return f"regexp_replace({c}, {lit(JUNK_RE)}, ' ', 'g')"


def body_of(clean: str) -> str:
    return (f"CASE WHEN regexp_matches({clean}, {lit(BODY_OPEN_RE)}) THEN regexp_extract({clean}, {lit(BODY_RE)}, 1) "
            f"ELSE regexp_replace({clean}, {lit(HEAD_RE)}, ' ', 'g') END")


def untag(c: str) -> str:
    return f"regexp_replace({c}, {lit(TAG_RE)}, ' ', 'g')"


def title_raw(clean: str) -> str:
    return f"regexp_extract({clean}, {lit(TITLE_RE)}, 1)"


def node_text(c: str) -> str:
    """get_text(strip=True) of a fragment column."""
    return (f"array_to_string(list_filter(list_transform(string_split_regex({c}, '<[^>]*>'), "
            f"lambda p: {strip(decode_entities('p'))}), lambda p: p <> ''), '')")


__all__ = ["lit", "strip", "collapse", "decode_entities", "strip_junk", "body_of", "untag", "title_raw",
           "node_text", "A_HREF_RE", "ARTICLE_RE", "H3_RE", "NEXT_LI_RE", "TABLE_RE", "TD_RE", "TH_RE",
           "TR_SPLIT_RE"]


URL_RE = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
SCHEME_PREFIX_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def url_part(c: str, part: str) -> str:
    idx = {"scheme": 1, "netloc": 2, "path": 3, "query": 4, "fragment": 5}[part]
    e = f"regexp_extract({c}, {lit(URL_RE)}, {idx})"
    return f"lower({e})" if part == "scheme" else e


def resolve_url(h: str, b: str) -> str:
    """urljoin(b, h) for two column references."""
    hs, hn, hp, hq, hf = (url_part(h, p) for p in ("scheme", "netloc", "path", "query", "fragment"))
    bs, bn, bp, bq = (url_part(b, p) for p in ("scheme", "netloc", "path", "query"))
    h_has_scheme = f"regexp_matches({h}, {lit(SCHEME_PREFIX_RE)})"
    h_has_net = f"starts_with(regexp_replace({h}, {lit(SCHEME_PREFIX_RE)}, ''), '//')"
    b_has_net = f"starts_with(regexp_replace({b}, {lit(SCHEME_PREFIX_RE)}, ''), '//')"
    h_has_query = f"strpos(regexp_replace({h}, '#.*$', ''), '?') > 0"
    b_has_query = f"strpos(regexp_replace({b}, '#.*$', ''), '?') > 0"
    h_has_frag = f"strpos({h}, '#') > 0"
    scheme = f"(CASE WHEN {h_has_scheme} THEN {hs} ELSE {bs} END)"
    qsfx = f"(CASE WHEN {h_has_query} AND {hq} <> '' THEN '?' || {hq} ELSE '' END)"
    fsfx = f"(CASE WHEN {h_has_frag} AND {hf} <> '' THEN '#' || {hf} ELSE '' END)"
    prefix = f"(CASE WHEN {b_has_net} OR {bn} <> '' THEN {scheme} || '://' || {bn} ELSE {scheme} || ':' END)"
    base_parts = (f"(CASE WHEN string_split({bp}, '/')[-1] <> '' THEN string_split({bp}, '/')[1:-2] "
                  f"ELSE string_split({bp}, '/') END)")
    rel_raw = f"list_concat({base_parts}, string_split({hp}, '/'))"
    rel = f"list_filter({rel_raw}, lambda x, i: i = 1 OR i = len({rel_raw}) OR x <> '')"
    segs = f"(CASE WHEN starts_with({hp}, '/') THEN string_split({hp}, '/') ELSE {rel} END)"
    reduced = (f"list_reduce({segs}, lambda acc, seg: CASE WHEN seg = '..' THEN acc[1:len(acc) - 1] "
               f"WHEN seg = '.' THEN acc ELSE list_append(acc, seg) END, []::VARCHAR[])")
    with_tail = f"(CASE WHEN {segs}[-1] IN ('.', '..') THEN list_append({reduced}, '') ELSE {reduced} END)"
    joined = f"array_to_string({with_tail}, '/')"
    path = f"(CASE WHEN {joined} = '' THEN '/' ELSE {joined} END)"
    path = f"(CASE WHEN starts_with({path}, '/') THEN {path} ELSE '/' || {path} END)"
    same_q = (f"(CASE WHEN {h_has_query} AND {hq} <> '' THEN '?' || {hq} "
              f"WHEN {b_has_query} AND {bq} <> '' THEN '?' || {bq} ELSE '' END)")
    return (f"(CASE WHEN {h} IS NULL OR {b} IS NULL THEN NULL WHEN {b} = '' THEN {h} WHEN {h} = '' THEN {b} "
            f"WHEN {h_has_scheme} AND {hs} <> {bs} THEN {h} "
            f"WHEN {h_has_net} THEN {scheme} || '://' || {hn} || {hp} || {qsfx} || {fsfx} "
            f"WHEN {hp} = '' THEN {prefix} || {bp} || {same_q} || {fsfx} "
            f"ELSE {prefix} || {path} || {qsfx} || {fsfx} END)")
