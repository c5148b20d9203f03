"""Text expressions: chunk windows, table serialization, snippets, citation
markers, highlighting, charset repair and prefix comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake.functions.charsets import decode_column
from pagelake.functions.html import WS, let, strip_ws

# Chunk size and overlap of the overlap chunker (characters).
CHUNK_SIZE = 500
CHUNK_OVERLAP = 75

# Snippet context on each side of a keyword hit (characters).
SNIPPET_CONTEXT = 80

# Citation marker patterns, e.g. "[1]" and "[1, 3]".
CITATION_BRACKET_RE = r"\[\s*\d+(?:\s*,\s*\d+)*\s*\]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def chunk_windows(text, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of overlap chunks of ``text``.

    The text is stripped; windows of ``size`` characters start every
    ``size - overlap`` characters until one reaches the end; every piece is
    stripped and empty pieces are dropped.  Empty text gives an empty array.
    ``size <= overlap`` is rejected, but only for non-empty text (as the
    reference does), so it raises at run time on the first such row.
    """
    if size <= overlap:
        return let(strip_ws(_col(text)), lambda t: F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(
            F.raise_error(F.lit("chunk_size must be greater than overlap")).cast("array<string>")))
    stride = size - overlap

    def windows(t):
        n = F.length(t)
        last = F.greatest(F.lit(0), F.ceil((n - F.lit(size)) / F.lit(stride)).cast("int"))
        # One pass over the text (a substring would count characters from its start for every window).
        cut = F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{stride}}}"), 1)
        pieces = F.transform(F.slice(cut, F.lit(1), last + 1), strip_ws)
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.filter(pieces, lambda p: p != ""))

    return let(strip_ws(_col(text)), windows)


def serialize_table(entries) -> Column:
    """P5: ordered ``array<struct<key,value>>`` (or a map) → "Key: Value" lines."""
    e = _col(entries)
    return F.array_join(F.transform(e, lambda x: F.concat(x["key"], F.lit(": "), x["value"])), "\n")


def snippet(text, q, context: int = SNIPPET_CONTEXT) -> Column:
    """First case-insensitive literal hit of ``q`` with ``context`` chars on
    each side and '...' on cut sides; no literal hit → first 2*context chars."""
    q = F.lit(q) if isinstance(q, str) else q

    def body(s):
        t, qq = s["t"], s["q"]
        pos = F.call_function("instr", F.lower(t), F.lower(qq))
        idx = pos - 1
        start = F.greatest(F.lit(0), idx - context)
        end = F.least(F.length(t), idx + F.length(qq) + context)
        mid = F.substring(t, start + 1, end - start)
        hit = F.concat(F.when(start > 0, F.lit("...")).otherwise(F.lit("")), mid,
                       F.when(end < F.length(t), F.lit("...")).otherwise(F.lit("")))
        return F.when(pos == 0, F.substring(t, 1, 2 * context)).otherwise(hit)

    return let(F.struct(_col(text).alias("t"), q.alias("q")), body)


def citation_numbers(answer) -> Column:
    """Every citation number in an answer, in order of appearance, as
    ``array<bigint>`` ("[1, 3]" yields 1 and 3)."""
    brackets = F.regexp_extract_all(_col(answer), F.lit(f"({CITATION_BRACKET_RE})"), 1)
    nums = F.flatten(F.transform(brackets, lambda b: F.regexp_extract_all(b, F.lit(r"(\d+)"), 1)))
    return F.transform(nums, lambda s: s.cast("bigint"))


def java_regex_literal(q: str) -> str:
    """Escape a literal for Java regex (ASCII punctuation only)."""
    return "".join("\\" + ch if (ord(ch) < 128 and not ch.isalnum() and ch != " ") else ch for ch in q)


def _js_trim(s: str) -> str:
    return s.strip().strip("﻿").strip()


def highlight(text, q) -> Column:
    """Wrap case-insensitive literal matches of ``q`` (trimmed) in
    ``<mark>…</mark>``; a blank query leaves the text unchanged.

    ``q`` is a Python string or a string Column.
    """
    t = _col(text)
    if isinstance(q, str):
        trimmed = _js_trim(q)
        if not trimmed:
            return t
        return F.regexp_replace(t, F.lit("(?iu)" + java_regex_literal(trimmed)), F.lit("<mark>$0</mark>"))
    qt = F.regexp_replace(q, rf"^[{WS[1:-1]}\x{{feff}}]+|[{WS[1:-1]}\x{{feff}}]+$", "")
    quoted = F.concat(F.lit("\\Q"), F.replace(qt, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.when(qt == "", t).otherwise(
        F.regexp_replace(t, F.concat(F.lit("(?iu)"), quoted), F.lit("<mark>$0</mark>")))


def decode_body(body, content_type) -> Column:
    """Bytes → text.  A declared charset wins, whichever Python knows, and bad bytes become U+FFFD.  With none declared
    the body tells: a byte-order mark, valid UTF-8, or the charset whose characters fit best (:mod:`.charsets`).

    Valid UTF-8 without a mark, declared as such or not at all, is a cast; only other bodies go through Python."""
    b, ct = _col(body), F.coalesce(_col(content_type), F.lit(""))
    has_cs = F.lower(ct).contains("charset")
    declared = F.lower(F.regexp_extract(ct, r"(?i)charset\s*=\s*[\"']?([A-Za-z0-9._:\-]+)", 1))
    declared = F.when(has_cs, F.when(declared == "", "utf-8").otherwise(declared))
    text = b.cast("string")
    marked = F.hex(F.substring(b, 1, 3)).rlike("^(EFBBBF|FFFE|FEFF)")
    plain = F.is_valid_utf8(text) & F.when(has_cs, declared.isin("utf-8", "utf8")).otherwise(~marked & ~F.contains(b, F.lit(b"\x00")))
    return F.when(plain, text).otherwise(decode_column(F.when(~plain, b), declared))


def repair_mojibake(text) -> Column:
    """Undo UTF-8 bytes that were decoded as Latin-1 ("Â£" → "£").

    Applied only when every char is ≤ U+00FF, at least one is ≥ U+0080 and
    the Latin-1 bytes form valid UTF-8; other text is returned unchanged."""
    t = _col(text)
    latin1_only = ~t.rlike(r"[^\x{00}-\x{ff}]")
    has_high = t.rlike(r"[\x{80}-\x{ff}]")
    raw = F.encode(F.when(latin1_only, t).otherwise(F.lit("")), "ISO-8859-1")
    valid = F.is_valid_utf8(raw.cast("string"))
    return F.when(latin1_only & has_high & valid, F.decode(raw, "UTF-8")).otherwise(t)


def common_prefix_len(a, b) -> Column:
    """V8: length of the common prefix of two strings (code points)."""
    a, b = _col(a), _col(b)
    n = F.least(F.length(a), F.length(b))
    eq = F.zip_with(F.split(F.substring(a, 1, n), ""), F.split(F.substring(b, 1, n), ""),
                    lambda x, y: x == y)
    first_diff = F.array_position(eq, F.lit(False))
    return F.when(n == 0, F.lit(0)).when(first_diff == 0, n).otherwise(first_diff - 1).cast("bigint")
