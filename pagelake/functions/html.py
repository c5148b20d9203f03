"""HTML → text expressions (Catalyst only, no UDF).

Regex-based, not a tree parser: comments, scripts and styles are removed as one
alternation so that whichever opener comes first wins; tags become a space;
character references are decoded after the tags are gone, in one pass; whitespace is
collapsed with the same character set Python's ``str.isspace`` uses.
Nested tables and CSS-selector nesting are approximated (see README).
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts, as one regex
# class valid both in Java regex and in RE2.
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# All named character references of HTML5, from the standard library; some also stand without a semicolon.
NAMED_REFERENCES = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
BARE_REFERENCES = sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n))
# All names, those that pages mostly use first, as a look-up walks the list.
ALL_REFERENCES = list(dict.fromkeys(["apos", *BARE_REFERENCES, *NAMED_REFERENCES]))
# Numeric references 128 to 159 mean the windows-1252 character, where there is one.
_WINDOWS = [bytes([n]).decode("windows-1252", "ignore") or chr(n) for n in range(128, 160)]
REPLACEMENT = "\ufffd"

from pagelake.functions.patterns import BODY_OPEN_RE, BODY_RE, HEAD_RE, JUNK_RE, TAG_RE, TITLE_RE  # noqa: E402


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a lambda binding), so
    that an expensive input used several times is neither recomputed per use
    nor copied into the expression tree."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unnest(df: DataFrame, keep, array, index: str, value: str) -> DataFrame:
    """``posexplode`` that evaluates an expensive array once.  The plain generator gets a filter on the array's size below
    it, which copies the expression; the outer one does not, and its rows for empty arrays are dropped here."""
    return df.select(*keep, F.posexplode_outer(array).alias(index, value)).where(F.col(index).isNotNull())


# The same set as characters (29 of them), built by the rule that defines it.
WS_CHARS = "".join(chr(cp) for cp in range(0x3001) if chr(cp).isspace())


def strip_ws(c) -> Column:
    """Python ``str.strip()``: trim Unicode whitespace at both ends (a plain
    character-set trim; ~10x faster than an anchored regex on long texts)."""
    return F.trim(_col(c), F.lit(WS_CHARS))


def collapse_ws(c) -> Column:
    """Python ``" ".join(s.split())``."""
    return strip_ws(F.regexp_replace(_col(c), rf"{WS}+", " "))


def _code_point(num: Column) -> Column:
    """The character of a numeric reference; U+FFFD for zero, surrogates and numbers beyond Unicode."""
    bad = (num <= 0) | (num > 0x10FFFF) | ((num >= 0xD800) & (num <= 0xDFFF))
    plain = F.decode(F.unhex(F.lpad(F.hex(F.when(bad, 0xFFFD).otherwise(num)), 8, "0")), "UTF-32")
    windows = F.array(*[F.lit(c) for c in _WINDOWS])
    return F.when((num >= 128) & (num <= 159), F.get(windows, (num - 128).cast("int"))).otherwise(plain)


def _number(digits: Column, base: int, longest: int) -> Column:
    short = F.regexp_replace(digits, "^0+", "")
    value = F.when((short == "") | (F.length(short) > longest), F.lit("0")).otherwise(short)
    return (value if base == 10 else F.conv(value, base, 10)).cast("bigint")


def _lookup(names, key: Column) -> Column:
    """The text of a named reference, null if ``names`` has none.  Both lists are literals after constant folding."""
    def listed(items):
        return F.split(F.lit("\x01".join(items)), "\x01")

    at = F.array_position(listed(names), key).cast("int")
    return F.get(listed(NAMED_REFERENCES[n] for n in names), at - 1)


def decode_entities(c) -> Column:
    """Decode all character references in one pass (so ``&amp;lt;`` gives ``&lt;``)."""
    def piece(p, i):
        decimal = F.regexp_extract(p, "^#([0-9]+);?", 1)
        hexadecimal = F.regexp_extract(p, "^#[xX]([0-9a-fA-F]+);?", 1)
        name = F.regexp_extract(p, "^([A-Za-z][A-Za-z0-9]*);", 1)
        bare = F.regexp_extract(p, "^(" + "|".join(BARE_REFERENCES) + ")", 1)
        named = F.when(name != "", _lookup(ALL_REFERENCES, name))
        after = lambda used: F.substring(p, used + 1, F.length(p))
        return (
            F.when(i == 0, p)
            .when(decimal != "", F.concat(_code_point(_number(decimal, 10, 7)), F.regexp_replace(p, "^#[0-9]+;?", "")))
            .when(hexadecimal != "", F.concat(_code_point(_number(hexadecimal, 16, 6)),
                                              F.regexp_replace(p, "^#[xX][0-9a-fA-F]+;?", "")))
            .when(named.isNotNull(), F.concat(named, after(F.length(name) + 1)))
            .when(bare != "", F.concat(_lookup(BARE_REFERENCES, bare), after(F.length(bare))))
            .otherwise(F.concat(F.lit("&"), p)))

    def body(x):
        return F.when(x.contains("&"), F.array_join(F.transform(F.split(x, "&"), piece), "")).otherwise(x)

    return let(_col(c), body)


def strip_junk(html) -> Column:
    """Remove comments, scripts and styles (content included)."""
    return F.regexp_replace(_col(html), JUNK_RE, " ")


def html_text(html) -> Column:
    """Visible text of the body (whole document minus head without a body)."""
    def body_of(clean):
        return (F.when(clean.rlike(BODY_OPEN_RE), F.regexp_extract(clean, BODY_RE, 1))
                .otherwise(F.regexp_replace(clean, HEAD_RE, " ")))

    body = let(strip_junk(html), body_of)
    return collapse_ws(decode_entities(F.regexp_replace(body, TAG_RE, " ")))


def html_title(html) -> Column:
    """First <title> text, entity-decoded and stripped; '' when missing."""
    raw = F.regexp_extract(strip_junk(html), TITLE_RE, 1)
    return strip_ws(decode_entities(raw))


def content_hash(text) -> Column:
    """SHA-256 hex of the UTF-8 extracted text."""
    return F.sha2(_col(text), 256)


def node_text_stripped(fragment) -> Column:
    """BeautifulSoup ``get_text(strip=True)`` of an HTML fragment: every text
    node decoded and stripped, empty ones dropped, joined without separator.

    Text nodes are cut at tags, re-joined with NUL (which markup text cannot
    carry), entity-decoded in one pass and cut again."""
    nodes = F.array_join(F.split(_col(fragment), TAG_RE), "\u0000")
    pieces = F.split(decode_entities(nodes), "\u0000")
    return F.array_join(F.filter(F.transform(pieces, strip_ws), lambda p: p != ""), "")
