"""Bytes to text in any charset: declared ones with bad bytes replaced, undeclared ones by the statistics of the body."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Charsets tried for a body without a declared one that is not UTF-8; of equal scores the first counts.
CANDIDATES = ("windows-1252", "windows-1251", "koi8-r", "windows-1253", "gb18030", "big5", "shift_jis", "euc-jp", "euc-kr")
MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"),
         (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
# Bytes that the statistics look at; the body is always decoded whole.
SAMPLE = 1 << 16


def _weight(before: str, c: str, after: str) -> float:
    """How well a character above ASCII fits in running text."""
    n = ord(c)
    beside = [x for x in (before, after) if x.isalpha()]
    if n < 0xA0 or 0xE000 <= n < 0xF900 or n == 0xFFFD:
        return -2.0
    if 0x00C0 <= n < 0x0250 and c.isalpha():  # accented Latin letters stand among plain ones
        return 1.0 if any(x.isascii() for x in beside) and not (c.isupper() and before.islower()) else -0.2
    if 0x0370 <= n < 0x0530 and c.isalpha():  # Greek and Cyrillic words: a capital at most in front
        same = [x for x in beside if 0x0370 <= ord(x) < 0x0530]
        return (1.0 if same else 0.0) - (0.7 if c.isupper() and before.islower() or any(x.isascii() for x in beside) else 0.0)
    if 0x3040 <= n < 0x3100:  # kana
        return 1.2
    if 0xAC00 <= n < 0xD7A4:  # Hangul
        return 1.0
    if 0x4E00 <= n < 0xA000:  # ideographs
        return 0.75
    if 0x3000 <= n < 0x3040 or 0xFF00 <= n < 0xFF60:  # their punctuation
        return 0.8
    if 0x2010 <= n < 0x2040 or n in (0x20AC, 0x2122) or n < 0xC0:  # quotes, dashes, signs
        return 0.4
    return -0.5


# Lead bytes of the most frequent ideographs in the sets ordered by frequency.
FREQUENT = {"gb18030": (0xB0, 0xD7), "big5": (0xA4, 0xC6), "euc-kr": (0xB0, 0xC8), "euc-jp": (0xB0, 0xCF)}
JAPANESE = ("shift_jis", "euc-jp")


def _score(body: bytes, charset: str) -> float:
    try:
        text = body.decode(charset)
    except UnicodeDecodeError as e:
        if e.start < len(body) - 4 or len(body) < SAMPLE:
            return float("-inf")
        text = body[:e.start].decode(charset)
    total, seen = 0.0, 0
    padded = f" {text} "
    for at, c in enumerate(text, 1):
        if not c.isascii():
            kana = 0x3040 <= ord(c) < 0x3100 and charset not in JAPANESE
            total += 0.2 if kana else _weight(padded[at - 1], c, padded[at + 1])
            seen += 1
    if charset in FREQUENT and seen:
        low, high = FREQUENT[charset]
        leads = [r[0] for r in (c.encode(charset, "ignore") for c in text if "一" <= c <= "鿿" or "가" <= c <= "힣") if r]
        total += 0.5 * sum(low <= b <= high for b in leads) - 0.5 * sum(not low <= b <= high for b in leads)
    return total / seen if seen else 0.0


def sniff(body: bytes) -> str:
    """The charset of a body without a declaration: byte-order mark, UTF-8 if valid, the zero bytes of UTF-16, else the
    candidate whose characters fit best."""
    for mark, charset in MARKS:
        if body.startswith(mark):
            return charset
    try:
        body.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        pass
    part = body[:SAMPLE]
    for charset, zeros in (("utf-16-le", part[1::2]), ("utf-16-be", part[::2])):
        if len(part) > 3 and zeros.count(0) > 0.4 * len(zeros):
            return charset
    best = max(CANDIDATES, key=lambda c: (_score(part, c), -CANDIDATES.index(c)))
    return best if _score(part, best) > 0 else "iso-8859-1"


def decode(body: bytes, declared: str | None) -> str:
    """Text of a body; bad bytes become U+FFFD.  A declared charset that does not exist reads as UTF-8."""
    charset = declared if declared is not None else sniff(body)
    try:
        return body.decode(charset, "replace")
    except (LookupError, ValueError):
        return body.decode("utf-8", "replace")


def decode_column(body: Column, declared: Column) -> Column:
    """:func:`decode` in Arrow batches; null bodies stay null, and cost nothing."""
    @F.pandas_udf("string")
    def decoded(bodies: pd.Series, charsets: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else decode(bytes(b), c) for b, c in zip(bodies, charsets, strict=True)], dtype=object)

    return decoded(body, declared)
