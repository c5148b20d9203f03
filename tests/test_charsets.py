"""Decoding of page bodies: declared charsets, bad bytes, and sniffing."""

import pytest
from pyspark.sql import functions as F

from pagelake.functions import charsets
from pagelake.functions.text import decode_body

RUSSIAN = "Сегодня утром в городе шёл дождь, и улицы были почти пустыми."
CHINESE = "今天早上城里下雨,街道几乎是空的。人们在家里喝茶看书。"
TRADITIONAL = "今天早上城裡下雨,街道幾乎是空的。人們在家裡喝茶看書。"
JAPANESE = "けさ町では雨がふっていて、通りにはほとんど人がいませんでした。"
KOREAN = "오늘 아침 도시에 비가 내려서 거리가 거의 비어 있었다."
GREEK = "Σήμερα το πρωί έβρεχε στην πόλη και οι δρόμοι ήταν άδειοι."
FRENCH = "L’été dernier, le café « à côté » était fermé – déjà."


@pytest.mark.parametrize("text, charset", [
    (RUSSIAN, "windows-1251"), (RUSSIAN, "koi8-r"), (CHINESE, "gbk"), (TRADITIONAL, "big5"), (JAPANESE, "shift_jis"), (JAPANESE, "euc-jp"),
    (KOREAN, "euc-kr"), (GREEK, "windows-1253"), (FRENCH, "windows-1252"), ("Une façon très élégante", "iso-8859-1"),
    (FRENCH, "utf-8"), (FRENCH, "utf-8-sig"), (RUSSIAN, "utf-16"), (FRENCH, "utf-16-le"), (FRENCH, "utf-16-be"), (RUSSIAN, "utf-32"), ("plain", "ascii"),
])
def test_sniffing(text, charset):
    html = f"<html><body><p>{text}</p></body></html>"
    assert charsets.decode(html.encode(charset), None) == html


def test_a_cut_in_the_sample_changes_nothing():
    text = CHINESE * 2000
    assert len(text.encode("gbk")) > charsets.SAMPLE and charsets.decode(text.encode("gbk"), None) == text


def test_column(spark):
    rows = [
        (CHINESE.encode("gbk"), "text/html; charset=gbk", CHINESE),
        (FRENCH.encode("windows-1252"), "text/html; charset=\"Windows-1252\"", FRENCH),
        ("café".encode("latin-1"), "text/html; charset=us-ascii", "caf�"),
        (b"a\x00b", "text/html; charset=utf-16-le", "a�"),
        (b"\x00a\x00", "text/html;charset=utf-16be", "a�"),
        (b"\xff\xfeA\x00\x00\xd8", "text/html; charset=utf-16", "A�"),
        ("naïve".encode(), "text/html; charset=no-such-set", "naïve"),
        ("naïve".encode(), "text/html; charset=", "naïve"),
        (b"ok \xff", "text/html; CHARSET=UTF-8", "ok �"),
        ("Â£".encode(), "text/html; charset=iso-8859-1", "Ã\x82Â£"),
        ("£5".encode(), "text/html", "£5"),
        ("£5".encode(), None, "£5"),
        (RUSSIAN.encode("koi8-r"), None, RUSSIAN),
        (b"\xef\xbb\xbfmarked", None, "marked"),
        (b"", None, ""),
        (None, "text/html", None),
    ]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None, c) for i, (b, c, _) in enumerate(rows)],
                               "i int, b binary, c string")
    got = df.select("i", decode_body("b", "c").alias("t")).orderBy("i").collect()
    assert [r["t"] for r in got] == [t for _, _, t in rows]
    assert df.select(decode_body("b", F.lit("x/y; charset=koi8-r")).alias("t")).where("t = ''").count() == 1
