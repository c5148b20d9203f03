"""Extraction on small pages with hand-written expectations."""

import pytest
from pyspark.sql import functions as F

from pagelake.functions.html import html_text, html_title
from pagelake.operators import extract as X

BASE = "https://shop.test/list/p1.html"


def one(spark, col, html):
    return spark.createDataFrame([(html,)], "html string").select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("html, text", [
    ("<html><head><title>T</title><style>i{}</style></head><body><script>alert(1)</script><h2>Big</h2><p>small print", "Big small print"),
    ("<p>no body<!-- hidden --> here</p>", "no body here"),
    ("<body>caf&eacute; &rarr; &copy 2024 &#233; &#xE9;</body>", "café → © 2024 é é"),
    ("<body>&amp;lt; &amp;amp; &unknown; R&D</body>", "&lt; &amp; &unknown; R&D"),
    ("<body>&#1114112; &#9999999; &#xD800; &#0;</body>", "� � � �"),
    ("<body>&#0000000065;&#x00000000042; &#150;</body>", "AB –"),
    ('<body><p title="a>b">x</p><p title=it\'s>y</p><img alt=\'1 > 0\'>z</body>', "x y z"),
])
def test_visible_text(spark, html, text):
    assert one(spark, html_text("html"), html) == text


def test_title(spark):
    assert one(spark, html_title("html"), "<title lang=en> Tea &amp; cake </title>") == "Tea & cake"
    assert one(spark, html_title("html"), "<p>untitled</p>") == ""


def tables_of(spark, html):
    df = X.extract_tables(spark.createDataFrame([(1, html)], "page_id long, raw_html string"))
    return [[(e["key"], e["value"]) for e in t] for t in df.first()["tables"]]


@pytest.mark.parametrize("html, tables", [
    ("<p>nothing</p>", []),
    ("<table><tr><th>Weight</th><td>&frac12; kg</td></tr><tr><th>Colour</th><td><b>dark</b> red</td></tr></table>",
     [[("Weight", "½ kg"), ("Colour", "darkred")]]),
    ("<table><tr><th>k<td>v<tr><th>l<td>w</table>", [[("k", "v"), ("l", "w")]]),
    ("<table><tr><th>k</th><td>v</td></tr>", [[("k", "v")]]),
    ("<table><tr><th>k</th><td>old</td></tr><tr><th>m</th><td>1</td></tr><tr><th>k</th><td>new</td></tr><tr><td>loose</td></tr></table>",
     [[("k", "new"), ("m", "1")]]),
    # a table in a cell: it counts by itself, its rows and text also for the outer one, whose later rows stay
    ("<table><tr><th>o1</th><td>1</td></tr><tr><th>o2</th><td>two <table><tr><th>i</th><td>3</td></tr></table> end</td></tr>"
     "<TR><TH>o3</TH><TD>4</TD></TR></table><table><tr><th>z</th><td>9</td></tr></table>",
     [[("o1", "1"), ("o2", "twoi3end"), ("i", "3"), ("o3", "4")], [("i", "3")], [("z", "9")]]),
    # the first cell of a row may lie in a table inside it (k: kvlw, until the inner row sets it); unclosed cells end at their own depth
    ("<table class=a><tr><td><table><tr><th>k<td>v<tr><th>l<td>w</table><tr><th>m<td>x</table>",
     [[("k", "v"), ("l", "w"), ("m", "x")], [("k", "v"), ("l", "w")]]),
    ("<table><tr><th>a</th><td><table><tr><td><table><tr><th>deep</th><td>d</td></tr></table></td></tr></table></td></tr><tr><th>b</th><td>2</td></tr>",
     [[("a", "deepd"), ("deep", "d"), ("b", "2")], [("deep", "d")], [("deep", "d")]]),
    ("</table><table><tr><th>k</th><td>v<table></table></td></tr></table></table><table-x><tr><th>no</th><td>no</td></tr></table-x>", [[("k", "v")]]),
])
def test_tables(spark, html, tables):
    assert tables_of(spark, html) == tables


@pytest.mark.parametrize("item, target", [
    ('<li class="next"><a href="p2.html">more</a></li>', "https://shop.test/list/p2.html"),
    ("<li class=next><a class=x href=p2.html>more</a></li>", "https://shop.test/list/p2.html"),
    ("<li class='big next'><a href='/z'>more</a></li>", "https://shop.test/z"),
    ('<li class="nextish"><a href="p2.html">more</a></li>', None),
    ("<li><a href='p2.html'>more</a></li>", None),
])
def test_next_link(spark, item, target):
    df = spark.createDataFrame([(f"<ul>{item}</ul>", BASE)], "html string, url string")
    assert df.select(X.next_link(F.col("html"), F.col("url")).alias("n")).first()["n"] == target


def test_links_in_and_out_of_products(spark):
    html = ("<a href=about>a</a><article class='product_pod new'><h3><a title=\"1>0\" href=\"it's.html\">n</a></h3></article>"
            "<article class=product_pod><h3><a href=' two.html '>n</a></h3></article><article><h3><a href=no>n</a></h3></article>")
    df = spark.createDataFrame([(1, BASE, html)], "page_id long, url string, html string")
    urls = lambda scope: [r["link_url"].removeprefix("https://shop.test/list/") for r in
                          X.extract_links(df, scope=scope).orderBy("link_idx").collect()]
    assert urls("product_pod") == ["it's.html", "two.html"]
    assert urls(None) == ["about", "it's.html", "two.html", "no"]


def test_pages_without_a_table_are_not_parsed(spark):
    assert tables_of(spark, "<ta<!-- x -->ble><tr><th>k</th><td>v</td></tr></table>") == []
    assert tables_of(spark, "<TABLE><tr><th>k</th><td>v</td></tr></TABLE>") == tables_of(
        spark, "<table><tr><th>k</th><td>v</td></tr></table>") != []
    plan = X.extract_tables(spark.createDataFrame([("x",)], "raw_html string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "(?i)<table" in plan
