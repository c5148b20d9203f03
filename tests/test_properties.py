"""Property tests (hypothesis): whole batches of generated inputs per Spark job."""

from urllib.parse import urljoin

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pagelake.functions.text import chunk_windows
from pagelake.functions.urls import resolve_url

TEXT = st.text(alphabet=st.sampled_from(list("ab é\n\t　.-")), max_size=1400)
SEG = st.sampled_from(["a", "b", ".", "..", "", "x_1", "c.html"])
PATH = st.lists(SEG, min_size=0, max_size=5).map("/".join)
HREF = st.tuples(st.sampled_from(["", "/", "//h.com/", "?q=1", "#f", "http://o.com/"]), PATH,
                 st.sampled_from(["", "?x=2", "#y"])).map(lambda t: t[0] + t[1] + t[2] if t[0] not in
                                                           ("?q=1", "#f") else t[0])
BASE = st.tuples(st.sampled_from(["http://a.com", "https://b.org:8080"]), PATH,
                 st.sampled_from(["", "?k=v"])).map(lambda t: t[0] + "/" + t[1] + t[2])

FAST = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@FAST
@given(st.lists(TEXT, min_size=1, max_size=40), st.sampled_from([(500, 75), (50, 10), (7, 3)]))
def test_chunks_cover_the_text_in_order(spark, texts, so):
    """Every piece is a stripped window that begins at a multiple of the stride; together they cover all of the text."""
    size, overlap = so
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r["i"]: r["c"] for r in df.select("i", chunk_windows("t", size, overlap).alias("c")).collect()}
    for i, t in enumerate(texts):
        body, pieces, covered = t.strip(), list(got[i]), 0
        for at in range(0, len(body), size - overlap):
            window = body[at:at + size]
            if covered < len(body) and window.strip():
                assert pieces.pop(0) == window.strip()
            covered = max(covered, at + len(window))
        assert not pieces and covered == len(body)


@FAST
@given(st.lists(st.tuples(HREF, BASE), min_size=1, max_size=40))
def test_resolve_url_equals_urljoin(spark, pairs):
    df = spark.createDataFrame(pairs, "h string, b string")
    got = [r["r"] for r in df.select(resolve_url("h", "b").alias("r")).collect()]
    assert got == [urljoin(b, h) for h, b in pairs]
