"""Operators that judge or change single rows: quality rules, language, toxicity, contamination, main text."""

import random

import pytest
from pyspark.sql import functions as F

from pagelake.llm import decontaminate, html_main, langid, quality, toxicity


def test_quality_edge_cases(odd, none):
    out = quality.quality(odd)
    assert out.columns[:-1] == odd.columns and out.columns[-1] == "_quality" and out.count() == 12
    by = {r["doc_id"]: r["_quality"] for r in out.where("doc_id is not null").collect()}
    assert by[5]["n_words"] == by[4]["n_words"] == by[7]["n_words"] == 0 and by[5]["base_failed"] and not by[5]["kept"]
    assert by[1] == by[2] and quality.quality(none).count() == 0


def test_quality_statistics_by_hand(spark):
    text = "a b c a b c\n\na b c x\na b c x\n#1 $ done"
    q = quality.quality(spark.createDataFrame([(text,)], "text string")).first()["quality"]
    # windows: abc at 0, 3, 6, 10; bcx at 7, 11; and the ones between that recur
    assert (q["n_words"], q["n_symbols"], q["n_dup_lines"], q["word_chars"]) == (17, 2, 1, 21)
    words = text.split()
    seen = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(seen) if seen.count(w) > 1 for j in range(i, i + 3)}
    assert q["n_repeat_words"] == len(covered)


def test_keep_good_keeps_the_columns(spark, odd):
    good = "The house of the old man stood by the sea and it was a quiet place for all of us. " * 1
    rows = [(i, " ".join(random.Random(i).sample((good + "with more words than most people would read today or any "
             "other day of this long year when nothing much happened here at all except rain wind snow light dark cold warm "
             "north south east west up down left right").split(), 55)), "en", "s", None, *["x"] * 8) for i in range(3)]
    docs = spark.createDataFrame(rows, odd.schema).unionByName(odd)
    kept = quality.keep_good(spark, docs, "")
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {0, 1, 2}


def test_language(spark, odd, none):
    words = {"en": "the and of to with house water people", "de": "der und die das mit haus wasser leute nicht",
             "fr": "le et la des avec maison eau gens dans", "es": "el y los las con casa agua gente para"}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(words[lang].split(), k=12)), lang) for i in range(160) for lang in [list(words)[i % 4]]]
    rows += [(200, "orphan", None), (201, None, "en"), (202, "123", "en")]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(labelled, "text", "lang", "doc_id")
    got = {r["doc_id"]: r for r in langid.identify(labelled.drop("lang"), model).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in rows[:160]) >= 158
    assert got[201]["lang_pred"] == got[202]["lang_pred"] == "und" and got[201]["score"] == 0
    out = langid.identify(odd, model)
    assert out.columns == [*odd.columns, "_lang_pred", "_score"]
    assert {r["doc_id"]: r["_lang_pred"] for r in out.where("doc_id in (4, 5, 7, 8)").collect()} == dict.fromkeys((4, 5, 7, 8), "und")
    assert langid.identify(none, model).count() == 0
    blank = langid.train(none, "text", "lang", "doc_id")
    assert {r["_lang_pred"] for r in langid.identify(odd, blank).collect()} == {"und"}


@pytest.mark.parametrize("clause, least, most", [
    ("what a lovely day", 0, 0), ("zorp", 0.75, 0.85), ("you zorp", 0.9, 1), ("zorp you", 0.9, 1), ("not a zorp", 0.3, 0.6),
    ("he said you are a zorp", 0.4, 0.7), ("kill the lights", 0, 0), ("i will find you and kill you", 0.3, 0.7),
])
def test_toxic_grammar(clause, least, most):
    score, _ = toxicity.Lexicon({"zorp": 0.8}).score(clause)
    assert least <= score <= most


def test_composed_transducers_equal_their_meaning():
    rng = random.Random(5)
    t = toxicity
    for _ in range(3000):
        clause = [(rng.choice(t.SYMBOLS), rng.choice([0.3, 0.5, 0.8])) for _ in range(rng.randint(0, 9))]
        names, best = [n for n, _ in clause], 0.0
        for k, (name, own) in enumerate(clause):
            aimed = "target" in names[:k] + names[k + 1:]
            if name == "insult" or name == "threat" and aimed:
                denied = "negation" in names[max(0, k - t.NEGATION_SCOPE): k]
                best = max(best, own * (t.TARGETED if aimed else 1) * (t.NEGATED if denied else 1) * (t.REPORTED if "report" in names[:k] else 1))
        assert t.clause_score(clause) == pytest.approx(min(0.99, best))
    shout = t.Transducer.of(1, {0}, (0, "insult", [(0, "threat", 0.5)]))       # composition multiplies weights
    assert shout.then(t.THREAT).then(t.TARGET).best([("insult", 0.8), ("target", 0.0)]) == pytest.approx(0.8 * 0.5 * t.TARGETED)
    assert t.GRAMMAR.best([]) == 0.0


def test_toxicity_learns_and_scores(spark, odd, none):
    rng = random.Random(2)
    filler = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(400):
        text = rng.choices(filler, k=30)
        if i % 8 == 0:
            text[rng.randrange(30)] = rng.choice(["blorgs", "blorgen", "Vrek!"])
        rows.append((" ".join(text), int(i % 8 == 0)))
    labelled = spark.createDataFrame([*rows, (None, 1), ("word1", None)], "text string, toxic int")
    lexicon = toxicity.learn(labelled)
    test = spark.createDataFrame([("word5 word6 VREK word7",), ("word1 word2",), ("",), (None,), ("blorgs",)], "text string")
    assert [r["score"] >= 0.3 for r in toxicity.score(test, lexicon).collect()] == [True, False, False, False, True]
    out = toxicity.score(odd, lexicon)
    assert out.columns == [*odd.columns, "_score", "n_clauses"] and out.where("_score > 0").count() == 0
    assert toxicity.score(none, lexicon).count() == 0 and not toxicity.learn(labelled.where("toxic = 0")).words


def test_apostrophes_and_elisions(spark):
    lexicon = toxicity.Lexicon({"zorp": 0.8, "vrek*": 0.9})
    texts = ["l'zorp", "qu\u2019zorp ici", "zorp's", "d\u2019vrekkig", "he isn't a zorp", "he isn\u2019t a zorp", "rock'n'roll", "\u2019"]
    got = [r["score"] for r in toxicity.score(spark.createDataFrame([(t,) for t in texts], "text string"), lexicon).collect()]
    assert min(got[:4]) > 0.7 and got[4] == got[5] < got[0] and got[6:] == [0, 0]


def test_toxicity_next_to_unicode_punctuation(spark):
    lexicon = toxicity.Lexicon({"zorp": 0.8, "дурак": 0.8, "vrek*": 0.9})
    texts = ["¡idiota!", "„Trottel“", "«connard»", "idiot…", "an\u00a0idiot", "so—zorp–so", "‘ZORP’", "ДУРАК!", "“vrekken”", "vrek's",
             "\u212aill you", "¿IMBÉCIL?", "½ zorp", "zorp½", "é vrek", "…", "日本語", "", None]
    got = toxicity.score(spark.createDataFrame([(t,) for t in texts], "text string"), lexicon).collect()
    want = [lexicon.score(t or "") for t in texts]
    assert [(r["score"], r["n_clauses"]) for r in got] == want and [s > 0 for s, _ in want] == [True] * 13 + [False] * 6


def brute_hits(text, items):
    import re
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    doc, hit, held, longest = words(text), set(), set(), 0
    for name, body in items:
        item = words(body)
        size = min(13, len(item))
        wins = {tuple(item[i:i + size]) for i in range(len(item) - size + 1)} if size else set()
        for p in range(len(doc) - size + 1 if size else 0):
            if tuple(doc[p:p + size]) in wins:
                hit.update(range(p, p + size))
                held.add(str(name))
                for o in range(len(item)):
                    same = 0
                    while o + same < len(item) and p + same < len(doc) and item[o + same] == doc[p + same]:
                        same += 1
                    longest = max(longest, same if same >= size else 0)
    return len(doc), len(hit), sorted(held), longest


def test_contamination_equals_brute_force(spark, odd, none, monkeypatch):
    rng = random.Random(3)
    vocabulary = ["ab", "Cd", "é", "x1", "of"]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([20, 13, 5, 2, 30])]
    items += [(6, items[4][1] + " x1 ab"), (7, " ".join(["ab"] * 40)), (8, items[0][1] + " " + items[1][1]), (9, ""), (10, None), (11, "x1 x1 x1")]
    docs = [(i, " ".join([*rng.choices(vocabulary, k=rng.randint(0, 40)), *(items[rng.randrange(8)][1].split() if i % 2 else []),
                          *(items[1][1].split() + items[0][1].split() if i % 7 == 0 else []),
                          "zz", *rng.choices(vocabulary, k=5)])) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for bound in (2_000_000, 60):       # one block, and several
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", bound)
        found = decontaminate.find_contamination(frame, bench)
        n_hit, _ = decontaminate.judge(found, list(decontaminate.ADDED))
        rows = found.select("*", n_hit.alias("n")).collect()
        assert {r["doc_id"]: (r["n_words"], r["n"], r["hit_items"], r["longest_match"]) for r in rows} == {i: brute_hits(t, items) for i, t in docs}
        plain = {str(i): t.lower().split() for i, t in items if t}
        for r in rows:       # the words at both places are the same
            size, place = r["longest_match"], r["longest_place"]
            assert (place is None) == (size == 0)
            if size:
                words = r["text"].lower().split()[place["at"]: place["at"] + size]
                assert len(words) == size and words == plain[place["item"]][place["item_at"]: place["item_at"] + size]
    assert decontaminate.find_contamination(odd, bench).count() == 12
    assert decontaminate.find_contamination(none, bench).count() == 0
    found = decontaminate.find_contamination(odd, bench.where("1 = 0"))
    assert found.columns[-5:] == ["_n_words", "hit_spans", "hit_items", "longest_match", "longest_place"] and found.where("longest_match > 0").count() == 0


@pytest.mark.parametrize("page, text", [
    ("", ""), ("<p>One\n two<p>Three &amp; four", "One two\nThree & four"),
    ("<body><nav>Menu</nav><header>Top</header><article><header><h1>Head</h1></header><p>A<b>b</b> c<br>d</p><ul><li>x<li>y</ul>"
     "<div class='share-bar'>Share</div><form>f</form></article><aside>Side</aside><footer>End</footer>", "Head\nAb c d\nx\ny"),
    ("<main><p>Main</p><section id=comments><p>Great post</p></section></main><p>rest", "Main"),
    ("<div class=\"cookie-notice\">Cookies</div><div>Body text</div><div hidden>no</div><script>if (a<b) '</p>'</script>", "Body text"),
    ("<article><p title='a>b'>Cut <!-- <p>not</p> -->off &copy 2 &#8364;", "Cut off © 2 €"),
    ("<p>İİİ one</p><script>x</script><p>hello</p><STYLE>a</STYLE><p>end</p>", "İİİ one\nhello\nend"),
    ("<p>a</p><script>var s = '</scripty>'; </script ><p>b</p><script>rest <p>c</p>", "a\nb"),
    ("<article><div class='search-results'><p>Found</p></div><div class='related work'><p>Kept</p></div><div class=search>Go</div></article>",
     "Found\nKept"),
    ("<body><form action=x><header>Top</header><div class='page has-sidebar'><h1>Head</h1><p>Text</p></div></form></body>", "Head\nText"),
    ("<p>a</p><form><p>Your name</p><label>Mail</label><div><p>more</p></div></form><div>b</div>", "a\nb"),
    ("<b>" * 20_000 + "x" + "</i>" * 20_000 + "<li>y" * 20_000, "x" + "\ny" * 20_000),
    ("<div>" * 20_000 + "deep" + "<p>p" * 3, "deep\np\np\np"),
    ("<article><table><tr><td>1<td>2<tr><td>3</table></article><article class=comment><p>reader</p></article>", "1\n2\n3\nreader"),
])
def test_main_text_by_hand(page, text):
    assert "\n".join(html_main.Page(page).main()[0]) == text


def test_templates_by_host(spark):
    def page(i, host):
        banner = f"<div><p>Welcome to {host}, our house</p></div>"
        return (i, f"http://{host}/p{i}", f"<body>{banner}<div><p>Body {i} of {host}</p><p>Shared line</p></div></body>")
    rows = [page(i, "a.test") for i in range(8)] + [page(i, "b.test") for i in range(20, 23)]
    rows += [(50, None, None), (50, None, None), (51, "not a url", ""), (52, "http://a.test/x", None)]
    rows += [(60 + i, "http://copies.test/", "<body><div><p>Copied page</p></div></body>") for i in range(9)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    out = html_main.main_text(df)
    assert out.columns == ["page_id", "url", "html", "text", "_text", "n_templates"] and out.count() == len(rows)
    got = {r["page_id"]: r for r in out.collect()}
    assert got[3]["_text"] == "Body 3 of a.test" and got[3]["n_templates"] == 3     # the banner, its p, and the shared p
    flow = [(i, f"http://c.test/{i}", f"<article><p>Body {i}</p><p>Shared line</p></article>", "x") for i in range(8)]
    shared = html_main.main_text(spark.createDataFrame(flow, df.schema))
    assert {r["_text"] for r in shared.collect()} == {f"Body {i}\nShared line" for i in range(8)}      # an article's text stays
    assert got[21]["_text"] == "Welcome to b.test, our house\nBody 21 of b.test\nShared line"
    assert got[50]["_text"] == "" and got[50]["html"] is None and got[51]["_text"] == "" and got[64]["_text"] == "Copied page"
    assert html_main.main_text(df.where("1 = 0")).count() == 0


def test_templates_of_a_section_of_a_large_host(spark):
    def page(i):
        hint = "<div><p>All about gardens</p></div>" if i < 25 else ""                   # a section: 25 of 400 pages
        variant = f"<section><p>House line number {i % 8}</p></section>"                # eight variants of 50 pages each
        rare = "<div><p>A saying that some pages share</p></div>" if 100 <= i < 119 else ""
        return (i, f"http://large.test/{i}", f"<body>{hint}{variant}<div><p>Body {i}</p></div>{rare}</body>")
    out = html_main.main_text(spark.createDataFrame([page(i) for i in range(400)], "page_id long, url string, html string"))
    got = {r["page_id"]: r["text"] for r in out.collect()}
    assert got == {i: f"Body {i}" + ("\nA saying that some pages share" if 100 <= i < 119 else "") for i in range(400)}


def brute_texts(rows):
    """Main texts by host, with the counting of templates in plain Python: rows are (url, html)."""
    hosts = {}
    for url, html in rows:
        host = (url or "").lower().split("://")[1].split("/")[0] if "://" in (url or "") else ""
        hosts.setdefault(host, []).append(html or "")
    cut = {}
    for host, pages in hosts.items():
        counts = {}
        for html in set(pages):
            for h in html_main.Page(html).subtrees:
                counts[h] = counts.get(h, 0) + 1
        bar = min(html_main.MANY_PAGES, html_main.SHARE * len(set(pages)))
        gone = {h for h, n in counts.items() if n >= html_main.MIN_PAGES and n >= bar}
        for html in pages:
            blocks, inner = html_main.Page(html).main()
            cut[host, html] = "\n".join(t for i, t in enumerate(blocks) if not any(h in gone and a <= i < b for h, a, b in inner))
    return cut


def test_templates_equal_brute_force(spark):
    rng = random.Random(8)
    parts = [f"<div><p>Part {i}</p></div>" for i in range(12)] + ["<article><div>A 1</div><p>B</p></article>", "<form><p>f</p></form>",
             "<section><div><p>Deep</p></div><div>Two</div></section>", "<nav>n</nav>", "<p>open", "</div>", "<div>Equal</div>"]
    rows = []
    for i in range(240):
        html = "".join(rng.choices(parts, weights=[9, 6, 5, 4, 3, 3, 2, 2, 1, 1, 1, 1, 1, 1, 3, 1, 1, 1, 4], k=rng.randint(0, 7)))
        rows.append((rng.choice(["http://a.test/", "http://a.test/", "https://B.test/x", "no host", None]), rng.choice([html, html, html, None])))
    rows += [("http://a.test/long", "".join(f"<div><p>Row {i} <b>x</b></p></div>" for i in range(5_000)))]
    frame = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)],
                                  "page_id long, url string, html string, page_blocks string").repartition(4)
    want = brute_texts(rows)
    hosts = {"http://a.test/": "a.test", "http://a.test/long": "a.test", "https://B.test/x": "b.test"}
    for keep in (True, False):
        out = html_main.main_text(frame, keep_html=keep)
        assert out.columns == ["page_id", "url", *(["html"] if keep else []), "page_blocks", "text", "n_templates"]
        got = {r["page_id"]: r["text"] for r in out.collect()}
        assert got == {i: want[hosts.get(u, ""), h or ""] for i, (u, h) in enumerate(rows)}
