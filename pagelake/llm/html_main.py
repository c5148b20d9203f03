"""Operator 8: main text of web pages, with site template removal.

1. Every page is read once into its element tree.  That gives the blocks of its main text (those of the article, or of
   ``main``, or of the body, if there is none), without elements that are boilerplate by tag, role or class, and the
   hash of the subtree of every element that could be a template (not the text flow of the article), with the run of
   blocks that it covers.  They are written, without the markup.
2. Spark counts the hashes per host, over pages of different content: copies of one page count once.  A subtree
   that recurs on ``MIN_PAGES`` pages and on ``SHARE`` of the host's pages is template, and so is one that recurs on
   ``MANY_PAGES`` pages, however large the host: templates of a section, and variants of a block, are a small share.
3. Subtrees inside the main text that are template take their blocks away.  Pages that have no candidate inside their
   main text are done after step 1 and are not shuffled.

Counts are aggregated before each shuffle, and the join of subtrees with templates is salted, so a host with a third
of all pages is spread.  The text flow of an article is never deleted as template, so paragraphs that articles share
stay.  A form is left out unless it wraps the page: one that holds an article, ``main``, ``h1``, header, footer or
``nav`` is read like a ``div``.  Defined results: a null or empty page has an empty text; unclosed and crossed tags are
closed where HTML would close them, a script that never ends takes the rest of the page; a page without a host belongs to
the host ''; repeated rows get equal texts; deep and long pages take time in proportion to their length; an empty table
gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm.common import add_columns, fresh, q, read
from pagelake.session import materialize

MIN_PAGES = 5
SHARE = 0.2
MANY_PAGES = 20
SALTS = 32

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option "
                   "p pre section select summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCKS - frozenset("body button caption dd dt head html legend li optgroup option select tbody td tfoot th thead title tr".split())
# An opening tag ends an open element of these names, up to the nearest of the scope names.
IMPLIED_END = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])), "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "body": (frozenset(["head"]), frozenset(["body"])),
}
BOILERPLATE_TAGS = frozenset("nav aside footer script style head noscript template iframe object svg button select menu "
                             "dialog textarea title canvas audio video".split())
PAGE_TAGS = frozenset("article main h1 header footer nav".split())     # a form that holds one wraps the page
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
# Parts of a class or id that name menus, headers, footers, sidebars, notices, adverts or reader comments ...
BOILERPLATE_PARTS = re.compile(
    r"(?:^|(?<!\bhas)(?<!\bwith)(?<!\bno)[\s_-])(?:ads?|advert\w*|adslot|adsense|sponsor\w*|promo|banner|cookies?|consent|gdpr|notices?|popup|"
    r"modal|newsletter|sidebars?|breadcrumbs?|menus?|nav|navbar|navigation|footer|masthead|comments?|commentlist|disqus)(?:$|[\s_-])", re.I)
# ... and words that do so only as a whole class or id: "search" is a form, "search-results" may be the article.
BOILERPLATE_WORDS = re.compile(
    r"(?:^|\s)(?:search|search-?(?:box|bar|form)|(?:share|sharing|social)(?:-?(?:bar|menu|buttons?|links?))?|login|signup|subscribe|respond|"
    r"replies|pagination|pager|toolbar|widgets?)(?:$|\s)", re.I)
UNMARKED = frozenset("html body main article".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption "
                 "article main a b i em strong span u s small sub sup code br q cite mark abbr time hr img".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW_END = {name: re.compile("</" + name + r"(?=[\s/>]|\Z)", re.I | re.A) for name in RAW}
MARKS = ("class", "id", "role", "hidden", "aria-hidden")


class Element:
    __slots__ = ("tag", "dropped", "main", "parts", "text", "first", "wraps", "spans")

    def __init__(self, tag: str, dropped: bool, main: bool, first: int, spans: int):
        self.tag, self.dropped, self.main, self.first, self.spans = tag, dropped, main, first, spans
        self.parts, self.text, self.wraps = [], False, False


def _marks(attributes: str) -> dict[str, str]:
    found = {}
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            name = m[1].lower()
            if name in MARKS and name not in found:
                found[name] = m[2] or m[3] or m[4] or ""
    return found


def _boilerplate(tag: str, marks: dict[str, str], in_main: bool) -> bool:
    if tag in BOILERPLATE_TAGS or tag == "header" and not in_main:
        return True
    if tag in UNMARKED or not marks:
        return False
    return ("hidden" in marks or marks.get("aria-hidden") == "true" or marks.get("role", "").lower() in BOILERPLATE_ROLES
            or any(BOILERPLATE_PARTS.search(x) or BOILERPLATE_WORDS.search(x) for x in (marks.get("class"), marks.get("id")) if x))


class Page:
    """One pass over a page.  ``subtrees`` are the hashes of possible templates, ``main()`` the blocks of the main text.

    An element covers the blocks made while it was open, so dropping a subtree drops a run of blocks."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, str]] = []      # (text, container: article, main or body)
        self.spans: list[tuple[int, int, int]] = []  # (subtree hash, first block, end) of possible templates
        self._buffer: list[str] = []
        self._stack = [Element("", False, False, 0, 0)]
        self._open: dict[str, list[int]] = {}        # places in the stack of the open elements of a name
        self._containers: list[str] = []
        at = 0
        for m in iter(lambda: TOKEN.search(source, at), None):
            if m.start() > at:
                self._characters(source[at:m.start()])
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                self._end(name)
            else:
                self._start(name, m[3])
                if name in RAW:
                    end = RAW_END[name].search(source, at)
                    at = end.start() if end else len(source)
        if at < len(source):
            self._characters(source[at:])
        while len(self._stack) > 1:
            self._pop()
        self._flush()

    def _characters(self, raw: str) -> None:
        top = self._stack[-1]
        text = entities.unescape(raw) if "&" in raw else raw
        if not text.isspace():
            top.text = True
            top.parts.append(text.strip().encode("utf-8", "replace"))
        if not top.dropped:
            self._buffer.append(text)

    def _flush(self) -> None:
        if self._buffer:
            text = " ".join("".join(self._buffer).split())
            if text:
                self.blocks.append((text, self._containers[-1] if self._containers else "body"))
            self._buffer = []

    def _start(self, tag: str, attributes: str) -> None:
        if tag in CLOSES_P:
            self._close(frozenset(["p"]), frozenset(["button", "table", "td", "th", "caption", "article", "div", "section", "object"]))
        if tag in IMPLIED_END:
            self._close(*IMPLIED_END[tag])
        if tag in BLOCKS:
            self._flush()
        if tag == "br":
            self._buffer.append(" ")
        if tag in VOID:
            self._stack[-1].parts.append(b"<" + tag.encode())
            return
        parent, marks = self._stack[-1], _marks(attributes)
        if tag in PAGE_TAGS and "form" in self._open:
            for place in self._open["form"]:
                self._stack[place].wraps = True
        element = Element(tag, parent.dropped or _boilerplate(tag, marks, bool(self._containers)), False, len(self.blocks),
                          len(self.spans))
        element.parts.append(f"{tag} {marks.get('class', '')} {marks.get('id', '')}".encode("utf-8", "replace"))
        if not element.dropped and (tag in ("article", "main") or marks.get("role") == "main"):
            element.main = True
            # The article counts also inside main, so the innermost kind that begins a run of blocks wins.
            self._containers.append("article" if tag == "article" or "article" in self._containers[-1:] else "main")
        self._open.setdefault(tag, []).append(len(self._stack))
        self._stack.append(element)

    def _nearest(self, names) -> int:
        return max((self._open[n][-1] for n in names if n in self._open), default=0)

    def _close(self, names, scope) -> None:
        place = self._nearest(names)
        if place > self._nearest(scope):
            self._end(self._stack[place].tag)

    def _end(self, tag: str) -> None:
        if tag in self._open:
            place = self._open[tag][-1]
            while len(self._stack) > place:
                self._pop()
        elif tag in ("p", "br"):
            self._flush() if tag == "p" else self._buffer.append(" ")

    def _pop(self) -> None:
        element = self._stack.pop()
        places = self._open[element.tag]
        places.pop()
        if not places:
            del self._open[element.tag]
        if element.tag in BLOCKS:
            self._flush()
        if element.tag == "form" and not element.wraps:
            del self.blocks[element.first:]
            inner = self.spans[element.spans:]
            self.spans[element.spans:] = [(h, element.first, element.first) for h, _, _ in inner]
        parent = self._stack[-1]
        digest = blake2b(b"\0".join(element.parts), digest_size=8).digest()
        parent.parts.append(digest)
        if element.main:
            self._containers.pop()
        elif element.text and not (self._containers and element.tag in FLOW) and element.tag not in UNMARKED:
            # An inline element's text may still be in the buffer; only blocks can be deleted as template.
            self.spans.append((int.from_bytes(digest, "big", signed=True), element.first,
                               len(self.blocks) if element.tag in BLOCKS else element.first))
        parent.text = parent.text or element.text

    @property
    def subtrees(self) -> list[int]:
        return sorted({h for h, _, _ in self.spans})

    def main(self) -> tuple[list[str], list[tuple[int, int, int]]]:
        """The blocks of the main text, and the possible templates that cover any: (hash, first block, end)."""
        kinds = {kind for _, kind in self.blocks}
        wanted = next((k for k in ("article", "main") if k in kinds), "body")
        place, texts = [0], []
        for text, kind in self.blocks:
            if kind == wanted or wanted == "body":
                texts.append(text)
            place.append(len(texts))
        return texts, [(h, place[a], place[b]) for h, a, b in self.spans if place[a] < place[b]]


def without(blocks: list[str], runs) -> str:
    """The blocks outside of the runs (first, end), joined; runs may be nested."""
    left, at = [], 0
    for first, end in sorted(runs):
        left.extend(blocks[at:first])
        at = max(at, end)
    return "\n".join(left + blocks[at:])


def host_of(url: str):
    return F.coalesce(F.regexp_extract(F.lower(q(url)), "^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def parsed(df: DataFrame, html: str, host, keep_html: bool, names: list[str]) -> DataFrame:
    """``df`` (without ``html``, if it isn't kept) with the columns ``names``: row number, host, hash of the page, blocks of
    the main text, possible templates inside it, hashes of all possible templates.  Written once."""
    number, site, content, blocks, inner, subtrees = names
    span = pa.struct([("h", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])

    def compute(columns):
        for column in columns:
            pages = [Page(x.as_py() or "") for x in column]
            mains = [page.main() for page in pages]
            yield [pa.array([m[0] for m in mains], pa.list_(pa.string())), pa.array([m[1] for m in mains], pa.list_(span)),
                   pa.array([page.subtrees for page in pages], pa.list_(pa.int64()))]

    source = df.withColumns({number: F.monotonically_increasing_id(), site: host, content: F.xxhash64(q(html))})
    made = add_columns(source, html, compute, {blocks: "array<string>", inner: "array<struct<h:bigint,a:int,b:int>>",
                                               subtrees: "array<bigint>"}, keep=keep_html)
    return materialize(made, "page-blocks")


def deleted_runs(pages: DataFrame, names: list[str], min_pages: int, share: float, many_pages: int) -> DataFrame:
    """(number, runs): for every page with a template inside its main text, (subtree, first block, end) of each."""
    number, site, content, _, inner, subtrees = (q(n) for n in names)
    seen = pages.select(site.alias("host"), content.alias("content"), subtrees.alias("subtrees"))
    host_pages = seen.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    counts = seen.select("host", "content", F.explode("subtrees").alias("subtree")).distinct().groupBy(
        "host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    bar = F.least(F.col("pages") * share, F.lit(many_pages))
    recurring = counts.join(host_pages, "host").where(F.col("n") >= bar).select(
        "host", "subtree", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = pages.select(number.alias("number"), site.alias("host"), F.explode(inner).alias("run")).select(
        "number", "host", "run", F.col("run.h").alias("subtree"), F.pmod("number", F.lit(SALTS)).cast("int").alias("salt"))
    # Written, so that the counting's shuffle files are gone before pages are shuffled.
    return materialize(own.join(recurring, ["host", "subtree", "salt"], "left_semi").groupBy("number").agg(
        F.collect_list("run").alias("runs")), "page-templates")


def main_text(df: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES,
              share: float = SHARE, many_pages: int = MANY_PAGES, keep_html: bool = True) -> DataFrame:
    """``df`` (without ``html`` unless ``keep_html``) with ``text`` and ``n_templates`` (different subtrees deleted from the
    text); underscored if the names are taken."""
    names = fresh(df, "row_number", "page_host", "page_hash", "page_blocks", "page_inner", "page_subtrees")
    number, blocks, inner = names[0], names[3], names[4]
    pages = parsed(df, html, host_of(url), keep_html, names)
    own = [c for c in df.columns if keep_html or c != html]
    text, n_templates = fresh(df, "text", "n_templates")
    runs = deleted_runs(pages, names, min_pages, share, many_pages)

    def compute(columns):
        for column in columns:
            found = [x or [] for x in column.field(1).to_pylist()]
            cut = [without(b, [(r["a"], r["b"]) for r in gone])
                   for b, gone in zip(column.field(0).to_pylist(), found, strict=True)]
            yield [pa.array(cut, pa.string()), pa.array([len({r["h"] for r in gone}) for gone in found], pa.int64())]

    done = pages.where(F.size(q(inner)) == 0).select(
        *[q(c) for c in own], F.array_join(q(blocks), "\n").alias(text), F.lit(0).cast("long").alias(n_templates))
    open_pages = pages.where(F.size(q(inner)) > 0).select(*[q(c) for c in own], q(number), q(blocks))
    paired = open_pages.join(runs.select(F.col("number").alias(number), F.col("runs").alias(inner)), number, "left").select(
        *[q(c) for c in own], F.struct(q(blocks).alias("blocks"), q(inner).alias("runs")).alias(blocks))
    rest = add_columns(paired, blocks, compute, {text: "string", n_templates: "bigint"}, keep=False)
    return done.unionByName(rest)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages, keep_html=False).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_templates")
