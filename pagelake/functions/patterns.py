"""Regular expressions of the HTML extraction (fixed values, Java syntax)."""

# A tag's inside: quotes count only after "=", so that neither ">" in a quoted value nor a stray quote ends or
# extends the tag.  Possessive, hence linear.
_INSIDE = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
_TO = r"""(?:[^>=\s]++|\s|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]*+))*?"""


def _open(name: str) -> str:
    return rf"<{name}\b{_INSIDE}>"


def _open_with_class(name: str, token: str) -> str:
    return (rf"<{name}\b[^>]*?\sclass\s*=\s*(?:\"(?:[^\"]*\s)?{token}(?:\s[^\"]*)?\"|'(?:[^']*\s)?{token}(?:\s[^']*)?'"
            rf"|{token}(?=[\s>])){_INSIDE}>")


# Page-level structure.
JUNK_RE = (r"(?is)<!--.*?(?:-->|\z)"
           rf"|{_open('script')}.*?(?:</script\s*>|\z)"
           rf"|{_open('style')}.*?(?:</style\s*>|\z)")
TAG_RE = rf"<[A-Za-z/!?]{_INSIDE}>"
BODY_OPEN_RE = r"(?i)<body\b"
BODY_RE = rf"(?is){_open('body')}(.*?)(?:</body\s*>|\z)"
HEAD_RE = rf"(?is){_open('head')}.*?(?:</head\s*>|\z)"
TITLE_RE = rf"(?is){_open('title')}(.*?)</title\s*>"

# Tables, next link and product links.  A cell ends at its end tag, at the next cell or row, or with its table.
HAS_TABLE_RE = r"(?i)<table"
TABLE_RE = rf"(?is){_open('table')}(.*?)(?:</table\s*>|\z)"
TR_SPLIT_RE = rf"(?i){_open('tr')}"
_CELL_END = r"(?=</?t[hdr]\b|</?t(?:able|body|head|foot)\b|\z)"
TH_RE = rf"(?is){_open('th')}(.*?){_CELL_END}"
TD_RE = rf"(?is){_open('td')}(.*?){_CELL_END}"
# Tags of tables that carry their depth ("<tr_2 class=x>"), so that \\1 finds the end at the same depth.  Captured in a
# look-ahead, an outer element does not use up the inner ones.
TABLE_TAG_RE = r"(?i)<(/?)(table|thead|tbody|tfoot|tr|th|td)(?=[\s/>])"
TABLE_CUT_RE = r"(?i)(?=</?table[\s/>])"
_DEEP_END = r"</table\1\b|\z"
DEEP_TABLE_RE = rf"(?is)(?=<table(_[0-9]+)\b{_INSIDE}>(.*?)(?={_DEEP_END}))<table"
DEEP_TR_RE = rf"(?is)(?=<tr(_[0-9]+)\b{_INSIDE}>(.*?)(?=</?t(?:r|body|head|foot)\1\b|{_DEEP_END}))<tr"
_DEEP_CELL_END = rf"(?=</?t[hdr]\1\b|</?t(?:body|head|foot)\1\b|{_DEEP_END})"
DEEP_TH_RE = rf"(?is)<th(_[0-9]+)\b{_INSIDE}>(.*?){_DEEP_CELL_END}"
DEEP_TD_RE = rf"(?is)<td(_[0-9]+)\b{_INSIDE}>(.*?){_DEEP_CELL_END}"
NEXT_LI_RE = rf"(?is){_open_with_class('li', 'next')}(.*?)(?:</li\s*>|(?=<li\b)|(?=</[uo]l\b)|\z)"
# Group 1 is the value with its quotes, if any.
A_HREF_RE = rf"(?is)<a(?=\s){_TO}\shref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)"
ARTICLE_RE = rf"(?is){_open_with_class('article', 'product_pod')}(.*?)(?:</article\s*>|\z)"
H3_RE = rf"(?is){_open('h3')}(.*?)</h3\s*>"
