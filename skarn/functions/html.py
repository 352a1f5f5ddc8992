"""HTML to text: a small element tree, text with closed sentences, tables, and site rules as data."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.runtime import need

# Elements without an end tag, elements that are skipped, and how elements are written.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SKIP = {"head", "meta", "style", "script"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
EMPHASIS = {"b", "i", "emph"}
CODE = {"code", "pre"}
CLOSED = ".,;:!?()\"'`"


class Node:
    """An element with its attributes and its children (elements and strings)."""

    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack.extend(reversed(n.children))
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("[document]", {}, None)

    def handle_starttag(self, tag, attrs):
        n = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(n)
        if tag not in VOID:
            self.at = n

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.name != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    """The tree of a page; unclosed and stray tags are tolerated."""
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def page_text(html: str, with_title: bool = True) -> tuple[str, list[tuple[int, int]]]:
    """Text whose headings, paragraphs and list items end in punctuation, and the spans of code in it.

    White space is one blank except in ``pre``; emphasis is quoted; list items are indented and end in ``;``, lists in ``.``.
    """
    root = parse(html)
    out = ""
    spans: list[tuple[int, int]] = []
    starts: list[int] = []
    if with_title:
        title = next((n for n in root.walk() if n.name == "title"), None)
        if title is not None and (t := title.text().strip()):
            out = t if t[-1] in CLOSED else t + "."
    # (node, whether its children are done)
    stack: list[tuple[Node | str, str, bool]] = [(root, "", False)]
    while stack:
        n, parent, done = stack.pop()
        if isinstance(n, str):
            if parent == "[document]":
                continue
            s = (n if parent == "pre" else re.sub(r"\s+", " ", n)).strip()
            if s:
                out += ("" if out.endswith("\n") else " ") + s + " "
            continue
        if not done:
            if n.name in SKIP:
                continue
            if n.name in HEADINGS or n.name == "p":
                out += "\n"
            elif n.name in EMPHASIS:
                out += '"'
            elif n.name in CODE:
                starts.append(len(out))
            elif n.name == "li":
                out += "    "
            stack.append((n, parent, True))
            stack.extend((c, n.name, False) for c in reversed(n.children))
            continue
        if n.name in HEADINGS or n.name in ("p", "li"):
            s = out.strip()
            if s and s[-1] not in CLOSED:
                out = out.rstrip() + (";" if n.name == "li" else ".")
        if n.name in ("p", "li"):
            out += "\n"
        elif n.name in EMPHASIS:
            out += '"'
        elif n.name in CODE:
            spans.append((starts.pop(), len(out)))
            if n.name == "pre":
                out += "\n"
        elif n.name in ("ol", "ul") and out.rstrip().endswith(";"):
            out = out.rstrip()[:-1] + ".\n"
    return out, spans


def tables(html: str) -> list[str]:
    """Every table as tab-separated lines, header rows first."""
    out = []
    for t in (n for n in parse(html).walk() if n.name == "table"):
        rows = [[re.sub(r"\s+", " ", c.text()).strip() for c in r.children if isinstance(c, Node) and c.name in ("td", "th")] for r in t.walk() if r.name == "tr"]
        out.append("\n".join("\t".join(r) for r in rows))
    return out


def closed_strings(node: Node, end: str = ".", closed: str = ",.?!:;") -> str:
    """The strings of an element, each closed with punctuation, joined by blank lines."""
    parts = [s.strip() for n in node.walk() for s in n.children if isinstance(s, str) and s.strip()]
    return "\n\n".join(p if p[-1] in closed else p + end for p in parts)


# Where each site keeps title and body, and what is dropped from the body. A selector is
# "tag", "tag.class", "tag#id" or "tag[attribute=value]"; " > " goes down, " | " gives alternatives.
SITES: tuple[tuple[str, str, str, tuple[str, ...]], ...] = (
    ("alienvault", "div.blog-title-date-author-area > h1", "div.blog-body", ()),
    ("anomali.com", "div.article-hero > h1", "div.article-text", ()),
    ("cybersecurity.att.com", "div.blog-title-date-author-area > h1", "div.blog-body", ()),
    ("bitdefender", "title", "div.single-post__content", ()),
    ("cybereason", "div.cr-mln__blog-post > h1", "div.cr-mln__blog-post > span#hs_cos_wrapper_post_body", ()),
    ("deepinstinct", "div.blog-header__content > h1", "div.text-block", ()),
    ("dragos", "article.resource > h1.resource__title", "article.resource > div.resource__main", ("div.resource-meta",)),
    ("eclecticlight", "h1.entry-title", "div.entry-content", ("div#jp-post-flair",)),
    ("fireeye", "title", "div.entrytext | div.resource-body", ()),
    ("forcepoint", "h1", "div.pane-node-field-main-content", ()),
    ("github.com", "", "article.entry-content", ()),
    ("hexacorn", "", "div.post-content", ()),
    ("infosecblog", "", "article.post", ("footer",)),
    ("lolbas-project.github.io", "", "html", ()),
    ("malwarebytes", "h1.entry-title", "div#articleBody", ("div#jp-relatedposts",)),
    ("mandiant", "h1", "div.resource-body", ()),
    ("mcafee", "h1.main-heading", "div.the_content", ()),
    ("medium", "", "article > section", ()),
    ("microsoft", "", "div.content", ()),
    ("nist", "", "div#vulnDetailPanel", ()),
    ("paloaltonetworks", "title", "div.article__content", ("div.article__subscribe",)),
    (".security.com", "article > div.blog-post__content > header > h1", "article > div.blog-post__content", ("header",)),
    ("securityweek", "h2.page-title", "div.node", ("div.ad_in_content", "div.sharethis", "div.author_content", "div.sponsored_links_box", "div.author-terms", "div#disqus_thread")),
    ("securityintelligence", "title", "main#post__content", ("div.post__tags", "div.post__author")),
    ("support.office", "div#supArticleContent > h1#page-header", "div#supArticleContent > article.ocpArticleContent", ()),
    ("sophos", "", "main#main > article", ()),
    ("sucuri", "h1.entry-title | h1.mb-30", "div.entry-content | div#step0", ("aside",)),
    ("symantec", "article > div.blog-post__content > header > h1", "article > div.blog-post__content", ("header",)),
    ("talosintelligence", "", "div.post", ("div.post-footer",)),
    ("taosecurity", "", "div.post", ("div.post-bottom",)),
    ("trendmicro", "article > h1.article-details__title | section.articleHeader > h1", "article > main | section.articleContent", ("section.tag--list", "div.postedIn")),
    ("twitter", "", "div[data-testid=tweetText]", ()),
    ("virusbulletin", "", "div.col-md-9", ("div.ccm-remo-expand",)),
    ("webroot", "h1.entry-title", "div.entry-content", ("div#singleBios", "div.et_social_inline")),
    ("welivesecurity", "div.promo-text", "div.formatted", ("div.dot", "div.widgets")),
)
_STEP = re.compile(r"^([a-z0-9]+)(?:\.([^\s#\[]+)|#([^\s\[]+)|\[([^=]+)=([^\]]+)\])?$")


def _matches(n: Node, step: str) -> bool:
    m = _STEP.match(step)
    tag, cls, ident, key, value = m.groups()
    if n.name != tag:
        return False
    if cls is not None:
        return cls in n.attrs.get("class", "").split()
    if ident is not None:
        return n.attrs.get("id") == ident
    return key is None or n.attrs.get(key) == value


def select(root: Node, selector: str) -> list[Node]:
    """The elements of the first alternative that finds any."""
    for alternative in selector.split(" | "):
        found = [root]
        for step in alternative.split(" > "):
            found = [n for f in found for n in f.walk() if n is not f and _matches(n, step)]
        if found:
            return found
    return []


def article(html: str, title: str, body: str, drop: tuple[str, ...]) -> tuple[str | None, str | None, str | None]:
    """Title (closed with punctuation), text and error of a page by a site's rule; blank lines are collapsed."""
    root = parse(html)
    head = None
    if title:
        found = select(root, title)
        if not found:
            return None, None, f"no {title}"
        head = found[0].text().strip()
        head = head if head and head[-1] in ",.?!:;" else head + "."
    found = select(root, body)
    if not found:
        return head, None, f"no {body}"
    for f in found:
        for d in drop:
            for n in select(f, d):
                n.parent.children.remove(n)
    raw = "\n\n".join(f.text() for f in found)
    return head, "\n".join(s for line in raw.split("\n") if (s := line.strip())), None


def extract_text(df: DataFrame, id_col: str, html: str) -> DataFrame:
    """``id_col, text, code_spans``; null pages have no row, an empty page has an empty text."""
    need(df, id_col, html)
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, t, [{"start": a, "end": b} for a, b in s]) for i, h in zip(pdf[id_col], pdf[html], strict=True) for t, s in [page_text(h)]]
            yield pd.DataFrame(rows, columns=[id_col, "text", "code_spans"])

    return df.where(F.col(html).isNotNull()).select(id_col, html).mapInPandas(run, f"`{id_col}` {kind}, text string, code_spans array<struct<start:int,end:int>>")


def extract_tables(df: DataFrame, id_col: str, html: str) -> DataFrame:
    """``id_col, tables``: tab-separated text of every table."""
    need(df, id_col, html)
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf[id_col], "tables": [tables(h) for h in pdf[html]]})

    return df.where(F.col(html).isNotNull()).select(id_col, html).mapInPandas(run, f"`{id_col}` {kind}, tables array<string>")


def extract_articles(df: DataFrame, id_col: str, site: str, html: str) -> DataFrame:
    """``id_col, site, title, text, error`` by the rule of each page's site; rows without a known site are dropped."""
    need(df, id_col, site, html)
    kind = dict(df.dtypes)[id_col]
    rules = {s[0]: s[1:] for s in SITES}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, s, *article(h, *rules[s])) for i, s, h in zip(pdf[id_col], pdf[site], pdf[html], strict=True)]
            yield pd.DataFrame(rows, columns=[id_col, site, "title", "text", "error"])

    return df.where(F.col(html).isNotNull() & F.col(site).isin(*rules)).select(id_col, site, html).mapInPandas(run, f"`{id_col}` {kind}, `{site}` string, title string, text string, error string")
