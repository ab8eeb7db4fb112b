"""Web pages to blocks, titles and stated dates, by Arrow-batched readers over Python's HTML and JSON modules."""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import _col

# Element groups.
SKIPPED = {"script", "style", "noscript", "template", "svg", "iframe", "head"}
BOILERPLATE = {"nav", "header", "footer", "aside", "form"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BREAKS = {"p", "div", "section", "article", "ul", "ol", "table", "tr", "blockquote", "main", "br", "dl", "dt", "dd", "figure", "body"} | HEADINGS

# Words of a class, id or role that mark what is not the page's own text, elements that
# never have an end, marks that begin a list item, and kinds of JSON-LD nodes that date a page.
MARKERS = (
    "sidebar|sidenav|side-nav|table-of-contents|breadcrumb|breadcrumbs|masthead|skip-link|cookie|consent|advert|advertisement|site-header|site-footer|"
    "topbar|searchbox|search-bar|version-switcher|prev-next|related-posts|dropdown-menu"
)
ENDLESS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
LIST_MARK = r"[-*·•]\s|\d+[.)、]\s"
DATED = {"Article", "TechArticle", "NewsArticle", "BlogPosting", "ScholarlyArticle", "WebPage", "Report", "CreativeWork"}

_MARKED = re.compile(rf"(^|[-_ ])({MARKERS})([-_ ]|$)", re.IGNORECASE)
#: Characters of a block at least.
LEAST = 2

BLOCK = "array<struct<kind:string,level:int,text:string>>"


class _Reader(HTMLParser):
    def __init__(self, boilerplate: bool):
        super().__init__(convert_charrefs=True)
        self.boilerplate = boilerplate
        self.skip = SKIPPED if boilerplate else SKIPPED | BOILERPLATE
        self.hidden: list[str] = []
        self.blocks: list[dict] = []
        self.words: list[str] = []
        self.kind, self.level, self.pre = "text", 0, 0

    def flush(self) -> None:
        text = "".join(self.words)
        text = text.strip("\n") if self.kind == "code" else " ".join(text.split())
        if self.kind == "heading" and text or len(text.strip()) >= LEAST:
            kind = "list" if self.kind == "text" and re.match(LIST_MARK, text) else self.kind
            self.blocks.append({"kind": kind, "level": self.level, "text": text})
        self.words = []

    def begin(self, kind: str, level: int = 0) -> None:
        self.flush()
        self.kind, self.level = kind, level

    def hides(self, tag, attrs) -> bool:
        marks = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        return tag in self.skip or tag not in ENDLESS and not self.boilerplate and bool(marks and _MARKED.search(marks))

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            # What is hidden ends where its own element ends, so elements of its name inside count too.
            if tag == self.hidden[-1] and tag not in ENDLESS or tag in self.skip:
                self.hidden.append(tag)
        elif self.hides(tag, attrs):
            self.flush()
            self.hidden.append(tag)
        elif tag == "pre":
            self.pre += 1
            self.begin("code")
        elif not self.pre and tag in HEADINGS:
            self.begin("heading", int(tag[1]))
        elif not self.pre and tag == "li":
            self.begin("list")
        elif not self.pre and tag in BREAKS:
            self.begin("text")

    def handle_endtag(self, tag):
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
        elif tag == "pre" and self.pre:
            self.pre -= 1
            if not self.pre:
                self.begin("text")
        elif not self.pre and (tag in BREAKS or tag == "li"):
            self.begin("text")

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


def blocks_of(html: str | None, boilerplate: bool = False) -> list[dict]:
    """Heading, text, list and code blocks of one page; navigation and the like are left out."""
    reader = _Reader(boilerplate)
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return reader.blocks


def blocks(pages: DataFrame, boilerplate: bool = False) -> DataFrame:
    """page_id and its blocks."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int32()), ("text", pa.string())]))
        for batch in batches:
            found = [blocks_of(h, boilerplate) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(found, kind)], ["page_id", "blocks"])

    return pages.select("page_id", "html").mapInArrow(parse, f"page_id long, blocks {BLOCK}")


def decoded(text) -> Column:
    """A text with its entities decoded; only texts that have an ampersand go through Python."""

    @F.pandas_udf("string")
    def decode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: entities.unescape(t) if t else t)

    text = _col(text)
    return F.when(text.contains("&"), decode(text)).otherwise(text)


def named(text) -> Column:
    """A text with the four entities that markup cannot do without decoded, where they are written in full."""
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(mark))
    return text


def title(html, decode: Callable[[Column], Column] = decoded) -> Column:
    """The title element's text, entities decoded and blanks collapsed."""
    return F.trim(F.regexp_replace(decode(F.regexp_extract(html, r"(?is)<title[^>]*>(.{0,300}?)</title>", 1)), r"\s+", " "))


_LINKED_DATA = re.compile(r"<script[^>]+application/ld\+json[^>]*>(.*?)</script>", re.IGNORECASE | re.DOTALL)


def _nodes(found) -> Iterator[dict]:
    """All objects of a JSON value, outer ones first."""
    waiting = [found]
    while waiting:
        value = waiting.pop(0)
        if isinstance(value, dict):
            yield value
            waiting = [*value.values(), *waiting]
        elif isinstance(value, list):
            waiting = [*value, *waiting]


def dates_of(html: str | None) -> tuple[str | None, str | None, int]:
    """The first published and modified dates (YYYY-MM-DD) of a page's dated JSON-LD nodes, and how many such nodes there are."""
    dates: dict[str, str] = {}
    n = 0
    for block in _LINKED_DATA.findall(html or ""):
        try:
            value = json.loads(block.strip())
        except ValueError:
            continue
        for node in _nodes(value):
            kinds = node.get("@type")
            if not DATED & {str(k) for k in (kinds if isinstance(kinds, list) else [kinds])}:
                continue
            n += 1
            for field in ("datePublished", "dateModified"):
                stated = re.match(r"\d{4}-\d{2}-\d{2}", node[field].strip()) if isinstance(node.get(field), str) else None
                if stated:
                    dates.setdefault(field, stated[0])
    return dates.get("datePublished"), dates.get("dateModified"), n


def stated_dates(pages: DataFrame) -> DataFrame:
    """page_id, published, modified and nodes: what a page's JSON-LD says of its dates; bad JSON says nothing."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*map(dates_of, batch.column("html").to_pylist()), strict=True)) or [(), (), ()]
            columns = [pa.array(x, kind) for x, kind in zip(rows, (pa.string(), pa.string(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *columns], ["page_id", "published", "modified", "nodes"])

    return pages.select("page_id", "html").mapInArrow(read, "page_id long, published string, modified string, nodes int")
