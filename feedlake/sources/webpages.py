"""Items listed on a web page, by selector."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlake.functions.text import slices
from feedlake.functions.urls import absolute_url
from feedlake.sources.feeds import ITEM_SCHEMA, _date

DEFAULT_SELECTOR, PER_PAGE = "article, .news-item, .post, li", 20
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES = {"li": {"li"}, "p": {"p"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}


class Element:
    """A node of a page."""

    def __init__(self, tag: str, attrs: dict, parent: Element | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        todo = list(reversed(self.children))
        while todo:
            node = todo.pop()
            if isinstance(node, Element):
                yield node
                todo += reversed(node.children)

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                todo += reversed(node.children)
        return "".join(out)

    def first(self, *tags: str) -> Element | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def closest(self, tag: str) -> Element | None:
        node = self
        while node is not None and node.tag != tag:
            node = node.parent
        return node


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("root", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES:
            node = self.at
            while node is not None and node.tag not in ("ul", "ol", "table", "dl", "root"):
                if node.tag in _CLOSES[tag]:
                    self.at = node.parent
                    break
                node = node.parent
        node = Element(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at.closest(tag)
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse_page(html: str | None) -> Element:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def _matches(node: Element, simple: str) -> bool:
    m = re.fullmatch(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[^\]]+\])*)", simple)
    if not m or not simple:
        return False
    if m[1] and m[1] != "*" and node.tag != m[1].lower():
        return False
    classes = (node.attrs.get("class") or "").split()
    for part in re.findall(r"[.#][\w-]+|\[[^\]]+\]", m[2]):
        if part[0] == "." and part[1:] not in classes or part[0] == "#" and node.attrs.get("id") != part[1:]:
            return False
        if part[0] == "[":
            name, _, value = part[1:-1].partition("=")
            if name.strip() not in node.attrs or (value and node.attrs[name.strip()] != value.strip("\"' ")):
                return False
    return True


def select(root: Element, selector: str) -> list[Element]:
    """Elements in page order that match one of comma-separated selectors of simple parts joined by blanks or `>`."""
    chains = [re.findall(r">|[^\s>]+", s) for s in selector.split(",")]

    def fits(node: Element | None, chain: list[str]) -> bool:
        if not chain:
            return True
        if node is None or not _matches(node, chain[-1]):
            return False
        rest = chain[:-1]
        if rest and rest[-1] == ">":
            return fits(node.parent, rest[:-1])
        up = node.parent
        while rest and up is not None:
            if fits(up, rest):
                return True
            up = up.parent
        return not rest

    return [n for n in root.walk() if any(fits(n, c) for c in chains if c)]


def _clean(text: str | None) -> str:
    return " ".join((text or "").split())


def page_items(html: str | None, url: str, selector: str | None = None, rendered: bool = False) -> list[dict]:
    """Items in page order: the first link in or around each selected element; its first heading, link text or first 160
    characters as title; its first paragraph (a static page: else its first 400 characters) as summary. A rendered
    page's first 20 elements are taken before anything is filtered, and an address that cannot be read fails the page."""
    selector = selector or DEFAULT_SELECTOR
    out = []
    nodes = select(parse_page(html), selector)
    for node in nodes[:PER_PAGE] if rendered else nodes:
        link = node.first("a") or node.closest("a")
        href = link.attrs.get("href") if link is not None else None
        item_url = absolute_url(url, href)
        if rendered and href and not item_url:
            raise ValueError(f"cannot resolve {href!r}")
        head, para, when = node.first("h1", "h2", "h3", "h4"), node.first("p"), node.first("time")
        title = _clean(head.text() if head is not None else "") or _clean(link.text() if link is not None else "") or _clean(node.text())[:160]
        summary = _clean(para.text() if para is not None else "") or ("" if rendered else _clean(node.text())[:400])
        date = _clean((when.attrs.get("datetime") or when.text()) if when is not None else "")
        if item_url and title:
            out.append({"external_id": item_url, "url": item_url, "title": title, "summary": summary, "content_text": summary, "published_at": _date(date), "raw": json.dumps({"selector": selector, "dateText": date})})
    return out


def scan_webpages(pages: DataFrame, per_page: int | None = PER_PAGE) -> DataFrame:
    """Item rows from (source_id, source_name, url, html[, selector][, rendered]).

    Of a static page's items with one url the first keeps its place and the last its values; then at most per_page of
    each page stay. A page that fails has no rows.
    """
    add = {c: F.lit(v) for c, v in (("selector", None), ("rendered", False)) if c not in pages.columns}
    rows = pages.withColumns(add) if add else pages

    def each(batches):
        for batch in slices(batches, "html"):
            out = []
            for page in batch.itertuples(index=False):
                try:
                    items = page_items(page.html, page.url or "", page.selector, bool(page.rendered))
                except ValueError:
                    items = []
                if not page.rendered:
                    items = list({i["url"]: i for i in items}.values())  # a dict keeps the first place and the last value
                for item in items[:per_page]:
                    out.append({"source_id": page.source_id, "source_type": "WEBSITE", "source_name": page.source_name, "authors": [], "tags": [], **item})
            yield pd.DataFrame(out, columns=[p.strip().split(" ")[0] for p in ITEM_SCHEMA.split(", ")])

    return rows.select("source_id", "source_name", "url", "html", F.col("selector").cast("string").alias("selector"), "rendered").mapInPandas(each, ITEM_SCHEMA)


def cap_per_source(items: DataFrame, cap: int, order: list) -> DataFrame:
    """At most cap items of each source."""
    return items.withColumn("__r", F.row_number().over(Window.partitionBy("source_id").orderBy(*order))).where(F.col("__r") <= cap).drop("__r")
