"""Main text of web pages by wrapper induction: the trees of same-host pages are aligned by simple tree matching; what
stays the same is template, what varies inside the main container is content."""

from __future__ import annotations

import html
import math
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlake.llm.scratch import discard, salted_join, stash, table
from feedlake.llm.url_filter import url_host

#: Elements that carry no article text, elements without content, elements whose content is no markup.
DROPPED = frozenset("nav footer aside form script style noscript template button select textarea iframe svg dialog head menu title object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
#: Elements that are passed over within a block.
UNSEEN = frozenset("script style noscript template".split())
#: Elements that start a block of text.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption head title script style noscript template button select textarea iframe svg object canvas".split())
#: Start tags that end an open element of these kinds.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "thead", "tbody")}
#: Names (class, id or role) of what is no article: those that consist of these words, and of PLAIN ones. DOUBTFUL ones may
#: name a paragraph as well: they count only on pages that no alignment explains.
MARKS = frozenset("ad ads advert adverts advertisement advertising sidebar comment comments disqus cookie cookies consent popup modal overlay newsletter subscribe signup login menu nav navbar navigation breadcrumb breadcrumbs masthead footer toolbar pagination pager complementary contentinfo".split())
DOUBTFUL = frozenset("alert banner notice notices promo promotion replies reply share sharing social sponsor sponsored".split())
PLAIN = frozenset("area bar block box container inner list outer section site top bottom left right wrap wrapper".split())
#: References of a host with which other skeletons are aligned; pages from which on a skeleton is frequent; pages that a layout
#: needs, and the share of its pages on which a node has one text for it to be template; how much of two trees must match for
#: one to stand for the other; the least part of the text that varies for a few pages to be told apart by it.
LAYOUTS, FREQUENT, LEAST_PAGES, CONSTANT, ALIKE, HALF = 8, 10, 2, 0.9, 0.8, 0.5
#: Part of the varying text that an `article` or `main` without a heading must hold to be the container.
NAMED = 0.1
_NAME = re.compile(r"[^\s\"'>/=]+")
_PART = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")
_STOP = re.compile(r"[>\"']")


class Tags:
    """The tags of a text, in time linear in its length, whatever is left open in it."""

    def __init__(self, text: str):
        self.text, self.last, self.quotes = text, text.rfind(">"), True

    def _end(self, at: int) -> int:
        """The place of the `>` that ends the tag begun before `at`; quoted values may hold others."""
        text, first = self.text, at
        while self.quotes and (m := _STOP.search(text, at)):
            at = m.start()
            if text[at] == ">":
                return at
            if text[first:at].rstrip()[-1:] == "=" if at - first < 64 else text[at - 64 : at].rstrip()[-1:] == "=":
                close = text.find(text[at], at + 1)
                if close < 0:
                    break
                at = close
            at += 1
        self.quotes = False  # a quote that never closes: from here on the first `>` ends a tag
        return text.find(">", first)

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(begin, end, is end tag, name, attributes) of the next tag from `at` on; the name is empty for comments and
        declarations. None: the rest is text."""
        text = self.text
        while (at := text.find("<", at)) >= 0:
            if text.startswith("<!--", at):
                end = text.find("-->", at + 4)
                return at, len(text) if end < 0 else end + 3, False, "", ""
            after = text[at + 1 : at + 3]
            if at >= self.last:
                return None
            if after[:1] in ("!", "?"):
                return at, text.find(">", at) + 1, False, "", ""
            close = after[:1] == "/"
            if after[close : close + 1].isascii() and after[close : close + 1].isalpha():
                name = _NAME.match(text, at + 1 + close)
                end = self._end(name.end())
                return at, end + 1, close, name[0].lower(), text[name.end() : end]
            at += 1
        return None


def attributes(text: str) -> dict[str, str]:
    """The attributes of a tag by name: the first of a name counts."""
    out: dict[str, str] = {}
    at, size = 0, len(text)
    while at < size:
        m = _NAME.match(text, at)
        if m is None:
            at += 1
            continue
        name, at, value = m[0].lower(), m.end(), ""
        rest = at + len(text[at : at + 256]) - len(text[at : at + 256].lstrip())
        if text[rest : rest + 1] == "=":
            at = rest + 1
            while at < size and text[at].isspace():
                at += 1
            quote = text[at : at + 1]
            close = text.find(quote, at + 1) if quote in ("'", '"') and quote else -1
            if close >= 0:
                value, at = text[at + 1 : close], close + 1
            else:
                m = re.compile(r"\S*").match(text, at)
                value, at = m[0], m.end()
        out.setdefault(name, value)
    return out


def is_marked(name: str) -> bool | None:
    """Whether a class, id or role names nothing but what is no article: `cookie-box` does, `has-sidebar` does not, and of
    `share` a single page can't tell (None)."""
    words = [w.lower() for w in _PART.findall(name)]
    if not all(w in MARKS or w in DOUBTFUL or w in PLAIN for w in words):
        return False
    return True if any(w in MARKS for w in words) else None if any(w in DOUBTFUL for w in words) else False


class Page:
    """Block-level tree of a page: labels and parents in document order, and the text of each block with its node.

    Neighbouring elements of one label without block children share a node (a repeated slot). Subtrees that cannot be
    article are a node without text, their label followed by `!`; doubtful ones keep theirs, their label followed by `?`.
    """

    def __init__(self, text: str | None):
        self.labels, self.parents, self.blocks = ["root"], [-1], []
        self._last: dict[int, int] = {}
        self._leaf = {0: True}
        self._parse(text or "")

    def _node(self, label: str, parent: int) -> int:
        before = self._last.get(parent)
        if before is not None and self.labels[before] == label and self._leaf[before]:
            return before
        self.labels.append(label)
        self.parents.append(parent)
        at = len(self.labels) - 1
        self._last[parent], self._leaf[at], self._leaf[parent] = at, True, False
        return at

    def _parse(self, text: str) -> None:
        stack = [("root", 0, False)]  # tag, node, dropped
        opened: dict[str, int] = {}  # how many of each tag are open: nothing is looked for in vain
        held: list[str] = []
        tags, pos, size = Tags(text), 0, len(text)

        def flush():
            if held:
                _, node, dropped = stack[-1]
                block = _SPACE.sub(" ", html.unescape("".join(held))).strip()
                if block and not dropped:
                    self.blocks.append((node, block))
                held.clear()

        def close(to: int):
            flush()
            for tag, _, _ in stack[to:]:
                opened[tag] -= 1
            del stack[to:]

        def close_last(names, barriers=()) -> bool:
            if not any(opened.get(n) for n in names):
                return False
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in names:
                    close(i)
                    return True
                if stack[i][0] in barriers:
                    return False
            return False

        def behind_raw(tag: str, at: int) -> int:
            end = re.compile(rf"</{tag}\b", re.I).search(text, at)
            close_ = text.find(">", end.end()) if end else -1
            return close_ + 1 if close_ >= 0 else size

        while pos < size:
            found = tags.next(pos)
            if found is None:
                held.append(text[pos:])
                break
            begin, end, ends, tag, inside = found
            if begin > pos:
                held.append(text[pos:begin])
            pos = end
            if tag not in BLOCKS:
                if tag == "br":
                    held.append(" ")
                continue
            if tag in UNSEEN:  # no part of the text around it
                if not ends:
                    pos = behind_raw(tag, pos)
                continue
            if ends:
                if not close_last((tag,)):
                    flush()
                continue
            flush()
            if tag in ("head", "body", "html") and opened.get(tag):
                continue
            if tag == "body":
                while len(stack) > 1 and stack[-1][0] != "html":
                    opened[stack.pop()[0]] -= 1
            elif tag in ENDS:
                barriers = ("ul", "ol", "dl", "table", "menu")
                while close_last(ENDS[tag], barriers) and tag in ("tr", "tbody", "tfoot"):
                    pass
            elif any(x[0] == "p" for x in stack[-3:]):  # a block ends an open paragraph
                close_last(("p",))
            kind = True if stack[-1][2] else self._is_dropped(tag, inside, opened)
            gone = kind is True
            parent = stack[-1][1]
            node = parent if stack[-1][2] else self._node(tag + ("!" if gone else "?" if kind is None else ""), parent)
            if tag in VOID:
                continue
            if tag in RAW:
                pos = behind_raw(tag, pos)
                continue
            stack.append((tag, node, gone))
            opened[tag] = opened.get(tag, 0) + 1
        flush()

    @staticmethod
    def _is_dropped(tag: str, inside: str, opened: dict[str, int]) -> bool | None:
        """Whether an element cannot be article; None: doubtful."""
        if tag in DROPPED or (tag == "header" and not opened.get("article")):
            return True
        if not inside or tag in ("html", "body"):
            return False
        given = attributes(inside)
        if "hidden" in given or given.get("aria-hidden", "").lower() == "true":
            return True
        if tag in ("article", "main"):
            return False
        marks = [is_marked(n) for n in (*given.get("class", "").split(), given.get("id", ""), given.get("role", ""))]
        return True if True in marks else None if None in marks else False

    def skeleton(self) -> str:
        return " ".join(f"{p}:{x}" for p, x in zip(self.parents[1:], self.labels[1:], strict=True))


#: What a worker remembers of skeletons and pairs of them; cleared when it is full.
_TREES: dict[str, tuple] = {}
_MATCHES: dict[tuple[str, str], tuple] = {}
REMEMBERED = 20_000
#: Pairs of nodes among them, and how many more pairs they may hold.
_ROOM, PAIRS = [2_000_000], 2_000_000


def tree(skeleton: str) -> tuple[tuple[str, ...], tuple[tuple[int, ...], ...]]:
    """(labels, children) of a skeleton."""
    if skeleton in _TREES:
        return _TREES[skeleton]
    labels, children = ["root"], [[]]
    for part in skeleton.split(" ") if skeleton else ():
        parent, label = part.split(":", 1)
        children.append([])
        children[int(parent)].append(len(labels))
        labels.append(label)
    if len(_TREES) >= REMEMBERED:
        _TREES.clear()
    _TREES[skeleton] = tuple(labels), tuple(map(tuple, children))
    return _TREES[skeleton]


def _aligned(m: int, n: int, weights) -> tuple[int, list[tuple[int, int]]]:
    """The largest sum of weights of an ordered alignment of m with n places, and its places; weights(i) is a row.

    Only every sqrt(m)-th row of the table is kept; the way back makes the rows between them again.
    """
    step = math.isqrt(m) + 1

    def rows(first: int, last: int, row: np.ndarray):
        for i in range(first, last):
            new = np.zeros(n + 1, np.int64)
            np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weights(i)), out=new[1:])
            row = new
            yield row

    kept, last = [np.zeros(n + 1, np.int64)], np.zeros(n + 1, np.int64)
    for i, last in enumerate(rows(0, m, last), 1):
        if i % step == 0:
            kept.append(last)
    pairs, i, j = [], m, n
    while i and j:
        first = (i - 1) // step * step
        score = [kept[first // step], *rows(first, i, kept[first // step])]
        while i > first and j:
            now, before = score[i - first], score[i - first - 1]
            if now[j] == before[j]:
                i -= 1
            elif now[j] == now[j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
    return int(last[n]), pairs


def match(a: str, b: str) -> tuple[int, tuple[tuple[int, int], ...]]:
    """Simple tree matching: the largest number of node pairs of two ordered trees with equal labels, equal parents'
    pairs and kept order, and these pairs (node of a, node of b). Equal subtrees are one kind, and each pair of kinds is
    worked out once, lower ones first."""
    if (a, b) in _MATCHES:
        return _MATCHES[a, b]
    (la, ca), (lb, cb) = tree(a), tree(b)
    ids: dict[tuple, int] = {}
    below: list[tuple[str, tuple[int, ...]]] = []  # of each kind: its label and the kinds of its children
    sizes: list[int] = []
    heights: list[int] = []

    def kinds(labels, children) -> list[int]:
        out = [0] * len(labels)
        for x in range(len(labels) - 1, -1, -1):  # children follow their parents
            key = (labels[x], tuple(out[c] for c in children[x]))
            out[x] = ids.setdefault(key, len(ids))
            if out[x] == len(sizes):
                below.append(key)
                sizes.append(1 + sum(sizes[c] for c in key[1]))
                heights.append(1 + max((heights[c] for c in key[1]), default=0))
        return out

    ka, kb = kinds(la, ca), kinds(lb, cb)
    needed, todo = {(ka[0], kb[0])}, [(ka[0], kb[0])]
    while todo:
        x, y = todo.pop()
        if x != y:
            by_label: dict[str, list[int]] = {}
            for k in set(below[y][1]):
                by_label.setdefault(below[k][0], []).append(k)
            fresh = {(i, j) for i in set(below[x][1]) for j in by_label.get(below[i][0], ())} - needed
            needed |= fresh
            todo += fresh
    best: dict[tuple[int, int], tuple[int, list]] = {}
    for x, y in sorted(needed, key=lambda p: heights[p[0]]):
        kx, ky = below[x][1], below[y][1]
        if x == y:
            best[x, y] = sizes[x], []
        elif not kx or not ky:
            best[x, y] = 1, []
        else:
            some, where = np.unique(ky, return_inverse=True)
            rows = {i: np.array([best[i, j][0] if (i, j) in best else 0 for j in some.tolist()], np.int64)[where] for i in set(kx)}
            total, pairs = _aligned(len(kx), len(ky), lambda i, rows=rows, kx=kx: rows[kx[i]])
            best[x, y] = total + 1, pairs
    total, out, open_ = best[ka[0], kb[0]][0], [], [(0, 0)]
    while open_:
        x, y = open_.pop()
        out.append((x, y))
        same = ka[x] == kb[y]
        open_ += zip(ca[x], cb[y], strict=True) if same else [(ca[x][i], cb[y][j]) for i, j in best[ka[x], kb[y]][1]]
    if len(_MATCHES) >= REMEMBERED or _ROOM[0] < len(out):
        _MATCHES.clear()
        _ROOM[0] = PAIRS
    _ROOM[0] -= len(out)
    _MATCHES[a, b] = total, tuple(sorted(out))
    return _MATCHES[a, b]


def _totals(skeleton: str, mass: dict[int, float]) -> np.ndarray:
    """The text of each node's subtree."""
    _, children = tree(skeleton)
    total = np.zeros(len(children))
    for node, n in mass.items():
        total[node] += n
    for x in range(len(children) - 1, -1, -1):  # children follow their parents
        total[x] += sum(total[c] for c in children[x])
    return total


def main_container(skeleton: str, mass: dict[int, float]) -> int:
    """The node that holds the article: from the root on, the child with seven tenths of the text, as long as there is one
    that has children itself. One of several `article`s with text is not chosen: they belong together."""
    (labels, children), total = tree(skeleton), _totals(skeleton, mass)
    at = 0
    while total[at] > 0:
        down = [c for c in children[at] if total[c] >= 0.7 * total[0] and (children[c] or len(children[at]) == 1)]
        if not down or (labels[down[0]] == "article" and sum(labels[c] == "article" and total[c] > 0 for c in children[at]) > 1):
            break
        at = down[0]
    return at


def _ancestors(skeleton: str, node: int) -> list[int]:
    """The nodes from the root down to this one."""
    parents = {c: x for x, cs in enumerate(tree(skeleton)[1]) for c in cs}
    out = [node]
    while out[-1] in parents:
        out.append(parents[out[-1]])
    return out[::-1]


def common_node(skeleton: str, nodes: list[int]) -> int:
    """The deepest node that holds all of these."""
    paths = [_ancestors(skeleton, n) for n in nodes]
    at = 0
    while all(len(p) > at and p[at] == paths[0][at] for p in paths):
        at += 1
    return paths[0][at - 1]


def named_container(skeleton: str, mass: dict[int, float], least: float = 0.0) -> int | None:
    """The `main` or the `article` with text, if there is one; the deepest node that holds all its `article`s, if there are
    several; None without any. They must hold `least` of the text or a heading."""
    (labels, _), total = tree(skeleton), _totals(skeleton, mass)
    for kind in ("main", "article"):
        named = [x for x in range(len(labels)) if labels[x] == kind and total[x] > 0]
        if named:
            at = named[0] if len(named) == 1 else common_node(skeleton, named)
            if total[at] >= least * total[0] or any(labels[x] in ("h1", "h2") and total[x] > 0 for x in below(skeleton, at)):
                if kind == "article" or len(named) == 1:
                    return at
    return None


def own_container(skeleton: str, mass: dict[int, float]) -> int:
    """As main_container for a page that no other page explains: its named container, else the node with most of the text
    together with the page's one `h1`."""
    named = named_container(skeleton, mass)
    if named is not None:
        return named
    labels, at = tree(skeleton)[0], main_container(skeleton, mass)
    heads = [x for x in range(len(labels)) if labels[x] == "h1" and mass.get(x, 0) > 0]
    return common_node(skeleton, [at, heads[0]]) if len(heads) == 1 else at


def varying_container(skeleton: str, mass: dict[int, float]) -> int:
    """The container of a layout by the text that varies: structure tells more than mass, so its named container, else the
    deepest node that holds all of it."""
    named = named_container(skeleton, mass, NAMED)
    return named if named is not None else common_node(skeleton, [n for n, m in mass.items() if m > 0] or [0])


def doubtful(skeleton: str) -> set[int]:
    """The nodes within elements whose names leave it open whether they are article."""
    labels, out = tree(skeleton)[0], set()
    for x, label in enumerate(labels):
        if label.endswith("?") and x not in out:
            out |= below(skeleton, x)
    return out


def below(skeleton: str, top: int) -> set[int]:
    """The nodes of the subtree of `top`."""
    _, children = tree(skeleton)
    out, todo = set(), [top]
    while todo:
        x = todo.pop()
        out.add(x)
        todo += children[x]
    return out


def best_layout(skeleton: str, layouts, least: float) -> tuple[int, dict[int, int]]:
    """The layout that matches best, and the layout's node for each node of the page; -1 if none matches by `least`."""
    found = (-1, {}, 0.0)
    size = len(tree(skeleton)[0])
    for i, layout in enumerate(layouts):
        most = len(tree(layout)[0])
        if 2 * min(size, most) / (size + most) <= max(found[2], least):
            continue  # even a whole match would be too small
        score, pairs = match(skeleton, layout)
        share = 2 * score / (size + most)
        if share > max(found[2], least):
            found = (i, dict(pairs), share)
    return found[0], found[1]


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every page, from the whole html.

    Each page is parsed once, in linear time, into a tree of block elements; labels are the elements' names. The 8 skeletons
    (trees of labels) that most different pages of a host have are its references, less those that are rare and like
    another. A skeleton is aligned with the references by simple tree matching: one of ten pages or more joins a
    reference that matches four fifths of it and else stays a layout of its own; a rarer one joins the reference that
    matches best, by half at least, or else is a layout of its own if two pages have it. Over all different pages of a
    layout, of which there must be two, a text that one slot has on nine tenths of them is template, and what varies is
    content; of fewer than ten pages most of the text must vary, as near copies of one page would take its article for
    template. The layout's container is its `main` or `article` with varying text, and without one the deepest node that
    holds all text that varies. A page's text is what its container holds, less the template's texts: also a line that
    every article has ("By the staff") is template. Pages without a layout find their own container: their `main` or
    `article`, else the node with most of the text and the `h1`.

    What varies from page to page and still is no article, elements tell (nav, aside, footer, form, header outside an
    article, and so on) and classes, ids and roles all of whose words name adverts, menus, comments and the like. Names
    that paragraphs have as well (`share`, `notice`, ...) count only on pages without a layout.

    Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by
    one newline in page order; nothing is capped: trees of any depth and size are matched. Skeletons are matched, not
    pages; statistics are sums by slot and hash; no page text is grouped by host; what a skeleton's pages must know comes
    back by a salted join.

    A null or empty html, or one without content, has the empty text. A null url has the empty host. Repeated rows
    appear as often as they occur, and count as one page for the template; where all of a layout's texts are template
    (one page many times, with little differences elsewhere) its pages count as pages without a layout. A tag that is
    never closed ends at the next `>`; without one it is text. Other columns are ignored. An empty table gives an empty
    table.
    """

    def parse(batches):
        for batch in batches:
            rows = []
            for text in batch["html"]:
                page = Page(text)
                nodes, blocks = [n for n, _ in page.blocks], [b for _, b in page.blocks]
                rows.append((page.skeleton(), nodes, blocks, [_hash(b) for b in blocks], [len(b) for b in blocks], _hash("\n".join(blocks))))
            skel, nodes, blocks, hashes, sizes, whole = map(list, zip(*rows, strict=True)) if rows else ([],) * 6
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "host": batch["host"], "skel": skel, "nodes": nodes, "blocks": blocks, "hashes": hashes, "sizes": sizes, "whole": whole})

    slim = pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(url_col).alias("url"), url_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    kind = pages.schema[id_col].dataType.simpleString()
    parsed = slim.mapInPandas(parse, "page_id string, url string, host string, skel string, nodes array<int>, blocks array<string>, hashes array<long>, sizes array<int>, whole long")
    parsed = stash(parsed.withColumn("sid", F.xxhash64("host", "skel")), "pages", "zstd")

    # one row for each different page, and of each skeleton how many pages have it
    seen = stash(parsed.select("sid", "whole", "nodes", "hashes", "sizes").dropDuplicates(["sid", "whole"]), "slots")
    named = parsed.groupBy("sid").agg(F.first("host").alias("host"), F.first("skel").alias("skel"))
    skeletons = stash(seen.groupBy("sid").agg(F.count("*").alias("n")).join(named, "sid"), "skeletons")
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "skel"))
    top = skeletons.withColumn("r", rank).where(F.col("r") <= LAYOUTS)
    listed = top.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("r", "n", "sid", "skel"))).alias("x")).select("host", F.col("x.n").alias("ns"), F.col("x.sid").alias("sids"), F.col("x.skel").alias("layouts"))

    def lead(batches):
        """Rare references that are like one before them are none."""
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                kept: list[int] = []
                for i, n in enumerate(row.ns.tolist()):
                    if n >= FREQUENT or best_layout(row.layouts[i], [row.layouts[k] for k in kept], HALF)[0] < 0:
                        kept.append(i)
                out.append((row.host, [row.sids[i] for i in kept], [row.layouts[i] for i in kept]))
            yield pd.DataFrame(out, columns=["host", "sids", "layouts"])

    references = listed.mapInPandas(lead, "host string, sids array<long>, layouts array<string>")

    def align(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                sids = row.sids.tolist()
                at, nodes = (-1, {}) if row.sid in sids else best_layout(row.skel, row.layouts, ALIKE if row.n >= FREQUENT else HALF)
                size = len(tree(row.skel)[0])
                if at >= 0:
                    out.append((row.sid, row.skel, sids[at], row.layouts[at], [nodes.get(x, -1) for x in range(size)]))
                elif row.n >= LEAST_PAGES or row.sid in sids:
                    out.append((row.sid, row.skel, row.sid, row.skel, list(range(size))))
            yield pd.DataFrame(out, columns=["sid", "skel", "layout", "layout_skel", "slot_of"])

    aligned = salted_join(skeletons, references, ["host"], "sid").mapInPandas(align, "sid long, skel string, layout long, layout_skel string, slot_of array<int>")
    aligned = stash(aligned, "layouts")

    here = salted_join(seen, aligned.select("sid", "layout", "slot_of"), ["sid"], "whole").select("layout", "nodes", "hashes", "sizes", "slot_of")
    slot = F.transform("nodes", lambda n: F.get("slot_of", n)).alias("slot")
    block = here.select("layout", F.explode(F.array_distinct(F.arrays_zip(slot, "hashes", "sizes"))).alias("b")).select("layout", F.col("b.slot").alias("slot"), F.col("b.hashes").alias("hash"), F.col("b.sizes").alias("size"))
    counted = stash(block.where("slot >= 0").groupBy("layout", "slot", "hash").agg(F.count("*").alias("n"), F.first("size").alias("size")), "slots")
    pages_of = salted_join(seen.select("sid", "whole"), aligned.select("sid", "layout"), ["sid"], "whole").groupBy("layout").agg(F.count("*").alias("pages"))
    # a text that is template stands on two pages at least, so few rows meet the number of pages
    fixed = counted.where(F.col("n") >= LEAST_PAGES).join(pages_of, "layout").where(F.col("n") >= F.col("pages") * CONSTANT)
    both = counted.select("layout", "slot", (F.col("n") * F.col("size")).alias("mass"), F.lit(None).cast("long").alias("hash")).unionAll(fixed.select("layout", "slot", (-F.col("n") * F.col("size")).alias("mass"), "hash"))
    slots = both.groupBy("layout", "slot").agg(F.sum("mass").cast("double").alias("mass"), F.sum(F.greatest("mass", F.lit(0))).cast("double").alias("whole"), F.collect_set("hash").alias("fixed"))
    of_layout = slots.groupBy("layout").agg(F.sum("whole").alias("whole"), F.collect_list(F.struct("slot", "mass", "fixed")).alias("slots")).join(pages_of, "layout")
    skel_of = aligned.groupBy("layout").agg(F.first("layout_skel").alias("layout_skel"))

    def decide(batches):
        for batch in batches:
            mains = []
            for skel, found, whole, n in zip(batch["layout_skel"], batch["slots"], batch["whole"], batch["pages"], strict=True):
                varies = sum(s["mass"] for s in found)
                told = n >= LEAST_PAGES and varies > (0 if n >= FREQUENT else HALF * whole)
                mains.append(varying_container(skel, {s["slot"]: s["mass"] for s in found}) if told else -1)
            fixed_ = [[{"slot": s["slot"], "hash": h} for s in found for h in s["fixed"]] for found in batch["slots"]]
            yield pd.DataFrame({"layout": batch["layout"], "main": mains, "fixed": fixed_})

    wrappers = stash(skel_of.join(of_layout, "layout").mapInPandas(decide, "layout long, main int, fixed array<struct<slot:int,hash:long>>"), "wrappers")

    def guide(batches):
        """The wrapper of each skeleton in the skeleton's own nodes: those inside the main one, and (node, text)s to leave."""
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                own: dict[int, list[int]] = {}
                for x, s in enumerate(row.slot_of):
                    own.setdefault(int(s), []).append(x)
                if row.main >= 0 and (mains := own.get(row.main)):
                    out.append((row.sid, sorted(below(row.skel, mains[0])), [{"node": x, "hash": f["hash"]} for f in row.fixed for x in own.get(f["slot"], ())]))
            yield pd.DataFrame(out, columns=["sid", "inside", "leave"])

    guides = salted_join(aligned.select("sid", "skel", "layout", "slot_of"), wrappers, ["layout"], "sid").mapInPandas(guide, "sid long, inside array<int>, leave array<struct<node:int,hash:long>>")
    guides = stash(guides, "guides")

    def extract(batches):
        for batch in batches:
            texts = []
            for row in batch.itertuples(index=False):
                if row.inside is None:
                    own: dict[int, float] = {}
                    unsure = doubtful(row.skel)
                    for n, s in zip(row.nodes, row.sizes, strict=True):
                        if n not in unsure:
                            own[n] = own.get(n, 0) + s
                    inside, leave = below(row.skel, own_container(row.skel, own)) - unsure, set()
                else:
                    inside, leave = set(row.inside), {(f["node"], f["hash"]) for f in row.leave}
                texts.append("\n".join(b for n, b, h in zip(row.nodes, row.blocks, row.hashes, strict=True) if n in inside and (n, h) not in leave))
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    full = salted_join(parsed.select("page_id", "url", "sid", "whole", "skel", "nodes", "blocks", "hashes", "sizes"), guides, ["sid"], "whole", "left")
    out = full.mapInPandas(extract, "page_id string, url string, text string, n_chars long")
    for used in (seen, skeletons, aligned, counted, wrappers):
        discard(used)
    return out.select(F.col("page_id").cast(kind).alias("page_id"), "url", "text", "n_chars")


def op1_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages"))
