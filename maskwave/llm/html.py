"""Operator 3: main text of web pages by removal of site templates."""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, spread_join, table, written
from .urls import url_parts

#: A text, or a tag whose attributes hold neither < nor >: what most of a page is. It looks no further than the next of these.
PLAIN = re.compile("<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*')*+)>|[^<]+")
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
SPECIAL = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
# Elements by what they are for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object select button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
MAIN = frozenset("article main".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd tr td th caption figcaption hgroup address header hr".split())
CLOSED_BY = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
FURNITURE = frozenset("nav footer aside form dialog menu head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
NAMES = frozenset("ad ads advert advertisement adsbygoogle banner breadcrumb breadcrumbs comment comments comment-list consent cookie cookies cookie-banner disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo related share sharing sidebar site-footer site-header social sponsored subscribe toolbar widget".split())
#: Names that say, inside an article, no more than the element <header> does: that a box begins it.
HEADS = frozenset("header masthead".split())
#: Articles of these classes are readers' remarks wherever they stand.
REMARKS = frozenset("comment comments comment-list".split())
#: A subtree is a template if this share of its host's distinct pages has it, and at least so many of them.
SHARE, LEAST = 0.3, 3
#: Elements that an open p, li, dt, dd, tr, td, th or option outside them isn't closed from within.
BOUNDARIES = frozenset("div section article main body ul ol table td".split())
#: End tags that don't reach out of an article, main or body.
KEPT_INSIDE = INLINE | frozenset("p li div".split())


class _Node:
    __slots__ = ("tag", "names", "parent", "parts", "skip", "main", "hash", "named")

    def __init__(self, tag: str, names: frozenset, parent: _Node | None):
        self.tag, self.names, self.parent = tag, names, parent
        self.parts: list = []
        self.hash = None
        inside = bool(parent and parent.main)
        self.main = inside or tag in MAIN
        remark = tag == "article" and bool(names & (NAMES if inside else REMARKS))
        body = tag in ("html", "body") or (tag in MAIN and not remark)
        # Inside an article names speak for boxes alone; whether a paragraph or heading of such a name is furniture, its count decides.
        self.named = inside and not body and bool(names & NAMES) and (tag in PROSE or tag in INLINE or not names & NAMES - HEADS)
        self.skip = bool(parent and parent.skip) or (not body and (tag in FURNITURE or (tag == "header" and not inside) or (bool(names & NAMES) and not self.named)))


def _names(attributes: str) -> frozenset:
    if not attributes or "=" not in attributes:
        return frozenset()
    out = set()
    for kind, value in ATTRIBUTE.findall(attributes):
        words = value.strip("\"'").lower().split()
        out.update(["ad"] if kind.lower() == "role" and ROLES & set(words) else [] if kind.lower() == "role" else words)
    return frozenset(out)


class _Ends:
    """Where tags end: the first > outside quotes. From a mark (>, " or ') outside quotes the way on is always the same, so marks from which
    no end was found are remembered, and each is passed once."""

    def __init__(self, page: str):
        self.page, self.near, self.dead = page, -1, set()

    def _mark(self, at: int) -> int:
        found = SPECIAL.search(self.page, at)
        return found.start() if found else len(self.page)

    def of(self, at: int) -> int:
        """The place of the > of a tag whose name ends at ``at``, or -1."""
        if self.near < at:
            self.near = self._mark(at)
        passed, mark = [], self.near
        while mark < len(self.page) and mark not in self.dead:
            if self.page[mark] == ">":
                return mark
            passed.append(mark)
            close = self.page.find(self.page[mark], mark + 1)
            mark = self._mark(close + 1) if close >= 0 else len(self.page)
        self.dead.update(passed)
        return -1


def _tokens(page: str) -> Iterator[tuple[str | None, str, str]]:
    """(tag, attributes, "" or "/" for an end tag) of tags and (None, text, "") of texts, in order; comments and what a raw element holds up
    to its end tag, or the page's end, are passed over. A < that begins no tag is text."""
    at, ends, size, last = 0, _Ends(page), len(page), page.rfind(">")
    while at < size:
        for m in PLAIN.finditer(page, at):
            if m.start() != at:
                break
            at = m.end()
            closing, tag, attributes = m.groups()
            if tag is None:
                yield None, m.group(), ""
                continue
            yield tag, attributes, closing
            if tag.lower() in RAW and not closing and not attributes.endswith("/"):
                at = _after_raw(page, tag, at)
                break
        if at >= size:
            return
        if page[at] != "<" or PLAIN.match(page, at):
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else size
            continue
        if page.startswith(("<!", "<?"), at) and last > at:
            at = page.find(">", at) + 1
            continue
        m = TAG.match(page, at)
        end = ends.of(m.end()) if m and last > at else -1
        if end < 0:
            yield None, "<", ""
            at += 1
            continue
        tag, attributes, at = m.group(2), page[m.end() : end], end + 1
        yield tag, attributes, m.group(1)
        if tag.lower() in RAW and not m.group(1) and not attributes.endswith("/"):
            at = _after_raw(page, tag, at)


def _after_raw(page: str, tag: str, at: int) -> int:
    close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
    return close.end() if close else len(page)


class _Open:
    """The open elements, outermost first, and where those of each tag stand, so that a tag costs no climb."""

    def __init__(self, root: _Node):
        self.nodes = [root]
        self.places: dict[str, list[int]] = {}
        self.bounds: list[int] = [0]
        self.bodies: list[int] = [0]

    def push(self, node: _Node) -> None:
        at = len(self.nodes)
        self.nodes.append(node)
        self.places.setdefault(node.tag, []).append(at)
        if node.tag in BOUNDARIES:
            self.bounds.append(at)
        if node.tag in MAIN or node.tag == "body":
            self.bodies.append(at)

    def cut(self, at: int) -> None:
        """Closes the element at a place and all inside it."""
        while len(self.nodes) > at:
            node = self.nodes.pop()
            self.places[node.tag].pop()
            for places in (self.bounds, self.bodies):
                if places[-1] == len(self.nodes):
                    places.pop()

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else -1

    def end(self, tag: str) -> None:
        at = self.last(tag)
        if at > 0 and not (tag in KEPT_INSIDE and self.bodies[-1] > at):
            self.cut(at)

    def begin(self, tag: str) -> None:
        """Closes the nearest element that the new one ends, if no boundary lies between; a boundary itself may be ended too."""
        near = max((self.last(t) for t, enders in CLOSED_BY.items() if tag in enders), default=-1)
        if near > 0 and near >= self.bounds[-1]:
            self.cut(near)


def parse(page: str | None) -> _Node:
    """A tree of elements and texts; unclosed elements end where HTML lets them, and a cut page ends all of them. In time linear in the page."""
    root = _Node("", frozenset(), None)
    opened = _Open(root)
    for tag, text, closing in _tokens(page or ""):
        if tag is None:
            opened.nodes[-1].parts.append(text)
            continue
        tag = tag.lower()
        if closing:
            opened.end(tag)
            continue
        if tag in RAW:
            continue
        if tag == "br":
            opened.nodes[-1].parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                opened.nodes[-1].parts.append(None)
            continue
        opened.begin(tag)
        if text.endswith("/"):
            continue
        node = opened.nodes[-1]
        child = _Node(tag, _names(text), node)
        node.parts.append(child)
        opened.push(child)
    return root


def _inside_out(top: _Node, enter) -> list[_Node]:
    """top and the elements below it that ``enter`` lets in, in reverse page order, so that children come before parents."""
    out, todo = [], [top]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [p for p in reversed(node.parts) if isinstance(p, _Node) and enter(p)]
    return out[::-1]


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _hash(node: _Node, kind: str) -> int:
    """Hash of an element's subtree from its tag, its names, its texts and its children's hashes."""
    parts = [p if isinstance(p, str) else "|" if p is None else "" if p.hash is None else f"{p.hash:x}" for p in node.parts]
    return xxhash.xxh64_intdigest(f"{kind}{node.tag} {' '.join(sorted(node.names))}<{' '.join(' '.join(parts).split())}>".encode("utf-8", "replace"))


def _digest(root: _Node) -> dict[int, int]:
    """Hashes of every block outside the article, and of boxes inside it, by the element's identity."""
    out: dict[int, int] = {}
    for node in _inside_out(root, lambda p: not (p.main and p.parent.main)):
        if node.main:
            if not node.skip:
                out |= _boxes(node)
            node.hash = 0
        elif node.tag not in ("", "html", "body", "head"):
            node.hash = _hash(node, "")
            if node.tag not in INLINE:
                out[id(node)] = _signed(node.hash)
    return out


def _boxes(top: _Node) -> dict[int, int]:
    """Hashes of the boxes in an article: blocks that are no prose (div, section, ul, ...), or have a name of furniture, and hold less than half
    of its text.

    Other paragraphs may be quoted and a wrapper may hold the article itself, so neither is ever a template."""
    size: dict[int, int] = {}
    found: list[_Node] = []
    order = _inside_out(top, lambda p: not p.skip)
    boxed: set[int] = set()  # boxes and what is in them; prose outside boxes isn't hashed
    for node in reversed(order):
        if node is not top and (id(node.parent) in boxed or node.named or (node.tag not in INLINE and node.tag not in PROSE)):
            boxed.add(id(node))
    for node in order:
        size[id(node)] = sum(size.get(id(p), 0) if isinstance(p, _Node) else 1 if p is None else len(p.strip()) for p in node.parts)
        if id(node) in boxed:
            node.hash = _hash(node, "box ")
            if (node.named or (node.tag not in INLINE and node.tag not in PROSE)) and size[id(node)]:
                found.append(node)
    return {id(n): _signed(n.hash) for n in found if 2 * size[id(n)] < size[id(top)]}


def subtree_hashes(page: str | None) -> list[int]:
    """The distinct hashes of the page's blocks outside the article and of the boxes inside it."""
    return sorted(set(_digest(parse(page)).values()))


#: A page as read: the text of each block with the place of the innermost hashed element around it (-1: none), and of each hashed element its
#: hash with the place of the next one around it.
Page = tuple[list[tuple[str, int]], list[tuple[int, int]]]


def _read(top: _Node, hashes: dict[int, int], page: Page) -> None:
    """Appends top's blocks and hashed elements in page order."""
    blocks, elements = page
    line: list[str] = []

    def close(place: int) -> None:
        if line:
            text = " ".join(entities.unescape("".join(line)).split())
            line.clear()
            if text:
                blocks.append((text, place))

    def enter(node: _Node, place: int):
        block = node.tag not in INLINE
        if block:
            close(place)
        if node.skip:
            return None
        if (own := hashes.get(id(node))) is not None:
            elements.append((own, place))
            place = len(elements) - 1
        return iter(node.parts), place, block

    first = enter(top, -1)
    stack = [first] if first else []
    while stack:
        parts, place, block = stack[-1]
        for p in parts:
            if p is None:
                close(place)
            elif isinstance(p, str):
                line.append(p)
            else:
                if (inner := enter(p, place)) is not None:
                    stack.append(inner)
                break
        else:
            stack.pop()
            if block:
                close(place)
    close(-1)


def read_page(page: str | None) -> Page:
    """The blocks of a page that are no furniture (menus, footers, forms, adverts, ...): those of its article, where it marks one, else all."""
    root = parse(page)
    out: Page = ([], [])
    for node in _inside_out(root, lambda p: not p.skip and not (p.main and p.parent.main))[::-1]:
        if node.main:
            _read(node, _boxes(node), out)
    if not out[0]:
        out[1].clear()
        _read(root, _digest(root), out)
    return out


def text_without(page: Page, gone: set[int]) -> str:
    """The blocks that no element of these hashes holds, joined by line ends."""
    blocks, elements = page
    dead: list[bool] = []
    for own, outer in elements:  # outer elements come first
        dead.append(own in gone or (outer >= 0 and dead[outer]))
    return "\n".join(t for t, place in blocks if place < 0 or not dead[place])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [subtree_hashes(p) for p in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.record_batch([*batch.columns[:-1], pa.array(found, pa.list_(pa.int64()))], [*batch.schema.names[:-1], "hashes"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = batch.column(batch.num_columns - 1).to_pylist()
        blob = [zlib.compress(json.dumps(read_page(p), ensure_ascii=False).encode("utf-8", "replace"), 1) for p in pages]
        yield pa.record_batch([*batch.columns[:-1], pa.array(blob, pa.binary())], [*batch.schema.names[:-1], "blob"])


def main_text(pages: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """page_id, url and text of every row of pages.

    Each page is parsed into a tree; every element's subtree outside the marked article is hashed, and inside it every box (no prose, and less
    than half of its text); the distinct pages of each host that have a hash are counted, and subtrees that recur on a ``share`` of the host's distinct pages, and on ``least``, are deleted. What elements
    say of themselves (nav, footer, form, class "ad", ...) removes furniture that differs from page to page; the marked article, where there is
    one, is the main text without its recurring boxes; a paragraph in it that many articles quote is kept. In an article such names speak for boxes
    alone (and not "header"): a paragraph, heading or span that has one goes if it recurs like a box. Blocks are joined by line ends, white space in them
    becomes one space.

    Null, empty and textless pages give "". Rows without a host count together. Rows of a host with the same html are one page, given
    as often. Counting shuffles one row of numbers a page and subtree; pages meet only their own templates,
    so a host with a third of all pages is nowhere in one task. Extra columns are ignored.
    """
    host = url_parts(F.col("url"))[0]
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    keyed = rows.select("page_id", "url", F.xxhash64(host).alias("host"), "html")
    keyed = keyed.select("page_id", "url", "host", F.xxhash64("host", "html").alias("a"), F.hash("html", "host").alias("b"), "html")
    hashed = keyed.select("host", "a", "b", "html").mapInArrow(_hashes, "host long, a long, b int, hashes array<long>")
    parsed = keyed.select("page_id", "url", "a", "b", "html").mapInArrow(_blocks, "page_id long, url string, a long, b int, blob binary")
    seen = hashed.select("a", "b", "host", F.explode("hashes").alias("hash")).distinct().withColumn("at", F.xxhash64("host", "hash"))
    sizes = written(keyed.select("host", "a", "b").distinct().groupBy("host").agg(F.count("*").alias("pages")), "hosts")
    counted = seen.groupBy("at").agg(F.count("*").alias("n"), F.first("host").alias("host")).where(F.col("n") >= least)
    often = spread_join(counted, sizes, "host", hot_keys(sizes, "host", "pages"), F.col("at")).where(F.col("n") >= F.col("pages") * share - 1e-9).select("at")
    mine = seen.join(often, "at").groupBy("a", "b").agg(F.collect_set("hash").alias("templates"))
    out = parsed.join(mine, ["a", "b"], "left")

    @F.pandas_udf("string")
    def text(blobs: pd.Series, templates: pd.Series) -> pd.Series:
        gone = [set() if g is None else set(g) for g in templates]
        return pd.Series([text_without(json.loads(zlib.decompress(b)), g) for b, g in zip(blobs, gone, strict=True)], dtype=object)

    return out.select("page_id", "url", text("blob", "templates").alias("text"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``main_text`` of all pages."""
    out = main_text(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
