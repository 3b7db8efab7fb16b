"""Pages of shops and makers as rows: cards of a schedule or brand, an item's detail, a board's list, a post, a mall's list.

Each reader is a function from a page's text to plain values, wrapped as an Arrow batch function; a page that lacks a part
gives null for it, broken markup is read as far as it goes, null pages give null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Node:
    """An element: tag, attributes, children (nodes and texts)."""

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.classes = (attrs.get("class") or "").split()

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order; no recursion, however deep."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def all(self, tag: str | None = None, kind: str | None = None) -> list[Node]:
        return [n for n in self.walk() if (tag is None or n.tag == tag) and (kind is None or kind in n.classes)]

    def first(self, tag: str | None = None, kind: str | None = None) -> Node | None:
        return next((n for n in self.walk() if (tag is None or n.tag == tag) and (kind is None or kind in n.classes)), None)

    def within(self, tag: str) -> Node | None:
        n = self.parent
        while n is not None and n.tag != tag:
            n = n.parent
        return n

    def texts(self) -> Iterator[str]:
        stack: list = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, Node):
                stack += [] if n.tag in ("script", "style", "noscript") else list(reversed(n.children))
            elif t := n.strip():
                yield t

    def text(self) -> str:
        return re.sub(r"\s+", " ", " ".join(self.texts()))


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(html: str) -> Node:
    p = _Tree()
    p.feed(html)
    p.close()
    return p.root


def price_of(text: str | None, unit: str = "円") -> int | None:
    m = re.search(rf"(\d[\d,]*)\s*{unit}", text or "")
    return int(m[1].replace(",", "")) if m else None


def release_of(text: str | None) -> tuple[str | None, str | None]:
    """(month, day) of a Japanese date; a month that isn't one gives none."""
    m = re.search(r"(\d{4})年\s*(\d{1,2})月(?:\s*(\d{1,2})日)?", text or "")
    if not m or not 1 <= int(m[2]) <= 12:
        return None, None
    month = f"{int(m[1]):04d}-{int(m[2]):02d}"
    return month, f"{month}-{int(m[3]):02d}" if m[3] else None


_ID = re.compile(r"/item/(01_\d+|item-\d+)/?(?:[?#].*)?$")
CARD = "id string, nameJa string, priceJpy bigint, channel string, month string, date string"


def cards(root: Node) -> list[tuple]:
    """The product cards of a listing, the first of an id; links to anything else are left."""
    out: dict[str, tuple] = {}
    for a in root.all("a", "p-card"):
        name, m = a.first(kind="p-card__tit"), _ID.search(a.attrs.get("href", "").strip())
        if name is None or not m:
            continue
        online = m[1].startswith("item-")
        tag = next(iter(a.all(kind="p-card__tag")), None)
        marks = " ".join(tag.classes) if tag else ""
        channel = "online" if online or "-online" in marks else "gbase" if "-gbase" in marks or "-sidef" in marks else "general"
        price, day = a.first(kind="p-card__price"), a.first(kind="p-card_date")
        key = ("pb-" if online else "bh-") + m[1]
        out.setdefault(key, (key, name.text(), price_of(price.text()) if price else None, channel, *release_of(day.text() if day else None)))
    return list(out.values())


def listing(html: str, most: int = 30) -> tuple:
    """(cards, last page): the greatest number of the pager up to ``most``; 1 without one."""
    root = tree(html)
    links = [a.attrs.get("href", "") for a in root.all("a") if any(c.startswith("c-archives__pagination") for c in a.classes)]
    numbers = [int(m[1]) for x in links if (m := re.search(r"[?&]p=(\d+)", x))]
    return cards(root), min(max([1, *numbers]), most)


DETAIL = "nameJa string, priceJpy bigint, month string, date string, brandKeys array<string>, seriesKey string, series string, images array<string>"


def detail(html: str) -> tuple:
    """An item's page: name, price, release, brand keys in order, the first series, pictures that stay."""
    root = tree(html)
    h1 = root.first("h1", "p-heading__h1-product")
    fields: dict[str, str] = {}
    for dl in root.all("dl", "pg-products__detail"):
        label = None
        for n in dl.walk():
            if n.tag == "dt":
                label = n.text()
            elif n.tag == "dd" and label:
                fields.setdefault(label, n.text())
    keys, series = [], (None, None)
    for a in root.all("a", "p-card__flat"):
        if m := re.search(r"/(brand|series)/([^/?#]+)", a.attrs.get("href", "")):
            if m[1] == "brand":
                keys.append(m[2])
            elif series == (None, None):
                series = (m[2], (a.first(kind="p-card__flatTit") or a).text())
    pictures = [i.attrs.get("src", "").strip() for box in root.all(kind="pg-products__contentLeft") for i in box.all("img")]
    stable = [u for u in pictures if u.startswith("https://") and "Expires=" not in u and "Signature=" not in u and "/images/common/" not in u]
    return h1.text() if h1 else None, price_of(fields.get("価格")), *release_of(fields.get("発売日")), list(dict.fromkeys(keys)), *series, list(dict.fromkeys(stable))


BOARD = "id string, date string, title string, category string"


def board(html: str) -> list[tuple]:
    """A board's posts without the pinned ones, the first of an id; the day stands in the row, the category beside the title."""
    out: dict[str, tuple] = {}
    for a in tree(html).all("a"):
        href = a.attrs.get("href", "")
        m, row, cell = re.search(r"board_view\.asp\?.*?B_iID=(\d+)", href, re.I), a.within("tr"), a.within("td")
        if not m or "notice=true" in href.lower() or row is None:
            continue
        title, day = a.text(), re.search(r"\d{4}-\d{2}-\d{2}", row.text())
        kind = cell.text().replace(title, "").strip() if cell else ""
        out.setdefault(m[1], (m[1], day[0] if day else None, title, kind or None))
    return list(out.values())


POST = "title string, intro string, restock boolean, rows array<struct<code string, name string, price bigint>>"
_CODE, _ANY, _WON = re.compile(r"BD\d{7}"), re.compile(r"[A-Z]{2,4}\d{4,8}"), re.compile(r"([\d,]+)\s*원")


def post(html: str) -> tuple:
    """A post: title, the text before its first code, whether it tells of a restock, and its records of three lines - code, name, price.
    A price may be missing; a record with a code or a price for a name is broken; the first of a code counts."""
    root = tree(html)
    top = root.first("td", "Board_View_top")
    title = top.text() if top else None
    lines = [x.strip() for t in (top.within("table") or root if top else root).texts() for x in t.split("\n") if x.strip()]
    first = next((i for i, x in enumerate(lines) if _ANY.fullmatch(x)), len(lines))
    intro, rows, i = " ".join(lines[:first]), {}, first
    while i < len(lines):
        step = 1
        if _CODE.fullmatch(lines[i]) and i + 1 < len(lines) and not _ANY.fullmatch(lines[i + 1]) and not _WON.fullmatch(lines[i + 1]):
            price = _WON.fullmatch(lines[i + 2]) if i + 2 < len(lines) else None
            rows.setdefault(lines[i], (lines[i], lines[i + 1], int(price[1].replace(",", "")) if price else None))
            step = 3 if price else 2
        i += step
    return title, intro, "재입고" in f"{title or ''} {intro}", list(rows.values())


MALL = "gno string, name string, series string, price bigint, soldOut boolean, imgPath string"


def mall(html: str) -> tuple:
    """(goods, pages, ok): a mall's list; not ok if it has no row or fewer than half can be read."""
    root = tree(html)
    rows = [n for n in root.all("li") if "data-childno" in n.attrs]
    out: dict[str, tuple] = {}
    read = 0
    for li in rows:
        a, name, cost = next((x for x in li.all("a", "thumb") if "href" in x.attrs), None), li.first("h5"), next((n for p in li.all(kind="price") for n in p.all(kind="num")), None)
        m, price = re.search(r"gno=(\d+)", a.attrs["href"]) if a else None, re.search(r"[\d,]+", cost.text()) if cost else None
        if not (m and price and name and name.text()):
            continue
        read += m[1] not in out
        said = " ".join([*(n.text() for k in ("badge", "thumb-dim") for n in li.all(kind=k)[:1]), *li.classes])
        box, series = li.first(kind="img_box"), li.first(kind="caption")
        path = re.search(r"/(goods/(?:big|middle)/\d{8}/[0-9a-f]{32}\.(?:jpe?g|png|webp))", box.attrs.get("style", "")) if box else None
        out.setdefault(m[1], (m[1], name.text(), (series.text() if series else None) or None, int(price[0].replace(",", "")), bool(re.search(r"품절|sold[\s_-]?out", said, re.I)), path[1] if path else None))
    pages = [int(x) for x in re.findall(r"pageLink\('(\d+)'\)", html)]
    return list(out.values()), max([1, *pages]), bool(rows) and read * 2 >= len(rows)


def reader(read: Callable[[str], object], kind: str):  # noqa: ANN201
    """A reader as a column function; ``kind`` is the type of what it gives."""
    struct = not kind.startswith("array")
    names = re.findall(r"(?:^|, )(\w+) ", re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", kind))) if struct else []

    @F.pandas_udf(kind)
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None,) * len(names) if x is None else read(x) for x in pages], columns=names, dtype="object")

    @F.pandas_udf(kind)
    def rows(pages: pd.Series) -> pd.Series:
        keys = [f.split()[0] for f in kind.removeprefix("array<struct<").removesuffix(">>").split(", ")]
        return pd.Series([None if x is None else [dict(zip(keys, r, strict=True)) for r in read(x)] for x in pages])

    return run if struct else rows
