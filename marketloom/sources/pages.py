"""Product cards and article fields from stored pages, in one scan of each page."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.html import VOID, attributes, tokens
from ..session import ship

#: Words in a class or item type that make an element a product card, and one of its parts.
CARD = re.compile(r"(?:^|[-_\s/])products?(?:[-_]?(?:card|item|tile|box|inner))?(?:$|\s)", re.I)
PARTS = {k: re.compile(rf"(?:^|[-_\s])(?:{v})(?:$|[-_\s])", re.I) for k, v in {"name": "name|title", "price": "price|amount", "brand": "brand", "category": "category"}.items()}
#: Attributes and elements that tell a part.
DATA = {"data-sku": "sku", "data-product_sku": "sku", "data-brand": "brand", "data-category": "category"}
TELLING = {"del": ("old",), "ins": ("new",), "h2": ("name",), "h3": ("name",), "h4": ("name",)}
_MONEY = re.compile(r"[0-9][0-9,]*(?:\.[0-9]+)?")
_DATE = re.compile(r"\b(\d{4}-\d{2}-\d{2})\b")
_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")
_HOST = re.compile(r"[a-z]+://(?:www\.)?([^/?#]*)", re.I)
#: Pages of a batch whose fields are held at a time.
PAGES = 256
FIELDS = {"page_id": pa.int64(), "position": pa.int32(), "name": pa.string(), "url": pa.string(), "sku": pa.string(), "regular_price": pa.float64(), "sale_price": pa.float64(), "brand": pa.string(), "category": pa.string()}


def money(text: str | None) -> float | None:
    m = _MONEY.search(text or "")
    return float(m[0].replace(",", "")) if m else None


def flat(text: str) -> str:
    return " ".join(unescape(text).split())


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, tag, value): text, open (value: attributes), close; void elements close at once, raw ones keep their content as value."""
    at = 0
    for start, end, name, closing, attrs, content in tokens(page):
        if start > at:
            yield "text", "", page[at:start]
        at = end
        if name is None:
            continue
        if closing:
            yield "close", name, ""
        elif content or name in ("script", "style", "title"):
            yield "raw", name, attrs + "\0" + content
        else:
            yield "open", name, attrs
            if name in VOID or attrs.endswith("/"):
                yield "close", name, ""
    if at < len(page):
        yield "text", "", page[at:]


class Card:
    """What a card has said so far; parts are collected while their element is open."""

    __slots__ = ("depth", "linked", "listed", "open", "place", "said", "texts")

    def __init__(self, depth: int, attrs: dict[str, str], listed: bool):
        self.depth, self.listed, self.linked, self.place = depth, listed, False, 0
        self.said = {"sku": attrs.get("data-sku") or attrs.get("data-product_sku"), "brand": attrs.get("data-brand"), "category": attrs.get("data-category"), "url": None}
        self.texts: dict[str, list[str]] = {}
        self.open: list[tuple[str, int]] = []

    def start(self, tag: str, attrs: dict[str, str], depth: int) -> None:
        for n in DATA.keys() & attrs.keys():
            self.said[DATA[n]] = self.said[DATA[n]] or attrs[n] or None
        if tag == "meta" and attrs.get("itemprop") in ("sku", "brand", "category", "name", "price") and attrs.get("content"):
            self.texts.setdefault(attrs["itemprop"], []).append(attrs["content"])
        if tag == "a" and attrs.get("href") and not self.linked:
            self.linked, self.said["url"] = True, attrs["href"]
            self.open.append(("link", depth))
        kind = attrs and attrs.get("itemprop", "") + " " + attrs.get("class", "")
        parts = [k for k, rx in PARTS.items() if rx.search(kind)] if kind else []
        parts += TELLING.get(tag, ())
        self.open += [(p, depth) for p in parts if p not in self.texts]

    def text(self, text: str) -> None:
        for p, _ in self.open:
            self.texts.setdefault(p, []).append(text)

    def end(self, depth: int) -> None:
        self.open = [(p, d) for p, d in self.open if d < depth]

    def row(self) -> dict | None:
        """Name, address, sku, prices, brand and category; None without a link."""
        if not self.linked:
            return None
        part = lambda k: flat("".join(self.texts[k])) if k in self.texts else None
        old, new = money(part("old")), money(part("new"))
        if old is None and new is None:
            old = money(part("price"))
        named = part("link") if self.listed else None
        return {"name": named or part("name") or part("link") or "", "url": self.said["url"], "sku": self.said["sku"] or part("sku"), "regular_price": old, "sale_price": new,
                "brand": self.said["brand"] or part("brand"), "category": self.said["category"] or part("category")}


def cards_of(page: str) -> list[dict]:
    """The cards of a page in order: list items with a link, elements whose class or item type names a product, and products
    of embedded JSON-LD. An inner card takes what lies in it; an unclosed list item ends at the next one."""
    out: list[tuple[int, dict]] = []
    stack: list[str] = []
    cards: list[Card] = []
    place = 0

    def finish(card: Card) -> None:
        if row := card.row():
            out.append((card.place, row))

    def close(to: int) -> None:
        while cards and cards[-1].depth > to:
            finish(cards.pop())
        if cards:
            cards[-1].end(to + 1)
        del stack[to:]

    opened: dict[str, list[int]] = {}
    for kind, tag, value in events(page):
        if kind == "text":
            if cards:
                cards[-1].text(value)
        elif kind == "raw":
            attrs, content = value.split("\0", 1)
            if tag == "script" and "ld+json" in attrs:
                for row in products_of(content):
                    out.append((place, row))
                    place += 1
        elif kind == "open":
            if tag == "li" and opened.get("li") and not any(opened.get(t) and opened[t][-1] > opened["li"][-1] for t in ("ul", "ol", "menu")):
                to = opened["li"][-1] - 1
                close(to)
                for v in opened.values():
                    while v and v[-1] > to:
                        v.pop()
            attrs = attributes(value) if value else {}
            stack.append(tag)
            opened.setdefault(tag, []).append(len(stack))
            product = bool(attrs) and CARD.search(attrs.get("class", "") + " " + attrs.get("itemtype", ""))
            if tag == "li" or product:
                card = Card(len(stack), attrs, listed=not product)
                card.place, place = place, place + 1
                cards.append(card)
            elif cards:
                cards[-1].start(tag, attrs, len(stack))
        elif opened.get(tag):
            to = opened[tag][-1] - 1
            close(to)
            for v in opened.values():
                while v and v[-1] > to:
                    v.pop()
    close(0)
    return [row for _, row in sorted(out, key=lambda x: x[0])]


def products_of(content: str) -> Iterator[dict]:
    """Products of a JSON-LD script, wherever they stand in it; broken JSON has none."""
    try:
        todo = [json.loads(content)]
    except (ValueError, RecursionError):
        return
    named = lambda x: x.get("name") if isinstance(x, dict) else x
    text = lambda x: None if x is None else str(x)
    while todo:
        x = todo.pop(0)
        if isinstance(x, list):
            todo = x + todo
        elif isinstance(x, dict):
            kinds = x.get("@type")
            if "Product" in (kinds if isinstance(kinds, list) else [kinds]):
                offer = x.get("offers")
                offer = offer[0] if isinstance(offer, list) and offer else offer
                price = offer.get("price") or offer.get("lowPrice") if isinstance(offer, dict) else None
                yield {"name": flat(str(x.get("name") or "")), "url": text(x.get("url")), "sku": text(x.get("sku")), "regular_price": money(text(price)), "sale_price": None,
                       "brand": text(named(x.get("brand"))), "category": text(named(x.get("category")))}
            else:
                todo = [v for v in x.values() if isinstance(v, (dict, list))] + todo


def product_cards(pages: DataFrame) -> DataFrame:
    """One row per product card of stored pages: name, url, sku, regular and sale price, brand, category.

    A null page has none; broken markup costs no more time than whole."""
    schema = "page_id long, position int, name string, url string, sku string, regular_price double, sale_price double, brand string, category string"

    def run(batches):
        for batch in batches:
            rows = [{"page_id": page, "position": i} | row for page, html in zip(*(batch.column(i).to_pylist() for i in range(2))) for i, row in enumerate(cards_of(html or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in FIELDS.items()], list(FIELDS))

    ship(pages.sparkSession)
    return pages.select("page_id", "html").mapInArrow(run, schema)


def article_of(page: str) -> tuple[str, str, str | None]:
    """(title, paragraphs joined by line ends, first date): paragraphs of the first article element, else of the whole page; the
    title is the first h1, else the title element; the date that of the first datetime attribute, else the first in a text."""
    title = heading = None
    inside, took, date, written = 0, False, None, None
    every: list[list[str]] = []
    own: list[list[str]] = []
    para: list[str] | None = None
    head: list[str] | None = None
    for kind, tag, value in events(page):
        if kind == "text":
            if head is not None:
                head.append(value)
            if para is not None:
                para.append(value)
            if written is None and (m := _DATE.search(value)):
                written = m[1]
        elif kind == "raw":
            if tag == "title" and title is None:
                title = flat(value.split("\0", 1)[1])
        elif kind == "open":
            if tag == "article" and not took:
                inside += 1
            if tag == "h1" and heading is None and head is None:
                head = []
            if tag == "p":
                para = []
                every.append(para)
                if inside:
                    own.append(para)
            elif para is not None:
                para.append(" ")
            if date is None and "datetime" in value and (m := _DAY.match(attributes(value).get("datetime", ""))):
                date = m[0]
        else:
            if tag == "h1" and head is not None:
                heading, head = flat("".join(head)), None
            if tag == "p":
                para = None
            elif para is not None:
                para.append(" ")
            if tag == "article" and inside:
                inside, took, para = inside - 1, inside == 1, None
    if head is not None and heading is None:
        heading = flat("".join(head))
    paras = [t for t in (flat("".join(p)) for p in (own if took or inside else every)) if t]
    return heading or title or "", "\n".join(paras), date or written


def article_fields(pages: DataFrame) -> DataFrame:
    """Title, text, publisher (host) and first date of stored article pages, one row per page."""
    fields = ["page_id", "title", "text", "publisher", "published"]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES):
                some, rows = batch.slice(start, PAGES), []
                for page, url, html in zip(*some.columns):
                    title, text, date = article_of(html.as_py() or "")
                    host = _HOST.match(url.as_py() or "")
                    rows.append((page.as_py(), title, text, host and host[1].lower(), date))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if k else pa.int64()) for k in range(5)], fields)

    ship(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, title string, text string, publisher string, published string")
