"""Product cards and cells of saved pages, in one pass over the tags.

Every open element has a summary (its text while that is short enough for a card, its product links, price nodes, links that
wait for a better card), which goes into its parent's at the end tag. A block whose text is over
``CARD_CHARS`` can't be a card, nor can any block around it, so nothing of it goes further up: a page costs its own length."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from pricelode.functions.html import _VOID, _resolve

#: What counts for a card: only its product's link, the product's title in its text, a card-information element, one price. Fixed values.
CARD_SCORES = {"alone": 12, "among": 2, "titled": 2, "informed": 2, "one_price": 3, "two_prices": 1, "more_prices": -3}
CARD_CHARS = 900
INFORMATION = {"card__information", "card-information"}
PRICE_AROUND = {"price", "price__sale", "price__regular"}
PRICE_ITEMS = {"price-item--sale", "price-item--regular"}
#: Elements that end where the next of their kind begins.
_SELF_ENDING = {"li", "p", "td", "th", "tr", "dt", "dd", "option"}
_CELLS = {"li": "list", "td": "row", "th": "row", "dt": "terms", "dd": "terms"}
_GROUPS = {"ul": "list", "ol": "list", "tr": "row", "dl": "terms"}
_SPACE = re.compile(r"\s+")
_AMOUNT = re.compile(r"\d")


class _Element:
    __slots__ = ("anchors", "cell", "classes", "group", "href", "information", "large", "links", "own", "price_place", "prices", "tag", "text")

    def __init__(self, tag: str, classes: set[str], href: str | None, price_place: frozenset[str]) -> None:
        self.tag, self.classes, self.href, self.price_place = tag, classes, href, price_place
        self.text: list[str] = []
        self.links: Counter[str] = Counter()
        self.anchors: list[dict] = []
        self.prices, self.information, self.large = 0, False, False
        self.cell: dict | None = None
        self.group: dict | None = None
        self.own: list[str] = []


class PageWalk(HTMLParser):
    """``cards``: for each target of a link the best block; ``cells``: list items, row cells and terms in order."""

    def __init__(self, base: str | None, link_part: str, priced: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.link_part, self.priced = base, link_part, priced
        self.open: list[_Element] = [_Element("", set(), None, frozenset())]
        self.tags: Counter[str] = Counter()
        self.cards: dict[str, tuple] = {}
        self.cells: list[dict] = []
        self.groups = 0
        self.group_stack: list[dict] = []
        self.cell_stack: list[_Element] = []

    def walk(self, page: str) -> PageWalk:
        self.feed(page)
        self.close()
        while len(self.open) > 1:
            self._end()
        return self

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _SELF_ENDING and self.open[-1].tag == tag:
            self._end()
        if tag in _VOID:
            return
        own, around = dict(attrs), self.open[-1]
        classes = set((own.get("class") or "").split())
        place = around.price_place | (around.classes & (PRICE_AROUND | INFORMATION))
        element = _Element(tag, classes, own.get("href") if tag == "a" else None, place)
        if tag in _GROUPS:
            self.groups += 1
            element.group = {"kind": _GROUPS[tag], "number": self.groups, "cells": 0}
            self.group_stack.append(element.group)
        if tag in _CELLS and self.group_stack and self.group_stack[-1]["kind"] == _CELLS[tag]:
            group = self.group_stack[-1]
            group["cells"] += 1
            element.cell = {"tag": tag, "group": group["number"], "position": group["cells"], "text": "", "link": None}
            self.cells.append(element.cell)
            self.cell_stack.append(element)
        if element.href and self.cell_stack and self.cell_stack[-1].cell["link"] is None:
            self.cell_stack[-1].cell["link"] = _resolve(self.base, element.href)
        self.open.append(element)
        self.tags[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if self.tags[tag]:
            while self._end() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag in ("script", "style"):
            return
        text = _SPACE.sub(" ", data)
        if not self.open[-1].large:
            self.open[-1].text.append(text)
        if self.cell_stack:
            self.cell_stack[-1].own.append(text)

    def _end(self) -> str:
        x = self.open.pop()
        self.tags[x.tag] -= 1
        if x.group:
            self.group_stack.pop()
        if x.cell:
            self.cell_stack.pop()
            x.cell["text"] = " ".join("".join(x.own).split())
        text = _SPACE.sub(" ", "".join(x.text))
        shown = text.strip()
        x.large = x.large or len(shown) > CARD_CHARS
        target = _resolve(self.base, x.href) if x.href and self.link_part in x.href else None
        if target:
            x.links[target] += 1
            x.anchors.append({"target": target, "title": "" if x.large else shown, "depth": len(self.open)})
        up = self.open[-1]
        if x.large:
            up.large, up.text = True, []
            return x.tag
        if shown and (x.prices or not self.priced):
            self._judge(x, shown)
        up.text.append(text)
        if not up.large:
            up.links.update(x.links)
            up.anchors += x.anchors
        up.prices += x.prices + self._is_price(x, shown)
        up.information |= x.information or bool(x.classes & INFORMATION)
        return x.tag

    def _is_price(self, x: _Element, shown: str) -> bool:
        """Is it a price node? One that holds the amounts of others of the kind isn't named like one."""
        named = x.classes & PRICE_ITEMS or ("price-item" in x.classes and x.price_place & PRICE_AROUND) or ("price" in x.classes and x.price_place & INFORMATION and not x.prices)
        return bool(named and _AMOUNT.search(shown))

    def _judge(self, x: _Element, shown: str) -> None:
        w = CARD_SCORES
        prices = 0 if not x.prices else w["one_price"] if x.prices == 1 else w["two_prices"] if x.prices == 2 else w["more_prices"]
        whole = prices + (w["informed"] if x.information else 0) + (w["alone"] if len(x.links) == 1 else w["among"])
        for a in x.anchors:
            score = whole + (w["titled"] if a["title"] and a["title"] in shown else 0)
            steps = a["depth"] - len(self.open)
            rank = (score, -len(x.links), -len(shown), x.links[a["target"]], -steps)
            best = self.cards.get(a["target"])
            if best is None or (rank, shown) > best[0]:
                self.cards[a["target"]] = ((rank, shown), a["title"], x.prices, steps)


def page_cards(page: str, base: str | None, link_part: str = "", priced: bool = True) -> list[dict]:
    found = PageWalk(base, link_part, priced).walk(page).cards
    return [{"target": t, "title": title, "score": r[0][0], "n_links": -r[0][1], "prices": prices, "steps": steps, "text": r[1]} for t, (r, title, prices, steps) in found.items()]


def page_cells(page: str, base: str | None) -> list[dict]:
    return PageWalk(base, "", True).walk(page).cells


_CARD = ArrayType(StructType([
    StructField("target", StringType()), StructField("title", StringType()), StructField("score", IntegerType()), StructField("n_links", IntegerType()), StructField("prices", IntegerType()),
    StructField("steps", IntegerType()), StructField("text", StringType()),
]))
_CELL = ArrayType(StructType([
    StructField("tag", StringType()), StructField("group", IntegerType()), StructField("position", IntegerType()), StructField("text", StringType()), StructField("link", StringType()),
]))


def cards(page: Column, base: Column, link_part: str = "", priced: bool = True) -> Column:
    """For each linked product of a page the block that shows it best: of all blocks around its links with text of at most
    CARD_CHARS characters (and, with ``priced``, a price), that of the highest score, then fewest links, least
    text, most links to the product, nearest, last by text. Only links with ``link_part`` in them count."""

    @F.pandas_udf(_CARD)
    def walk(pages: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([page_cards(p or "", b, link_part, priced) for p, b in zip(pages, bases, strict=True)])

    return walk(page, base)


@F.pandas_udf(_CELL)
def cells(page: pd.Series, base: pd.Series) -> pd.Series:
    """List items, cells of table rows, and terms with their descriptions: the number of their list or row in the page, their place in it (from 1), the text that
    is in no inner cell, and the first link."""
    return pd.Series([page_cells(p or "", b) for p, b in zip(page, base, strict=True)])


def labelled_cells(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, value of rows with two cells and of terms: of exploded ``cells`` (keys, tag, group, position, text). A label loses its colon."""
    label = F.lower(F.trim(F.regexp_replace("first", r"\s*:\s*$", "")))
    in_rows = found.where(F.col("tag").isin("td", "th")).groupBy(*keys, "group").agg(
        F.count("*").alias("n"), F.max(F.when(F.col("position") == 1, F.col("text"))).alias("first"), F.max(F.when(F.col("position") == 2, F.col("text"))).alias("value")
    ).where("n = 2")
    both = found.where(F.col("tag") == "dd").alias("d").join(found.where(F.col("tag") == "dt").alias("t"), [*(F.col(f"d.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys), F.col("d.group") == F.col("t.group"), F.col("d.position") == F.col("t.position") + 1])
    terms = both.select(*(F.col(f"d.{k}").alias(k) for k in keys), F.col("t.text").alias("first"), F.col("d.text").alias("value"))
    return in_rows.select(*keys, "first", "value").unionByName(terms).where(F.col("first") != "").select(*keys, label.alias("label"), "value")


def behind_title(found: DataFrame, keys: list[str], title: Column, place: int) -> DataFrame:
    """keys and value: the text of the item ``place`` steps behind the item that is the title, in the same list; of several, the first."""
    at = found.where(F.col("tag") == "li").withColumn("_title", F.lower(F.trim("text")) == F.lower(F.trim(title)))
    titles = at.where("_title").groupBy(*keys).agg(F.min(F.struct("group", "position")).alias("_at"))
    joined = at.join(titles, keys).where((F.col("group") == F.col("_at.group")) & (F.col("position") == F.col("_at.position") + place))
    return joined.select(*keys, F.col("text").alias("value"))
