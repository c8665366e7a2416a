"""Fields of saved pages. Regular expressions where they do; pandas UDFs where markup nests."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from pricelode.functions.text import collapse

#: Image sources by trust; img tags come last, and only so many of a page.
_METAS = (("og", "property", ("og:image", "og:image:url", "og:image:secure_url")), ("twitter", "name", ("twitter:image", "twitter:image:src")))
MOST_TAGS = 5

_TAG = re.compile(r"<(meta|link|img|script)\b([^>]*)>", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_JSONLD = re.compile(r"""<script\b[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script>""", re.IGNORECASE | re.DOTALL)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_NO_COVER = re.compile(r"logo|icon|sprite|placeholder|avatar|banner|pixel", re.IGNORECASE)


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<a\s+href="([^"]*)"'), 1)


def lines(html: Column) -> Column:
    """The distinct text lines of a page, tags dropped."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", "\n")
    parts = F.split(F.regexp_replace(bare, r"(?s)<[^>]*>", "\n"), "\n")
    return F.array_distinct(F.filter(F.transform(parts, collapse), lambda x: x != ""))


def value_after(text_lines: Column, label: str, most: int = 3) -> Column:
    """The first line of up to ``most`` behind the first line that is ``label``; null if there is none."""
    at = F.array_position(F.transform(text_lines, lambda x: F.regexp_replace(F.lower(x), r"\s*:$", "")), F.lit(label.lower()))
    following = F.slice(text_lines, F.greatest(at + 1, F.lit(1)).cast("int"), F.lit(most))
    return F.when(at > 0, F.try_element_at(F.filter(following, lambda x: ~x.rlike(r":$")), F.lit(1)))


def first_code_line(text_lines: Column) -> Column:
    return F.try_element_at(F.filter(text_lines, lambda x: x.rlike("^[0-9]{8,14}$")), F.lit(1))


def labelled_price(text: Column, labels: list[str]) -> Column:
    """The amount behind the first of ``labels`` that has one, else the last amount of the text
    that isn't about shipping or a total; null if there is none."""
    amount = r"€\s*(\d+(?:[.,]\d{3})*(?:[.,]\d{2})?)"
    found = [F.nullif(F.regexp_extract(text, rf"(?i)\Q{x}\E[^€]{{0,40}}{amount}", 1), F.lit("")) for x in labels]
    rest = F.regexp_extract_all(F.regexp_replace(text, rf"(?i)(?:verzend|shipping|vanaf|totaal|total)[^€]{{0,80}}{amount}", ""), F.lit(amount), 1)
    return F.coalesce(*found, F.try_element_at(rest, F.lit(-1)))


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)}


def _resolve(base: str | None, url: str) -> str | None:
    url = url.strip()
    if not url or url.lower().startswith("data:"):
        return None
    try:
        return urldefrag(urljoin(base or "", url)).url
    except ValueError:
        return None


def _walk(node: object) -> Iterator[str]:
    """Images of a JSON-LD tree: texts, lists and objects with url below ``image``."""

    def images(x: object) -> Iterator[str]:
        if isinstance(x, str):
            yield x
        elif isinstance(x, list):
            for y in x:
                yield from images(y)
        elif isinstance(x, dict):
            yield from images(x.get("url") or x.get("contentUrl") or [])

    todo = [node]
    while todo:
        x = todo.pop(0)
        if isinstance(x, dict):
            yield from images(x.get("image") or [])
            todo += [v for k, v in x.items() if k != "image"]
        elif isinstance(x, list):
            todo += x


def _blocks(page: str) -> Iterator[object]:
    for m in _JSONLD.finditer(page):
        try:
            yield json.loads(m[1])
        except (ValueError, RecursionError):
            continue


def page_images(page: str, base: str | None) -> list[tuple[str, str]]:
    """(url, source) in order of trust, each URL once."""
    tags = [(m[1].lower(), _attributes(m[2])) for m in _TAG.finditer(page)]
    found: list[tuple[str, str]] = []
    for source, key, names in _METAS:
        found += [(a.get("content", ""), source) for t, a in tags if t == "meta" and (a.get(key) or a.get("property") or a.get("name") or "").lower() in names]
    found += [(a.get("href", ""), "image_src") for t, a in tags if t == "link" and a.get("rel", "").lower() == "image_src"]
    found += [(u, "jsonld") for block in _blocks(page) for u in _walk(block)]
    plain = [a for t, a in tags if t == "img" and not _NO_COVER.search(" ".join((a.get("src", ""), a.get("class", ""), a.get("alt", ""))))]
    plain.sort(key=lambda a: -sum(w in " ".join((a.get("class", ""), a.get("id", ""), a.get("src", ""))).lower() for w in ("cover", "product", "main", "front")))
    found += [(a.get("data-src") or a.get("src", ""), "img_tag") for a in plain[:MOST_TAGS]]
    out: dict[str, str] = {}
    for url, source in found:
        whole = _resolve(base, url)
        if whole and not _NO_COVER.search(whole):
            out.setdefault(whole, source)
    return list(out.items())


_CANDIDATE = ArrayType(StructType([StructField("url", StringType()), StructField("source", StringType()), StructField("position", IntegerType())]))


@F.pandas_udf(_CANDIDATE)
def image_candidates(page: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([[{"url": u, "source": s, "position": i} for i, (u, s) in enumerate(page_images(p or "", b))] for p, b in zip(page, base, strict=True)])


@F.pandas_udf(ArrayType(StringType()))
def jsonld_images(page: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([[w for x in _blocks(p or "") for u in _walk(x) if (w := _resolve(b, u))] for p, b in zip(page, base, strict=True)])


@F.pandas_udf(StringType())
def embedded_array(page: pd.Series, name: pd.Series) -> pd.Series:
    """The JSON array behind ``"name":`` in a page's scripts; null if there is none that can be read."""

    def find(text: str, key: str) -> str | None:
        m = re.search(rf'["\']?{re.escape(key)}["\']?\s*[:=]\s*\[', text)
        if not m:
            return None
        try:
            return text[m.end() - 1 : json.JSONDecoder().raw_decode(text, m.end() - 1)[1]]
        except (ValueError, RecursionError):
            return None

    return pd.Series([find(p or "", n or "") for p, n in zip(page, name, strict=True)])


_PRODUCT = StructType([StructField(x, StringType()) for x in ("name", "price", "currency", "availability")])


def _products(node: object) -> Iterator[dict]:
    """Product objects of a JSON-LD tree, outer ones first."""
    todo = [node]
    while todo:
        x = todo.pop(0)
        if isinstance(x, list):
            todo += x
        elif isinstance(x, dict):
            kind = x.get("@type")
            if kind == "Product" or (isinstance(kind, list) and "Product" in kind):
                yield x
            todo += [v for v in x.values() if isinstance(v, (dict, list))]


def page_product(page: str) -> dict | None:
    """Name, price, currency and availability of the first Product that a page declares; its first offer with a price counts."""
    for block in _blocks(page):
        for x in _products(block):
            offers = x.get("offers") or {}
            offers = [o for o in (offers if isinstance(offers, list) else [offers]) if isinstance(o, dict)]
            offer = next((o for o in offers if o.get("price") is not None), offers[0] if offers else {})
            text = lambda v: None if v is None else str(v).strip()
            price = offer.get("price") if offer.get("price") is not None else offer.get("lowPrice")
            return {"name": text(x.get("name")), "price": text(price), "currency": text(offer.get("priceCurrency")), "availability": text(offer.get("availability"))}
    return None


@F.pandas_udf(_PRODUCT)
def jsonld_product(page: pd.Series) -> pd.DataFrame:
    found = [page_product(p or "") or {} for p in page]
    return pd.DataFrame({f.name: [x.get(f.name) for x in found] for f in _PRODUCT.fields}, dtype=object)
