"""The walk over a page against a tree of all its elements, judged one by one."""

import random
import time
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import functions as F

from pricelode.functions import page_walk
from pricelode.operators.ranking import pick_cards

BASE = "http://s.example/list"


class Tree(HTMLParser):
    def __init__(self):
        super().__init__()
        self.root = {"tag": "", "classes": set(), "href": None, "up": None, "kids": []}
        self.at = self.root

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        node = {"tag": tag, "classes": set((own.get("class") or "").split()), "href": own.get("href"), "up": self.at, "kids": []}
        self.at["kids"].append(node)
        if tag not in ("br", "img"):
            self.at = node

    def handle_endtag(self, tag):
        self.at = self.at["up"]

    def handle_data(self, data):
        self.at["kids"].append(data)


def inside(node):
    for kid in node["kids"]:
        if not isinstance(kid, str):
            yield kid
            yield from inside(kid)


def text(node):
    raw = "".join(k if isinstance(k, str) else text_raw(k) for k in node["kids"])
    return " ".join(raw.split())


def text_raw(node):
    return "".join(k if isinstance(k, str) else text_raw(k) for k in node["kids"])


def around(node):
    while node["up"]:
        node = node["up"]
        yield node


def is_price(node):
    above = set().union(*(x["classes"] for x in around(node)))
    named = node["classes"] & {"price-item--sale", "price-item--regular"} or ("price-item" in node["classes"] and above & {"price", "price__sale", "price__regular"})
    own = "price" in node["classes"] and above & {"card-information", "card__information"} and not any(is_price(x) for x in inside(node))
    return bool((named or own) and any(c.isdigit() for c in text(node)))


def brute(page, part):
    tree = Tree()
    tree.feed(page)
    best = {}
    for a in inside(tree.root):
        if a["tag"] != "a" or part not in (a["href"] or ""):
            continue
        target = urljoin(BASE, a["href"])
        for steps, block in enumerate([a, *around(a)]):
            shown = text(block)
            links = [urljoin(BASE, x["href"]) for x in [block, *inside(block)] if x["tag"] == "a" and part in (x["href"] or "")]
            prices = sum(map(is_price, inside(block)))
            if not block["tag"] or not shown or len(shown) > 900 or not prices:
                continue
            score = 12 if set(links) == {target} else 2
            score += 2 * bool(text(a) and text(a) in shown) + 2 * any(x["classes"] & {"card-information", "card__information"} for x in inside(block)) + {1: 3, 2: 1}.get(prices, -3)
            rank = ((score, -len(set(links)), -len(shown), links.count(target), -steps), shown)
            if target not in best or rank > best[target][0]:
                best[target] = (rank, prices)
    return {t: (r[0][0], -r[0][1], n, -r[0][4], r[1]) for t, (r, n) in best.items()}


def listing(rng, cards):
    out = ["<html><body><nav><a href='/about'>About</a></nav><div class='list'>"]
    for i in range(cards):
        price = rng.choice(["<span class='price-item--sale'>€ 5</span>", "<div class='price'><span class='price-item'>€ 7</span><s class='price-item'>€ 9</s></div>", "<p class='price'>1</p>", "<span class='price-item--sale'>sold</span>", ""])
        body = f"<a href='/products/{i}'> Title  {i} </a>{price}"
        if rng.random() < 0.5:
            body = f"<div class='card-information'>{body}</div>"
        if rng.random() < 0.3:
            body += f"<a href='/products/{i}'><img src='x'></a>"
        if rng.random() < 0.2:
            body += f"<a href='/products/{rng.randrange(cards)}'>also</a>"
        if rng.random() < 0.2:
            body = f"<section>{body}<p>{'text ' * rng.choice([3, 100, 400])}</p></section>"
        out.append(f"<div class='card'><div>{body}</div></div>" if rng.random() < 0.8 else body)
    return "".join([*out, "</div></body></html>"])


def test_cards_equal_all_blocks():
    rng = random.Random(6)
    for _ in range(60):
        page = listing(rng, rng.randint(0, 12))
        got = {c["target"]: (c["score"], c["n_links"], c["prices"], c["steps"], c["text"]) for c in page_walk.page_cards(page, BASE, "/products/")}
        assert got == brute(page, "/products/")


def test_a_large_page_costs_its_length():
    """1 MB with thousands of links; deep nesting without ends; a page that is one text."""
    page = listing(random.Random(7), 6000)
    while len(page) < 1_000_000:
        page += page
    began = time.process_time()
    found = page_walk.page_cards(page, BASE, "/products/")
    once = time.process_time() - began
    assert len(found) > 3000 and once < 12
    page_walk.page_cards(page + page, BASE, "/products/")
    assert time.process_time() - began - once < 3.5 * once
    deep = "<div><p><b>" * 100_000 + "<a href='/products/1'>x</a>"
    assert page_walk.page_cards(deep, BASE, "/products/") == [] and page_walk.page_cells("<li>" * 50_000, BASE) == []


def test_cells_and_labels(spark):
    page = (
        "<ul><li>One<li><a href='/x'>Two</a> &amp; <ul><li>inner</li></ul> more</ul><table><tr><th>EAN :<td>123<tr><td>a<td>b<td>c</table>"
        "<dl><dt>Label:</dt><dd>Analog</dd><dd>other</dd></dl><script>var t = '<li>no</li>'</script><td>stray</td>"
    )
    rows = spark.createDataFrame([(1, page), (2, None), (3, "")], "page int, html string")
    found = rows.select("page", F.explode(page_walk.cells(F.col("html"), F.lit(BASE))).alias("c")).select("page", "c.*")
    assert [(r.tag, r.group, r.position, r.text, r.link) for r in found.where("tag = 'li'").collect()] == [
        ("li", 1, 1, "One", None), ("li", 1, 2, "Two & more", "http://s.example/x"), ("li", 2, 1, "inner", None)
    ]
    assert sorted((r.label, r.value) for r in page_walk.labelled_cells(found, ["page"]).collect()) == [("ean", "123"), ("label", "Analog")]
    assert [r.value for r in page_walk.behind_title(found, ["page"], F.lit("ONE"), 1).collect()] == ["Two & more"]


def test_blocks_of_a_table_count_information(spark):
    rows = [(1, "u", "T", 0, "T 1", ["u"], 1, False), (1, "u", "T", 1, "T 1 x", ["u"], 1, True)]
    blocks = spark.createDataFrame(rows, "page int, target string, title string, steps int, text string, links array<string>, prices int, information boolean")
    assert [(r.score, r.text) for r in pick_cards(blocks, ["page"]).collect()] == [(19, "T 1 x")]
    assert [(r.score, r.text) for r in pick_cards(blocks.drop("information"), ["page"]).collect()] == [(17, "T 1")]


def test_batches_of_pages_are_bounded(spark, tmp_path):
    """a batch of pages for Python is bounded by bytes, and by fewer rows than Spark's 10,000."""
    from pyspark.sql.types import IntegerType

    from pricelode.plans.tables import pages

    spark.range(3000).coalesce(1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("x").alias("html")).write.parquet(f"{tmp_path}/short/pages.parquet")
    spark.range(200).coalesce(1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("x"), 100_000).alias("html")).write.parquet(f"{tmp_path}/long/pages.parquet")
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(n) for n in names]
    size = F.pandas_udf(lambda x: x.str.len() * 0 + len(x), IntegerType())
    try:
        for kind, most in (("short", 1000), ("long", 50)):
            assert max(r.n for r in pages(spark, f"{tmp_path}/{kind}").select(size("html").alias("n")).collect()) <= most
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
