"""Scores of search, suggestions and cover candidates. Weights are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelode.functions.dates import recency_score
from pricelode.functions.ids import search_gtin
from pricelode.functions.text import normalized


def _sum(*terms: tuple[Column, int]) -> Column:
    total = F.lit(0)
    for test, weight in terms:
        total = total + F.when(test, weight).otherwise(0)
    return total


# The weights of what a search text meets.
def search_score(query: str, artist: Column, title: Column, gtin: Column, fresh_shops: Column, shops: Column, lowest: Column) -> Column:
    """How well a product answers a search text."""
    words = list(query.lower().split())
    q = " ".join(words)
    a, t = normalized(artist), normalized(title)
    both = F.trim(F.concat_ws(" ", a, t))
    text = _sum(
        (F.coalesce(gtin == search_gtin(F.lit(query)), F.lit(False)), 5000), (both == q, 1200), (t == q, 1000), (a == q, 900), (both.startswith(q), 600), (t.startswith(q), 500),
        (a.startswith(q), 450), (both.contains(q), 250), (t.contains(q), 220), (a.contains(q), 200),
    )
    every = F.lit(bool(words))
    hits = F.lit(0)
    for w in words:
        every = every & both.contains(w)
        hits = hits + F.when(t.contains(w), 30).when(a.contains(w), 25).when(both.contains(w), 15).otherwise(0)
    offers = F.least(F.coalesce(fresh_shops, F.lit(0)), F.lit(5)) * 20 + F.least(F.coalesce(shops, F.lit(0)), F.lit(5)) * 8
    price = _sum((lowest.isNotNull(), 40), (F.coalesce(lowest < 20, F.lit(False)), 15))
    return (text + F.when(every, 180).otherwise(0) + hits + offers + price).cast("int")


def _grade(*grades: tuple[Column, int, int]) -> Column:
    """struct(bucket, score) of the first test that holds; (9, 0) if none does."""
    pair = lambda b, s: F.struct(F.lit(b).alias("bucket"), F.lit(s).alias("score"))
    found = None
    for test, bucket, score in grades:
        found = F.when(test, pair(bucket, score)) if found is None else found.when(test, pair(bucket, score))
    return found.otherwise(pair(9, 0))


# Buckets and scores of suggestions and facets.
def artist_grade(query: str, artist: Column) -> Column:
    q, a = " ".join(query.lower().split()), normalized(artist)
    return _grade((F.lit(q == ""), 9, 0), (a == q, 0, 3000), (a.startswith(q + " "), 1, 2600), (a.startswith(q), 1, 2400), (a.contains(" " + q), 2, 1600), (a.contains(q), 2, 1400))


def album_grade(query: str, artist: Column, title: Column) -> Column:
    q, t = " ".join(query.lower().split()), normalized(title)
    both = F.trim(F.concat_ws(" ", normalized(artist), t))
    return _grade(
        (F.lit(q == ""), 9, 0), (t == q, 0, 3200), (both == q, 0, 3100), (t.startswith(q), 1, 2700), (both.startswith(q), 1, 2550), (t.contains(q), 2, 1750), (both.contains(q), 2, 1600)
    )


def facet_score(query: str, artist: Column) -> Column:
    q, a = " ".join(query.lower().split()), normalized(artist)
    if not q:
        return F.lit(0)
    return F.when(a == q, 1000).when(a.startswith(q + " "), 850).when(a.startswith(q), 800).when(a.contains(" " + q), 500).when(a.contains(q), 250).otherwise(0)


#: How much a source of images counts. Shops are keyed by id, 50 where unknown.
SOURCE_SCORES = {"listing": 45, "detail": 35, "jsonld": 30, "og": 28, "twitter": 26, "image_src": 24, "meta": 20, "img_tag": 12, "unknown": 0}
LEAST_SIDE = 250


def candidate_rank(source: Column, shop_priority: Column, primary: Column, width: Column, height: Column, has_shop: Column, last_seen: Column, as_of: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in SOURCE_SCORES.items() for x in pair))
    sized = (F.coalesce(width, F.lit(0)) > 0) & (F.coalesce(height, F.lit(0)) > 0)
    short, long = F.least(width, height), F.greatest(width, height)
    size = F.when(~sized, 0).when(short >= 900, 20).when(short >= 600, 12).when(short >= LEAST_SIDE, 6).otherwise(0)
    aspect = F.when(~sized, 0).when(long / short <= 1.25, 8).when(long / short <= 1.6, 2).otherwise(-20)
    return (
        F.coalesce(F.try_element_at(table, source), F.lit(0)) + F.coalesce(shop_priority, F.lit(50)) + F.when(primary, 10).otherwise(0) + size + aspect
        + F.when(has_shop, 4).otherwise(0) + recency_score(last_seen, as_of)
    ).cast("int")


MATCHED, MARGIN, AMBIGUOUS = 115.0, 12.0, 100.0


def release_score(barcode: Column, code: Column, service_score: Column, title_similarity: Column, artist_similarity: Column, status: Column) -> Column:
    same = F.coalesce((barcode != "") & (barcode == code), F.lit(False))
    return (
        F.when(same, 100.0).otherwise(0.0) + F.least(F.coalesce(service_score, F.lit(0.0)) / 10, F.lit(10.0)) + F.round(title_similarity * 25, 2) + F.round(artist_similarity * 20, 2)
        + F.when(F.coalesce(status == "Official", F.lit(False)), 5.0).otherwise(0.0)
    )


def match_decision(best: Column, second: Column) -> Column:
    """``second`` is null where there is only one candidate."""
    clear = second.isNull() | (best - second >= MARGIN)
    return F.when((best >= MATCHED) & clear, F.lit("matched")).when(best >= AMBIGUOUS, F.lit("ambiguous")).otherwise(F.lit("no_match"))
