"""Shop feeds as declarations: required columns, target expressions, reject rules.

A mapping is a function of a feed's columns that returns the canonical columns; reject rules
are named conditions, tried in order. Adding a shop is adding an entry; no rows pass
through Python."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelode.functions import classify, ids, prices, text
from pricelode.operators.validation import first_reason, reject_duplicates, split
from pricelode.sources.feeds import validated

CANONICAL = ("artist", "title", "format_label", "ean", "gtin", "price", "currency", "availability", "product_url", "captured_at", "second_hand")


@dataclass(frozen=True)
class Feed:
    """How a family of feeds maps to the canonical columns. Values are the feed's column names."""

    required: tuple[str, ...]
    title: str
    price: str
    url: str
    ean: str
    artist: str | None = None
    carrier: str | None = None
    captured_at: tuple[str, ...] = ()
    availability: str | None = None
    availability_of: Callable[[Column], Column] = classify.availability
    price_of: Callable[[Column], Column] = prices.decimal_price
    condition: str | None = None
    currency: str = "EUR"
    also: dict[str, Column] = field(default_factory=dict)


#: The feed families by layout.
FEEDS: dict[str, Feed] = {
    "step-2": Feed(("title", "prijs", "url", "detail_status", "mogelijk_2e_hands", "detail_checked_at", "ean"), "title", "prijs", "url", "ean", "artist", "drager", ("detail_checked_at", "price_checked_at"), condition="mogelijk_2e_hands"),
    "listing": Feed(("title", "raw_name", "price_current", "url", "scraped_at", "ean"), "title", "price_current", "url", "ean", "artist", "format", ("scraped_at",)),
    "marketplace": Feed(("title", "url", "ean"), "title", "price_eur", "url", "ean", "artist", None, ("timestamp",), price_of=prices.dots_dropped_price),
    "enriched": Feed(("title", "prijs", "url", "op_voorraad", "drager", "ean"), "title", "prijs", "url", "ean", "artist", "drager", (), "op_voorraad", classify.availability_of_text),
    "master": Feed(("title", "price", "availability", "product_url", "scraped_at", "ean"), "title", "price", "product_url", "ean", "artist", "product_type", ("enriched_at", "scraped_at"), "availability"),
    "variants": Feed(("product_url", "ean13"), "album", "price_offer", "product_url", "ean13", "artist", "variant_title", ("scraped_at",), "available", classify.availability_of_flag),
    "detail": Feed(("price", "url", "ean"), "title", "price", "url", "ean", "artist", "format", (), "availability", condition="is_secondhand", price_of=prices.stripped_price),
    "slugs": Feed(("detail_url", "artist_slug_raw", "title_slug_raw", "price_current", "scraped_at"), "title_raw", "price_current", "detail_url", "ean_normalized", "artist_raw", "format_label_raw", ("scraped_at",), "availability_text", classify.availability_of_text),
    "stock": Feed(("title", "prijs", "url", "op_voorraad", "ean"), "title", "prijs", "url", "ean", "artist", "drager", (), "op_voorraad", classify.availability_of_text),
    "product": Feed(("title", "price", "product_url", "ean"), "title", "price", "product_url", "ean", "artist", "carrier", ("updated_at", "last_seen_at", "created_at")),
    "template": Feed(("title", "price", "url", "scraped_at", "ean"), "title", "price", "url", "ean", "artist", "format", ("scraped_at",)),
}


def canonical(df: DataFrame, feed: Feed, as_of: Column, keep_second_hand: bool = False) -> DataFrame:
    """Canonical columns, ``raw`` (the row as a map) and ``reject_reason`` (null: accepted)."""
    df = validated(df, list(feed.required))
    col = lambda name: F.col(f"`{name}`") if name and name in df.columns else F.lit(None).cast("string")
    pair = text.infer_artist_title(col(feed.artist), col(feed.title))
    times = [F.nullif(F.trim(col(c)), F.lit("")).try_cast("timestamp") for c in feed.captured_at]
    second_hand = col(feed.condition).isNotNull() & F.lower(F.trim(F.coalesce(col(feed.condition), F.lit("")))).isin("1", "true", "ja", "yes") if feed.condition else classify.is_second_hand(col(feed.title))
    raw = F.create_map(*(x for c in df.columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))))
    mapped = df.select(
        pair["artist"].alias("artist"), pair["title"].alias("title"), text.format_label(col(feed.carrier)).alias("format_label"), ids.ean(col(feed.ean)).alias("ean"), ids.gtin14(col(feed.ean)).alias("gtin"),
        feed.price_of(col(feed.price)).try_cast("decimal(10,2)").alias("price"), F.lit(feed.currency).alias("currency"),
        (feed.availability_of(col(feed.availability)) if feed.availability else F.lit("in_stock")).alias("availability"), F.trim(F.coalesce(col(feed.url), F.lit(""))).alias("product_url"),
        F.coalesce(*times, as_of).alias("captured_at"), F.coalesce(second_hand, F.lit(False)).alias("second_hand"), raw.alias("raw"),
    )
    rules = [
        ("missing_title", F.col("title") == ""), ("missing_url", F.col("product_url") == ""), ("invalid_ean", F.col("ean").isNull()), ("invalid_price", F.col("price").isNull() | (F.col("price") <= 0)),
        ("hidden_format", classify.is_hidden_format(F.col("format_label"))),
    ]
    if not keep_second_hand:
        rules.append(("second_hand", F.col("second_hand")))
    return mapped.withColumn("reject_reason", first_reason(rules))


def imported(df: DataFrame, feed: Feed, as_of: Column, keep_second_hand: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rejects of the rules, and of GTINs that several rows claim."""
    good, bad = split(canonical(df, feed, as_of, keep_second_hand), "reject_reason")
    judged = reject_duplicates(good.withColumn("_key", text.canonical_key(F.col("artist"), F.col("title"))), "gtin", "_key", "price", [F.desc("captured_at"), F.asc("product_url")]).drop("_key")
    kept, doubled = split(judged, "reject_reason")
    return kept, bad.unionByName(doubled)
