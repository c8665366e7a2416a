"""Longer computations that join the others: release matching, EAN back-fill, seeds, requests by code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelode.functions import ids, scoring, text, urls
from pricelode.operators.history import first_by
from pricelode.operators.joins import match_cardinality
from pricelode.operators.queueing import enqueue
from pricelode.operators.ranking import decide
from pricelode.operators.validation import conflicts, first_reason, split


def match_releases(products: DataFrame, releases: DataFrame) -> DataFrame:
    """Per product (product, artist, title, ean) its best release (product, release_id, title,
    artist, barcode, score, status), with total, second_score and decision. A product without
    releases is no_match."""
    r = releases.select("product", "release_id", F.col("title").alias("r_title"), F.col("artist").alias("r_artist"), "barcode", "score", "status")
    joined = products.join(r, "product")
    total = scoring.release_score(F.col("barcode"), F.col("ean"), F.col("score"), text.similarity("title", "r_title"), text.similarity("artist", "r_artist"), F.col("status"))
    best = decide(joined.select("product", "release_id", total.alias("total")), "product", "total", [F.asc("release_id")])
    out = products.select("product").join(best, "product", "left")
    return out.withColumn("decision", F.coalesce("decision", F.lit("no_match")))


def clean_backfill(rows: DataFrame, excluded: list[str], lengths: list[int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clean, conflicting, quarantined) of back-fill rows (row, shop, url, ean): clean rows
    are one per shop and URL; a shop and URL with several codes is a conflict."""
    found = ids.backfill_ean(F.col("ean"))
    shop = F.lower(F.trim(F.coalesce("shop", F.lit(""))))
    own = rows.select("row", shop.alias("shop"), urls.normalize_url(F.col("url")).alias("url"), F.col("ean").alias("ean_original"), found["ean"].alias("ean"), found["reason"].alias("_reason"))
    bad_length = ~F.length("ean").isin(*(lengths or [8, 12, 13, 14]))
    reason = F.coalesce(
        first_reason([("missing_shop", F.col("shop") == ""), ("excluded_shop", F.col("shop").isin(*excluded) if excluded else F.lit(False)), ("missing_or_invalid_url", F.col("url") == "")]),
        F.nullif(F.col("_reason"), F.lit("")), F.when(bad_length, F.concat(F.lit("invalid_ean_length_"), F.length("ean").cast("string"))),
    )
    good, quarantined = split(own.withColumn("reason", reason).drop("_reason"), "reason")
    clashing = conflicts(good, ["shop", "url"], "ean")
    first = first_by(good, ["shop", "url"], [F.asc("row")])
    return first.join(clashing, ["shop", "url"], "left_anti"), first.join(clashing, ["shop", "url"]), quarantined


def plan_backfill(clean: DataFrame, offers: DataFrame) -> DataFrame:
    """What to do with each clean row, given offers (shop, url, product, ean): update, already_set,
    conflict with a code that is there, unmatched or ambiguous."""
    known = offers.select(F.concat_ws(" ", F.lower("shop"), urls.normalize_url(F.col("url"))).alias("_key"), "product", F.nullif(F.col("ean"), F.lit("")).alias("_old"))
    matched = match_cardinality(clean.withColumn("_key", F.concat_ws(" ", "shop", "url")), known, "_key", "product")
    codes = known.groupBy("product").agg(F.max("_old").alias("_old"))
    joined = matched.join(codes, matched["matched_id"] == codes["product"], "left").drop("product")
    same = ids.same_product_code(F.col("_old"), F.col("ean"))
    action = F.when(F.col("match") != "matched", F.col("match")).when(F.col("_old").isNull(), F.lit("update")).when(same, F.lit("already_set")).otherwise(F.lit("conflict"))
    return joined.withColumn("action", action).drop("_key", "_old", "match")


def combine_seeds(files: DataFrame, table: DataFrame, key: str, seen: str) -> DataFrame:
    """One row per key of both sources: the newest time, and each other column from the newest row that has it."""
    both = files.select(*table.columns).unionByName(table)
    latest = F.coalesce(F.col(seen), F.lit("0001-01-01").cast(table.schema[seen].dataType))
    fill = [F.max_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", latest)).alias(c) for c in table.columns if c not in (key, seen)]
    return both.groupBy(key).agg(F.max(seen).alias(seen), *fill)


def enqueue_by_code(queue: DataFrame, products: DataFrame, codes: DataFrame, priority: int) -> tuple[DataFrame, DataFrame]:
    """(the queue with the products of these codes, the codes that no product has). Products
    have job and ean; a product asked for by several codes counts once."""
    asked = codes.select(F.col("ean").alias("code"), ids.gtin14(F.col("ean")).alias("_g"))
    known = products.select("job", ids.gtin14(F.col("ean")).alias("_g"))
    hits = asked.join(known, "_g").select("job").distinct().withColumn("priority", F.lit(priority))
    return enqueue(queue, hits, "job"), asked.join(known, "_g", "left_anti").select("code")


def uncached(jobs: DataFrame, cache: DataFrame, key: str, checked: str, as_of: Column, days: int) -> DataFrame:
    """Jobs whose key the cache lacks or has seen too long ago."""
    fresh = cache.where(F.col(checked) >= as_of - F.make_interval(days=F.lit(days))).select(key)
    return jobs.join(fresh, key, "left_anti")


def offer_priority(offers: DataFrame, product: str, rank: Column) -> DataFrame:
    """Per product: the best rank of its offers, five for each offer, and ten."""
    return offers.groupBy(product).agg((F.max(rank) + F.count("*") * 5 + 10).alias("priority"))


def within_keys(df: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """Rows whose key one of the other tables has."""
    keys = others[0].select(key)
    for o in others[1:]:
        keys = keys.union(o.select(key))
    return df.join(keys, key, "left_semi")
