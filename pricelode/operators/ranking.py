"""Top lists, search, suggestions and choices with a margin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelode.functions import scoring
from pricelode.functions.classify import is_hidden_format
from pricelode.functions.page_walk import CARD_CHARS, CARD_SCORES
from pricelode.functions.text import dutch, normalized
from pricelode.operators import postings


def top_then_filter(df: DataFrame, order: list[Column], first: int, keep: Column, most: int) -> DataFrame:
    """The first rows, of these those that pass, of these ``most``: fewer are possible by design."""
    return df.orderBy(*order).limit(first).where(keep).orderBy(*order).limit(most)


def nested_offers(offers: DataFrame, product: str, shop: str, price: str, last_seen: str, in_stock: Column) -> DataFrame:
    """Per product its offers as an array: in stock first, then by price, then the last seen."""
    late = -F.unix_micros(F.col(last_seen).cast("timestamp"))
    item = F.struct(F.when(in_stock, 0).otherwise(1).alias("stock_rank"), F.col(price).alias("price"), late.alias("late"), F.col(shop).alias("shop"), F.col(last_seen).alias("last_seen"))
    return offers.groupBy(product).agg(F.array_sort(F.collect_list(item)).alias("offers"))


def top_n(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key, with ``rank`` from 1."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= most)


def matching(products: DataFrame, query: str) -> DataFrame:
    """The shown products that a query could mean. Best prices are needed of these alone."""
    q = " ".join(query.lower().split())
    words = F.lower(F.concat_ws(" ", "artist", "title"))
    gtin = F.coalesce(F.col("gtin") == scoring.search_gtin(F.lit(query)), F.lit(False))
    return products.where(~is_hidden_format(F.col("format")) & (gtin | words.contains(q) | normalized(F.col("artist")).contains(q) | normalized(F.col("title")).contains(q)))


def search_fields() -> list[Column]:
    """The texts of a product that ``matching`` looks into, for ``postings.build``."""
    return [F.lower(F.concat_ws(" ", "artist", "title")), normalized(F.col("artist")), normalized(F.col("title"))]


def indexed_matching(spark: SparkSession, index: str, query: str) -> DataFrame:
    """``matching`` over the rows of an index that can hold the query: products aren't scanned. A query that could be a GTIN has no postings
    to be found by, so such products are for the caller."""
    return matching(postings.candidates(spark, index, "product", " ".join(query.lower().split())), query)


def search(products: DataFrame, best: DataFrame, query: str, most: int = 24) -> DataFrame:
    """product, artist, title, score, lowest price and shops of the best answers. ``products``
    has product, artist, title, gtin, format; ``best`` has product and the best-price columns."""
    found = matching(products, query)
    joined = found.join(best, "product", "left")
    score = scoring.search_score(query, F.col("artist"), F.col("title"), F.col("gtin"), F.col("fresh_instock_shop_count"), F.col("total_active_shop_count"), F.col("lowest_fresh_price"))
    shops = F.coalesce("fresh_instock_shop_count", F.lit(0))
    rows = joined.select("product", "artist", "title", score.alias("score"), F.col("lowest_fresh_price").alias("price"), shops.alias("found_in")).where((F.col("score") > 0) & (F.col("found_in") > 0))
    return rows.orderBy(F.desc("score"), F.asc_nulls_last("price"), F.desc("found_in"), "artist", "product").limit(most)


def suggestions(products: DataFrame, query: str, most: int = 3) -> DataFrame:
    """kind, label, sublabel, bucket and score: artists and albums, best first. A group of
    artists shows its shortest spelling."""
    shown = products.where(~is_hidden_format(F.col("format")))
    by_artist = shown.withColumn("key", normalized(F.col("artist"))).where(F.col("key") != "").withColumn("g", scoring.artist_grade(query, F.col("artist"))).where("g.bucket <= 2")
    label = F.min(F.struct(F.length("artist").alias("n"), F.col("artist").alias("text")))["text"]
    grade = F.min(F.struct(F.col("g.bucket"), (-F.col("g.score")).alias("minus")))
    artists = by_artist.groupBy("key").agg(label.alias("label"), grade.alias("g")).select(F.lit("artist").alias("kind"), "label", F.lit("").alias("sublabel"), F.col("g.bucket"), (-F.col("g.minus")).alias("score"))
    by_album = shown.withColumn("key", F.concat_ws("::", normalized(F.col("artist")), normalized(F.col("title")))).withColumn("g", scoring.album_grade(query, F.col("artist"), F.col("title"))).where("g.bucket <= 2")
    best = F.min(F.struct(F.col("g.bucket"), (-F.col("g.score")).alias("minus"), "title", "artist"))
    albums = by_album.groupBy("key").agg(best.alias("b")).select(F.lit("album").alias("kind"), F.col("b.title").alias("label"), F.col("b.artist").alias("sublabel"), F.col("b.bucket"), (-F.col("b.minus")).alias("score"))
    return artists.union(albums).orderBy("bucket", F.desc("score"), F.desc("kind"), dutch(F.col("label")), "label", "sublabel").limit(most)


def artist_facets(results: DataFrame, query: str) -> DataFrame:
    """key, artist (the shortest spelling), count and score of the artists of a result."""
    label = F.min(F.struct(F.length("artist").alias("n"), F.col("artist").alias("text")))["text"]
    graded = results.withColumn("key", normalized(F.col("artist")))
    return graded.groupBy("key").agg(label.alias("artist"), F.count("*").alias("n"), F.max(scoring.facet_score(query, F.col("artist"))).alias("score"))


def decide(candidates: DataFrame, key: str, score: str, order: list[Column]) -> DataFrame:
    """Per key its best candidate, the second-best score, and matched, ambiguous or no_match."""
    w = Window.partitionBy(key).orderBy(F.desc(score), *order)
    ranked = candidates.withColumn("second_score", F.lead(score).over(w)).withColumn("_place", F.row_number().over(w)).where(F.col("_place") == 1).drop("_place")
    return ranked.withColumn("decision", scoring.match_decision(F.col(score), F.col("second_score")))


def pick_cards(blocks: DataFrame, keys: list[str], most_chars: int = CARD_CHARS) -> DataFrame:
    """Per key (a link of a page) the block that shows its product best, of those with the link, a price and
    at most ``most_chars`` characters: highest score, then fewest links, least text, most links to the product, nearest,
    last by text and prices, so that every choice is one.
    ``blocks`` has target, title, steps, text, links (an array) and prices (a count), and may have
    information (is there a card-information element in it?). ``page_walk.cards`` chooses the same from a page itself."""
    unique = F.array_distinct("links")
    same = F.size(F.filter("links", lambda x: x == F.col("target")))
    fit = blocks.where((F.length("text") > 0) & (F.length("text") <= most_chars) & (F.col("prices") > 0) & (same > 0))
    w = CARD_SCORES
    score = (
        F.when(F.size(unique) == 1, w["alone"]).otherwise(w["among"]) + F.when((F.col("title") != "") & F.contains("text", "title"), w["titled"]).otherwise(0)
        + F.when(F.col("prices") == 1, w["one_price"]).when(F.col("prices") == 2, w["two_prices"]).otherwise(w["more_prices"])
    )
    if "information" in blocks.columns:
        score = score + F.when(F.col("information"), w["informed"]).otherwise(0)
    rank = F.struct(score.alias("score"), (-F.size(unique)).alias("links"), (-F.length("text")).alias("chars"), same.alias("same"), (-F.col("steps")).alias("near"), "text", "prices")
    best = F.max_by(F.struct(score.alias("score"), F.size(unique).alias("n_links"), "prices", "steps", "text"), rank)
    return fit.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def with_facet(results: DataFrame, artist: str | None) -> DataFrame:
    """The results of one artist, whatever its spelling; all where none is asked for."""
    wanted = " ".join((artist or "").lower().split())
    return results.where(normalized(F.col("artist")) == wanted) if wanted else results


def newest(df: DataFrame, created: str, first: int, keep: Column, most: int, tie: str) -> DataFrame:
    return top_then_filter(df, [F.desc(created), F.asc(tie)], first, keep, most)
