"""Classification of offers: availability, condition, format, outcome."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelode.functions.prices import is_placeholder_text
from pricelode.functions.text import collapse, is_blank, normalized

#: Formats that are not shown. Fixed values, compared after trimming in upper case.
HIDDEN_FORMATS = ("CD", "POSTER", "ACCESSORIES", "PHOTOBOOK", "BLUERAY", "BLURAY")


def is_hidden_format(label: Column) -> Column:
    return F.upper(F.trim(F.coalesce(label, F.lit("")))).isin(*HIDDEN_FORMATS)


def contains_any(text: Column, words: list[str]) -> Column:
    """Does a text hold one of the words, whatever its case?"""
    low = normalized(text)
    found = F.lit(False)
    for w in words:
        found = found | low.contains(w.lower())
    return found


def availability(c: Column) -> Column:
    """Of a status word: what isn't known to be sold out or to come is in stock."""
    word = F.translate(normalized(c), "- ", "__")
    return F.when(word.isin("out_of_stock", "sold_out", "uitverkocht"), F.lit("out_of_stock")).when(word.isin("preorder", "pre_order", "coming_soon"), F.lit("preorder")).otherwise(F.lit("in_stock"))


def availability_of_text(c: Column) -> Column:
    """Of free text: the negative is tested first, since it holds the positive ("niet op voorraad")."""
    low = normalized(c)
    return (
        F.when(low == "", F.lit("unknown")).when(low.rlike("niet op voorraad|uitverkocht|sold out|out of stock|niet leverbaar"), F.lit("out_of_stock"))
        .when(low.rlike("pre-?order|verwacht|binnenkort|coming soon"), F.lit("preorder")).when(low.rlike("op voorraad|in stock|leverbaar|direct leverbaar|add to cart|in winkelwagen"), F.lit("in_stock"))
        .otherwise(F.lit("unknown"))
    )


def availability_of_flag(c: Column) -> Column:
    low = normalized(c)
    return F.when(low.isin("true", "1", "yes", "ja", "j"), F.lit("in_stock")).when(low.isin("false", "0", "no", "nee", "n"), F.lit("out_of_stock")).otherwise(F.lit("unknown"))


#: What feeds write for an offer that is sold out, or to be had. Fixed values, in lower case.
SOLD_OUT_WORDS = ("niet op voorraad", "uitverkocht", "sold out", "not in stock", "out of stock", "temporarily unavailable")
FOR_SALE_WORDS = ("op voorraad", "leverkans", "levertijd", "preorder", "bestelbaar", "in stock", "estimated delivery", "delivery chance")
SOLD_OUT_STATUS = ("uitverkocht", "sold out", "niet leverbaar", "out_of_stock")
VARIANT_SOLD_OUT, VARIANT_FOR_SALE = ("uitverkocht", "sold out"), ("op voorraad", "in stock", "preorder", "bestelbaar")


def _unless_priced(price: Column) -> Column:
    """What has a price and no word against it is in stock."""
    return F.when(price.isNotNull(), F.lit("in_stock")).otherwise(F.lit("unknown"))


def availability_of_yes(c: Column) -> Column:
    """Of JA and NEE alone; all else is unknown."""
    word = F.upper(collapse(c))
    return F.when(word == "JA", F.lit("in_stock")).when(word == "NEE", F.lit("out_of_stock")).otherwise(F.lit("unknown"))


def availability_of_ja(c: Column) -> Column:
    """JA, or out of stock."""
    return F.when(F.upper(collapse(c)) == "JA", F.lit("in_stock")).otherwise(F.lit("out_of_stock"))


def availability_unless_sold_out(c: Column) -> Column:
    """In stock unless the text says that it is sold out."""
    return F.when(normalized(c).contains("uitverkocht"), F.lit("out_of_stock")).otherwise(F.lit("in_stock"))


def availability_of_listing(status: Column, price: Column) -> Column:
    """Of a listing's status, which is "ok" or says what is wrong."""
    return F.when(contains_any(status, list(SOLD_OUT_STATUS)), F.lit("out_of_stock")).when(normalized(status) == "ok", F.lit("in_stock")).otherwise(_unless_priced(price))


def availability_of_variant(flag: Column, label: Column, price: Column) -> Column:
    """A flag decides; without one, the words of the label."""
    word = normalized(flag)
    return (
        F.when(word.isin("false", "0"), F.lit("out_of_stock")).when(word.isin("true", "1"), F.lit("in_stock")).when(contains_any(label, list(VARIANT_SOLD_OUT)), F.lit("out_of_stock"))
        .when(contains_any(label, list(VARIANT_FOR_SALE)), F.lit("in_stock")).otherwise(_unless_priced(price))
    )


def availability_of_status(status: Column, label: Column, price: Column) -> Column:
    """A known status decides; without one, the words of the label, the negative ones first."""
    word = F.replace(normalized(status), F.lit("_"), F.lit(""))
    return (
        F.when(word == "outofstock", F.lit("out_of_stock")).when(word == "instock", F.lit("in_stock")).when(contains_any(label, list(SOLD_OUT_WORDS)), F.lit("out_of_stock"))
        .when(contains_any(label, list(FOR_SALE_WORDS)), F.lit("in_stock")).otherwise(_unless_priced(price))
    )


def is_second_hand(text: Column) -> Column:
    return F.coalesce(normalized(text).rlike(r"2e ?hands|tweede ?hands|second[- ]?hand|pre[- ]?owned|\bused\b|gebruikt"), F.lit(False))


def enrichment_state(page_ok: Column, fetch_error: Column, code: Column, second_hand: Column) -> Column:
    return (
        F.when(fetch_error, F.lit("fetch_error")).when(~page_ok, F.lit("invalid_page")).when(~is_blank(code), F.lit("ok")).when(second_hand, F.lit("second_hand_confirmed"))
        .otherwise(F.lit("no_ean"))
    )


def lacks_details(price: Column, *fields: Column) -> Column:
    """A row whose details are to be read again: a blank field or price, or the price that a shop shows where it has none."""
    lacking = is_blank(price) | is_placeholder_text(price)
    for f in fields:
        lacking = lacking | is_blank(f)
    return lacking


def needs_enrichment(code: Column, status: Column) -> Column:
    return is_blank(code) & ~F.coalesce(status, F.lit("")).isin("second_hand_confirmed", "no_ean")


def is_valid_page(title: Column, info: Column, description: Column, price: Column, cart: Column) -> Column:
    """A product page: a title, an info block, and a description, price or cart."""
    return ~is_blank(title) & ~is_blank(info) & (~is_blank(description) | ~is_blank(price) | ~is_blank(cart))


def signal_lines(text: Column) -> Column:
    """The distinct lines of a text that are not prices, codes or generic words."""
    noise = r"(?i)^(?:€?\s*[\d.,]+|ean:?.*|[0-9]{8,14}|lp|cd|vinyl|new|nieuw|sale|in winkelwagen|bestel|op voorraad)$"
    return F.array_distinct(F.filter(F.transform(F.split(text, "\n"), collapse), lambda x: (x != "") & ~x.rlike(noise)))


def run_status(exit_code: Column, accepted: Column, rejected: Column) -> Column:
    return F.when(exit_code.isNull(), F.lit("running")).when(exit_code != 0, F.lit("failed")).when(F.coalesce(accepted, F.lit(0)) == 0, F.lit("empty")).when(F.coalesce(rejected, F.lit(0)) > 0, F.lit("partial")).otherwise(F.lit("success"))


def queue_state(old: Column, candidates: Column) -> Column:
    """The state after a new request: processing stays, published stays without candidates, all else is queued."""
    return F.when(old == "processing", F.lit("processing")).when((old == "published") & (F.coalesce(candidates, F.lit(0)) == 0), F.lit("published")).otherwise(F.lit("queued"))


def confidence(score: Column, most: float = 125.0) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score / most))


def rank_confidence(rank: Column, most: int = 100) -> Column:
    """A candidate's rank as confidence in whole percent."""
    return F.least(F.lit(most), F.greatest(F.lit(0), rank))
