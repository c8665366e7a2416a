"""Identifiers: EAN and GTIN in the variants that the feeds need, and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelode.functions.text import collapse, strip_null_tokens


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[^0-9]", "")


def _of_length(d: Column, *lengths: int) -> Column:
    return F.when(F.length(d).isin(*lengths), d)


def ean(c: Column, decimal_tail: bool = True) -> Column:
    """8, 12, 13 or 14 digits, else null. 11 digits get a leading zero; a spreadsheet's
    trailing ".0" is cut off unless ``decimal_tail`` is false."""
    text = F.trim(c.cast("string"))
    d = digits(F.regexp_replace(text, r"\.0$", "") if decimal_tail else text)
    return _of_length(F.when(F.length(d) == 11, F.concat(F.lit("0"), d)).otherwise(d), 8, 12, 13, 14)


def gtin14(c: Column) -> Column:
    return F.lpad(ean(c), 14, "0")


def ean_bulk(c: Column) -> Column:
    """13 digits, or 12 with a zero before them; else ''."""
    d = digits(c)
    return F.when(F.length(d) == 12, F.concat(F.lit("0"), d)).when(F.length(d) == 13, d).otherwise(F.lit(""))


def ean_sync(c: Column) -> Column:
    """12 or 13 digits as they are; else ''."""
    return F.coalesce(_of_length(digits(strip_null_tokens(c)), 12, 13), F.lit(""))


def check_digit(body: Column) -> Column:
    """The GTIN check digit of a body of digits: weights 3, 1, 3, ... from the right."""
    n = F.length(body)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.substring(body, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, F.lit(3)).otherwise(F.lit(1))
    )
    return F.when(body.rlike("^[0-9]+$"), (10 - total % 10) % 10)


def is_valid_gtin(code: Column) -> Column:
    safe = F.when(code.rlike("^(?:[0-9]{8}|[0-9]{12,14})$"), code)
    n = F.length(safe)
    return F.coalesce(check_digit(F.substring(safe, F.lit(1), n - 1)) == F.substring(safe, n, F.lit(1)).cast("int"), F.lit(False))


def ean_listing(c: Column) -> Column:
    """11 to 13 digits, zero-padded to 13, if the check digit holds; else null."""
    d = F.lpad(_of_length(digits(c), 11, 12, 13), 13, "0")
    return F.when(is_valid_gtin(d), d)


def ean_strict(c: Column) -> Column:
    d = _of_length(digits(c), 13)
    return F.when(is_valid_gtin(d), d)


def gtin14_to_ean13(c: Column) -> Column:
    g = gtin14(c)
    return F.when(g.startswith("0"), F.substring(g, 2, 13))


def same_product_code(a: Column, b: Column) -> Column:
    return F.coalesce(gtin14(a) == gtin14(b), F.lit(False))


def search_gtin(query: Column) -> Column:
    """The GTIN-14 that a search text may be (11 digits are not rescued here)."""
    return F.lpad(_of_length(digits(query), 8, 12, 13, 14), 14, "0")


def upgraded_ean(old: Column, new: Column) -> Column:
    """12 digits give way to the 13 that extend them; else the old code stands, if any."""
    return F.when((F.length(old) == 12) & (new == F.concat(F.lit("0"), old)), new).otherwise(F.coalesce(F.nullif(old, F.lit("")), new))


def backfill_ean(c: Column) -> Column:
    """struct(ean, reason): a cleaned code, or why there is none."""
    raw = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    compact = F.regexp_replace(raw, "[ -]", "")
    compact = F.when(compact.startswith("="), F.btrim(F.ltrim(F.regexp_replace(compact, "^=+", "")), F.lit('"'))).otherwise(compact)
    only = digits(compact)
    reason = (
        F.when(raw == "", F.lit("missing_ean")).when(F.lower(raw).rlike(r"e[+-]"), F.lit("scientific_notation")).when(only == "", F.lit("non_numeric_ean")).otherwise(F.lit(""))
    )
    return F.struct(F.when(reason == "", only).otherwise(F.lit("")).alias("ean"), reason.alias("reason"))


def labelled_ean(text: Column) -> Column:
    """8 to 14 digits behind the first label (EAN, then barcode, then GTIN); null if none."""
    found = [F.nullif(F.regexp_extract(text, rf"(?i)\b{label}\b[^0-9]{{0,20}}([0-9]{{8,14}})(?![0-9])", 1), F.lit("")) for label in ("ean(?:[- ]?code)?", "bar ?code", "gtin")]
    return F.coalesce(*found)


def longest_digit_run(text: Column) -> Column:
    """The first of the longest runs of 8 to 14 digits; null if there is none."""
    runs = F.regexp_extract_all(text, F.lit(r"(?<![0-9])([0-9]{8,14})(?![0-9])"), 1)
    most = F.array_max(F.transform(runs, F.length))
    return F.try_element_at(F.filter(runs, lambda r: F.length(r) == most), F.lit(1))


def is_uuid(c: Column) -> Column:
    return F.coalesce(c.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"), F.lit(False))


def url_key(url: Column) -> Column:
    return F.md5(collapse(url).cast("binary"))


def content_key(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)


def fallback_key(release: Column, code: Column, url: Column, name: Column) -> Column:
    """release::, ean::, url:: or missing::, by what is there."""
    some = lambda c: F.nullif(collapse(c), F.lit(""))
    return F.coalesce(*(F.concat(F.lit(f"{k}::"), some(c)) for k, c in (("release", release), ("ean", code), ("url", url))), F.concat(F.lit("missing::"), collapse(name)))
