"""Price parsers. Feeds disagree on separators, so each family keeps its own; ``decimal_price``
is the canonical one. Texts that a parser can't read give null (or '' where it returns text)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelode.functions.text import collapse

_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def _number(text: Column) -> Column:
    """A finite number; words such as nan and inf are refused."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def _shown(number: Column) -> Column:
    """A number with two decimals, as text, rounded by its exact binary value (2.675 is 2.67): the
    patterns of format_number do so, round and format_string go by the digits that a number shows."""
    return F.translate(F.format_number(number, 2), ",", "")


def _two(text: Column, otherwise: str | None = "") -> Column:
    """The number with two decimals, as text."""
    return F.coalesce(_shown(_number(text)), F.lit(otherwise))


def _both(t: Column) -> Column:
    return t.contains(",") & t.contains(".")


def _commas_are_decimal(t: Column) -> Column:
    """With both signs dots are thousands; a comma alone is the decimal sign."""
    return F.when(_both(t), F.translate(t, ",.", ".")).otherwise(F.translate(t, ",", "."))


def decimal_price(c: Column) -> Column:
    """P1, canonical."""
    t = F.regexp_replace(collapse(c), "€|EUR| ", "")
    return F.when(c.isNotNull(), _number(_commas_are_decimal(t)))


def token_price(c: Column) -> Column:
    """The first number token, two decimals half up; negative ones are refused."""
    token = F.regexp_extract(F.regexp_replace(collapse(c), "€", ""), r"-?\d+[.,]?\d*", 0)
    value = F.round(_commas_are_decimal(token).try_cast("decimal(20,6)"), 2).cast("decimal(12,2)")
    return F.when(value >= 0, value)


def positive_price_text(c: Column) -> Column:
    """Every comma is a dot, the first dot counts, half even; '' unless positive."""
    t = F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), ",", "."), r"[^0-9.\-]", "")
    first = F.instr(t, F.lit("."))
    t = F.when(first > 0, F.concat(F.substring(t, F.lit(1), first), F.translate(F.substring(t, first + 1, F.length(t)), ".", ""))).otherwise(t)
    value = F.bround(F.when(t.rlike(_NUMBER), t.try_cast("decimal(20,6)")), 2).cast("decimal(12,2)")
    return F.when(value.isNotNull() & (F.when(t.rlike(_NUMBER), t.try_cast("decimal(20,6)")) > 0), value.cast("string")).otherwise(F.lit(""))


def dutch_price(c: Column) -> Column:
    """For display, dots as commas."""
    return F.translate(F.regexp_replace(collapse(c), "€|EUR| ", ""), ".", ",")


def euro_echo(c: Column) -> Column:
    """P5: the amount with a euro sign before it; other texts as they are."""
    t = F.regexp_replace(collapse(c), "EUR", "€")
    amount = F.regexp_extract(t, r"€\s*([\d.,]+)", 1)
    return F.when(amount != "", F.concat(F.lit("€"), amount)).when(t.rlike(r"^[\d.,]+$"), F.concat(F.lit("€"), t)).otherwise(F.regexp_replace(t, "€ ", "€"))


def cents_price(c: Column) -> Column:
    """P6."""
    return _shown(_number(F.trim(c)) / 100).cast("double")


def plain_price(c: Column) -> Column:
    """Digits and signs, commas as dots."""
    return _shown(_number(F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\d,.]", ""), ",", "."))).cast("double")


def dots_dropped_price(c: Column) -> Column:
    """Dots are thousands always."""
    return _number(F.translate(F.trim(F.regexp_replace(collapse(c), "€", "")), ",.", "."))


def _later_comma(t: Column, comma_alone: Column) -> Column:
    """With both signs, the text is rewritten only where the comma comes later."""
    comma, dot = (F.length(t) - F.instr(F.reverse(t), F.lit(x)) for x in (",", "."))
    return F.when(_both(t) & (comma > dot), F.translate(t, ",.", ".")).when(_both(t), t).when(t.contains(","), comma_alone).otherwise(t)


def later_sign_price(c: Column) -> Column:
    """Null where both signs stand and the dot is later."""
    t = F.regexp_replace(collapse(c), "€| ", "")
    return _two(_later_comma(t, F.translate(t, ",", ".")), None)


def digits_sign_price(c: Column) -> Column:
    """P10: as P9 on digits and signs alone; ''."""
    t = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"[^\d,.]", "")
    return _two(_later_comma(t, F.translate(t, ",", ".")))


def first_decimal_price(c: Column) -> Column:
    """The first number with up to two decimals."""
    t = F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)€|\s", ""), ",", ".")
    return _two(F.regexp_extract(t, r"\d+(?:\.\d{1,2})?", 0))


def stripped_price(c: Column) -> Column:
    """Digits, signs and minus, then as P1; ''."""
    return _two(_commas_are_decimal(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9,.\-]", "")))


def last_euro_price(c: Column) -> Column:
    """The last euro amount with two decimals, for display."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"€\s*(\d+[.,]\d{2})"), 1)
    return F.when(F.size(found) > 0, F.concat(F.lit("€"), F.translate(F.element_at(found, -1), ".", ","))).otherwise(F.lit(""))


PARSERS = {
    "p1": decimal_price, "p2": token_price, "p3": positive_price_text, "p4": dutch_price, "p5": euro_echo, "p6": cents_price, "p7": plain_price, "p8": dots_dropped_price,
    "p9": later_sign_price, "p10": digits_sign_price, "p11": first_decimal_price, "p12": stripped_price, "p13": last_euro_price,
}


def current_and_old(prices: Column) -> Column:
    """struct(current, old) of the prices of a listing: the last is current, a different first one old."""
    first, last = F.try_element_at(prices, F.lit(1)), F.try_element_at(prices, F.lit(-1))
    return F.struct(last.alias("current"), F.when(F.size(prices) > 1, F.nullif(first, last)).alias("old"))


def is_placeholder(price: Column, value: float = 80.0) -> Column:
    """A price that a shop shows where it has none."""
    return F.coalesce(price == value, F.lit(False))


#: The same as texts, without blanks. Fixed values.
PLACEHOLDER_TEXTS = ("80", "80,00", "€80", "€80,00")


def is_placeholder_text(price: Column) -> Column:
    return F.coalesce(F.replace(dutch_price(price), F.lit(" "), F.lit("")).isin(*PLACEHOLDER_TEXTS), F.lit(False))


def euro(price: Column) -> Column:
    """For display: € 1.234,50; €--,-- for null."""
    plain = F.translate(F.format_number(price, 2), ",.", ".,")
    return F.when(price.isNull(), F.lit("€--,--")).otherwise(F.concat(F.lit("€ "), plain))
