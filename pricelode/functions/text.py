"""Text expressions. All are native columns except ``similarity``."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Separators between artist and title, in order of precedence.
SEPARATORS = (" – ", " - ", " — ", "–", "—")
#: What exports write for a missing value.
NULL_TOKENS = ("nan", "none", "null", "<na>")


def collapse(c: Column) -> Column:
    """Runs of Unicode blanks, NUL and left-to-right marks as one blank; trimmed; null as ''."""
    plain = F.translate(F.coalesce(c.cast("string"), F.lit("")), "‎\u0000", "  ")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def is_blank(c: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("")) == ""


def strip_null_tokens(c: Column) -> Column:
    """Trimmed text; '' for null and for the words that exports write instead."""
    text = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(text).isin(*NULL_TOKENS), F.lit("")).otherwise(text)


def normalized(c: Column) -> Column:
    """Lower case, single blanks: the form in which queries and names are compared."""
    return F.lower(collapse(c))


def tokens(c: Column) -> Column:
    return F.filter(F.split(normalized(c), " "), lambda t: t != "")


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(normalized(c), "[^a-z0-9]+", "-"), F.lit("-"))


def open_slug(c: Column) -> Column:
    """A slug whose edges are not trimmed."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-")


def canonical_key(artist: Column, title: Column) -> Column:
    return F.concat(slug(artist), F.lit("::"), slug(title))


def sync_key(artist: Column, title: Column) -> Column:
    """lower(artist)::lower(title), null where both are empty."""
    a, t = (F.lower(F.trim(F.coalesce(x, F.lit("")))) for x in (artist, title))
    return F.when((a == "") & (t == ""), F.lit(None).cast("string")).otherwise(F.concat(a, F.lit("::"), t))


def free_text(c: Column) -> Column:
    """Lower case letters and digits, all else as single blanks."""
    return F.trim(F.regexp_replace(normalized(c), "[^a-z0-9]+", " "))


def search_text(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *(blank_to_null(collapse(p)) for p in parts)))


def plain_search_text(*parts: Column) -> Column:
    """The parts as they are, by single blanks; null where there are none."""
    return blank_to_null(F.trim(F.concat_ws(" ", *parts)))


def staged_search_text(*parts: Column) -> Column:
    """The parts in lower case, blanks inside kept; '' where there are none."""
    return F.lower(F.trim(F.concat_ws(" ", *parts)))


#: What stands for a name that no column tells. Fixed values.
UNKNOWN_ARTIST, UNKNOWN_TITLE = "Unknown Artist", "Unknown Title"


def unslugged(c: Column) -> Column:
    """A slug as words."""
    return collapse(F.replace(F.coalesce(c, F.lit("")), F.lit("-"), F.lit(" ")))


def names_or_unknown(artist: Column, title: Column, artist_slug: Column, title_slug: Column, display_name: Column) -> Column:
    """struct(artist, title) from the best columns that say something: the raw names, a title that holds
    both, a display name that begins with the artist's slug, the slugs, the display name; else Unknown."""
    a_slug, t_slug = unslugged(artist_slug), unslugged(title_slug)
    first = lambda *c: F.coalesce(*map(blank_to_null, c))
    shown = F.coalesce(first(collapse(display_name), collapse(title), t_slug), F.lit(""))
    raw = F.coalesce(first(collapse(title), t_slug, shown), F.lit(""))
    pair = infer_artist_title(F.coalesce(first(collapse(artist), a_slug), F.lit("")), raw)
    rest = F.when(F.startswith(F.lower(shown), F.concat(F.lower(a_slug), F.lit(" "))) & (a_slug != ""), collapse(F.substring(shown, F.length(a_slug) + 1, F.length(shown))))
    led = (pair["artist"] == "") & (F.coalesce(rest, F.lit("")) != "")
    return F.struct(
        F.coalesce(first(pair["artist"], a_slug), F.lit(UNKNOWN_ARTIST)).alias("artist"), F.coalesce(F.when(led, rest), first(pair["title"], raw), F.lit(UNKNOWN_TITLE)).alias("title")
    )


def _split_at(text: Column, separator: str) -> tuple[Column, Column]:
    at = F.instr(text, F.lit(separator))
    return collapse(F.substring(text, F.lit(1), at - 1)), collapse(F.substring(text, at + len(separator), F.length(text)))


def infer_artist_title(artist: Column, title: Column) -> Column:
    """struct(artist, title): a given artist stands; else the title is split at the first
    separator, by precedence, that leaves both sides, else before a blank behind a hyphen."""
    a, t = collapse(artist), collapse(title)
    pair = lambda x, y: F.struct(x.alias("artist"), y.alias("title"))

    def cut(separator: Column) -> Column:
        at = F.instr(t, separator)
        return pair(collapse(F.substring(t, F.lit(1), at - 1)), collapse(F.substring(t, at + F.length(separator), F.length(t))))

    hyphen = r"^(.+?)-\s+(.+)$"
    last = pair(collapse(F.regexp_extract(t, hyphen, 1)), collapse(F.regexp_extract(t, hyphen, 2)))
    # one tree for all separators: a chain of them would repeat the cleaned text for each
    cuts = F.concat(F.transform(F.array(*map(F.lit, SEPARATORS)), cut), F.array(last))
    cuts = F.filter(cuts, lambda c: (c["artist"] != "") & (c["title"] != ""))
    return F.coalesce(F.when(a != "", pair(a, t)), F.get(cuts, F.lit(0)), pair(F.lit(""), t))


def artist_album(title: Column) -> Column:
    """struct(artist, album) of a title whose trailing carrier in brackets goes first."""
    t = F.trim(F.regexp_replace(title, r"(?i)\s*\((?:(?:\d+\s*)?LPs?|CD|Cassette)\)\s*$", ""))
    none = F.lit(None).cast("string")
    found = None
    for separator in (" - ", " – ", " — "):
        left, right = _split_at(t, separator)
        pair = F.struct(blank_to_null(left).alias("artist"), blank_to_null(right).alias("album"))
        test = F.instr(t, F.lit(separator)) > 0
        found = F.when(test, pair) if found is None else found.when(test, pair)
    return found.otherwise(F.struct(none.alias("artist"), blank_to_null(t).alias("album")))


def artist_title_carrier(title: Column) -> Column:
    """struct(artist, title, carrier): a trailing bracket of up to 30 characters is the carrier."""
    t = collapse(title)
    carrier = F.regexp_extract(t, r"\(([^()]{1,30})\)$", 1)
    rest = F.when(carrier != "", collapse(F.regexp_replace(t, r"\([^()]{1,30}\)$", ""))).otherwise(t)
    pair = infer_artist_title(F.lit(""), rest)
    return F.struct(pair["artist"].alias("artist"), pair["title"].alias("title"), carrier.alias("carrier"))


def strip_format(title: Column) -> Column:
    """A title without a last part that names a format."""
    return collapse(F.regexp_replace(title, r"(?i)\s*[-–(\[]\s*(?:\d+\s*x?\s*)?(?:lp|vinyl|cd|cassette|12 ?inch|7 ?inch|12\"|7\"|box ?set)\b[^-–]*$", ""))


def last_first(name: Column) -> Column:
    """"Last, First" as "First Last"; other names as they are."""
    n = collapse(name)
    parts = F.split(n, r"\s*,\s*")
    whole = (F.size(parts) == 2) & (parts[0] != "") & (parts[1] != "")
    return F.when(whole, F.concat_ws(" ", parts[1], parts[0])).otherwise(n)


def artist_year(name: Column) -> Column:
    """struct(artist, year): a last word of four digits from 1900 to 2100 is the year."""
    n = collapse(name)
    year = F.regexp_extract(n, r"^.*\s(\d{4})$", 1).try_cast("int")
    plausible = F.coalesce(year.between(1900, 2100), F.lit(False))
    return F.struct(
        F.when(plausible, collapse(F.regexp_replace(n, r"\s+\d{4}$", ""))).otherwise(n).alias("artist"), F.when(plausible, year).alias("year")
    )


def display_case(name: Column) -> Column:
    """A name all in capitals with only its first letter large."""
    n = F.trim(name)
    return F.when((n != "") & (n == F.upper(n)), F.concat(F.upper(F.substring(n, 1, 1)), F.lower(F.substring(n, 2, 100_000)))).otherwise(n)


def format_label(*parts: Column, default: str = "Vinyl", separator: str = " | ") -> Column:
    """Distinct non-empty parts in order; ``default`` where none is left."""
    kept = F.array_distinct(F.filter(F.array(*(collapse(p) for p in parts)), lambda p: p != ""))
    return F.when(F.size(kept) > 0, F.array_join(kept, separator)).otherwise(F.lit(default))


def carrier(c: Column) -> Column:
    low = normalized(c)
    return (
        F.when(low == "", F.lit("")).when(low.contains("lp") | low.contains("vinyl"), F.lit("LP")).when(low.contains("cd"), F.lit("CD")).when(low.contains("box"), F.lit("BOX"))
        .when(low.contains("12 inch") | low.contains('12"'), F.lit("12 INCH")).when(low.contains("7 inch") | low.contains('7"'), F.lit("7 INCH")).otherwise(F.upper(collapse(c)))
    )


def pipe_join(existing: Column, new: Column, most: int = 20) -> Column:
    """A " | " list with a value appended unless it is there; the last ``most`` items stay."""
    items = F.filter(F.split(F.coalesce(existing, F.lit("")), r" \| "), lambda x: x != "")
    longer = F.when((F.coalesce(new, F.lit("")) != "") & ~F.array_contains(items, F.coalesce(new, F.lit(""))), F.concat(items, F.array(new))).otherwise(items)
    return F.array_join(F.slice(longer, F.greatest(F.size(longer) - most + 1, F.lit(1)), F.lit(most)), " | ")


def with_flag(status: Column, flag: str, test: Column) -> Column:
    """A "|" list of flags with ``flag`` appended where ``test`` holds."""
    flags = F.filter(F.split(F.coalesce(status, F.lit("")), r"\|"), lambda x: x != "")
    return F.array_join(F.when(test, F.array_distinct(F.concat(flags, F.array(F.lit(flag))))).otherwise(flags), "|")


def between_labels(text: Column, labels: list[str], following: list[str]) -> Column:
    """What stands between one of ``labels`` and the next of ``following``, or the end."""
    a, b = ("|".join(f"\\Q{x}\\E" for x in xs) for xs in (labels, following))
    return collapse(F.regexp_extract(text, rf"(?is)(?:{a})\s*:?\s*(.*?)(?:(?:{b})|$)", 1))


def longer_value(current: Column, candidate: Column) -> Column:
    a, b = collapse(current), collapse(candidate)
    return F.when(F.length(b) > F.length(a), b).otherwise(a)


def truncated(c: Column, most: int = 1000) -> Column:
    return F.substring(c, 1, most)


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts, blanks collapsed; 0 if either is empty. No native
    function measures this (edit distances differ)."""

    def ratio(x: str | None, y: str | None) -> float:
        x, y = (" ".join((v or "").split()) for v in (x, y))
        return SequenceMatcher(None, x, y).ratio() if x and y else 0.0

    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def dutch(c: Column) -> Column:
    """A text for ordering and comparing by Dutch rules at base strength: accents and case don't count."""
    return F.collate(c, "nl_CI_AI")
