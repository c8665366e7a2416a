"""Dates and times. "Now" is always a parameter; zones are explicit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelode.functions.text import collapse

SHOP_ZONE = "Europe/Amsterdam"


def local_day(ts: Column, zone: str = SHOP_ZONE) -> Column:
    """The day of a UTC time in a zone."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), zone))


def parse_timestamp(c: Column, as_of: Column) -> Column:
    """ISO text as a time (no zone: UTC); blank gives ``as_of``, an unreadable text null."""
    text = collapse(c)
    return F.when(text == "", as_of).otherwise(text.try_cast("timestamp"))


def timestamp_text(c: Column) -> Column:
    ts = collapse(c).try_cast("timestamp")
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit(""))


def date_or(c: Column, fallback: Column, as_of: Column) -> Column:
    """The date that a text begins with, else the fallback's, else today's."""
    return F.coalesce(F.substring(collapse(c), 1, 10).try_cast("date"), fallback.try_cast("date"), as_of.cast("date"))


def iso_week(day: Column) -> Column:
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), day).cast("int"), F.weekofyear(day))


def hours_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 3_600_000_000


#: Upper bounds in hours and labels. Fixed values, as the shop shows them.
FRESHNESS = ((24, "vandaag gecontroleerd"), (48, "1 dag oud"), (72, "2 dagen oud"))
STALE = "mogelijk niet actueel"


def freshness_label(last_seen: Column, as_of: Column) -> Column:
    age = hours_between(last_seen, as_of)
    label = F.when(last_seen.isNull(), F.lit(None).cast("string"))
    for hours, text in FRESHNESS:
        label = label.when(age < hours, F.lit(text))
    return label.otherwise(F.lit(STALE))


#: The labels of a product's page: whole sentences, and older ones by days.
CHECKED = ((24, "Vandaag gecontroleerd"), (48, "1 dag geleden gecontroleerd"))


def checked_label(last_seen: Column, as_of: Column) -> Column:
    age = hours_between(last_seen, as_of)
    label = F.when(last_seen.isNull(), F.lit(None).cast("string"))
    for hours, text in CHECKED:
        label = label.when(age < hours, F.lit(text))
    return label.otherwise(F.concat(F.floor(age / 24).cast("string"), F.lit(" dagen geleden gecontroleerd")))


#: Short Dutch month names, as charts show them. Fixed values.
MONTHS = ("jan", "feb", "mrt", "apr", "mei", "jun", "jul", "aug", "sep", "okt", "nov", "dec")


def day_label(day: Column, year: bool = False) -> Column:
    """A day for display: 5 mei, or 5 mei 2024."""
    parts = [F.dayofmonth(day).cast("string"), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day))]
    return F.when(day.isNotNull(), F.concat_ws(" ", *parts, *([F.year(day).cast("string")] if year else [])))


def recency_score(last_seen: Column, as_of: Column) -> Column:
    age = F.greatest(hours_between(last_seen, as_of), F.lit(0.0))
    return F.when(last_seen.isNull(), 0).when(age <= 24, 10).when(age <= 72, 6).when(age <= 168, 2).otherwise(0)


def backoff_minutes(attempts: Column) -> Column:
    """10 minutes, doubled for each further attempt, a day at most."""
    return F.least(F.lit(1440), F.lit(10) * F.pow(F.lit(2), F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(12)))).cast("int")


def duration_seconds(started: Column, finished: Column) -> Column:
    return F.round((F.unix_micros(finished.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))) / 1_000_000, 3)


def cutoff_day(as_of: Column, days: int) -> Column:
    """The first of the last ``days`` days, counted back from the day before."""
    return F.date_sub(as_of.cast("date"), max(1, days - 1))
