"""Date columns: as-of arithmetic, month steps, calendar weeks and text parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(asof: str | Column) -> Column:
    return F.lit(asof).cast("date") if isinstance(asof, str) else asof


def shift(asof: str | Column, days: int) -> Column:
    return F.date_add(day(asof), days)


def months_back(asof: str | Column, months: int) -> Column:
    """asof less months, overflowing into the next month where the day doesn't exist."""
    d = day(asof)
    first = F.add_months(F.trunc(d, "month"), -months)
    return F.date_add(first, F.dayofmonth(d) - 1)


def add_months_clamped(d: Column, months: Column) -> Column:
    """d plus months with the day no later than the 28th; null without either or for 0 months."""
    m = F.month(d) - 1 + months
    made = F.make_date(F.year(d) + F.floor(m / 12).cast("int"), F.pmod(m, F.lit(12)).cast("int") + 1, F.least(F.dayofmonth(d), F.lit(28)))
    return F.when(months != 0, made)


def month_key(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def week_key(d: Column) -> Column:
    """Year and Monday-based week number, 00 before the first Monday."""
    d = d.cast("date")
    week = F.floor((F.dayofyear(d) + 6 - F.weekday(d)) / 7)
    return F.concat(F.year(d).cast("string"), F.lit("-"), F.lpad(week.cast("string"), 2, "0"))


def days_left(closing: Column, asof: str | Column) -> Column:
    """Calendar days, as the feed shows them."""
    return F.date_diff(closing, day(asof))


def days_left_truncated(closing: Column, now: str) -> Column:
    """Days from a moment, truncated towards zero, as rankings use them."""
    seconds = F.unix_timestamp(closing.cast("timestamp")) - F.unix_timestamp(F.lit(now).cast("timestamp"))
    return (seconds / 86400).cast("int")


def days_between(a: Column, b: Column) -> Column:
    """Absolute gap of two ISO strings; null where either isn't a date."""
    return F.abs(F.date_diff(F.try_to_date(a, "yyyy-MM-dd"), F.try_to_date(b, "yyyy-MM-dd")))


def _made(y: Column, m: Column, d: Column) -> Column:
    text = F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.try_to_date(F.when((y != "") & (m != "") & (d != ""), text), "yyyy-MM-dd")


MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def _month_number(name: Column) -> Column:
    numbers = F.create_map(*(F.lit(x) for k, m in enumerate(MONTHS, 1) for x in (m, str(k))))
    return F.coalesce(F.try_element_at(numbers, F.lower(F.substring(name, 1, 3))), F.lit(""))


def parse_date(text: Column) -> Column:
    """Portal dates: month name first, day first with month name, ISO, day/month/year; else null."""
    t = F.trim(F.coalesce(text, F.lit("")))
    g = lambda pattern, k: F.regexp_extract(t, pattern, k)
    named, dmy = r"(?i)([a-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})", r"(?i)(\d{1,2})(?:st|nd|rd|th)?[\s\-]+([a-z]{3,9})[\s\-,]+(\d{4})"
    iso, slashed = r"(\d{4})-(\d{1,2})-(\d{1,2})", r"(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})"
    return F.coalesce(
        _made(g(named, 3), _month_number(g(named, 1)), g(named, 2)),
        _made(g(dmy, 3), _month_number(g(dmy, 2)), g(dmy, 1)),
        _made(g(iso, 1), g(iso, 2), g(iso, 3)),
        _made(g(slashed, 3), g(slashed, 2), g(slashed, 1)),
    )


def parse_list_date(text: Column) -> Column:
    """Dates of uploaded lists: any dash, two-digit years, a trailing time; ISO text, '' where there is none."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "[‐‑‒–—−]", "-")
    t = F.trim(F.regexp_replace(t, r"(?i)\s*at\s*\d{1,2}:\d{2}\s*[apm.]*", ""))
    g = lambda pattern, k: F.regexp_extract(t, pattern, k)
    iso, numeric = r"(\d{4}-\d{2}-\d{2})", r"(\d{1,2})[-/](\d{1,2})[-/](\d{2,4})"
    short, long = r"(?i)(\d{1,2})[-\s]([a-z]{3,9})[-\s](\d{2})(?!\d)", r"(?i)(\d{1,2})[-\s]([a-z]{3,9})[-\s](\d{4})"
    year = F.when(F.length(g(numeric, 3)) == 2, F.concat(F.lit("20"), g(numeric, 3))).otherwise(g(numeric, 3))
    as_text = lambda d: F.date_format(d, "yyyy-MM-dd")
    return F.coalesce(
        F.when(g(iso, 1) != "", g(iso, 1)),
        F.when(g(numeric, 1) != "", F.concat_ws("-", year, F.lpad(g(numeric, 2), 2, "0"), F.lpad(g(numeric, 1), 2, "0"))),
        as_text(_made(F.concat(F.lit("20"), g(short, 3)), _month_number(g(short, 2)), g(short, 1))),
        as_text(_made(g(long, 3), _month_number(g(long, 2)), g(long, 1))),
        F.lit(""),
    )


def parse_time(text: Column) -> Column:
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)(\d{1,2}:\d{2}\s*(?:a\.?m\.?|p\.?m\.?)?)", 1)
    return F.when(found != "", F.trim(found))


def sane_year(d: Column, first: int, last: int) -> Column:
    return F.when(F.year(d).between(first, last), d)


def sane_advertised(advertised: Column, closing: Column, asof: str | Column) -> Column:
    """advertised, or null where it lies after asof or after closing."""
    wrong = (advertised > day(asof)) | F.coalesce(advertised > closing, F.lit(False))
    return F.when(~wrong, advertised)
