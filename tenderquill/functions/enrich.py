"""Facts read out of notice and award texts: winner, term, fill-if-empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dates import sane_year

#: Numbers in words; patterns that end a firm's name in running text; words of a scope of work, which no name holds; parts of firms' names.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "twelve": 12, "eighteen": 18,
    "twenty four": 24, "thirty six": 36,
}
STOP = [
    r"National\s+Tender", r"Provincial\s+Tender", r"TS\d", r"TN\d", r"P\.?\s?No", "Plot", r"E-\d", "Survey", "Near", "Phase", "Block", "Street", r"Road\b", "Sector", "House", "Shop",
    "Floor", "Building", "Market", "Town", "Colony", "Scheme", "Chowk", "Bazar", "Bazaar", "Office", "Suite", "Room", "Flat", "Gali", "Mouza", "Tehsil", "District", "Opposite",
    r"\d{1,2}(?:st|nd|rd|th)\b", r"\bNo\.",
]
SCOPE = [
    "along with", r"works?\b", r"services?\b", "repair", "providing", "fixing", "supply", "installation", "construction", "procurement", "maintenance", "provision", "including", "complete",
    "various", "miscellaneous", "equipment", "material",
]
FIRM = [
    "enterprise", "trader", "associate", "international", "pvt", "private", "ltd", "limited", "corporation", "industries", "company", r"\bco\b", r"&\s?co", "builder", "engineer",
    "solution", "system", "technolog", r"tech\b", "services", "store", "paint", "mills", "hardware", "traders", "brothers", "sons", "agencies", "agency", "impex", "construction",
]


def _any(patterns: list[str]) -> str:
    return "(?:" + "|".join(patterns) + ")"


def winner_of(text: Column, cities: list[str]) -> Column:
    """The firm after M/s, else after words like awarded to, without its city; null unless it reads like a firm."""
    t = F.coalesce(text, F.lit(""))
    after = rf"([A-Za-z][A-Za-z0-9&.\-' ]{{2,55}}?)(?=,|\s+{_any([*STOP, *cities, *SCOPE])}\b|\s*$)"
    leads = [r"M/?s\.?\s+", r"(?:awarded\s+to|contractor|supplier|vendor)\s*[:\-]?\s+"]
    name = F.coalesce(*(F.nullif(F.regexp_extract(t, "(?i)" + lead + after, 1), F.lit("")) for lead in leads))
    name = F.trim(F.regexp_replace(name, r"\s{2,}", " "), F.lit(" .,-"))
    name = F.trim(F.regexp_replace(name, rf"(?i)\s+{_any(cities)}$", "")) if cities else name
    good = (F.length(name) >= 4) & ~name.rlike(f"(?i){_any(SCOPE)}")
    words = F.split(name, " ")
    # a repeated longer word is kept once
    lower = F.transform(words, lambda x: F.lower(x))
    name = F.array_join(F.filter(words, lambda w, k: (F.length(w) <= 3) | (F.array_position(lower, F.lower(w)) == k + 1)), " ")
    name = F.trim(F.regexp_replace(name, r"\s+\d[\w\-]*$", ""))
    reads = name.rlike(f"(?i){_any(FIRM)}") | F.size(F.split(name, " ")).between(2, 5)
    return F.when(good & reads, F.substring(name, 1, 80))


def term_months(text: Column) -> Column:
    """A term in months: digits before year or month, else a number word after 'period of'."""
    low = F.lower(F.coalesce(text, F.lit("")))
    digits = lambda unit: F.nullif(F.regexp_extract(low, rf"(\d{{1,3}})\s*\(?\d{{0,3}}\)?\s*{unit}", 1), F.lit("")).cast("int")
    word, unit = (F.regexp_extract(low, rf"period of\s+({'|'.join(sorted(NUMBER_WORDS, key=len, reverse=True))})\b.*?(year|month)", k) for k in (1, 2))
    number = F.try_element_at(F.create_map(*(F.lit(x) for kv in NUMBER_WORDS.items() for x in kv)), word)
    return F.coalesce(digits("year") * 12, digits("month"), number * F.when(unit == "year", 12).otherwise(1))


def first_found(texts: list[Column], read) -> Column:
    return reduce(lambda a, b: F.coalesce(a, b), (read(t) for t in texts))


def enrich_awards(awards: DataFrame, cities: list[str], first_year: int = 2000, last_year: int = 2100) -> DataFrame:
    """Empty winners and terms filled from title and description; dates outside the years emptied."""
    texts = [F.col("title"), F.col("description")]
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return awards.withColumns(
        {
            "winner": F.coalesce(blank("winner"), first_found(texts, lambda t: winner_of(t, cities))),
            "tenure_months": F.coalesce("tenure_months", first_found(texts, term_months)),
            "award_date": sane_year(F.col("award_date"), first_year, last_year),
        }
    )
