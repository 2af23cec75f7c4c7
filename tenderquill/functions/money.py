"""Money: currency, amount words, conversion and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rupees a unit, and what amount words stand for.
FX = {"PKR": 1.0, "USD": 278.0, "EUR": 302.0, "GBP": 355.0}
UNITS = {"million": 1e6, "m": 1e6, "billion": 1e9, "bn": 1e9, "crore": 1e7, "lakh": 1e5}
AMOUNT = r"(?i)(rs\.?|pkr|usd|us\$|\$|eur|gbp)?\s*(\d[\d,]*(?:\.\d+)?)\s*(million|billion|crore|lakh|m\b|bn\b)?"


def parse_money(text: Column, fx: dict[str, float] = FX) -> Column:
    """struct(value_text, value_num in PKR, currency); all null for blank text, number and currency null without digits."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    sign, digits, unit = (F.lower(F.regexp_extract(t, AMOUNT, k)) for k in (1, 2, 3))
    currency = F.when(sign.isin("usd", "us$", "$"), "USD").when(sign == "eur", "EUR").when(sign == "gbp", "GBP").otherwise("PKR")
    amount = F.when(digits != "", F.regexp_replace(digits, ",", "").cast("double"))
    pick = lambda key, values: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key), F.lit(1.0))
    value = amount * pick(unit, UNITS) * pick(currency, fx)
    return F.struct(F.when(t != "", t).alias("value_text"), value.alias("value_num"), F.when(value.isNotNull(), currency).alias("currency"))


def fixed(x: Column, places: int) -> Column:
    """x, 1 or more, with so many decimals (1 or 2) as C and Python print it: by the exact value of the binary number, ties to even.

    Java's formatter rounds the shortest decimal instead, half up: 4.85, which is less than that, to 4.9 and 1.25 to 1.3.
    """
    scale = 10**places
    whole = F.floor(x)
    part = x - whole
    k = F.floor(part * scale)
    # 2k + 1 less 2 part * scale, its sign without rounding: part times powers of 2, large ones first
    rest = (2 * k + 1).cast("double")
    for power in (1 << b for b in reversed(range(8)) if (2 * scale) >> b & 1):
        rest = rest - part * power
    k = k + F.when((rest < 0) | ((rest == 0) & (k % 2 == 1)), 1).otherwise(0)
    near = F.concat((whole + F.when(k == scale, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad((k % scale).cast("string"), places, "0"))
    inf = F.lit(float("inf"))
    return F.when(F.isnan(x), "nan").when(x == inf, "inf").when(x < 9e18, near).otherwise(F.format_string(f"%.{places}f", x))


def money_label(n: Column) -> Column:
    """Rupees in billions, millions or whole; '-' for null and 0."""
    return (
        F.when(n.isNull() | (n == 0), F.lit("-"))
        .when(n >= 1e9, F.concat(F.lit("Rs "), fixed(n / 1e9, 2), F.lit("bn")))
        .when(n >= 1e6, F.concat(F.lit("Rs "), fixed(n / 1e6, 1), F.lit("m")))
        .otherwise(F.concat(F.lit("Rs "), F.format_number(n, 0)))
    )


VALUE_BANDS = [(1e6, "Under 1M"), (1e7, "1M - 10M"), (5e7, "10M - 50M"), (5e8, "50M - 500M")]


def value_band(v: Column) -> Column:
    band = F.when(v.isNull(), "Not disclosed")
    for top, name in VALUE_BANDS:
        band = band.when(v < top, name)
    return band.otherwise("Above 500M")
