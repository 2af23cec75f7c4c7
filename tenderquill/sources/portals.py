"""Portal listings as columns: page counts, rows by content, JSON records, id sweeps, award windows, adverts."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.dates import parse_date
from ..functions.money import parse_money
from ..functions.text import clean
from .html import EMAIL, PHONE, page_text

c = F.col


def total_pages(html: Column) -> Column:
    """M of 'Page N of M', else the largest numbered link, else 1."""
    t = page_text(html)
    stated = F.nullif(F.regexp_extract(t, r"Page\s+\d+\s+of\s+(\d+)", 1), F.lit("")).cast("int")
    links = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<a[^>]*>\s*(\d{1,6})\s*</a>"), F.lit(1)), lambda x: x.cast("int"))
    return F.coalesce(stated, F.array_max(links), F.lit(1))


def row_by_content(cells: Column, ref_pattern: str) -> Column:
    """ref, title, advertised, closing of a row's cells: first reference, longest cell, least and largest date."""
    dates = F.filter(F.transform(cells, parse_date), lambda d: d.isNotNull())
    refs = F.filter(F.transform(cells, lambda x: F.regexp_extract(x, ref_pattern, 0)), lambda x: x != "")
    longest = F.array_max(F.transform(cells, lambda x, k: F.struct(F.length(x).alias("n"), (-k).alias("k"), x.alias("x"))))["x"]
    return F.struct(F.get(refs, F.lit(0)).alias("ref"), longest.alias("title"), F.array_min(dates).alias("advertised"), F.array_max(dates).alias("closing"))


def json_records(raw: DataFrame, column: str, schema: str, names: dict[str, list[str]], must_contain: str | None = None) -> DataFrame:
    """Records of a JSON column: each field is the first non-null of its keys; closing on or before advertised is emptied."""
    rows = raw.where(F.lower(column).contains(must_contain)) if must_contain else raw
    rows = rows.select(F.from_json(column, schema).alias("r")).where("r IS NOT NULL")
    out = rows.select(*(F.coalesce(*(c(f"r.{k}") for k in keys)).alias(name) for name, keys in names.items()))
    if {"advertised", "closing"} <= set(names):
        out = out.withColumns({x: parse_date(c(x)) for x in ("advertised", "closing")})
        out = out.withColumn("closing", F.when(~F.coalesce(c("closing") <= c("advertised"), F.lit(False)), c("closing")))
    return out


def sweep_ids(spark: SparkSession, fetch: Callable[[DataFrame], DataFrame], start: int, lowest: int = 0, batch: int = 60, stop_after: int = 600, save: Callable[[int, DataFrame], None] | None = None) -> Iterator[DataFrame]:
    """Batches of ids downward through fetch (ids to rows with id), until so many ids in a row had none.

    save(cursor, rows) is called after each batch, so a sweep can go on from its cursor.
    """
    missed = 0
    while start > lowest and missed < stop_after:
        ids = spark.range(max(lowest, start - batch) + 1, start + 1)
        rows = fetch(ids).persist()
        low = rows.agg(F.min("id").alias("low")).first()["low"]
        first = max(lowest, start - batch)
        missed = missed + start - first if low is None else low - first - 1
        start = first
        if save:
            save(start, rows)
        yield rows
        rows.unpersist()


BLOCK_IDS = 1 << 20


def consecutive_misses(ids: DataFrame, hit: Column, block: int = BLOCK_IDS) -> DataFrame:
    """first, last, n of each run of ids without a hit: runs are named by the hit before them, found within blocks of ids and, where a block has none yet, from the last hit of earlier blocks."""
    rows = ids.select("id", hit.alias("hit"), F.floor(F.col("id") / block).alias("block"))
    last = rows.groupBy("block").agg(F.max(F.when(F.col("hit"), F.col("id"))).alias("hit_id"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    last = last.select("block", F.max("hit_id").over(before).alias("earlier"))
    here = Window.partitionBy("block").orderBy("id")
    rows = rows.withColumn("own", F.max(F.when(F.col("hit"), F.col("id"))).over(here)).join(last, "block")
    rows = rows.where("NOT hit").withColumn("run", F.coalesce("own", "earlier"))
    return rows.groupBy("run").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).drop("run")


def month_windows(asof: datetime.date, back: int = 2) -> list[tuple[datetime.date, datetime.date]]:
    """(first, last day) of asof's month and those before: award lists are read again for late rows."""
    out, first = [], asof.replace(day=1)
    for _ in range(back + 1):
        last = (first + datetime.timedelta(days=31)).replace(day=1) - datetime.timedelta(days=1)
        out.append((first, min(last, asof)))
        first = (first - datetime.timedelta(days=1)).replace(day=1)
    return out


def union_windows(parts: list[DataFrame], key: str = "ref") -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.dropDuplicates([key])


def capped(rows: DataFrame, per: str, order: str, n: int = 80) -> DataFrame:
    """At most n rows of each organisation, titles once."""
    w = Window.partitionBy(per).orderBy(order)
    return rows.dropDuplicates([per, "title"]).withColumn("__k", F.row_number().over(w)).where(f"__k <= {n}").drop("__k")


CUE = r"(?i)tender|bid|proposal|quotation|expression of interest|auction|procurement"
INSTITUTION = r"(?i)authority|department|ministry|board|corporation|company|university|hospital|government|office|directorate|council|bank|limited"


def advert_row(block: Column, asof_year: Column | int) -> Column:
    """buyer, title, ref, advertised, closing, value, email, phone of an advert block; null without a tender cue."""
    lines = F.filter(F.transform(F.split(block, "\n"), clean), lambda x: x != "")
    institutions = F.filter(F.slice(lines, 1, 8), lambda x: x.rlike(INSTITUTION) & F.length(x).between(9, 119))
    upper = lambda x: F.length(F.regexp_replace(x, r"[^\p{Lu}]", "")) > 0.75 * F.length(F.regexp_replace(x, r"[^\p{L}]", ""))
    field = r"(?i)^(?:sr|s\.?no|lot|item|contact|email|ph|tel|bid security|last date|closing|tender no|nit no|estimated)\b"
    buyer = F.coalesce(F.get(institutions, F.lit(0)), F.substring(F.get(lines, F.lit(0)), 1, 120))
    subject = F.get(F.filter(lines, lambda x: (F.length(x) >= 20) & (x != buyer) & ~upper(x) & ~x.rlike(field)), F.lit(0))
    found = F.regexp_extract_all(block, F.lit(r"(\d{1,2}[/\-.\s](?:\d{1,2}|[A-Za-z]{3,9})[/\-.\s,]+\d{4}|[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4})"), F.lit(1))
    days = F.filter(F.transform(found, parse_date), lambda d: d.isNotNull() & F.year(d).between(asof_year - 2, asof_year + 4))
    amount = F.nullif(F.regexp_extract(block, r"(?i)((?:rs\.?|pkr|usd)\s*[\d,]+(?:\.\d+)?\s*(?:million|billion|crore|lakh)?)", 1), F.lit(""))
    row = F.struct(
        buyer.alias("buyer"), F.regexp_replace(subject, r"(?i)^(?:subject|description|name of work)\s*[:\-]\s*", "").alias("title"),
        F.nullif(F.regexp_extract(block, r"(?i)(?:tender|nit|ref(?:erence)?|ift)\s*(?:no\.?|#)\s*[:\-]?\s*([A-Za-z0-9/\-.]{0,20}\d[A-Za-z0-9/\-.]{0,20})", 1), F.lit("")).alias("ref"),
        F.when(F.size(days) > 1, F.array_min(days)).alias("advertised"), F.array_max(days).alias("closing"), parse_money(amount)["value_num"].alias("value_num"),
        F.nullif(F.regexp_extract(block, EMAIL, 1), F.lit("")).alias("contact_email"), F.nullif(F.regexp_extract(block, PHONE, 1), F.lit("")).alias("contact_phone"),
    )
    return F.when(block.rlike(CUE) & (F.size(lines) >= 2) & (F.length(subject) >= 14), row)


def ingest_adverts(blocks: DataFrame, text_col: str, year: int) -> DataFrame:
    """Structured rows of advert blocks, one of each 60-character title."""
    rows = blocks.select(advert_row(c(text_col), F.lit(year)).alias("r")).where("r IS NOT NULL").select("r.*")
    key = F.substring(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", ""), 1, 60)
    rows = rows.withColumn("key", key)
    return rows.dropDuplicates(["key"]).withColumn("ref", F.coalesce("ref", F.concat(F.lit("AD-"), F.substring(F.sha1("key"), 1, 12)))).drop("key")
