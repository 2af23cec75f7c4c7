"""HTML in columns: tables, text, contacts and attachments; and adverts in page text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import parse_money
from ..functions.text import clean

c = F.col


class _Tables(HTMLParser):
    """Cell texts of all tables, nested ones as tables of their own."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.open: list[tuple[list[list[str]], list[list[str]]]] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            self.tables.append([])
            self.open.append((self.tables[-1], []))
        elif self.open and tag == "tr":
            self.open[-1][0].append([])
        elif self.open and tag in ("td", "th"):
            rows = self.open[-1][0]
            if not rows:
                rows.append([])
            rows[-1].append("")
            self.open[-1][1].append(rows[-1])

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "table" and self.open:
            self.open.pop()
        elif tag in ("td", "th") and self.open and self.open[-1][1]:
            self.open[-1][1].pop()

    def handle_data(self, data: str) -> None:
        if not self.skip and self.open and self.open[-1][1]:
            self.open[-1][1][-1][-1] += data


def tables_of(html: str | None) -> list[list[list[str]]]:
    p = _Tables()
    p.feed(html or "")
    p.close()
    return [[[re.sub(r"\s+", " ", x).strip() for x in row] for row in t if row] for t in p.tables]


def largest_table(html: str | None) -> list[dict[str, str]]:
    """Rows of the table with most rows, by its first row's heads."""
    found = max(tables_of(html), key=len, default=[])
    if len(found) < 2:
        return []
    heads = [h or f"c{k}" for k, h in enumerate(found[0])]
    return [dict(zip(heads, row, strict=False)) for row in found[1:]]


def table_rows(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, row, cells (map of head to text) of each page's largest table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, k, r) for i, h in zip(pdf[id_col], pdf[html_col], strict=True) for k, r in enumerate(largest_table(h))]
            if out:
                yield pd.DataFrame(out, columns=[id_col, "row", "cells"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInPandas(run, f"{id_col} {kind}, row int, cells map<string,string>")


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def page_text(html: Column) -> Column:
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return clean(F.regexp_replace(t, r"(?s)<[^>]+>", " "))


EMAIL, PHONE = r"([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})", r"(\+?\d[\d\-\s()]{7,16}\d)"


def emails(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(EMAIL), F.lit(1)))


def attachments(html: Column, most: int = 10) -> Column:
    """array of (label, url) of linked documents, the first ones."""
    link = r"(?is)(<a[^>]+href=[\"'][^\"']+\.(?:pdf|docx?|xlsx?|zip)[^\"']*[\"'][^>]*>.*?</a>)"
    found = F.regexp_extract_all(html, F.lit(link), F.lit(1))
    one = lambda a: F.struct(clean(F.regexp_replace(a, "<[^>]+>", " ")).alias("label"), F.regexp_extract(a, r"(?i)href=[\"']([^\"']+)", 1).alias("url"))
    return F.slice(F.array_distinct(F.transform(found, one)), 1, most)


def details(html: Column) -> Column:
    """Detail page fields; bid security gives a value band of 2 to 5 %."""
    t = page_text(html)
    label = lambda words: clean(F.regexp_extract(t, rf"(?i)(?:{words})\s*[:\-]?\s*((?:(?!\.\s+[A-Z])[^;]){{1,120}})", 1))
    security = parse_money(F.nullif(label("bid security|earnest money"), F.lit("")))["value_num"]
    band = lambda share: F.when(security > 1000, security / share)
    return F.struct(
        label("bid security|earnest money").alias("bid_security"), label("tender fee|document fee").alias("tender_fee"), label("eligibility").alias("eligibility"),
        label("pre-?bid").alias("prebid"), label("opening").alias("opening"), F.regexp_extract(t, EMAIL, 1).alias("contact_email"), F.regexp_extract(t, PHONE, 1).alias("contact_phone"),
        band(0.05).alias("est_value_low"), band(0.02).alias("est_value_high"), attachments(html).alias("attachments"),
    )


CUE = re.compile(r"(?im)^(?=\s*(?:tender notice|invitation (?:to|for) bids?|request for (?:proposals?|quotations?)|expression of interest|notice inviting|auction notice)\b)")


def advert_blocks(text: str | None) -> list[str]:
    """Adverts of a page: parts between wide gaps or rules, cut again at headings; short parts join the one before."""
    parts = [x for p in re.split(r"\n\s*\n\s*\n+|\n\s*[-_=]{5,}\s*\n", text or "") for x in CUE.split(p)]
    out: list[str] = []
    for p in (re.sub(r"[ \t]+", " ", x).strip() for x in parts):
        if not p:
            continue
        if out and len(p) < 200 and not CUE.match(p):
            out[-1] = f"{out[-1]}\n{p}"
        else:
            out.append(p)
    return [p for p in out if 90 < len(p) < 4000]


def adverts(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, block, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, k, b) for i, t in zip(pdf[id_col], pdf[text_col], strict=True) for k, b in enumerate(advert_blocks(t))]
            if out:
                yield pd.DataFrame(out, columns=[id_col, "block", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, block int, text string")
