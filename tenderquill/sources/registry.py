"""Source plug-ins: named readers of notices, stamped and cleaned alike; uploads and exports."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col


@dataclass(frozen=True)
class Source:
    name: str
    tier: str
    jurisdiction: str
    read: Callable[[SparkSession], DataFrame]
    confidence: str = "drafted"


REGISTRY: dict[str, Source] = {}


def register(name: str, tier: str = "", jurisdiction: str = "", confidence: str = "drafted"):
    """Adds a reader (session to DataFrame with at least title) under name."""

    def add(read: Callable[[SparkSession], DataFrame]) -> Callable[[SparkSession], DataFrame]:
        REGISTRY[name] = Source(name, tier, jurisdiction, read, confidence)
        return read

    return add


def scan(spark: SparkSession, only: list[str] | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """(rows of all sources, errors by source): a source that fails doesn't stop the others; rows without title go."""
    rows, errors = None, {}
    for s in REGISTRY.values():
        if only and s.name not in only:
            continue
        try:
            one = s.read(spark)
        except Exception as e:  # noqa: BLE001
            errors[s.name] = str(e)
            continue
        one = one.where("trim(title) <> ''").withColumns({"source": F.lit(s.name), "source_tier": F.lit(s.tier), "jurisdiction": F.lit(s.jurisdiction)})
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    return rows, errors


HEAD_WORDS = ("department", "region", "description", "tender", "title", "name", "date", "submission", "closing", "organization", "buyer", "ref", "no")


def header_score(cells: list[str | None]) -> int:
    """How many cells read like column heads."""
    return sum(any(re.search(rf"\b{w}", (x or "").lower()) for w in HEAD_WORDS) and len(x or "") < 60 for x in cells)


def header_row(rows: list[list[str | None]], within: int = 15, least: int = 2) -> int:
    """Index of the best row of the first few; 0 where none scores enough."""
    scores = [header_score(r) for r in rows[:within]]
    return max(range(len(scores)), key=lambda k: (scores[k], -k)) if scores and max(scores) >= least else 0


def pick_column(heads: list[str], *wanted: str) -> str | None:
    key = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    return next((h for w in wanted for h in heads if key(w) == key(h)), next((h for w in wanted for h in heads if key(w) in key(h)), None))


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """A CSV whose head isn't its first line: head found in the first 15 lines, repeated heads dropped."""
    raw = spark.read.csv(path, header=False, inferSchema=False, multiLine=True, encoding="UTF-8")
    first = [list(r) for r in raw.limit(15).collect()]
    at = header_row(first)
    heads = [(h or f"c{k}").strip().lstrip("﻿") for k, h in enumerate(first[at])] if first else []
    rows = raw.toDF(*heads)
    before = first[: at + 1]
    for b in before:
        same = F.lit(True)
        for h, x in zip(heads, b, strict=True):
            same = same & c(f"`{h}`").eqNullSafe(F.lit(x))
        rows = rows.where(~same)
    return rows


def items_from_upload(rows: DataFrame) -> DataFrame:
    """item, description, department, submission_date from an upload's likely columns."""
    from ..functions.dates import parse_list_date

    heads = rows.columns
    text = lambda *w: c(f"`{h}`") if (h := pick_column(heads, *w)) else F.lit(None).cast("string")
    description = text("description", "tender", "title", "subject", "name")
    out = rows.select(description.alias("description"), text("department", "organization", "buyer").alias("department"), parse_list_date(text("submission date", "closing", "date")).alias("submission_date"))
    return out.where("trim(description) <> ''").withColumn("item", F.sha1(F.concat_ws("|", "description", "department", "submission_date")))


EXPORT = ["ref", "title", "buyer", "source", "jurisdiction", "lane", "product_line", "relevance", "fit_score", "tender_type", "buyer_sector", "advertised", "closing", "value_num", "status", "url", "dup_of"]


EXPORT_ROWS = 5000


def export_rows(rows: DataFrame, limit: int = EXPORT_ROWS) -> DataFrame:
    """The export's columns of the rows that fit best, in that order."""
    return rows.orderBy(c("fit_score").desc_nulls_last(), c("uid").asc()).limit(limit).select(*(x for x in EXPORT if x in rows.columns))


def export_csv(rows: DataFrame, path: str, limit: int = EXPORT_ROWS) -> None:
    export_rows(rows, limit).coalesce(1).write.mode("overwrite").csv(path, header=True)
