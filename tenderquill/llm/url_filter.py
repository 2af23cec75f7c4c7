"""URL filter: host/path rules, and a character language-model ratio for the rest.

Two smoothed variable-order Markov models over a 40-symbol alphabet are counted
from the URLs that the rules accept and reject: each symbol is predicted from up
to three preceding ones, with Witten-Bell interpolation towards shorter
contexts, so a context that was never seen falls back. A URL's score is the mean
over its symbols of log P(accepted) - log P(rejected). The threshold is
calibrated on one fifth of the labelled URLs (by crc32) with models counted on
the other four fifths: it maximises balanced accuracy over a 4,096-bin
histogram. The final models use all labelled URLs.

A model holds at most 40^4 cells whatever the input, which bounds both what
reaches the driver and what is broadcast (10 MB of float32).

Defined cases: a null URL, or one without "://", has empty host and path and is
scored as its text (null as empty); with one class unseen the score is 0 and
the threshold 0, so all such URLs are allowed; repeated rows are judged alike;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

SYMBOLS, ORDER = 40, 3
CELLS = SYMBOLS ** (ORDER + 1)
BINS, SPAN = 4096, 8.0
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: (host, path, verdict)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def _symbols() -> np.ndarray:
    """Symbol of each byte: 0 start, letters 1-26, digits 27, punctuation, 38 others, 39 end."""
    code = np.full(256, 38, np.int64)
    for k in range(26):
        code[ord("a") + k] = code[ord("A") + k] = 1 + k
    code[48:58] = 27
    for k, c in enumerate("./-_:?=&#%"):
        code[ord(c)] = 28 + k
    return code


def grams(urls: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Code of (symbol, three before) for each position of each URL and its end; row of each."""
    raw = [u.encode() if isinstance(u, str) else b"" for u in urls]
    sizes = np.array([len(x) + ORDER + 1 for x in raw], np.int64)
    flat = np.zeros(int(sizes.sum()), np.int64)
    ends = np.cumsum(sizes)
    body = np.ones(len(flat), bool)
    first = ends - sizes
    for k in range(ORDER):
        body[first + k] = False
    flat[ends - 1] = 39
    text = body.copy()
    text[ends - 1] = False
    flat[text] = _symbols()[np.frombuffer(b"".join(raw), np.uint8)]
    code = flat.copy()
    for k in range(1, ORDER + 1):
        code[k:] += flat[:-k] * SYMBOLS**k
    return code[body], np.repeat(np.arange(len(raw)), sizes - ORDER)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for (label, fold), g in pdf.groupby(["label", "fold"]):
            codes, n = np.unique(grams(g["url"])[0], return_counts=True)
            yield pd.DataFrame({"label": label, "fold": fold, "code": codes, "n": n})


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """log P of each (symbol, context) cell, by Witten-Bell interpolation from order 0 up."""
    p = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for order in range(ORDER + 1):
        n = counts.reshape(-1, SYMBOLS ** (order + 1)).sum(axis=0).reshape(-1, SYMBOLS).astype(np.float64)
        total, kinds = n.sum(axis=1, keepdims=True), (n > 0).sum(axis=1, keepdims=True)
        # the same cell without its oldest context symbol
        lower = np.tile(p, SYMBOLS if order else 1).reshape(-1, SYMBOLS)
        weight = np.where(total > 0, kinds, 1.0)
        p = ((n + weight * lower) / (total + weight)).reshape(-1)
    return np.log(p)


def log_ratio(accepted: np.ndarray, rejected: np.ndarray) -> np.ndarray:
    if not accepted.any() or not rejected.any():
        return np.zeros(CELLS, np.float32)
    return (log_probabilities(accepted) - log_probabilities(rejected)).astype(np.float32)


def url_scores(urls: pd.Series, ratio: np.ndarray) -> np.ndarray:
    codes, row = grams(urls)
    return np.bincount(row, ratio[codes].astype(np.float64), len(urls)) / np.maximum(np.bincount(row, minlength=len(urls)), 1)


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = (F.when if rule is None else rule.when)(fits, F.lit(h + p))
        verdict = (F.when if verdict is None else verdict.when)(fits, F.lit(v))
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def fit(labelled: DataFrame) -> tuple[np.ndarray, float]:
    """labelled: url, label (1 accepted, 0 rejected). The log ratio of each cell and the threshold."""
    spark = labelled.sparkSession
    rows = labelled.select("url", F.col("label").cast("int").alias("label"), (F.crc32(F.coalesce("url", F.lit(""))) % 5 == 0).cast("int").alias("fold"))
    counted = rows.mapInPandas(_count, "label int, fold int, code long, n long").groupBy("label", "fold", "code").agg(F.sum("n").alias("n"))
    cells = np.zeros((2, 2, CELLS), np.int64)
    got = counted.toPandas()
    np.add.at(cells, (got["label"].to_numpy(int), got["fold"].to_numpy(int), got["code"].to_numpy(int)), got["n"].to_numpy(int))
    held = spark.sparkContext.broadcast(log_ratio(cells[1, 0], cells[0, 0]))

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = url_scores(pdf["url"], held.value)
            yield pd.DataFrame({"label": pdf["label"], "bin": np.clip(((s + SPAN) / (2 * SPAN) * BINS).astype(int), 0, BINS - 1)})

    hist = np.zeros((2, BINS))
    for r in rows.where("fold = 1").mapInPandas(binned, "label int, bin int").groupBy("label", "bin").count().collect():
        hist[r["label"], r["bin"]] = r["count"]
    threshold = 0.0
    if hist[0].any() and hist[1].any():
        # cut k: bins from k up are accepted
        below = np.concatenate([[0], np.cumsum(hist[0])]) / hist[0].sum()
        kept = 1 - np.concatenate([[0], np.cumsum(hist[1])]) / hist[1].sum()
        best = np.flatnonzero(np.isclose(below + kept, (below + kept).max()))
        threshold = (best[0] + best[-1]) / 2 / BINS * 2 * SPAN - SPAN
    return log_ratio(cells[1].sum(axis=0), cells[0].sum(axis=0)), float(threshold)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """id, url, host, path, rule, score, verdict."""
    url = F.col(url_col)
    rows = pages.select(
        F.col(id_col),
        url.alias("url"),
        ascii_lower(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit(""))).alias("host"),
        F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit("")).alias("path"),
    )
    rule, ruled = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), ruled.alias("ruled"))
    ratio, threshold = fit(rows.where("ruled IS NOT NULL").select("url", (F.col("ruled") == "allow").cast("int").alias("label")))
    model = pages.sparkSession.sparkContext.broadcast(ratio)

    @F.pandas_udf("double")
    def score(urls: pd.Series) -> pd.Series:
        return pd.Series(url_scores(urls, model.value))

    rows = rows.withColumn("score", score("url"))
    by_model = F.when(F.col("score") >= threshold, F.lit("allow")).otherwise(F.lit("block"))
    return rows.withColumn("verdict", F.coalesce("ruled", by_model)).drop("ruled")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")
