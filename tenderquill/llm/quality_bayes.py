"""Hierarchical empirical-Bayes quality.

A logistic classifier over form features (letters, symbols, capitals, spread of
words, lengths), fitted on a bounded labelled sample, gives each document's own
evidence. Grouped aggregation sums these probabilities over hosts and over paths
within hosts, for all documents. A host's posterior rate shrinks towards the
global rate with a strength estimated from the spread between hosts (method of
moments); a path's posterior shrinks towards its host's the same way. A document
leaves itself out of both sums, so a site with only this document is just the
global prior. The final log-odds are the document's plus the site's offset from
the global rate.

All features are built-in expressions; only four sums reach the driver besides
the sample. The query takes source as host and language as path, documents
having no URL.

Defined cases: null and empty texts have features of zero; null hosts and paths
are groups of their own; null doc_ids are scored, not learnt from; without labels of both
classes the classifier is constant at the share of good labels (1 without any);
repeated rows count as often as they occur; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_WORD, materialize, table
from .toxicity import FOLD, fit_sample

SAMPLE = 4000
CLIP = 1e-4
#: How much of the site's offset in log-odds counts.
SITE_WEIGHT = 0.5


def form_features(text: Column) -> dict[str, Column]:
    """Between 0 and 1 each, but for log_chars."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    share = lambda pattern: (n - F.length(F.regexp_replace(t, pattern, ""))) / n
    ws = F.regexp_extract_all(t, F.lit(f"({SPACE_WORD})"), F.lit(1))
    words = F.greatest(F.size(ws), F.lit(1))
    return {
        "symbols": share(r"[^\p{L}\p{N}\s.,]"),
        "capitals": share(r"[\p{Lu}]"),
        "digits": share(r"[\p{N}]"),
        "distinct": F.size(F.array_distinct(ws)) / words,
        "word_length": F.least(n / words / 20.0, F.lit(1.0)),
        "log_chars": F.log1p(F.length(t)) / 12.0,
    }


def train(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 25) -> np.ndarray:
    """Weights and intercept by Newton's method, classes weighing alike."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) / len(y) + l2 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x / len(y) + l2 * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


def fit(labelled: DataFrame) -> tuple[list[float], float]:
    """Weights of the features and the intercept from a bounded sample of text and label."""
    f = form_features(F.col("text"))
    rows = labelled.select("label", *(c.cast("double").alias(k) for k, c in f.items())).orderBy("label", *f).collect()
    x = np.array([[r[k] for k in f] for r in rows], float).reshape(len(rows), len(f))
    y = np.array([r["label"] for r in rows], float)
    if not 0 < y.sum() < len(y):
        return [0.0] * len(f), float(np.log((y.mean() if len(y) else 1.0) + CLIP) - np.log(1 - (y.mean() if len(y) else 1.0) + CLIP))
    w = train(x, y)
    return w[:-1].tolist(), float(w[-1])


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, centre: Column) -> float:
    """Beta strength of group rates around centre, by moments: columns n, s."""
    n, rate = F.col("n"), F.col("s") / F.col("n")
    r = groups.agg(
        F.sum(n * F.pow(rate - centre, 2)).alias("between"),
        F.sum(centre * (1 - centre)).alias("noise"),
        F.sum(n).alias("n"),
        F.sum(n * centre * (1 - centre)).alias("scale"),
    ).first()
    if not r["n"] or not r["scale"]:
        return 1.0
    spread = max(r["between"] - r["noise"], 0.0) / r["scale"]  # variance of true rates over the binomial scale
    return float(min(max(1 / spread - 1 if spread > 0 else 1e6, 1.0), 1e6))


def hierarchical_quality(documents: DataFrame, labelled: DataFrame, host_col: str, path_col: str) -> DataFrame:
    """doc_id, host, path, own (classifier), host_rate, path_rate (posteriors without the document), quality, keep."""
    weights, bias = fit(labelled)
    z = F.lit(bias)
    for w, c in zip(weights, form_features(F.col("text")).values(), strict=True):
        z = z + c * w
    own = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))
    rows = materialize(documents.select("doc_id", F.col(host_col).alias("host"), F.col(path_col).alias("path"), own.alias("own")), "quality-own")
    paths = materialize(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("own").alias("s")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    prior = (whole["s"] / whole["n"]) if whole["n"] else 0.5
    a = _strength(hosts, F.lit(prior))
    h = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    both = paths.join(h, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    b = _strength(both, (F.col("host_s") + a * prior) / (F.col("host_n") + a))
    sites = both.select(F.col("host").alias("h"), F.col("path").alias("p"), "n", "s", "host_n", "host_s")
    joined = rows.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p"))).drop("h", "p")
    host_rate = (F.col("host_s") - F.col("own") + a * prior) / (F.col("host_n") - 1 + a)
    joined = joined.withColumn("host_rate", host_rate)
    joined = joined.withColumn("path_rate", (F.col("s") - F.col("own") + b * F.col("host_rate")) / (F.col("n") - 1 + b))
    total = logit(F.col("own")) + SITE_WEIGHT * (logit(F.col("path_rate")) - logit(F.lit(prior)))
    quality = 1 / (1 + F.exp(-total))
    return joined.select("doc_id", "host", "path", "own", "host_rate", "path_rate", quality.alias("quality"), (quality >= 0.5).alias("keep"))


def op6_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sample = fit_sample(documents, labels, "quality", SAMPLE, F.expr(FOLD) != 0)
    return hierarchical_quality(documents, sample, "source", "lang")
