"""Mixing sources to target weights by cube-method balanced sampling.

Each source gets a share of the word budget by its weight; what exceeds the cap
of a source (max_repeats times its size) is shared again by weight among the
rest. A document of a source with ratio r = target / source size is taken
floor(r) times, and once more with inclusion probability r - floor(r). The cube
method draws these extra copies: as long as three undecided documents are in
hand, their probabilities move along the null space of the two balancing
constraints (document total and word total) until one of them is decided, so
both totals stay where the probabilities put them.

The flight runs in blocks of about BLOCK documents of one source, in parallel;
each leaves at most two documents undecided. These are gathered, BLOCK / 2
blocks at a time, and fly again, until a source is one block. Its last two
undecided documents are the landing problem: all their outcomes are tried and
the one nearest the source's word target is taken.

Randomness is a hash of the document, so reruns agree. Only ids, sizes and
probabilities are shuffled. Source totals (one row for each source) go to the
driver; their number is that of the mixture's entries.

Defined cases: null or blank text has size 0 and is taken 0 words; null sources
are one source, last in order; a null doc_id is a unit like any other; repeated
rows are separate units; a source of size 0 has target 0; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_WORD, materialize, table

BLOCK, WEIGHTS, SHARE, MAX_REPEATS = 5000, (3.0, 1.0, 2.0), 1.5, 2.0
EPS = 1e-9


def mixture_targets(sizes: list[int], weights: list[float], budget: float, cap: float = MAX_REPEATS) -> list[float]:
    """Budget by weight, no more than cap times a source's size, the excess reshared by weight."""
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(budget)
    while open_ and left > 0:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if left * weights[k] / total > cap * sizes[k]}
        if not full:
            for k in open_:
                target[k] = left * weights[k] / total
            break
        for k in full:
            target[k] = cap * sizes[k]
        left -= sum(target[k] for k in full)
        open_ -= full
    return target


def flight(size: np.ndarray, p: np.ndarray, uniform: np.ndarray) -> np.ndarray:
    """Probabilities after the flight phase: 0 or 1 but for two units at most."""
    p = p.astype(float).copy()
    hand: list[int] = []
    for i in range(len(p)):
        if p[i] <= EPS or p[i] >= 1 - EPS:
            p[i] = round(p[i])
            continue
        hand.append(i)
        u = uniform[i]
        while len(hand) == 3:
            a, b, c = hand
            move = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if not any(move):
                move = (1.0, -1.0, 0.0)
            up = min((1 - p[k]) / m if m > 0 else p[k] / -m for k, m in zip(hand, move, strict=True) if m)
            down = min(p[k] / m if m > 0 else (1 - p[k]) / -m for k, m in zip(hand, move, strict=True) if m)
            step = up if u * (up + down) < down else -down
            for k, m in zip(hand, move, strict=True):
                p[k] += step * m
                if p[k] <= EPS or p[k] >= 1 - EPS:
                    p[k] = round(p[k])
            hand = [k for k in hand if 0 < p[k] < 1]
            u = math.modf(u * 1e4 + 0.6180339887498949)[0]
    return p


def landing(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The outcome of the undecided units nearest the expected word total; ties take fewer."""
    p = p.copy()
    hand = np.flatnonzero((p > 0) & (p < 1))
    want = float((size[hand] * p[hand]).sum())
    if len(hand):
        tries = [[k >> j & 1 for j in range(len(hand))] for k in range(2 ** len(hand))]
        p[hand] = min(tries, key=lambda t: (abs(float((size[hand] * t).sum()) - want), sum(t), t))
    return p


SCHEMA = "doc_id long, source string, size long, p double, u double, block long"


def _fly(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "u", "doc_id"], kind="stable").reset_index(drop=True)
        size = pdf["size"].to_numpy(float)
        p = flight(size, pdf["p"].to_numpy(float), pdf["u"].to_numpy(float))
        pdf["p"] = landing(size, p) if last else p
        return pdf

    return run


def mix(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = MAX_REPEATS, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken, repeats; weights repeat over sources in code point order, null last."""
    spark = documents.sparkSession
    # the uniform number is also the order among equal sizes; equal rows are alike
    uniform = F.pmod(F.xxhash64("doc_id", "source", "size"), F.lit(1 << 40)) / float(1 << 40)
    units = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(SPACE_WORD)).cast("long").alias("size"),
    ).withColumn("u", uniform)
    units = materialize(units, "mix-units")
    totals = sorted(((r["source"], r["size"], r["n"]) for r in units.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    sizes = [r[1] for r in totals]
    targets = mixture_targets(sizes, [weights[k % len(weights)] for k in range(len(totals))], share * sum(sizes), cap)
    per = []
    for (source, size, n), target in zip(totals, targets, strict=True):
        ratio = target / size if size else 0.0
        whole = math.floor(ratio + EPS)
        per.append((source, size, float(target), whole, max(0.0, ratio - whole), max(1, math.ceil(n / block))))
    plan = spark.createDataFrame(per, "s string, source_size long, target double, whole int, extra double, blocks int")
    joined = units.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    width = max([1, *(r[5] for r in per)])
    blocks = F.pmod(F.xxhash64(F.col("doc_id"), F.col("size"), F.lit(9)), F.col("blocks")).cast("long")
    at = joined.select("doc_id", "source", "size", F.col("extra").alias("p"), "u", blocks.alias("block"))
    decided = []
    while True:
        flown = materialize(at.groupBy("source", "block").applyInPandas(_fly(width == 1), SCHEMA), "mix-flight")
        decided.append(flown.where("p = 0 OR p = 1"))
        if width == 1:
            break
        gather = max(2, block // 2)
        at = flown.where("p > 0 AND p < 1").withColumn("block", F.floor(F.col("block") / gather))
        width = math.ceil(width / gather)
    drawn = decided[0]
    for d in decided[1:]:
        drawn = drawn.unionByName(d)
    repeats = F.col("whole") + F.col("p").cast("int")
    return (
        drawn.join(plan, F.col("source").eqNullSafe(F.col("s")))
        .select("doc_id", "source", "size", "source_size", "target", (F.col("size") * repeats).cast("long").alias("taken"), repeats.alias("repeats"))
    )


def op9_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
