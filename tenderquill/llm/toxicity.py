"""Toxicity: counterfactual-regularised logistic regression on character n-grams.

Features of a text are the 5-grams of its words, word boundaries included, so
inflected and compounded insults share features; each has three levels: found
once, found twice, and found in one of a hundred words. Fitting:

1. A class-balanced sample of at most SAMPLE labelled rows a class, the first by
   hash of doc_id, is the bounded fit sample.
2. Document frequencies of all its n-grams by class are summed by Spark; the
   FEATURES ones with the highest one-sided chi-square become the model's.
3. Every sentence of the sample that holds an identity term is written again
   with the term swapped for each other one of its group. The first sentence of a
   text without any gets a pair of terms of one group put before it, chosen by a
   hash of the text, so that terms the sample lacks are swapped too. Differences d
   between the feature vectors, times the weights, are score changes; their mean
   square is added to the logistic loss, so weights that fire on a neutral mention
   of a group shrink, while weights that don't change under a swap are free. The
   penalty is w' G w with G the mean of d d', whose FEATURES x FEATURES sums Spark
   adds up: no difference reaches the driver.

Groups of identity terms, in the four languages of the corpus, are a parameter.

Scoring covers every whole text in one narrow pass. Labels, language, source and
id never enter a score.

Defined cases: null and empty texts have no features and get the score of the
intercept; without toxic labels every score is near 0, without others near 1; a null label row is ignored, several labels of one
doc_id count as the highest; null doc_ids are scored, not learnt from; repeated
rows are scored alike; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

SAMPLE, FEATURES, MIN_DF, MIN_CHI2 = 4000, 1024, 5, 25.0
GRAM = 5
#: Levels of a feature: found at all, twice, in one of a hundred words.
LEVELS = ("", "#2", "#d")
#: Most that a toxic row weighs against a clean one where toxic rows are rarer.
MAX_WEIGHT = 4.0
L2, SWAP_PENALTY, STEPS = 1e-4, 1.0, 300
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")
#: Groups of identity terms that may stand for each other.
IDENTITY_GROUPS = [
    ["women", "men"],
    ["woman", "man"],
    ["girls", "boys"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino"],
    ["gay", "straight", "lesbian", "bisexual"],
    ["transgender", "cisgender"],
    ["immigrants", "natives"],
    ["disabled", "nondisabled"],
    ["old", "young"],
    ["femmes", "hommes"],
    ["musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"],
    ["noirs", "blancs", "asiatiques", "arabes"],
    ["homosexuels", "hétérosexuels"],
    ["immigrés", "autochtones"],
    ["frauen", "männer"],
    ["muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"],
    ["schwarze", "weiße", "asiaten", "araber"],
    ["homosexuelle", "heterosexuelle"],
    ["einwanderer", "einheimische"],
    ["mujeres", "hombres"],
    ["musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"],
    ["negros", "blancos", "asiáticos", "árabes"],
    ["homosexuales", "heterosexuales"],
    ["inmigrantes", "nativos"],
]


def word_grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + GRAM] for i in range(len(w) - GRAM + 1)] or [w]


def levels(n: int, words: int) -> tuple[str, ...]:
    return LEVELS[:1] + LEVELS[1:2] * (n >= 2) + LEVELS[2:] * (n * 100 >= words)


def text_features(text: str | None) -> set[str]:
    count = Counter(WORD.findall((text or "").lower()))
    n: Counter[str] = Counter()
    for w, k in count.items():
        for g in set(word_grams(w)):
            n[g] += k
    words = count.total()
    return {g + x for g, k in n.items() for x in levels(k, words)}


def swaps(text: str | None, groups: list[list[str]]) -> Iterator[tuple[str, str]]:
    """Sentences with an identity term, each with its counterparts; without any, the first one with two terms put before it."""
    other: dict[str, set[str]] = {}
    for g in groups:
        for t in g:
            other.setdefault(t, set()).update(o for o in g if o != t)
    sentences, found = [s for s in SENTENCE.split((text or "").lower()) if s.strip()], False
    for s in sentences:
        for term in sorted(set(WORD.findall(s)) & other.keys()):
            found = True
            for o in sorted(other[term]):
                yield s, re.sub(rf"\b{term}\b", o, s)
    if sentences and groups and not found:
        h = zlib.crc32(text.encode())
        group = groups[h % len(groups)]
        if len(group) > 1:
            k = h // len(groups) % len(group)
            yield f"{group[k]} {sentences[0]}", f"{group[(k + 1) % len(group)]} {sentences[0]}"


def _class_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for start in range(0, len(pdf), 500):
            part = pdf.iloc[start : start + 500]
            n = (Counter(), Counter())
            for text, y in zip(part["text"], part["label"], strict=True):
                n[int(y)].update(text_features(text))
            for y in (0, 1):
                if n[y]:  # Arrow takes no empty column of strings
                    yield pd.DataFrame({"gram": list(n[y]), "label": y, "n": list(n[y].values())})


class Model:
    """Weights of n-grams and an intercept; a word's features are remembered while a task runs."""

    def __init__(self, grams: list[str], weights: np.ndarray, bias: float, pairs: int = 0) -> None:
        self.index, self.weights, self.bias, self.pairs = {g: k for k, g in enumerate(grams)}, weights, bias, pairs
        self.bases = {g.removesuffix(x) for g in grams for x in LEVELS[1:]}

    def features(self, text: str | None, memo: dict[str, tuple[str, ...]]) -> set[int]:
        if len(memo) > 100_000:
            memo.clear()
        words = WORD.findall((text or "").lower())
        n: dict[str, int] = {}
        for w in words:
            f = memo.get(w)
            if f is None:
                f = memo[w] = tuple({g for g in word_grams(w) if g in self.bases})
            for g in f:
                n[g] = n.get(g, 0) + 1
        found = (self.index.get(g + x) for g, k in n.items() for x in levels(k, len(words)))
        return {k for k in found if k is not None}

    def score(self, texts: pd.Series, memo: dict[str, tuple[str, ...]]) -> np.ndarray:
        z = np.array([self.bias + sum(self.weights[k] for k in sorted(self.features(t, memo))) for t in texts], float)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def train(x: np.ndarray, y: np.ndarray, swapped: np.ndarray, l2: float = L2, penalty: float = SWAP_PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Logistic regression with the swap penalty, by Nesterov's method; swapped: mean of the products of feature differences."""
    w, bias = np.zeros(x.shape[1]), 0.0
    v, v0 = w.copy(), 0.0
    n = len(y)
    weight = np.where(y == 1, min(MAX_WEIGHT, max(1.0, (n - y.sum()) / max(y.sum(), 1))), 1.0)
    weight = weight / weight.mean()
    lipschitz = 0.25 * (((x.astype(np.float64) ** 2).sum(axis=1) * weight).sum() / n + 1) + l2 + 2 * penalty * float(np.trace(swapped))
    for k in range(steps):
        err = weight * (1 / (1 + np.exp(-(x @ v + v0))) - y)
        grad = x.T @ err / n + l2 * v + 2 * penalty * (swapped @ v)
        w_, b_ = v - grad / lipschitz, v0 - err.mean() / lipschitz
        m = k / (k + 3)
        v, v0 = w_ + m * (w_ - w), b_ + m * (b_ - bias)
        w, bias = w_, b_
    return w, float(bias)


def swap_products(rows: DataFrame, model: Model, groups: list[list[str]]) -> tuple[np.ndarray, int]:
    """Mean of d d' over all swaps in the texts, and their number."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, tuple[str, ...]] = {}
        total: Counter[tuple[int, int]] = Counter()
        m = held.value
        for pdf in batches:
            for text in pdf["text"]:
                for a, b in swaps(text, groups):
                    p, q = m.features(a, memo), m.features(b, memo)
                    d = [(k, 1) for k in sorted(p - q)] + [(k, -1) for k in sorted(q - p)]
                    total[-1, -1] += 1
                    for i, u in d:
                        for j, v in d:
                            total[i, j] += u * v
        yield pd.DataFrame([(i, j, n) for (i, j), n in total.items()], columns=["i", "j", "n"], dtype="int64")

    out, count = np.zeros((len(model.weights), len(model.weights))), 0
    # at most FEATURES x FEATURES sums and one
    for r in rows.mapInPandas(products, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        if r["i"] < 0:
            count = r["n"]
        else:
            out[r["i"], r["j"]] = r["n"]
    return out / max(count, 1), count


def fit(labelled: DataFrame, groups: list[list[str]] = IDENTITY_GROUPS, penalty: float = SWAP_PENALTY) -> Model:
    """labelled: text, label (0 or 1); a bounded sample."""
    rows = materialize(labelled.select("text", F.col("label").cast("int").alias("label")), "toxicity-sample")
    size = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    if not pos or not neg:
        return Model([], np.zeros(0), -50.0 if not pos else 50.0)
    counts = rows.repartition(16).mapInPandas(_class_counts, "gram string, label int, n long").groupBy("gram").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b")
    )
    a, b, n = F.col("a"), F.col("b"), float(pos + neg)
    chi2 = n * F.pow(a * (neg - b) - b * (pos - a), 2) / (float(pos) * neg * (a + b) * (n - a - b + 0.5))
    picked = counts.where((a + b >= MIN_DF) & (a * neg > b * pos)).select("gram", chi2.alias("chi2")).where(F.col("chi2") >= MIN_CHI2)
    grams = [r["gram"] for r in picked.orderBy(F.desc("chi2"), "gram").limit(FEATURES).collect()]
    model = Model(grams, np.zeros(len(grams)), 0.0)
    held = labelled.sparkSession.sparkContext.broadcast(model)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, tuple[str, ...]] = {}
        for pdf in batches:
            yield pd.DataFrame({"label": pdf["label"], "features": [sorted(held.value.features(t, memo)) for t in pdf["text"]]})

    # the sample's rows, 2 x SAMPLE at most
    docs = sorted((r["label"], r["features"]) for r in rows.mapInPandas(vectors, "label int, features array<int>").collect())
    x, y = np.zeros((len(docs), len(grams)), np.float32), np.array([label for label, _ in docs], float)
    for k, (_, own) in enumerate(docs):
        x[k, own] = 1
    products, pairs = swap_products(rows, model, groups)
    weights, bias = train(x, y, products, penalty=penalty)
    return Model(grams, weights, bias, pairs)


def fit_sample(documents: DataFrame, labels: DataFrame, label_col: str, sample: int, learn: Column) -> DataFrame:
    """text and label of at most sample labelled rows a class, first by hash of doc_id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & learn).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    picked = None
    for y in (0, 1):
        one = known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = one if picked is None else picked.unionByName(one)
    # 2 * sample rows at most, whatever the input
    return documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "label")


def score_texts(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """documents with column toxicity."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict[str, tuple[str, ...]] = {}
        for texts in batches:
            yield pd.Series(held.value.score(texts, memo))

    return documents.withColumn("toxicity", score(F.col(text_col)))


#: Remainder 0 is held out of learning.
FOLD = "crc32(cast(doc_id AS string)) % 5"


def toxicity_model(documents: DataFrame, labels: DataFrame, penalty: float = SWAP_PENALTY) -> Model:
    return fit(fit_sample(documents, labels, "toxic", SAMPLE, F.expr(FOLD) != 0), penalty=penalty)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity_model(documents, table(spark, sf_dir, "labels"))
    out = score_texts(documents.select("doc_id", "text"), model)
    return out.select(
        "doc_id",
        F.coalesce(F.expr(FOLD) == 0, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )
