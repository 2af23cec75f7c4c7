"""Benchmark decontamination by winnowing.

Words are 64-bit hashes of runs of word bytes. In each window of WINDOW
consecutive k-grams (GRAM words) those with the smallest hash are kept as
fingerprints, so any shared run of GRAM + WINDOW - 1 = 10 words shares at least
one. Document fingerprints are joined with the benchmark's; each match is
extended over the 10-word windows around it, which must equal a window of the
benchmark (64-bit hash, then a 128-bit digest of the words). Items of fewer than
10 words are one window each and are found by their whole-length gram.

The benchmark side is cut into blocks of at most BLOCK_WORDS words by its
measured size; each block is broadcast and joined map-side, one after the other,
while a document's hits travel with it. So documents are never shuffled, and
neither side has a size limit. The words of a text are hashed in pieces of
128 KB, so long texts need little memory beyond their own.

Defined cases: null or empty texts have no words and no hits; items without
words or without id are ignored; repeated documents are judged alike, repeated
items count once by id; an empty benchmark hits nothing; empty documents give no
rows; extra columns are kept by decontaminate(), but for those named as the
added ones, and ignored by the query.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, materialize, table

GRAM, WINDOW = 5, 6
SPAN = GRAM + WINDOW - 1
BLOCK_WORDS = 1_000_000
#: Blocks that one stage joins, each in a Python worker of its own; more of them go by way of a written table.
CHAIN = 4
PIECE_BITS = 17
PIECE = 1 << PIECE_BITS


def _word_bytes() -> bytes:
    """Translation: A-Z to a-z, word bytes to themselves, all others to a space."""
    keep = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
    t = [b if b in keep else 0x20 for b in range(256)]
    for c in UPPER:
        t[ord(c)] = ord(c.lower())
    return bytes(t)


TRANSLATION = _word_bytes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


BYTE_VALUES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = np.uint64(0xD6E8FEB86659FD93)


@functools.lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, 2^bits of each."""
    out = []
    for x in (BASE, np.uint64(pow(int(BASE), -1, 1 << 64))):
        p = np.full(1 << bits, x, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def words(buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a translated buffer: sums of byte values times powers of BASE from the word's start."""
    starts, ends, hashes = [], [], []
    at = 0
    while at < len(buf):
        to = len(buf) if at + PIECE >= len(buf) else buf.find(b" ", at + PIECE)
        to = len(buf) if to < 0 else to
        arr = np.frombuffer(buf, np.uint8, to - at, at)
        inside = np.zeros(len(arr) + 2, bool)
        np.not_equal(arr, 0x20, out=inside[1:-1])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        s, e = edge[::2], edge[1::2]
        if len(s):
            power, inverse = _powers(max(PIECE_BITS + 1, (len(arr) - 1).bit_length()))
            total = np.zeros(len(arr) + 1, np.uint64)
            np.cumsum(BYTE_VALUES[arr] * power[: len(arr)], out=total[1:])
            starts.append(s + at)
            ends.append(e + at)
            hashes.append(_mix((total[e] - total[s]) * inverse[s]))
        at = to
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(starts) == 1:
        return starts[0], ends[0], hashes[0]
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out = out * BASE + h[j : n + j]
    return _mix(out)


def fingerprints(g: np.ndarray, w: int = WINDOW) -> np.ndarray:
    """Places of the grams that are smallest in some window of w; all of equal ones."""
    if len(g) < w:
        return np.zeros(0, np.int64)
    low = np.lib.stride_tricks.sliding_window_view(g, w).min(axis=1) if len(g) < 64 else _sliding(g, w, np.minimum)
    reach = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    return np.flatnonzero(_sliding(reach, w, np.maximum) == g)


def _sliding(a: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    span, out = 1, a
    while span * 2 <= w:
        out = op(out[:-span], out[span:])
        span *= 2
    rest = w - span
    return op(out[: len(out) - rest], out[rest:]) if rest else out


def _digest(buf: bytes, starts: np.ndarray, ends: np.ndarray, at: int, n: int) -> bytes:
    return hashlib.blake2b(b" ".join(buf[starts[k] : ends[k]] for k in range(at, at + n)), digest_size=16).digest()


class Block:
    """Fingerprints and windows of some benchmark items."""

    def __init__(self, items: list[tuple[str, str]]) -> None:
        marks, self.windows = [], {}  # words in a window -> {hash: {digest: items}}
        for item, text in items:
            buf = text.encode().translate(TRANSLATION)
            s, e, h = words(buf)
            n = min(SPAN, len(h))
            if not n:
                continue
            known = self.windows.setdefault(n, {})
            for at, g in enumerate(grams(h, n).tolist()):
                known.setdefault(g, {}).setdefault(_digest(buf, s, e, at, n), set()).add(item)
            if n == SPAN:
                g = grams(h, GRAM)
                marks.append(g[fingerprints(g)])
        self.marks = np.unique(np.concatenate(marks)) if marks else np.zeros(0, np.uint64)
        self.sorted = {n: np.array(sorted(k), np.uint64) for n, k in self.windows.items()}
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(self.marks & np.uint64(0xFFFF)).astype(np.int64)] = True

    @staticmethod
    def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(values), bool)
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        return known[at] == values

    def hits(self, buf: bytes, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """(first word, words) of the benchmark windows in a text, and their items."""
        found: list[tuple[int, int]] = []
        items: set[str] = set()
        for n, known in self.sorted.items():
            if n < SPAN:
                g = grams(h, n)
                places = np.flatnonzero(self._among(g, known))
            else:
                short = grams(h, GRAM)
                at = fingerprints(short)
                at = at[self.bits[(short[at] & np.uint64(0xFFFF)).astype(np.int64)]]
                at = at[self._among(short[at], self.marks)]
                if not len(at):
                    continue
                # every window around a matching fingerprint
                around = np.unique((at[:, None] - np.arange(WINDOW)).ravel())
                around = around[(around >= 0) & (around + SPAN <= len(h))]
                g = np.zeros(len(around), np.uint64)
                if len(around):
                    g = h[around]
                    for j in range(1, SPAN):
                        g = g * BASE + h[around + j]
                    g = _mix(g)
                ok = self._among(g, known)
                places, g = around[ok], g[ok]
                for p, x in zip(places.tolist(), g.tolist(), strict=True):
                    self._take(x, n, buf, s, e, p, found, items)
                continue
            for p in places.tolist():
                self._take(int(g[p]), n, buf, s, e, p, found, items)
        return found, items

    def _take(self, x: int, n: int, buf: bytes, s: np.ndarray, e: np.ndarray, p: int, found: list, items: set) -> None:
        owners = self.windows[n][x].get(_digest(buf, s, e, p, n))
        if owners:
            found.append((p, n))
            items |= owners


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Merged (first, after last) of (first, length) spans."""
    out: list[list[int]] = []
    for a, n in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return [(a, b) for a, b in out]


STATE = "n_words long, hits array<struct<first:long,words:long>>, items array<string>"


def _with_block(held, text_col: str, columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = held.value
        for pdf in batches:
            if not len(pdf):
                continue
            n, hits, items = [], [], []
            for text, had, owners in zip(pdf[text_col], pdf["hits"], pdf["items"], strict=True):
                buf = text.encode().translate(TRANSLATION) if isinstance(text, str) else b""
                s, e, h = words(buf)
                new, own = block.hits(buf, s, e, h)
                old = [(x["first"], x["words"]) for x in had]
                n.append(len(h))
                hits.append([{"first": a, "words": b - a} for a, b in covered(old + new)] if new else list(had))
                items.append(sorted(own.union(owners)))
            yield pdf.assign(n_words=n, hits=hits, items=items)[columns]

    return run


def benchmark_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of bounded size; the driver holds one block at a time."""
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), "text").distinct()
    block, size = [], 0
    for r in rows.orderBy("item", "text").toLocalIterator():
        block.append((r["item"], r["text"]))
        size += len(r["text"]) // 2 + 1
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def decontaminate(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """documents with n_words, hits (merged runs of hit words) and items (ids, as sorted strings)."""
    spark = documents.sparkSession
    out = documents.drop("n_words", "hits", "items").select("*", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<first:long,words:long>>").alias("hits"), F.array().cast("array<string>").alias("items"))
    blocks = 0
    for block in benchmark_blocks(benchmark, block_words):
        if blocks and blocks % CHAIN == 0:
            out = materialize(out, "decontaminate")
        out = out.mapInPandas(_with_block(spark.sparkContext.broadcast(Block(block)), text_col, out.columns), out.schema)
        blocks += 1
    if not blocks:
        out = out.mapInPandas(_with_block(spark.sparkContext.broadcast(Block([])), text_col, out.columns), out.schema)
    return out


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + x["words"])
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), '" + UPPER + "', '" + UPPER.lower() + "'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
il AS (SELECT item, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM (SELECT item, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM il)),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS k
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT doc_id, p, n, item FROM dw JOIN iw USING (n, k)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
