"""N-gram Jaccard join: size-aware heavy-light similarity join of shingle sets.

A document is the set of its 5-word shingles, as 64-bit hashes; equal sets are
one set with a 64-bit signature. Sets link when 100 |A n B| >= 75 |A u B|; the
result is each document's connected component.

Light sets (at most B shingles) enumerate subsets of fixed sizes: a pair of
sizes a <= b shares at least c = ceil(3b / 4) elements, so both emit all their
subsets of c elements and meet in one. Heavy sets, and light ones near enough to B to link
with heavy ones, are found by scanning inverted lists of their first
n - ceil(3n / 4) + 1 shingles in order of rarity. B minimises the cost of both
over the measured histogram of set sizes. Rarity comes from counts of all
shingles in 65,536 hash buckets, so passages that many documents share are late
in that order. A bucket holds ever more shingles as the corpus grows and tells
less of each, so a first pass counts the shingles that would make up the lists
themselves, and those of more than FREQUENT entries (the MOST longest lists at
most) go behind all others. Lists of unrelated texts, which meet in a common
phrase, thus stay shorter. Shingles that come into lists only as these leave them
are not counted again. Any order of shingles gives the same links; this one only
makes less work.

Two linked sets differ in at most (a + b) / 7 elements. Each set has a parity of
four bits an element, in which every element flips one, and the same folded to
LEAST_PARITY bits: differing bits are never more than differing elements, so most
pairs that don't link are seen from these alone.

Lists are worked off without expanding groups of near copies into pairs:

1. In each of ROUNDS rounds every list is compared with one pivot, the entry of
   the smallest place; these pairs are verified, the pivot leaves the list, and
   lists whose sets are all connected by now go. Work is linear in the entries,
   and lists of up to ROUNDS + 1 sets are done.
2. What is left of lists of up to LONG entries is joined pair by pair.
3. Longer lists get a pivot P once more, and their sets are joined by what they
   differ from it in. With l elements of P that A lacks and x that it adds, let
   u = 100 l + 75 x. A links with P when u(A) <= 25 |P|, and A with B when they
   share (u(A) + u(B) - 25 |P|) / 175 of their differences. Two sets that link
   with P are connected already. For all others this is a set join with a high
   threshold: the added elements, rare ones first, then the lacking ones, have
   prefixes in which any two linked sets share an element, shorter the further
   the partner is from P (CLASSES steps). So an edit that few sets share is what
   brings two sets together, not the text that all of them share.

Every pair that can link is thus verified on its elements or lies within one
component, and no link between components is lost.

Nothing but 65,536 bucket counts, histograms of small sizes and of list lengths
and at most MOST frequent shingles (2 MB) reaches the driver; all loops keep their state in the shared folder. A set is one array, so a
text must fit into memory several times over (8 bytes a shingle); Arrow batches
end by bytes.

Defined cases: null, empty and blank texts have no shingles, are linked with
nothing and are their own component; a text of fewer than 5 words is one shingle;
null doc_ids take part but never name a component (it is null where all ids are);
repeated rows are one set; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import UPPER, materialize, table, with_keys
from .decontaminate import BASE, _mix, grams, words

SHINGLE, PERCENT = 5, 75
BUCKETS, CHUNK = 1 << 16, 1 << 10
#: Sets of more shingles are never light: their subsets alone cost more than any list.
LIGHT_SIZES, SCAN_COST = 24, 4
LEAST_PARITY, ROUNDS, LONG, CLASSES = 512, 3, 128, 8
#: Longest list of a shingle that isn't frequent; most shingles that are taken as frequent.
FREQUENT, MOST = 16, 1 << 18
NONE = np.zeros(0, np.uint64)
SALT = np.uint64(0xA0761D6478BD642F)
TRANSLATION = bytes(ord(chr(b).lower()) if chr(b) in UPPER else 0x20 if 9 <= b <= 13 else b for b in range(256))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    if not isinstance(text, str):
        return np.zeros(0, np.uint64)
    h = words(text.encode().translate(TRANSLATION))[2]
    if not len(h):
        return h
    g = np.sort(grams(h, min(SHINGLE, len(h))))
    return g[np.concatenate(([True], g[1:] != g[:-1]))]


def signature(s: np.ndarray) -> int:
    """The same for the same set, whatever the order."""
    with np.errstate(over="ignore"):
        x = _mix(s ^ SALT).sum(dtype=np.uint64) + np.uint64(len(s))
    return int(_mix(np.array([x]))[0].astype(np.int64))


def parity(s: np.ndarray, bits: int = 0) -> np.ndarray:
    """Bits as longs, of which every element flips one; four an element by default, LEAST_PARITY at least."""
    bits = bits or max(LEAST_PARITY, 1 << (4 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def least_share(n: int) -> int:
    """Least overlap of a set of n with any set it links with."""
    return -(-PERCENT * n // 100)


def need(a: int, b: int) -> int:
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def subset_sizes(n: int) -> list[int]:
    """Sizes of the subsets that a light set of n must emit, for partners of n elements or more."""
    largest = 100 * n // PERCENT
    return sorted({least_share(b) for b in range(n, largest + 1) if least_share(b) <= n})


def prefix_size(n: int) -> int:
    return n - least_share(n) + 1


def boundary(histogram: dict[int, int]) -> int:
    """Largest light size: the cheapest over how many sets there are of each size."""

    def cost(limit: int) -> int:
        total = 0
        for n, sets in histogram.items():
            if n <= limit:
                total += sets * sum(comb(n, c) for c in subset_sizes(n))
            if n > limit or n >= least_share(limit + 1):
                total += sets * SCAN_COST * prefix_size(n)
        return total

    return min(range(LIGHT_SIZES + 1), key=lambda k: (cost(k), k))


def _survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row (dk, doc_id, n, sig, parity, mini) for each document; then the counts of shingle buckets, in chunks."""
    counts = np.zeros(BUCKETS, np.int64)
    part = int(np.random.default_rng().integers(64))  # only spreads the sums
    empty = np.zeros(0, np.int64)
    for pdf in batches:
        if not len(pdf):
            continue
        found = [shingle_set(t) for t in pdf["text"]]
        counts += np.bincount((np.concatenate(found) >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
        yield pd.DataFrame(
            {
                "dk": pdf["dk"], "doc_id": pdf["doc_id"], "n": [len(s) for s in found], "sig": [signature(s) for s in found],
                "parity": [parity(s) for s in found], "mini": [parity(s, LEAST_PARITY) for s in found], "chunk": -1, "part": 0, "counts": [empty] * len(found),
            }
        )
    chunks = BUCKETS // CHUNK
    yield pd.DataFrame(
        {"dk": 0, "doc_id": None, "n": 0, "sig": 0, "parity": [empty] * chunks, "mini": [empty] * chunks, "chunk": range(chunks), "part": part, "counts": list(counts.reshape(chunks, CHUNK))}
    )


def _sum_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "part": [0], "counts": [np.sum(np.stack(pdf["counts"].to_list()), axis=0)]})


def rarity_ranks(counted: DataFrame) -> np.ndarray:
    schema = "chunk int, part int, counts array<long>"
    sums = counted.groupBy("chunk", "part").applyInPandas(_sum_counts, schema).groupBy("chunk").applyInPandas(_sum_counts, schema)
    n = np.zeros(BUCKETS, np.int64)
    for r in sums.collect():
        n[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = r["counts"]
    ranks = np.zeros(BUCKETS, np.uint64)
    ranks[np.lexsort((np.arange(BUCKETS), n))] = np.arange(BUCKETS, dtype=np.uint64)
    return ranks


def scanned(n: int, light: int) -> bool:
    """Whether a set of n is in the lists of its rarest shingles."""
    return n > light or n >= least_share(light + 1)


def _prefixes(ranks, light: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for pdf in batches:
            tokens, halves = [], []
            for t in pdf["text"]:
                s = shingle_set(t)
                n = len(s)
                if not n or not scanned(n, light) or (sig := signature(s)) in seen:
                    continue
                seen.add(sig)
                tokens.append(ordered(s, ranks.value)[: prefix_size(n)])
                halves.append(np.full(len(tokens[-1]), sig >> 32, np.int32))
            if tokens:
                yield pd.DataFrame({"token": np.concatenate(tokens).view(np.int64), "half": np.concatenate(halves)})

    return run


def frequent_shingles(rows: DataFrame, ranks, light: int, least: int, most: int) -> np.ndarray:
    """Those, as numbers of ordered() and sorted, whose lists would have more than `least` entries; the longest lists while there are at most `most`."""
    lists = rows.select("text").mapInPandas(_prefixes(ranks, light), "token long, half int").groupBy("token")
    # copies of one set, which several tasks may hold, are one entry in the end
    lists = lists.agg(F.count("*").alias("length"), F.min("half").alias("lo"), F.max("half").alias("hi")).where((F.col("length") > least) & (F.col("lo") != F.col("hi")))
    lists = materialize(lists.select("token", F.floor(F.log2("length") * 8).cast("int").alias("step")), "ngram-frequent")
    total, first = 0, None
    for step, count in sorted(((r["step"], r["count"]) for r in lists.groupBy("step").count().collect()), reverse=True):
        total += count
        if total > most:
            break
        first = step
    if first is None:
        return NONE
    return np.sort(lists.where(F.col("step") >= first).select("token").toArrow().column("token").to_numpy().view(np.uint64))


def _post(ranks, common, light: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for pdf in batches:
            tokens, sigs, sizes, places = [], [], [], []
            for t in pdf["text"]:
                s = shingle_set(t)
                n = len(s)
                if not n or (sig := signature(s)) in seen:
                    continue
                seen.add(sig)
                own, pos = [], []
                if n <= light:
                    for c in subset_sizes(n):
                        for sub in combinations(s, c):
                            x = np.uint64(c)
                            with np.errstate(over="ignore"):
                                for e in sub:
                                    x = x * BASE + e
                            own.append(x)
                    pos = [0] * len(own)
                if scanned(n, light):
                    rarest = ordered(s, ranks.value, common.value)[: prefix_size(n)]
                    own = np.concatenate([np.array(own, np.uint64), rarest])
                    pos = np.concatenate([np.array(pos, np.int32), np.arange(len(rarest), dtype=np.int32)])
                tokens.append(np.asarray(own, np.uint64))
                places.append(np.asarray(pos, np.int32))
                sigs.append(np.full(len(own), sig, np.int64))
                sizes.append(np.full(len(own), n, np.int32))
            if tokens:
                yield pd.DataFrame({"token": np.concatenate(tokens).view(np.int64), "sig": np.concatenate(sigs), "n": np.concatenate(sizes), "pos": np.concatenate(places)})

    return run


def ordered(s: np.ndarray, rank: np.ndarray, frequent: np.ndarray = NONE) -> np.ndarray:
    """The set's elements as numbers that sort by their bucket's rarity, sorted, but for the frequent ones, which come last; one-to-one."""
    x = np.sort((rank[(s >> np.uint64(48)).astype(np.int64)] << np.uint64(48)) | (s & np.uint64((1 << 48) - 1)))
    if len(frequent):
        late = frequent[np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)] == x
        if late.any():
            x = np.concatenate([x[~late], x[late]])
    return x


def _sets(ranks, common):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent = NONE if common is None else common.value
        for pdf in batches:
            found = [shingle_set(t) for t in pdf["text"]]
            yield pd.DataFrame({"sig": [signature(s) for s in found], "elements": [ordered(s, ranks.value, frequent).view(np.int64) for s in found]})

    return run


def _fits(na: Column, pa: Column, nb: Column, pb: Column) -> Column:
    """Length and positional filters, at the first element that two sets share: nothing before it counts."""
    need = F.ceil((na + nb) * PERCENT / (100 + PERCENT) - 1e-9)
    return (F.least(na, nb) >= F.greatest(na, nb) * PERCENT / 100 - 1e-9) & (F.least(na - pa, nb - pb) >= need)


def _differ(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)


def _alike(a: Column, b: Column, na: Column, nb: Column) -> Column:
    """Whether parities differ in no more bits than linked sets may in elements; the longer one, of twice the bits, is folded."""
    k = F.least(F.size(a), F.size(b))
    fold = lambda x: F.when(F.size(x) == k, x).otherwise(F.zip_with(F.slice(x, 1, k), F.slice(x, k + 1, k), lambda p, q: p.bitwiseXOR(q)))
    return _differ(fold(a), fold(b)) * (100 + PERCENT) <= (na + nb) * (100 - PERCENT)


def _mini_alike(x: str, y: str) -> Column:
    """The same by the folded parities of two sides of a join."""
    return _differ(F.col(f"{x}.mini"), F.col(f"{y}.mini")) * (100 + PERCENT) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (100 - PERCENT)


class Corpus:
    """Texts, one row for each distinct set, and the order: ranks of buckets and the frequent shingles, broadcast."""

    def __init__(self, rows: DataFrame, owners: DataFrame, ranks, common=None) -> None:
        self.rows, self.owners, self.ranks, self.common = rows, owners, ranks, common

    def elements(self, wanted: DataFrame) -> DataFrame:
        """sig, elements (rare ones first) of the wanted sigs."""
        keys = materialize(self.owners.select("sig", "dk").join(wanted.distinct(), "sig").select("dk").distinct(), "ngram-wanted")
        texts = with_keys(self.rows, keys, "dk").select("text")
        return materialize(texts.mapInPandas(_sets(self.ranks, self.common), "sig long, elements array<long>").dropDuplicates(["sig"]), "ngram-sets")

    def parities(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, na, nb) that may link by their parities, written."""
        a, b = (self.owners.select(F.col("sig").alias(x), F.col("parity").alias(f"{x}_parity")) for x in "ab")
        # sizes of linked sets differ by a third at most, so one parity is as long as the other or twice
        some = pairs.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT).join(a, "a").join(b, "b")
        some = some.where(_alike(F.col("a_parity"), F.col("b_parity"), F.col("na"), F.col("nb")))
        return materialize(some.select("a", "b"), "ngram-pairs")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, written."""
        sets = self.elements(pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))))
        a, b = (sets.select(F.col("sig").alias(x), F.col("elements").alias(f"{x}_set")) for x in "ab")
        both = pairs.join(a, "a").join(b, "b")
        shared = F.size(F.array_intersect("a_set", "b_set"))
        return materialize(both.where(shared * 100 >= (F.size("a_set") + F.size("b_set") - shared) * PERCENT).select("a", "b"), "ngram-links")


def _pair(x: str, y: str, nx: str, ny: str) -> list[Column]:
    """a, b, na, nb with a < b of sigs x, y and sizes nx, ny."""
    first = F.col(x) < F.col(y)
    either = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
    return [either(x, y).alias("a"), either(y, x).alias("b"), either(nx, ny).alias("na"), either(ny, nx).alias("nb")]


def _with_pivot(lists: DataFrame) -> DataFrame:
    """Entries beside the entry p of the smallest place in their list, without that entry itself."""
    pivots = lists.groupBy("token").agg(F.min(F.struct("pos", "sig", "n", "label")).alias("p"))
    return lists.join(pivots, "token").where("sig <> p.sig")


def components(links: DataFrame, steps: int = 1000) -> DataFrame:
    """sig, label of linked sets; with enough steps label is the smallest sig of the component.

    Each step takes the smallest label among neighbours, then the label's label.
    """
    both = materialize(links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct(), "ngram-edges")
    labels = materialize(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("sig"), F.least("x", "y").alias("label")), "ngram-labels")
    for _ in range(steps):
        near = both.join(labels.select(F.col("sig").alias("y"), F.col("label").alias("near")), "y").groupBy("x").agg(F.min("near").alias("near"))
        low = labels.join(near.withColumnRenamed("x", "sig"), "sig").select("sig", F.col("label").alias("old"), F.least("label", "near").alias("to"))
        far = labels.select(F.col("sig").alias("to"), F.col("label").alias("far"))
        new = materialize(low.join(far, "to", "left").select("sig", "old", F.least("to", F.coalesce("far", "to")).alias("label")), "ngram-labels")
        labels = new.select("sig", "label")
        if not new.where("old <> label").limit(1).count():
            break
    return labels


def _mixed(entries: DataFrame) -> DataFrame:
    """Entries of lists with more than one component left, with their list's length; written."""
    lists = entries.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("length")).where("lo <> hi").select("token", "length")
    return materialize(entries.select("token", "sig", "n", "pos", "label").join(lists, "token"), "ngram-postings")


def _round(corpus: Corpus, lists: DataFrame, links: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Compares each list with its pivot: lists without them, and all links so far."""
    met = _with_pivot(lists).where(F.col("label") != F.col("p.label")).where(_fits(F.col("n"), F.col("pos"), F.col("p.n"), F.col("p.pos")))
    pairs = corpus.parities(met.select(*_pair("sig", "p.sig", "n", "p.n")).distinct())
    found = corpus.verified(pairs)
    links = found if links is None else links.unionByName(found)
    rest = _with_pivot(lists).drop("label", "p").join(components(links, 3), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    return _mixed(rest), links


def _short_pairs(corpus: Corpus, lists: DataFrame) -> DataFrame:
    """Pairs that may link within each list."""
    rows = lists.join(corpus.owners.select("sig", "mini"), "sig")
    x, y = rows.alias("x"), rows.alias("y")
    at = lambda s, c: F.col(f"{s}.{c}")
    fits = _fits(at("x", "n"), at("x", "pos"), at("y", "n"), at("y", "pos")) & _mini_alike("x", "y")
    met = x.join(y, (at("x", "token") == at("y", "token")) & (at("x", "sig") < at("y", "sig")) & (at("x", "label") != at("y", "label")) & fits)
    return corpus.parities(met.select(at("x", "sig").alias("a"), at("y", "sig").alias("b"), at("x", "n").alias("na"), at("y", "n").alias("nb")).distinct())


def differences(corpus: Corpus, lists: DataFrame) -> DataFrame:
    """pivot, bound (25 |pivot|), sig, n, label, mini, u and differing elements d of the sets in each list against its pivot."""
    members = materialize(_with_pivot(lists).select(F.col("p.sig").alias("pivot"), "sig", "n", "label").distinct(), "ngram-members")
    sets = corpus.elements(members.select("sig").unionByName(members.select(F.col("pivot").alias("sig"))))
    rows = members.join(sets, "sig").join(corpus.owners.select("sig", "mini"), "sig").join(sets.select(F.col("sig").alias("pivot"), F.col("elements").alias("whole")), "pivot")
    rows = rows.select("pivot", "sig", "n", "label", "mini", F.size("whole").alias("p"), F.array_except("elements", "whole").alias("adds"), F.array_except("whole", "elements").alias("lacks"))
    u = F.size("lacks") * 100 + F.size("adds") * PERCENT
    return materialize(rows.select("pivot", (F.col("p") * (100 - PERCENT)).alias("bound"), "sig", "n", "label", "mini", u.alias("u"), F.concat("adds", "lacks").alias("d")), "ngram-differences")


def _prefix(shared_times: Column) -> Column:
    """The first differences, among which any partner has one that shares shared_times / (100 + PERCENT) of them."""
    least = F.greatest(F.ceil(shared_times / (100 + PERCENT) - 1e-9).cast("int"), F.lit(1))
    return F.slice("d", 1, F.greatest(F.size("d") - least + 1, F.lit(0)))


def _long_pairs(corpus: Corpus, diff: DataFrame) -> DataFrame:
    """Pairs that may link, not both of them with the pivot."""
    u, bound = F.col("u"), F.col("bound")
    step = F.when(u > bound, F.least(F.floor((u - bound) * CLASSES / bound).cast("int"), F.lit(2 * CLASSES))).otherwise(0)
    # the further set of a pair: a partner has u of .75 (u - bound) at least, as it must share that much
    far = diff.where(u > bound).select("pivot", "sig", "n", "label", "mini", "u", step.alias("class"), F.explode(_prefix(u + F.ceil((u - bound) * PERCENT / 100) - bound)).alias("e"))
    near = diff.select("*", F.explode(F.sequence(step, F.lit(2 * CLASSES))).alias("class"))
    near = near.select("pivot", "sig", "n", "label", "mini", "u", "class", F.explode(_prefix(u + F.greatest(F.ceil(bound + F.col("class") * bound / CLASSES), u) - bound)).alias("e"))
    x, y = far.alias("x"), near.alias("y")
    same = (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.class") == F.col("y.class")) & (F.col("x.e") == F.col("y.e"))
    nearer = (F.col("y.u") < F.col("x.u")) | ((F.col("y.u") == F.col("x.u")) & (F.col("y.sig") < F.col("x.sig")))
    met = x.join(y, same & nearer & (F.col("x.label") != F.col("y.label")) & _mini_alike("x", "y"))
    return corpus.parities(met.select(*_pair("x.sig", "y.sig", "x.n", "y.n")).distinct())


def link_components(documents: DataFrame, rounds: int = ROUNDS, long: int = LONG, frequent: int = FREQUENT, most: int = MOST) -> DataFrame:
    """doc_id, n_shingles, component_id. The other parameters only move work between the ways of the module's text."""
    spark = documents.sparkSession
    rows = documents.select(
        F.coalesce(F.col("doc_id").cast("long"), -2 - F.shiftrightunsigned(F.xxhash64("text"), 2)).alias("dk"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    survey = materialize(rows.mapInPandas(_survey, "dk long, doc_id long, n int, sig long, parity array<long>, mini array<long>, chunk int, part int, counts array<long>"), "ngram-survey")
    sets = survey.where("chunk < 0").select("dk", "doc_id", "n", "sig")
    owners = survey.where("chunk < 0 AND n > 0").groupBy("sig").agg(F.min("dk").alias("dk"), F.max("n").alias("n"), F.first("parity").alias("parity"), F.first("mini").alias("mini"))
    owners = materialize(owners, "ngram-owners")
    histogram = {r["n"]: r["count"] for r in owners.where(F.col("n") <= 2 * LIGHT_SIZES).groupBy("n").count().collect()}
    light = boundary(histogram)
    ranks = spark.sparkContext.broadcast(rarity_ranks(survey.where("chunk >= 0").select("chunk", "part", "counts")))
    common = spark.sparkContext.broadcast(frequent_shingles(rows, ranks, light, frequent, most))
    corpus = Corpus(rows, owners, ranks, common)
    posted = rows.select("text").mapInPandas(_post(ranks, common, light), "token long, sig long, n int, pos int")
    by_sig = Window.partitionBy("token").orderBy("sig")
    whole = by_sig.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    posted = posted.select("*", F.lag("sig").over(by_sig).alias("last"), F.min("sig").over(whole).alias("lo"), F.max("sig").over(whole).alias("hi"))
    lists = _mixed(materialize(posted.where("lo <> hi AND (last IS NULL OR last <> sig)").select("token", "sig", "n", "pos", F.col("sig").alias("label")), "ngram-lists"))
    links = None
    for _ in range(rounds):
        if not lists.limit(1).count():
            break
        lists, links = _round(corpus, lists, links)
    found = [] if links is None else [links]
    short, over = lists.where(F.col("length") <= long), lists.where(F.col("length") > long)
    if short.limit(1).count():
        found.append(corpus.verified(_short_pairs(corpus, short)))
    if over.limit(1).count():
        diff = differences(corpus, over)
        found += [diff.where("u <= bound").select(F.least("sig", "pivot").alias("a"), F.greatest("sig", "pivot").alias("b")), corpus.verified(_long_pairs(corpus, diff))]
    if not found:
        found = [owners.where("false").select(F.col("sig").alias("a"), F.col("sig").alias("b"))]
    labels = components(functools.reduce(DataFrame.unionByName, found))
    named = sets.where("n > 0").join(labels, "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    least = materialize(named.groupBy("label").agg(F.min("doc_id").alias("component_id")), "ngram-least")
    return (
        named.join(least, "label").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
        .unionByName(sets.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    )


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))


OP10_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT x AS doc_id, x AS c FROM l UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.c, s.doc_id)) AS component_id FROM s LEFT JOIN m USING (doc_id)
"""
