"""Line deduplication by an exact set-similarity join, in DataFrame operations only.

A line is the set of its lower-cased words, as 64-bit hashes, sorted.

1. Lines with equal sets are one set, standing at its first occurrence.
2. The range of hashes is cut into equal parts. If two sets differ in at most d
   words, then of any d + 1 parts one holds the same words in both. So a set has
   a key for each of as many parts as its size asks for: the hash of the words in
   it. The numbers of parts are 3, 4, 6, 8, 12 ...; a set whose smaller partners
   may use the number before has keys for either. A part of few words says
   little: it makes keys only together with each of the others, of which again
   one is the same in both. Keys that only one set has go.
3. First, each set is tried with the earliest set of each key and with the one
   before it by length, which settles most near copies in linear work. Sets
   without an earlier match there are then joined with all earlier sets of their
   keys. A pair must also fit by length and by the parity of word bits: the
   differing bits of two 64-bit parities are never more than differing words.
4. Surviving pairs are verified on all their word hashes, and every line that
   isn't the first of its set, or whose set has an earlier match, is removed.

Order is by (doc_id, hash of the text, line number), null doc_ids last; the same
three are a line's address throughout, with 0 for the hash where no other row has
the doc_id, as the id says all there (a random long in each of the many postings
is not for free).

No table of words is gathered. A text is one row wherever lines are
cut out of it, so it must fit into memory several times over; its lines are rows
of their own from there on.

Defined cases: null text stays null, empty text stays empty; lines of fewer than
MIN_WORDS distinct words and MIN_CHARS characters are kept and match nothing,
lines without words always; identical rows with one doc_id are one document and
lose the same lines; rows with one doc_id and other texts are separate documents,
the one of the smaller hash first; an empty table gives no rows; extra columns are
kept, but for those named as the added ones.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import BROADCAST_KEYS, materialize, table, with_keys

THRESHOLD, MIN_WORDS, MIN_CHARS = 0.9, 3, 40
SPACES = r"[\x20\x09-\x0D]+"
#: Of words, for line_table's callers.
BUCKETS = 1 << 16
#: Parts of so few words (one fewer where there are more than 8 parts) don't make a key alone.
FEW = 2
#: Numbers of parts up to this one have their bounds in a list.
LISTED = 64
#: Address of a line, in order.
AT = ["late", "dk", "th", "ln"]
ROW = [*AT, "n", "parity"]


def plain(text: Column) -> Column:
    """Lower-cased, with spaces for white space other than line ends; few texts need the regular expression."""
    odd = functools.reduce(lambda a, b: a | b, (text.contains(x) for x in "\t\x0b\x0c\r"))
    return F.lower(F.when(odd, F.regexp_replace(text, r"[\x09\x0B-\x0D]", " ")).otherwise(text))


def address() -> list[Column]:
    """Of a document: late (its id is null), dk (doc_id, or a negative number from the text) and th (hash of the text)."""
    th = F.xxhash64("text")
    return [F.col("doc_id").isNull().alias("late"), F.coalesce(F.col("doc_id").cast("long"), -2 - F.shiftrightunsigned(th, 2)).alias("dk"), th.alias("th")]


def repeated_ids(documents: DataFrame) -> DataFrame:
    """dk of the ids that several rows have, written."""
    ids = documents.select(F.col("doc_id").cast("long").alias("dk")).where("dk IS NOT NULL")
    return materialize(ids.groupBy("dk").count().where("count > 1").select("dk"), "line-ids")


def placed(documents: DataFrame, repeated: DataFrame, *more: Column) -> DataFrame:
    """text, late, dk and th of each document, and more columns; th is 0 where the id isn't null and no other row has it."""
    late, dk, th = address()
    rows = documents.select(*more, F.col("text"), late, dk)
    names = [c for c in rows.columns if c != "dk"]
    several, count = F.col("late"), repeated.count()
    if count:
        marks = repeated.select("dk", F.lit(True).alias("several"))
        rows = rows.join(F.broadcast(marks) if count <= BROADCAST_KEYS else marks.hint("merge"), "dk", "left")
        several |= F.col("several").isNotNull()
    return rows.select(*names, "dk", F.when(several, th).otherwise(F.lit(0).cast("long")).alias("th"))


def hashes(line: Column) -> Column:
    """Of the words of a plain line, repeated ones and the empty word included."""
    return F.transform(F.split(line, " "), lambda w: F.xxhash64(w))


def in_order(found: Column) -> Column:
    """Distinct words of such hashes, sorted."""
    return F.sort_array(F.array_distinct(F.array_remove(found, F.xxhash64(F.lit("")))))


def signature(words: Column) -> list[Column]:
    return [F.xxhash64(words).alias("h"), F.hash(words).alias("g")]


def parity(words: Column) -> Column:
    """A bit for each of 64 groups of words: whether it has an odd number of these."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(words, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(bit(x)))


def once(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """rows with one more column, through a generator: it is made once however often it is used, and compiled even if it stands on what can't be."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _needed(n: Column, t: float) -> Column:
    """One more than the words by which a set of n and a similar one of at least as many can differ."""
    return F.floor(n * ((1 - t) / t) + 1e-6).cast("int") + 1


def _step(needed: Column) -> Column:
    """Place of the least number above needed in the row of parts 3, 4, 6, 8, 12, 16, 24 ..., which begins at 2."""
    e = F.length(F.bin(needed)) - 1
    return 2 * e + (2 * (needed + 1) > 3 * _power(e)).cast("int")


def _power(e: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), e)


def _parts(step: Column) -> Column:
    e = F.call_function("shiftright", step, F.lit(1))
    return F.when(step % 2 == 1, 2 * _power(e)).otherwise(F.call_function("shiftright", 3 * _power(e), F.lit(1)))


def _bounds(parts: Column) -> Column:
    """First numbers of as many equal ranges of longs, and the last number."""
    low, high = -(1 << 63), (1 << 63) - 1
    listed = F.array(*(F.array(*(F.lit(x).cast("long") for x in (*(low + i * ((1 << 64) // k) for i in range(k)), high))) if k > 1 else F.array().cast("array<bigint>") for k in range(LISTED + 1)))
    # parts are even from there on: as many ranges below 0 as above
    half = (parts / 2).cast("int")
    width = F.floor(F.lit(float(1 << 62)) / half * 2 - 1024).cast("long")
    far = F.concat(F.sequence(F.lit(low), F.lit(low) + width * (half - 1), width), F.sequence(F.lit(0).cast("long"), width * (half - 1), width), F.array(F.lit(high)))
    return F.when(parts <= LISTED, F.get(listed, parts)).otherwise(far)


def _part(k: Column) -> Column:
    """The k-th part of the words in cut: its bound, and what stands before the next."""
    start = lambda i: F.array_position("cut", F.get("bounds", i)).cast("int")
    return F.slice("cut", start(k), start(k + 1) - start(k))


def line_rows(documents: DataFrame, repeated: DataFrame, t: float, min_words: int) -> DataFrame:
    """A row of address, n, h and g for each line that takes part, and a row of h and key for each of its keys."""
    lines = placed(documents, repeated).select(*AT[:3], F.posexplode(F.split(plain(F.col("text")), "\n")).alias("ln", "line"))
    rows = once(lines.select(*AT, F.length("line").alias("chars"), "line"), hashes(F.col("line")), "found")
    rows = once(rows.select(*AT, "chars", "found"), in_order(F.col("found")), "w")
    n = F.size("w")
    rows = rows.where((n >= min_words) | ((F.col("chars") >= MIN_CHARS) & (n > 0))).select(*AT, n.alias("n"), *signature(F.col("w")), parity(F.col("w")).alias("parity"), "w")
    rows = rows.withColumn("needed", _needed(F.col("n"), t))
    # the numbers of parts of all sets that are at most as large, and similar; -1 stands for the line itself
    least = _needed(F.ceil(F.col("n") * t - 1e-6).cast("int"), t)
    steps = F.when(F.col("needed") > 1, F.sequence(F.greatest(F.lit(2), _step(least)), _step(F.col("needed")))).otherwise(F.array().cast("array<int>"))
    rows = rows.select("*", F.explode(F.concat(F.array(F.lit(-1)), steps)).alias("step"))
    rows = once(rows, F.when(F.col("step") < 0, 0).otherwise(_parts(F.col("step"))), "parts")
    rows = once(rows, _bounds(F.col("parts")), "bounds")
    rows = once(rows, F.when(F.col("parts") == 0, F.col("bounds")).otherwise(F.sort_array(F.concat("w", "bounds"))), "cut").drop("w")
    rows = rows.withColumn("last", F.when(F.col("parts") == 0, 0).otherwise(F.least(F.col("needed"), F.col("parts") - 1)))
    # the lambda ends one compiled loop and begins another: as one they are so large that compiling them can take memory that executors don't have
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("last") - 1)), lambda k: k)
    rows = rows.select(*AT, "n", "g", "parity", "h", "parts", "last", "bounds", "cut", F.explode(each).alias("j"))
    rows = once(rows, F.when(F.col("parts") == 0, F.col("cut")).otherwise(_part(F.col("j"))), "one")
    few = (F.size("one") - 1 <= F.when(F.col("parts") <= 8, FEW).otherwise(FEW - 1)) & F.col("parts").between(1, LISTED)
    others = F.when(few, F.array_remove(F.sequence(F.lit(0), F.col("last")), F.col("j"))).otherwise(F.array(F.lit(-1)))
    rows = rows.select("*", F.explode(others).alias("i"))
    key = F.when(F.col("i") < 0, F.xxhash64("parts", "one")).otherwise(F.xxhash64("parts", "one", _part(F.col("i"))))
    own = F.col("parts") == 0
    return rows.select(*(F.when(own, F.col(c)).alias(c) for c in (*AT, "n", "g", "parity")), "h", F.when(~own, key).alias("key"))


def lines_of(rows: DataFrame) -> DataFrame:
    return rows.where("ln IS NOT NULL").select(*AT, "n", "parity", "h", "g")


def line_table(documents: DataFrame, repeated: DataFrame, ranks: list[int], t: float, min_words: int) -> DataFrame:
    """Address, n, parity, h and g of each line that takes part. ranks, of BUCKETS of words, are no longer used."""
    return lines_of(line_rows(documents, repeated, t, min_words))


def _fits(a: dict[str, Column], b: dict[str, Column], t: float) -> Column:
    """Length and parity filters of a pair."""
    differ = F.bit_count(a["parity"].bitwiseXOR(b["parity"]))
    return (differ <= (a["n"] + b["n"]) * ((1 - t) / (1 + t)) + 1e-6) & (a["n"] >= b["n"] * t - 1e-9) & (b["n"] >= a["n"] * t - 1e-9)


def _at(row: dict[str, Column]) -> Column:
    return F.struct(*(row[c] for c in AT))


def _before(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return functools.reduce(lambda later, c: (a[c] < b[c]) | ((a[c] == b[c]) & later), reversed(AT[:-1]), a[AT[-1]] < b[AT[-1]])


def _pair(first: Column, second: Column) -> list[Column]:
    """Addresses of a pair: a's, the earlier, and b's."""
    return [s[c].alias(f"{x}_{c}") for x, s in (("a", F.least(first, second)), ("b", F.greatest(first, second))) for c in AT[1:]]


def _fetch(documents: DataFrame, repeated: DataFrame, wanted: DataFrame) -> DataFrame:
    """dk, th, ln, words of the wanted lines."""
    per = materialize(wanted.groupBy("dk", "th").agg(F.collect_set("ln").alias("lns")), "line-wanted")
    rows = with_keys(placed(documents, repeated).select("dk", "th", "text"), materialize(per.select("dk").distinct(), "line-keys"), "dk")
    found = rows.dropDuplicates(["dk", "th"]).join(per.hint("merge"), ["dk", "th"])
    # the lines of a text are bound to a name, so that it is split once
    cut = F.transform(F.array(F.split(plain(F.col("text")), "\n")), lambda lines: F.transform("lns", lambda k: F.struct(k.alias("ln"), F.get(lines, k).alias("line"))))
    found = found.select("dk", "th", F.explode(F.flatten(cut)).alias("l"))
    found = once(found.select("dk", "th", "l.ln", "l.line"), hashes(F.col("line")), "found")
    return found.select("dk", "th", "ln", in_order(F.col("found")).alias("w"))


def _verify(documents: DataFrame, repeated: DataFrame, pairs: DataFrame, t: float) -> DataFrame:
    """Address (but late), h and g of the later line b of each pair whose words are similar enough."""
    a_at, b_at = ([F.col(f"{x}_{c}").alias(c) for c in AT[1:]] for x in "ab")
    words = materialize(_fetch(documents, repeated, pairs.select(*a_at).unionByName(pairs.select(*b_at))), "line-words")
    side = lambda x: words.select(*(F.col(c).alias(f"{x}_{c}") for c in AT[1:]), F.col("w").alias(f"{x}_w"))
    both = pairs.join(side("a"), [f"a_{c}" for c in AT[1:]]).join(side("b"), [f"b_{c}" for c in AT[1:]])
    shared = F.size(F.array_intersect("a_w", "b_w"))
    ok = both.where(shared >= (F.size("a_w") + F.size("b_w") - shared) * t - 1e-9)
    return ok.select(*b_at, *signature(F.col("b_w"))).distinct()


def similar_sets(documents: DataFrame, repeated: DataFrame, keyed: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """h and g of sets with a similar set at an earlier place."""
    shared = keyed.groupBy("key").agg(F.min("h").alias("least"), F.max("h").alias("most")).where("least <> most").select("key")
    members = keyed.join(materialize(shared, "line-keys").hint("shuffle_hash"), "key", "left_semi").distinct()
    posted = members.join(sets.select("h", "at.*", "n", "parity"), "h")
    w = Window.partitionBy("key").orderBy("n", *AT)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    posted = posted.select("key", *ROW, F.lag(F.struct(*ROW)).over(w).alias("prev"), F.min(F.struct(*ROW)).over(whole).alias("lead"))
    own = {c: F.col(c) for c in ROW}
    tries = []
    for name in ("lead", "prev"):
        other = {c: F.col(f"{name}.{c}") for c in ROW}
        tries.append(F.when((_at(other) != _at(own)) & _fits(own, other, t), _at(other)).alias(name))
    posted = materialize(posted.select("key", *ROW, *tries), "line-postings")
    tried = posted.select(*AT, F.explode(F.array_compact(F.array("lead", "prev"))).alias("other")).select(*_pair(_at(own), F.col("other"))).distinct()
    tried = materialize(tried, "line-pairs")
    settled = materialize(_verify(documents, repeated, tried, t), "line-settled")
    # sets without a match so far, against everything earlier in their lists
    rows = posted.select("key", *ROW)
    x, y = rows.alias("x"), rows.join(settled.select(*AT[1:]), AT[1:], "left_anti").alias("y")
    a, b = ({c: F.col(f"{s}.{c}") for c in ROW} for s in "xy")
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & _fits(a, b, t) & _before(a, b))
    rest = rest.select(*(r[c].alias(f"{x}_{c}") for x, r in (("a", a), ("b", b)) for c in AT[1:]))
    rest = materialize(rest.distinct().join(tried, tried.columns, "left_anti"), "line-rest")
    found = settled.select("h", "g")
    if rest.limit(1).count():
        found = found.unionByName(materialize(_verify(documents, repeated, rest, t), "line-found").select("h", "g"))
    return found.distinct()


def dedup_lines(documents: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """documents with text less removed lines, n_lines and n_removed."""
    repeated = repeated_ids(documents)
    rows = materialize(line_rows(documents, repeated, threshold, min_words), "lines")
    at = F.struct(*AT)
    lines, keyed = lines_of(rows), rows.where("key IS NOT NULL").select("key", "h")
    sets = materialize(lines.groupBy("h", "g").agg(F.min(at).alias("at"), F.max("n").alias("n"), F.max("parity").alias("parity"), F.count("*").alias("count")), "line-sets")
    bad = similar_sets(documents, repeated, keyed, sets, threshold).withColumn("similar", F.lit(True))
    marks = sets.join(bad, ["h", "g"], "left").where("count > 1 OR similar")
    marks = materialize(marks.select("h", "g", F.when(F.col("similar").isNull(), F.col("at")).alias("keep")), "line-marks")
    gone = lines.join(marks, ["h", "g"]).where(~at.eqNullSafe(F.col("keep")))
    per = gone.groupBy("dk", "th").agg(F.collect_set("ln").alias("gone"))
    # documents' own columns travel in a struct, so that none can clash
    own = [c for c in documents.columns if c not in ("n_lines", "n_removed")]
    rows = placed(documents, repeated, F.struct(*(F.col(f"`{c}`") for c in own)).alias("row")).select("row", "dk", "th")
    out = rows.join(per.hint("merge"), ["dk", "th"], "left")
    split = F.split("row.text", "\n")
    # the lines are bound to a name, so that the text is split once
    kept = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda k: F.get(lines, k))
    cleaned = F.get(F.transform(F.array(split), lambda lines: F.array_join(kept(lines), "\n")), F.lit(0))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(cleaned)
    return out.select(
        *(text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in own),
        F.when(F.col("row.text").isNull(), 0).otherwise(F.size(split)).alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("n_removed"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the remaining text; null texts: of the empty one)."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.col("n_removed").cast("long").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


#: The same by brute force over pairs of different sets, which share a word.
OP8_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents),
s AS (SELECT doc_id, ln, line, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '{SPACES}'), lambda w: w <> ''))) AS w FROM l),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id, ln) AS ix, len(w) >= {MIN_WORDS} OR (len(w) > 0 AND length(lower(line)) >= {MIN_CHARS}) AS taken FROM s),
u AS (SELECT w, min(ix) AS ix, len(w) AS n FROM o WHERE taken GROUP BY w),
df AS (SELECT t, count(*) AS df FROM (SELECT unnest(w) AS t FROM u) GROUP BY t),
r AS (SELECT ix, n, w, list(t ORDER BY df, t) AS byrare FROM (SELECT ix, n, w, unnest(w) AS t FROM u) JOIN df USING (t) GROUP BY ix, n, w),
p AS (SELECT ix, n, w, unnest(byrare[1:n - CAST(ceil({THRESHOLD} * n - 1e-9) AS INTEGER) + 1]) AS t FROM r),
m AS (SELECT DISTINCT b.ix FROM p a JOIN p b ON a.t = b.t AND a.ix < b.ix AND least(a.n, b.n) >= {THRESHOLD} * greatest(a.n, b.n) - 1e-9
  WHERE len(list_intersect(a.w, b.w)) >= {THRESHOLD} * (a.n + b.n - len(list_intersect(a.w, b.w))) - 1e-9),
g AS (SELECT o.doc_id, o.ln, o.line, o.taken AND (o.ix <> u.ix OR u.ix IN (SELECT ix FROM m)) AS gone FROM o LEFT JOIN u ON o.w = u.w)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id
"""
