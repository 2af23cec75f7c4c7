"""The notice feed: predicates, full-text terms, ordering, paging, lookups."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.dates import day, days_left, shift

LANES = ("Core", "Partner-led", "Signal")
GRACE_DAYS = 45


def buyer_key() -> Column:
    return F.coalesce(F.nullif(F.col("buyer_norm"), F.lit("")), F.col("buyer"))


def is_open(asof: str) -> Column:
    """Not closed, or without a closing date and advertised (else first seen) within 45 days."""
    seen = F.coalesce(F.col("advertised"), F.col("first_seen").cast("date"))
    return F.coalesce(F.col("closing") >= day(asof), F.lit(False)) | (F.col("closing").isNull() & (seen >= shift(asof, -GRACE_DAYS)))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def _any_starts(words: Column, prefix: str) -> Column:
    return F.exists(words, lambda w: w.startswith(prefix))


def matches(query: str, *columns: str) -> Column | None:
    """All terms of query in the columns together; a trailing * is a prefix; None without terms."""
    terms = re.findall(r"[A-Za-z0-9]+\*?", query or "")
    if not terms:
        return None
    words = tokens(F.concat_ws(" ", *columns))
    found = None
    for t in terms:
        t = t.lower()
        one = _any_starts(words, t[:-1]) if t.endswith("*") else F.array_contains(words, t)
        found = one if found is None else found & one
    return found


@dataclass(frozen=True)
class Feed:
    """Parameters of a feed request."""

    asof: str
    q: str = ""
    sources: tuple[str, ...] = ()
    lanes: tuple[str, ...] = ()
    products: tuple[str, ...] = ()
    sectors: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    relevance: tuple[str, ...] = ()
    jurisdictions: tuple[str, ...] = ()
    scope: str = "all"
    new_only: bool = False
    status: str = "all"
    date_on: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    closing_within: int | None = None
    value_min: float | None = None
    value_max: float | None = None
    sort: str = "closing"
    limit: int = 300
    offset: int = 0
    extra: tuple = field(default=())


def predicate(f: Feed) -> Column:
    c = F.col
    keep: list[Column] = []
    for name, values in (("source", f.sources), ("product_line", f.products), ("buyer_sector", f.sectors), ("tender_type", f.types), ("relevance", f.relevance), ("jurisdiction", f.jurisdictions)):
        if values:
            keep.append(c(name).isin(*values))
    if f.lanes:
        keep.append(c("lane").isin(*f.lanes))
    elif f.scope == "opportunity":
        keep.append(c("is_opportunity") == 1)
    elif f.scope == "relevant":
        keep.append(c("lane").isin(*LANES))
    if f.scope != "all":
        keep.append(c("dup_of").isNull())
    if f.new_only:
        keep.append(c("is_new") == 1)
    if f.status == "open":
        keep.append(is_open(f.asof))
    elif f.status == "closed":
        keep.append(c("closing") < day(f.asof))
    if f.date_on:
        keep.append((c("advertised") == day(f.date_on)) | (c("closing") == day(f.date_on)))
    if f.date_from:
        keep.append(c("advertised") >= day(f.date_from))
    if f.date_to:
        keep.append(c("advertised") <= day(f.date_to))
    if f.closing_within is not None:
        keep.append(c("closing").between(day(f.asof), shift(f.asof, f.closing_within)))
    if f.value_min is not None:
        keep.append(c("value_num") >= f.value_min)
    if f.value_max is not None:
        keep.append(c("value_num") <= f.value_max)
    text = matches(f.q, "title", "description", "buyer", "ref")
    if text is not None:
        keep.append(text)
    out = F.lit(True)
    for k in keep:
        out = out & k
    return out


def ordering(sort: str) -> list[Column]:
    c = F.col
    by = {
        "closing": [c("closing").asc_nulls_last()],
        "newest": [c("advertised").desc_nulls_last(), c("first_seen").desc_nulls_last()],
        "value": [c("value_num").desc_nulls_last()],
        "relevance": [c("fit_score").desc_nulls_last(), c("closing").asc_nulls_first()],
    }
    return [*by.get(sort, by["closing"]), c("uid")]


def search(notices: DataFrame, f: Feed) -> DataFrame:
    """One page of the feed with days_left; uid breaks ties."""
    rows = notices.where(predicate(f)).orderBy(*ordering(f.sort)).offset(f.offset).limit(f.limit)
    return rows.withColumn("days_left", days_left(F.col("closing"), f.asof))


def matching(notices: DataFrame, f: Feed) -> DataFrame:
    """All rows of the feed, for counting and export."""
    return notices.where(predicate(f))


def prefetch(notices: DataFrame, asof: str, n: int = 30) -> DataFrame:
    """Open opportunities whose details are still to fetch, best fit first."""
    keep = (F.col("is_opportunity") == 1) & F.col("detail_fetched").isNull() & F.col("url").like("http%") & F.col("dup_of").isNull() & is_open(asof)
    return notices.where(keep).orderBy(F.col("fit_score").desc(), "uid").limit(n).select("uid", "url", "fit_score")


def last_changes(changes: DataFrame, n: int = 12) -> DataFrame:
    """The n latest changes of each uid, with their place k."""
    w = Window.partitionBy("uid").orderBy(F.col("seen_at").desc(), F.col("id").desc())
    return changes.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)


def with_children(notices: DataFrame, alternates: DataFrame, changes: DataFrame, n: int = 12) -> DataFrame:
    """Notices with arrays alternates (by dedupe_key) and changes (the n latest)."""
    alt = alternates.groupBy("dedupe_key").agg(F.sort_array(F.collect_list(F.struct("source", "ref", "url"))).alias("alternates"))
    ch = last_changes(changes, n).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("k", "field", "old_value", "new_value", "seen_at"))).alias("changes"))
    return notices.join(alt, "dedupe_key", "left").join(ch, "uid", "left")


def get(notices: DataFrame, alternates: DataFrame, changes: DataFrame, uid: str) -> DataFrame:
    one = notices.where(F.col("uid") == uid)
    return with_children(one, alternates.join(one.select("dedupe_key"), "dedupe_key", "left_semi"), changes.where(F.col("uid") == uid))


def moved(notices: DataFrame, changes: DataFrame, asof: str, days: int = 2, n: int = 8) -> DataFrame:
    """Latest changes of open opportunities."""
    recent = changes.where(F.col("seen_at") >= shift(asof, -days).cast("timestamp"))
    live = notices.where((F.col("is_opportunity") == 1) & is_open(asof)).select("uid", "lane", "fit_score", "closing")
    return recent.join(live, "uid").orderBy(F.col("seen_at").desc(), F.col("id").desc()).limit(n)


def brief(notices: DataFrame, changes: DataFrame, asof: str, days_new: int = 2, closing_days: int = 7, n: int = 10) -> dict[str, DataFrame]:
    """What is new, what closes soon, what moved, and the totals."""
    c = F.col
    live = (c("is_opportunity") == 1) & c("dup_of").isNull()
    new = notices.where(live & (c("first_seen") >= shift(asof, -days_new).cast("timestamp")) & (c("closing") >= day(asof))).orderBy(c("fit_score").desc(), "closing", "uid").limit(n)
    soon = notices.where(live & c("closing").between(day(asof), shift(asof, closing_days))).orderBy("closing", c("fit_score").desc(), "uid").limit(n)
    clear = c("dup_of").isNull() & is_open(asof)
    stats = notices.agg(
        F.count_if((c("is_opportunity") == 1) & clear).alias("open_opps"),
        F.count_if((c("lane") == "Core") & clear).alias("open_core"),
        F.count("*").alias("tracked"),
    )
    return {"new": new, "closing": soon.withColumn("days_left", days_left(c("closing"), asof)), "moved": moved(notices, changes, asof, days_new), "stats": stats}
