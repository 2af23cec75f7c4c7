"""Upserts with change capture, duplicate tags, re-issues and keyed merges.

Snapshots in, snapshots out: each function takes the stored table and incoming
rows and returns the new table (and the changes), for foreachBatch or a batch
job to write. seq is the order of arrival and stands in for the row number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import buyer_id, title_key

c = F.col
TRACKED = ("title", "status", "closing", "closing_time", "value_text")
#: Columns that an update overwrites, nulls included; advertised keeps an old value.
OVERWRITTEN = ("title", "status", "closing", "closing_time", "value_text", "value_num", "lane", "product_line", "fit_score", "is_opportunity")


def notice_uid(source: Column, ref: Column, url: Column, title: Column) -> Column:
    blank = lambda x: F.nullif(x, F.lit(""))
    return F.concat(source, F.lit(":"), F.coalesce(blank(ref), blank(url), F.substring(title, 1, 60), F.lit("")))


def field_changes(rows: DataFrame, fields: Sequence[str], order: Sequence[str] = ("seq",)) -> DataFrame:
    """uid, seq, field, old_value, new_value: where a row's non-empty value differs from the one before it."""
    w = Window.partitionBy("uid").orderBy(*order)
    kept = rows.select("uid", "seq", *(c(f).cast("string").alias(f) for f in fields), *(F.lag(c(f).cast("string")).over(w).alias(f"old_{f}") for f in fields))
    each = F.array(*(F.struct(F.lit(f).alias("field"), c(f"old_{f}").alias("old_value"), c(f).alias("new_value")) for f in fields))
    out = kept.select("uid", "seq", F.explode(each).alias("x")).select("uid", "seq", "x.*")
    return out.where((c("old_value") != "") & (c("new_value") != "") & (c("old_value") != c("new_value")))


def upsert_notices(stored: DataFrame, incoming: DataFrame, fields: Sequence[str] = TRACKED) -> tuple[DataFrame, DataFrame]:
    """(new table, changes). Rows share one schema with uid, seq, advertised, first_seen, last_seen.

    A uid that occurs twice in incoming updates its own first row. The last row
    wins but for advertised (last non-null), first_seen and columns that no
    update writes (first).
    """
    rows = stored.unionByName(incoming, allowMissingColumns=True)
    last = [x for x in (*OVERWRITTEN, "last_seen") if x in rows.columns]
    first = [x for x in rows.columns if x not in (*last, "uid", "seq", "advertised", "is_new")]
    by_seq = lambda f, x: f(F.struct(c(x).alias("v")), "seq")["v"]  # noqa: E731  a struct keeps nulls
    merged = rows.groupBy("uid").agg(
        F.min("seq").alias("seq"),
        *(by_seq(F.max_by, x).alias(x) for x in last),
        *(by_seq(F.min_by, x).alias(x) for x in first),
        F.max_by("advertised", F.when(c("advertised").isNotNull(), c("seq"))).alias("advertised"),
        (F.count("*") == 1).cast("int").alias("is_new"),
    )
    return merged.select(*(x for x in rows.columns if x in merged.columns)), field_changes(rows, [f for f in fields if f in rows.columns])


def tag_duplicates(rows: DataFrame) -> DataFrame:
    """dup_of: uid of the first-arrived row of the dedupe_key, where that is of another source."""
    first = rows.groupBy("dedupe_key").agg(F.min_by(F.struct(c("uid").alias("u"), c("source").alias("s")), "seq").alias("first"))
    tagged = rows.drop("dup_of").join(first, "dedupe_key", "left")
    return tagged.withColumn("dup_of", F.when(c("first.s") != c("source"), c("first.u"))).drop("first")


def alternates(rows: DataFrame) -> DataFrame:
    """Other sources of one dedupe_key, once each."""
    return tag_duplicates(rows).where("dup_of IS NOT NULL").select("dedupe_key", "source", "ref", "url").dropDuplicates(["dedupe_key", "source", "ref"])


def keyed_upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Latest row of each key by order."""
    rest = [x for x in stored.columns if x not in keys]
    rows = stored.unionByName(incoming)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def fill_upsert(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming values over stored ones, stored ones where incoming is null."""
    a, b = stored.alias("a"), incoming.alias("b")
    rest = [x for x in stored.columns if x != key]
    joined = a.join(b, c(f"a.{key}") == c(f"b.{key}"), "full_outer")
    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *(F.coalesce(f"b.{x}", f"a.{x}").alias(x) for x in rest))


def find_reissues(notices: DataFrame, min_gap: int = 120) -> DataFrame:
    """uid, repeat_of, gap_days: a notice of the same title words and buyer at least min_gap days after the one before."""
    d = F.coalesce("advertised", c("first_seen").cast("date"))
    rows = notices.select("uid", F.substring(title_key(c("title")), 1, 160).alias("t"), buyer_id(c("buyer")).alias("b"), d.alias("d")).where("t <> '' AND d IS NOT NULL")
    w = Window.partitionBy("t", "b").orderBy("d", "uid")
    rows = rows.select("uid", F.lag("uid").over(w).alias("repeat_of"), F.date_diff("d", F.lag("d").over(w)).alias("gap_days"))
    return rows.where(c("gap_days") >= min_gap)


def fresh(notices: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """is_new off for rows first seen more than hours ago."""
    recent = c("first_seen") >= F.lit(now).cast("timestamp") - F.make_interval(hours=F.lit(hours))
    return notices.withColumn("is_new", F.when(recent, c("is_new")).otherwise(0))


def collapse(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """First row of each fingerprint (70 title and 30 buyer letters and digits) in the order given."""
    mark = lambda x, n: F.substring(F.regexp_replace(F.lower(F.coalesce(c(x), F.lit(""))), "[^a-z0-9]+", ""), 1, n)
    w = Window.partitionBy(mark("title", 70), mark("buyer", 30)).orderBy(*order)
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def source_health(runs: DataFrame) -> DataFrame:
    """Latest status of each source with totals; avg_ms is the last run's time. runs: source, at, ok, rows, message, ms."""
    out = runs.groupBy("source").agg(
        F.max("at").alias("last_run"),
        F.max(F.when(c("ok"), c("at"))).alias("last_ok"),
        F.max_by("rows", "at").alias("rows_last_run"),
        F.max_by("ok", "at").alias("ok"),
        F.max_by("message", "at").alias("message"),
        F.sum("rows").alias("total_rows"),
        F.max_by("ms", "at").alias("avg_ms"),
    )
    return out.withColumn("status", F.when(~c("ok"), "error").when(c("rows_last_run") == 0, "empty").otherwise("ok")).drop("ok")


def sweep_status(checkpoints: DataFrame, notices: DataFrame) -> DataFrame:
    """Sweep progress: stored rows and the share of the id range done."""
    n = notices.groupBy("source").agg(F.count("*").alias("stored"))
    span = c("highest") - c("lowest")
    done = F.when(c("done") == 1, F.lit(100.0)).otherwise(F.bround(F.try_divide(100 * (c("highest") - c("cursor")), span), 1))
    return checkpoints.join(n, "source", "left").withColumn("pct", done).withColumn("stored", F.coalesce("stored", F.lit(0)))
