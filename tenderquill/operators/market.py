"""Market aggregates over notices: facets, buyers, overview, dashboard, signals, pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.dates import day, month_key, months_back, shift, week_key
from ..functions.money import value_band
from .feed import LANES, buyer_key, is_open

c = F.col


def opportunity() -> Column:
    return c("is_opportunity") == 1


def live() -> Column:
    return opportunity() & c("dup_of").isNull()


def n_if(cond: Column) -> Column:
    return F.count_if(cond).cast("long")


def counts(df: DataFrame, key: Column | str, **more: Column) -> DataFrame:
    """k, n and further aggregates."""
    key = c(key) if isinstance(key, str) else key
    return df.groupBy(key.alias("k")).agg(F.count("*").alias("n"), *(v.alias(k) for k, v in more.items()))


def facets(notices: DataFrame) -> dict[str, DataFrame]:
    filled = lambda x: c(x).isNotNull() & (c(x) != "")
    return {
        "sources": counts(notices, "source"),
        "domains": counts(notices.where(opportunity() & (c("product_line") != "")), "product_line"),
        "lanes": counts(notices.where(c("lane") != "None"), "lane"),
        "jurisdictions": counts(notices, "jurisdiction"),
        "sectors": counts(notices.where(filled("buyer_sector")), "buyer_sector"),
        "types": counts(notices.where(filled("tender_type")), "tender_type"),
        "relevance": counts(notices.where(opportunity()), "relevance"),
    }


def facet_table(notices: DataFrame) -> DataFrame:
    """All facets in one scan: each row is offered to every facet it belongs to."""
    offer = lambda name, cond: F.when(cond, F.struct(F.lit(name).alias("facet"), c(name).alias("k")))
    some = F.lit(True)
    filled = lambda x: c(x).isNotNull() & (c(x) != "")
    offers = F.array(
        offer("source", some), offer("product_line", opportunity() & (c("product_line") != "")), offer("lane", c("lane") != "None"), offer("jurisdiction", some),
        offer("buyer_sector", filled("buyer_sector")), offer("tender_type", filled("tender_type")), offer("relevance", opportunity()),
    )
    rows = notices.select(F.explode(F.filter(offers, lambda o: o.isNotNull())).alias("o"))
    return rows.groupBy("o.facet", "o.k").agg(F.count("*").alias("n"))


def facet_stats(notices: DataFrame, asof: str) -> DataFrame:
    opp = opportunity()
    return notices.agg(
        F.count("*").alias("total"),
        F.sum("is_opportunity").alias("digital"),
        *(n_if(c("lane") == x).alias(a) for x, a in zip(LANES, ("core_n", "partner_n", "signal_n"), strict=True)),
        n_if(opp & is_open(asof)).alias("open_digital"),
        n_if(opp & c("closing").between(day(asof), shift(asof, 7))).alias("closing_week"),
        n_if(opp & (c("is_new") == 1)).alias("new_digital"),
        n_if(opp & (c("relevance") == "High")).alias("high_rel"),
    )


def buyers(notices: DataFrame, asof: str, limit: int = 60) -> DataFrame:
    out = (
        notices.where(c("buyer") != "")
        .groupBy(buyer_key().alias("buyer_k"))
        .agg(
            F.max("buyer_sector").alias("sector"),
            F.max("jurisdiction").alias("jurisdiction"),
            F.max("source").alias("source"),
            F.count("*").alias("tenders"),
            F.sum("is_opportunity").alias("digital"),
            F.sum("is_digital").alias("any_digital"),
            n_if(c("closing") >= day(asof)).alias("open_now"),
            F.max("contact_email").alias("contact_email"),
            F.round(F.avg(F.date_diff("closing", "advertised")), 0).alias("avg_window"),
        )
        .where("digital > 0")
        .withColumnRenamed("buyer_k", "buyer")
    )
    return out.orderBy(c("digital").desc(), c("tenders").desc(), "buyer").limit(limit)


def overview(notices: DataFrame, asof: str) -> dict[str, DataFrame]:
    dig, open_n = F.sum("is_opportunity"), n_if(c("closing") >= day(asof))
    monthly = counts(notices.where("advertised IS NOT NULL"), month_key(c("advertised")), dig=dig)
    by_buyer = counts(notices.where(c("buyer") != ""), buyer_key(), dig=dig).where("dig > 0")
    return {
        "by_domain": counts(notices.where(opportunity() & (c("product_line") != "")), "product_line", open_n=open_n),
        "by_lane": counts(notices.where(c("lane") != "None"), "lane"),
        "by_source": counts(notices, "source", dig=dig),
        "by_sector": counts(notices.where("buyer_sector IS NOT NULL"), "buyer_sector", dig=dig),
        "by_type": counts(notices.where(opportunity() & c("tender_type").isNotNull()), "tender_type", dig=dig),
        "by_buyer": by_buyer.orderBy(c("dig").desc(), "k").limit(12),
        "calendar": counts(notices.where(opportunity() & c("closing").between(day(asof), shift(asof, 30))), "closing"),
        "monthly": monthly.orderBy(c("k").desc()).limit(12),
        "value_bands": counts(notices.where(opportunity()), value_band(c("value_num"))),
    }


def scoped(notices: DataFrame, lane: str | None = None, sector: str | None = None, product: str | None = None, buyer: str | None = None) -> DataFrame:
    """Notices under the dashboard's filters."""
    for value, col in ((lane, c("lane")), (sector, c("buyer_sector")), (product, c("product_line")), (buyer, buyer_key())):
        if value:
            notices = notices.where(col == value)
    return notices


def kpi(notices: DataFrame, asof: str) -> DataFrame:
    clear = c("dup_of").isNull() & is_open(asof)
    seen = c("first_seen")
    a, b = shift(asof, -7).cast("timestamp"), shift(asof, -14).cast("timestamp")
    return notices.agg(
        n_if(opportunity() & clear).alias("open_opps"),
        n_if((c("lane") == "Core") & clear).alias("open_core"),
        F.sum(F.when(opportunity() & clear, F.coalesce("value_num", "est_value_low", F.lit(0.0))).otherwise(0.0)).alias("open_value"),
        n_if(live() & (seen >= a)).alias("new_7d"),
        n_if(live() & (seen < a) & (seen >= b)).alias("new_prev_7d"),
        n_if(opportunity() & clear & (c("value_num").isNotNull() | c("est_value_low").isNotNull())).alias("valued"),
        F.count("*").alias("tracked"),
        F.count_distinct(buyer_key()).alias("buyers"),
    )


def _windows(notices: DataFrame) -> DataFrame:
    w = notices.where(opportunity() & (c("closing") > c("advertised"))).select(F.date_diff("closing", "advertised").alias("w"))
    return w.where("w > 0 AND w < 150")


def median_window(notices: DataFrame) -> DataFrame:
    """Upper median of bid windows: at most 149 distinct values, so their counts decide."""
    n = _windows(notices).groupBy("w").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    upto = F.sum("n").over(Window.orderBy("w"))
    return n.select("w", upto.alias("upto")).crossJoin(F.broadcast(total)).where(c("upto") > F.floor(c("total") / 2)).agg(F.min("w").alias("median_window"))


WINDOW_BINS = [(0, 7, "under 7d"), (7, 14, "7-13d"), (14, 21, "14-20d"), (21, 30, "21-29d"), (30, 999, "30d+")]


def window_histogram(notices: DataFrame) -> DataFrame:
    w = c("w")
    one = _windows(notices).agg(*(n_if((w >= lo) & (w < hi)).alias(k) for lo, hi, k in WINDOW_BINS))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), c(f"`{k}`").alias("n")) for *_, k in WINDOW_BINS))).alias("r")).select("r.*")


def sparkline(notices: DataFrame, asof: str) -> DataFrame:
    rows = notices.where(live() & (c("first_seen") >= shift(asof, -84).cast("timestamp")))
    return rows.groupBy(week_key(c("first_seen")).alias("wk")).agg(F.count("*").alias("n"))


def monthly_lanes(notices: DataFrame, asof: str, months: int = 18) -> DataFrame:
    seen = F.coalesce("advertised", c("first_seen").cast("date"))
    rows = notices.where(c("lane").isin(*LANES) & c("dup_of").isNull() & (seen >= months_back(asof, months)))
    return rows.groupBy(month_key(seen).alias("m"), "lane").agg(F.count("*").alias("n"))


def coming_weeks(notices: DataFrame, asof: str) -> DataFrame:
    rows = notices.where(live() & c("closing").between(day(asof), shift(asof, 56)))
    return rows.groupBy(week_key(c("closing")).alias("wk"), "lane").agg(F.min("closing").alias("wk_start"), F.count("*").alias("n"))


def heat(notices: DataFrame) -> DataFrame:
    rows = notices.where(live() & (c("product_line") != ""))
    return rows.groupBy(F.coalesce("buyer_sector", F.lit("Other")).alias("s"), c("product_line").alias("p")).agg(F.count("*").alias("n"))


def types(notices: DataFrame, asof: str) -> DataFrame:
    return counts(notices.where(live() & c("tender_type").isNotNull()), "tender_type", open_n=n_if(is_open(asof)))


def jurisdictions(notices: DataFrame) -> DataFrame:
    return counts(notices.where(live()), F.coalesce("jurisdiction", F.lit("Unknown")))


def top_buyers(notices: DataFrame, asof: str, limit: int = 12) -> DataFrame:
    out = counts(notices.where(live()), buyer_key(), sector=F.max("buyer_sector"), open_n=n_if(is_open(asof)), core_n=n_if(c("lane") == "Core"))
    return out.orderBy(c("n").desc(), "k").limit(limit)


def source_debug(notices: DataFrame, asof: str) -> DataFrame:
    return notices.groupBy("source").agg(
        F.count("*").alias("total_rows"), F.sum("is_opportunity").alias("opps"), n_if(c("closing").isNull()).alias("no_closing"), n_if(c("closing") < day(asof)).alias("past_closing")
    )


def coverage(notices: DataFrame) -> DataFrame:
    return notices.agg(F.min("first_seen").alias("first_seen"), F.min("advertised").alias("first_advertised"))


def signals(notices: DataFrame, awards: DataFrame, asof: str, limit: int = 6) -> DataFrame:
    """place, tone, title, n, m: what moved, what is unusual, what is about to bite."""
    ts = lambda d: shift(asof, d).cast("timestamp")
    seen = c("first_seen")
    by = notices.where(live()).groupBy(F.coalesce("buyer_sector", F.lit("Other")).alias("s")).agg(n_if(seen >= ts(-30)).alias("n"), n_if((seen < ts(-30)) & (seen >= ts(-60))).alias("m"))
    up = (c("n") >= 3) & (c("n") >= 1.5 * F.greatest(F.lit(1), "m"))
    down = (c("m") >= 4) & (c("n") <= 0.5 * c("m"))
    moves = by.where(up | down).select(
        F.lit(0).alias("rank"), F.when(up, "up").otherwise("down").alias("tone"), F.concat("s", F.when(up, F.lit(" demand is accelerating")).otherwise(F.lit(" demand has cooled"))).alias("title"), "n", "m"
    )
    one = notices.agg(
        n_if(live() & c("closing").between(day(asof), shift(asof, 7))).alias("deadlines"),
        n_if(opportunity() & (F.date_diff("closing", "advertised") < 10) & (seen >= ts(-90))).alias("short"),
        n_if(c("repeat_of").isNotNull() & is_open(asof)).alias("repeats"),
    )
    single = awards.where((c("bids_received") == 1) & c("lane").isin("Core", "Partner-led")).agg(F.count("*").alias("n"))
    fixed = lambda df, rank, tone, title, n, cond: df.where(cond).select(F.lit(rank).alias("rank"), F.lit(tone).alias("tone"), F.lit(title).alias("title"), c(n).alias("n"), F.lit(0).cast("long").alias("m"))
    rows = moves
    for part in (
        fixed(one, 1, "warn", "biddable deadlines this week", "deadlines", c("deadlines") > 0),
        fixed(one, 2, "warn", "recent tenders gave under 10 days to bid", "short", c("short") >= 3),
        fixed(one, 3, "info", "open tenders are re-issues", "repeats", c("repeats") > 0),
        fixed(single, 4, "info", "biddable-lane awards went to a single bidder", "n", c("n") > 0),
    ):
        rows = rows.unionByName(part)
    return rows.orderBy("rank", "title").limit(limit).drop("rank")


def grouped_with_other(df: DataFrame, key: Column, top: int = 12) -> DataFrame:
    """Counts of key, all but the top ones rolled up as Other."""
    n = counts(df, F.coalesce(key, F.lit("Unspecified")))
    best = n.orderBy(c("n").desc(), "k").limit(top).select(c("k").alias("own"))
    named = n.join(F.broadcast(best), c("k") == c("own"), "left")  # top rows at most
    return named.groupBy(F.coalesce("own", F.lit("Other")).alias("k")).agg(F.sum("n").alias("n"))


def series(df: DataFrame, month: Column, key: Column, top: int = 6) -> DataFrame:
    """Month by top keys, absent pairs as 0."""
    rows = df.select(month.alias("m"), key.alias("k")).where("m IS NOT NULL AND k IS NOT NULL")
    best = counts(rows, "k").orderBy(c("n").desc(), "k").limit(top).select("k")
    grid = rows.select("m").distinct().crossJoin(F.broadcast(best))  # months by at most top keys
    n = rows.join(best, "k", "left_semi").groupBy("m", "k").agg(F.count("*").alias("n"))
    return grid.join(n, ["m", "k"], "left").select("m", "k", F.coalesce("n", F.lit(0)).alias("n"))


def pivot(df: DataFrame, x: Column, split: Column | None = None, value: Column | None = None, top_x: int = 14, splits: int = 10) -> DataFrame:
    """x, s, v: counts or sums by x and split, for the largest of both."""
    rows = df.select(x.alias("x"), (F.lit("all") if split is None else split).alias("s"), (F.lit(None).cast("double") if value is None else value).alias("val")).where("x IS NOT NULL AND s IS NOT NULL")
    measure = F.count("*").cast("double") if value is None else F.sum(F.coalesce("val", F.lit(0.0)))
    cells = rows.groupBy("x", "s").agg(measure.alias("v"))
    best = lambda k, n: cells.groupBy(k).agg(F.sum("v").alias("t")).orderBy(c("t").desc(), k).limit(n).select(k)
    return cells.join(best("x", top_x), "x", "left_semi").join(best("s", splits), "s", "left_semi").select("x", "s", "v")


def extent(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("first"), F.max(column).alias("last"), F.count("*").alias("n"))


def table_filter(df: DataFrame, lane: str | None = None, category: str | None = None, min_value: float | None = None, month: str | None = None, text: str | None = None, dates: Sequence[str] = ("advertised",)) -> DataFrame:
    """The question box's filter: lane, category, value, month and words of buyer or title."""
    if lane:
        df = df.where(c("lane") == lane)
    if category:
        df = df.where(F.lower("product_line") == category.lower())
    if min_value is not None:
        df = df.where(c("value_num") >= min_value)
    if month:
        df = df.where(month_key(F.coalesce(*dates)) == month)
    if text:
        df = df.where(F.lower(F.concat_ws(" ", "buyer", "title")).contains(text.lower()))
    return df
