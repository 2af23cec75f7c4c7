"""Award intelligence: accounts, rivals, renewals, cadence, prices, forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import add_months_clamped, day, month_key, months_back, shift
from .feed import buyer_key, is_open
from .market import n_if

c = F.col
BIDDABLE = ("Core", "Partner-led")


def has_alias(column: Column, aliases: Sequence[str]) -> Column:
    low, found = F.lower(column), F.lit(False)
    for a in aliases:
        found = found | low.contains(a)
    return found


def identity(winner: Column, ours: tuple[str, Sequence[str]], rivals: dict[str, Sequence[str]]) -> Column:
    """Name of the first identity whose alias the winner contains, ours first; else null."""
    who = F.when(has_alias(winner, ours[1]), ours[0])
    for name, aliases in rivals.items():
        who = who.when(has_alias(winner, aliases), name)
    return who


def _value() -> Column:
    return F.coalesce("value_num", F.lit(0.0))


def _ours(ours: Column, what: Column) -> Column:
    return F.sum(F.when(ours, what).otherwise(F.lit(0.0)))


def share(part: Column, whole: Column) -> Column:
    """Percentage, one decimal, half to even."""
    return F.coalesce(F.bround(F.try_divide(100 * part, whole), 1), F.lit(0.0))


def account_map(awards: DataFrame, ours: Column, asof: str, lanes: Sequence[str] = BIDDABLE, limit: int = 25) -> DataFrame:
    rows = awards.where((c("buyer") != "") & c("lane").isin(*lanes))
    out = rows.groupBy(buyer_key().alias("account")).agg(
        F.max("buyer_sector").alias("sector"),
        F.count("*").alias("awards"),
        F.round(F.sum(_value()), 2).alias("total_value"),
        F.round(_ours(ours, _value()), 2).alias("our_value"),
        n_if(ours).alias("our_wins"),
        F.count_distinct("winner").alias("suppliers"),
        F.round(F.avg("bids_received"), 1).alias("avg_bids"),
        F.min("award_date").alias("first_award"),
        F.max("award_date").alias("last_award"),
        F.min(F.when(c("renewal_due") >= day(asof), c("renewal_due"))).alias("next_renewal"),
    )
    out = out.orderBy(c("total_value").desc(), "account").limit(limit)
    out = out.withColumn("our_share", share(c("our_value"), c("total_value"))).withColumn("gap_value", F.bround(c("total_value") - c("our_value"), 0))
    return out.withColumn("status", F.when(c("our_share") >= 60, "Held").when(c("our_share") > 0, "Contested").otherwise("Not won"))


def winners(awards: DataFrame, lanes: Sequence[str] = BIDDABLE) -> DataFrame:
    rows = awards.where((c("winner") != "") & c("lane").isin(*lanes))
    return rows.groupBy("winner").agg(
        F.count("*").alias("wins"),
        F.round(F.sum(_value()), 2).alias("value"),
        F.count_distinct("buyer").alias("buyers"),
        F.round(F.avg("bids_received"), 1).alias("avg_bids"),
        n_if(c("bids_received") == 1).alias("uncontested"),
        F.max("award_date").alias("last_win"),
    )


def rivals(awards: DataFrame, who: Column, us: str, lanes: Sequence[str] = BIDDABLE, limit: int | None = 20) -> DataFrame:
    """Winners consolidated on identity: the top ones by name first, or with limit None all."""
    top = winners(awards, lanes)
    if limit is not None:
        top = top.orderBy(c("value").desc(), c("wins").desc(), "winner").limit(limit)
    bids = c("avg_bids").isNotNull() & (c("avg_bids") != 0)
    out = top.groupBy(F.coalesce(who, F.substring("winner", 1, 40)).alias("who")).agg(
        F.sum("wins").alias("wins"),
        F.round(F.sum("value"), 2).alias("value"),
        F.max("buyers").alias("buyers"),
        F.sum("uncontested").alias("uncontested"),
        F.max("last_win").alias("last_win"),
        F.bround(F.try_divide(F.sum(F.when(bids, c("avg_bids") * c("wins"))), F.sum(F.when(bids, c("wins")))), 1).alias("avg_bids"),
        F.count("*").alias("aliases"),
    )
    return out.withColumn("is_us", c("who") == us)


def _due(asof: str, horizon: int | None, lanes: Sequence[str] | None = BIDDABLE) -> Column:
    keep = c("renewal_due") >= day(asof)
    if horizon is not None:
        keep = keep & (c("renewal_due") <= shift(asof, horizon))
    return keep if lanes is None else keep & c("lane").isin(*lanes)


def renewal_calendar(awards: DataFrame, ours: Column, asof: str, horizon: int = 540, lanes: Sequence[str] = BIDDABLE) -> DataFrame:
    return (
        awards.where(_due(asof, horizon, lanes))
        .groupBy(month_key(c("renewal_due")).alias("month"))
        .agg(F.count("*").alias("n"), F.round(F.sum(_value()), 2).alias("value"), n_if(ours).alias("ours_n"), F.round(_ours(ours, _value()), 2).alias("ours_value"))
    )


_COLUMNS = ["uid", "winner", "value_num", "award_date", "tenure_months", "renewal_due", "lane", "product_line", "bids_received"]


def defend(awards: DataFrame, ours: Column, asof: str) -> DataFrame:
    rows = awards.where(_due(asof, None, None) & ours)
    return rows.select(*_COLUMNS, buyer_key().alias("account"), F.date_diff("renewal_due", day(asof)).alias("days_out"))


def attack(awards: DataFrame, ours: Column, who: Column, asof: str, horizon: int = 540, lanes: Sequence[str] = BIDDABLE, limit: int = 40) -> DataFrame:
    """Others' contracts up for renewal, largest first; awards without winner drop out."""
    rows = awards.where(_due(asof, horizon, lanes) & ~ours)
    rows = rows.orderBy(_value().desc(), "renewal_due", *(x for x in _COLUMNS if x != "renewal_due")).limit(limit)
    return rows.select(*_COLUMNS, buyer_key().alias("account"), F.date_diff("renewal_due", day(asof)).alias("days_out"), F.coalesce(who, F.lit("Other")).alias("incumbent"))


def cadence(awards: DataFrame, asof: str, lanes: Sequence[str] = BIDDABLE, limit: int | None = 20) -> DataFrame:
    """Buyers whose own rhythm says that a tender is due."""
    g = (
        awards.where(c("award_date").isNotNull() & (c("buyer") != "") & c("lane").isin(*lanes))
        .groupBy(buyer_key().alias("account"), "product_line")
        .agg(F.count("*").alias("n"), F.min("award_date").alias("first_award"), F.max("award_date").alias("last_award"))
        .where("n >= 2")
        .withColumn("avg_gap_days", F.expr("cast(date_diff(last_award, first_award) / (n - 1) AS int)"))
        .withColumn("since_last", F.date_diff(day(asof), "last_award"))
    )
    out = g.where((c("avg_gap_days") >= 120) & (c("since_last") > c("avg_gap_days") * 1.05))
    out = out.withColumn("overdue_by", c("since_last") - c("avg_gap_days")).withColumn("confidence", F.when(c("n") >= 4, "high").when(c("n") == 3, "medium").otherwise("low"))
    return out if limit is None else out.orderBy(c("overdue_by").desc(), "account", "product_line").limit(limit)


def price_bands(awards: DataFrame, lanes: Sequence[str] = BIDDABLE) -> DataFrame:
    rows = awards.where((c("value_num") > 10000) & (c("product_line") != "") & c("lane").isin(*lanes))
    return rows.groupBy("product_line").agg(
        F.count("*").alias("n"),
        F.round(F.min("value_num"), 0).alias("low"),
        F.round(F.avg("value_num"), 0).alias("avg"),
        F.round(F.max("value_num"), 0).alias("high"),
        F.round(F.avg("bids_received"), 1).alias("avg_bids"),
        n_if(c("bids_received") == 1).alias("uncontested"),
    )


def pipeline(notices: DataFrame, asof: str) -> DataFrame:
    rows = notices.where((c("is_opportunity") == 1) & c("dup_of").isNull() & is_open(asof))
    return rows.groupBy("product_line").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("value_num", "est_value_low", F.lit(0.0))), 2).alias("v"))


def sector_values(awards: DataFrame, ours: Column, lanes: Sequence[str] = BIDDABLE) -> DataFrame:
    rows = awards.where(c("lane").isin(*lanes)).groupBy(F.coalesce("buyer_sector", F.lit("Other")).alias("sector"))
    return rows.agg(F.count("*").alias("n"), F.round(F.sum(_value()), 2).alias("value"), F.round(_ours(ours, _value()), 2).alias("ours"))


def award_stats(awards: DataFrame, ours: Column) -> DataFrame:
    out = awards.agg(
        F.count("*").alias("awards"),
        F.round(F.sum(_value()), 2).alias("total_value"),
        F.round(_ours(ours, _value()), 2).alias("our_value"),
        n_if(ours).alias("our_wins"),
        F.count_distinct("winner").alias("suppliers"),
        F.count_distinct("buyer").alias("buyers"),
        F.min("award_date").alias("history_from"),
    )
    return out.withColumn("our_share", share(c("our_value"), c("total_value")))


def award_months(awards: DataFrame, asof: str, months: int = 18) -> DataFrame:
    d = F.coalesce("signing_date", "award_date")
    return awards.where(d >= months_back(asof, months)).groupBy(month_key(d).alias("m")).agg(F.count("*").alias("n"), F.round(F.sum(_value()), 2).alias("v"))


def bid_distribution(awards: DataFrame) -> DataFrame:
    b = c("bids_received")
    return awards.where(b > 0).groupBy(F.when(b >= 6, "6+").otherwise(b.cast("string")).alias("k")).agg(F.count("*").alias("n"))


def supplier_shares(awards: DataFrame, lanes: Sequence[str] = BIDDABLE, limit: int = 8) -> DataFrame:
    rows = awards.where((c("winner") != "") & c("lane").isin(*lanes)).groupBy("winner").agg(F.round(F.sum(_value()), 2).alias("v"), F.count("*").alias("n"))
    return rows.orderBy(c("v").desc(), "winner").limit(limit)


def concentration(awards: DataFrame, lanes: Sequence[str] = BIDDABLE) -> DataFrame:
    """Herfindahl-Hirschman index of supplier value shares: from one sum and one sum of squares."""
    v = awards.where((c("winner") != "") & c("lane").isin(*lanes)).groupBy("winner").agg(F.sum(_value()).alias("v"))
    one = v.agg(F.sum("v").alias("total"), F.sum(c("v") * c("v")).alias("squares"))
    return one.select(F.round("total", 2).alias("supplier_total"), F.bround(F.try_divide(c("squares") * 10000, c("total") * c("total")), 0).alias("hhi"))


def award_totals(awards: DataFrame) -> DataFrame:
    return awards.agg(F.count("*").alias("n"), F.round(F.sum(_value()), 2).alias("v"), F.round(F.avg("bids_received"), 1).alias("avg_bids"), n_if(c("bids_received") == 1).alias("single"))


def buyer_rhythm(awards: DataFrame, asof: str, lanes: Sequence[str] = (*BIDDABLE, "Signal"), min_awards: int = 2) -> DataFrame:
    """Forecast cadence by raw buyer: non-zero values, mean interval, days since, overdue beyond 1.25 intervals, most common line."""
    rows = awards.where(c("lane").isin(*lanes) & (c("buyer") != "") & c("award_date").isNotNull())
    worth = F.when(c("value_num") != 0, c("value_num"))
    per = rows.groupBy("buyer").agg(
        F.count("*").alias("n"),
        F.round(F.sum(worth), 2).alias("total"),
        F.round(F.percentile(worth, F.lit(0.5)), 4).alias("median_value"),
        F.min("award_date").alias("first"),
        F.max("award_date").alias("last"),
    ).where(c("n") >= min_awards)
    line = rows.where(c("product_line") != "").groupBy("buyer", "product_line").agg(F.count("*").alias("k"), F.min("award_date").alias("d"))
    top = line.groupBy("buyer").agg(F.min(F.struct((-c("k")).alias("k"), "d", "product_line")).alias("t")).select("buyer", c("t.product_line").alias("top_line"))
    per = per.join(top, "buyer", "left").withColumn("interval_days", F.bround(F.date_diff("last", "first") / (c("n") - 1), 0).cast("int")).withColumn("since_last", F.date_diff(day(asof), "last"))
    return per.withColumn("overdue", (c("interval_days") > 0) & (c("since_last") > c("interval_days") * 1.25))


def velocity(awards: DataFrame, lanes: Sequence[str] = (*BIDDABLE, "Signal")) -> dict[str, DataFrame]:
    rows = awards.where(c("lane").isin(*lanes))
    n, v = F.count("*").alias("n"), F.round(F.sum(_value()), 2).alias("value")
    return {
        "by_month": rows.where("award_date IS NOT NULL").groupBy(month_key(c("award_date")).alias("k")).agg(n, v),
        "by_line": rows.groupBy(F.coalesce(F.nullif(c("product_line"), F.lit("")), F.lit("Unspecified")).alias("k")).agg(n, v),
    }


def upcoming_renewals(awards: DataFrame, asof: str, within: int = 180, lead_months: int = 3, lanes: Sequence[str] = (*BIDDABLE, "Signal")) -> DataFrame:
    """Contracts whose expiry, or the retender window before it, falls within the horizon."""
    expiry = add_months_clamped(c("award_date"), c("tenure_months"))
    rows = awards.where(c("lane").isin(*lanes)).withColumn("expiry", expiry).withColumn("window_opens", add_months_clamped(c("expiry"), F.lit(-lead_months)))
    near = lambda d: c(d).between(day(asof), shift(asof, within))
    return rows.where(near("expiry") | near("window_opens")).select("uid", "buyer", "winner", "award_date", "tenure_months", "expiry", "window_opens", F.date_diff("expiry", day(asof)).alias("days_to_expiry"))


def infer_terms(awards: DataFrame, tenure: Column, service: Column, lanes: Sequence[str] = BIDDABLE) -> DataFrame:
    """tenure_months, tenure_basis and renewal_due of incoming awards: stated, else 12 assumed for services in biddable lanes."""
    stated = F.coalesce("tenure_months", tenure)
    months = F.coalesce(stated, F.when(c("lane").isin(*lanes) & service, 12))
    basis = F.when(stated.isNotNull(), "stated").when(months.isNotNull(), "assumed")
    return awards.withColumns({"tenure_months": months, "tenure_basis": basis, "renewal_due": add_months_clamped(F.coalesce("signing_date", "award_date"), months)})
