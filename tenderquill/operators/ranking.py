"""Rankings: the priority queue and the most similar awards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import days_left_truncated
from ..functions.text import terms
from .awards import has_alias
from .feed import buyer_key, is_open

c = F.col


def priority_queue(notices: DataFrame, awards: DataFrame, asof: str, key_accounts: Sequence[str], limit: int | None = 12) -> DataFrame:
    """Open opportunities by half fit, 30 % urgency, 20 % account weight, with an action; asof is a day or a moment, from which days left are truncated."""
    rows = notices.where((c("is_opportunity") == 1) & c("dup_of").isNull() & is_open(asof)).withColumn("account", buyer_key()).withColumn("days_left", days_left_truncated(c("closing"), asof))
    prior = awards.groupBy(buyer_key().alias("account")).agg(F.count("*").alias("prior_awards"))
    typical = awards.where("bids_received IS NOT NULL").groupBy("product_line").agg(F.round(F.avg("bids_received"), 1).alias("typical_bids"))
    rows = rows.join(prior, "account", "left").join(typical, "product_line", "left")
    d = c("days_left")
    urgency = F.when(d <= 3, 1.0).when(d <= 7, 0.8).when(d <= 14, 0.55).when(d.isNotNull(), 0.3).otherwise(0.15)
    weight = F.when(has_alias(c("account"), key_accounts), 1.0).when(c("prior_awards") > 0, 0.6).otherwise(0.2)
    score = F.bround(100 * (0.5 * F.coalesce("fit_score", F.lit(0)) / 100 + 0.3 * urgency + 0.2 * weight), 0).cast("int")
    action = F.when((c("lane") == "Core") & (d <= 10) & (c("fit_score") >= 85), "Bid now").when(d <= 30, "Qualify").otherwise("Watch")
    out = rows.select("uid", "account", "lane", "product_line", "fit_score", "closing", "days_left", "prior_awards", "typical_bids", score.alias("score"), action.alias("action"))
    return out if limit is None else out.orderBy(c("score").desc(), "uid").limit(limit)


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + n / (1 + F.coalesce(df, F.lit(0))))


def document_frequency(docs: DataFrame, words: Column) -> DataFrame:
    """term, df, idf over the rows of docs."""
    n = docs.agg(F.count("*").alias("n"))
    df = docs.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(idf(c("n"), c("df")), 6).alias("idf"))


def similar_awards(awards: DataFrame, title: str, product_line: str | None, ref: str | None, k: int = 5) -> DataFrame:
    """Awards most like a notice: harmonic mean of the shared idf's shares in both titles, 0.1 more in one line; its own award first.

    Awards are scored without a join: the distinct titles give df, and the
    notice's few terms meet each title's list.
    """
    spark = awards.sparkSession
    rows = awards.withColumn("ts", F.array_distinct(terms(c("title"))))
    n = rows.agg(F.count("*").alias("n"))
    titles = rows.groupBy("ts").agg(F.count("*").alias("copies"))
    df = titles.select(F.explode("ts").alias("term"), "copies").groupBy("term").agg(F.sum("copies").alias("df"))
    weights = df.crossJoin(F.broadcast(n)).select("term", idf(c("n"), c("df")).alias("w"))
    q = spark.createDataFrame([(title,)], "title string").select(F.explode(F.array_distinct(terms(c("title")))).alias("term"))
    q = q.join(weights, "term", "left").crossJoin(F.broadcast(n)).select("term", F.coalesce("w", idf(c("n"), F.lit(0))).alias("w"))
    qm = q.agg(F.sum("w").alias("qm"))
    per = titles.select("ts", F.explode("ts").alias("term")).join(weights, "term").join(F.broadcast(q.select("term", F.lit(True).alias("hit"))), "term", "left")
    per = per.groupBy("ts").agg(F.sum("w").alias("all"), F.sum(F.when(c("hit"), c("w"))).alias("shared")).where("shared IS NOT NULL").crossJoin(F.broadcast(qm))
    a, b = c("shared") / c("qm"), c("shared") / c("all")
    per = per.select("ts", (2 * a * b / (a + b)).alias("cov"))
    own = c("tender_no") == ref if ref else F.lit(False)
    cov = F.when(own, 2.0).otherwise(c("cov") + F.when((c("product_line") != "") & (c("product_line") == product_line), 0.1).otherwise(0.0))
    out = rows.join(per, "ts").withColumn("raw", cov).orderBy(c("raw").desc(), "uid").limit(k).where("raw >= 0.25")
    return out.select("uid", "title", "winner", "value_num", "bids_received", F.round(F.least("raw", F.lit(1.0)), 2).alias("similarity"), (c("raw") >= 2).alias("own"))
