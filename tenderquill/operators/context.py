"""Composite reports: workbook sheets, saved details, reclassification, contexts for a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import Rules, buyer_sector, lane_of, tender_type
from ..functions.text import first_json
from . import awards as aw
from . import feed, linkage, market, ranking

c = F.col


def save_details(notices: DataFrame, details: DataFrame, keep: tuple[str, ...] = ("contact_name", "contact_email", "contact_phone")) -> DataFrame:
    """Detail columns written over notices; contacts only where they bring a value."""
    fresh = [x for x in details.columns if x != "uid"]
    d = details.select("uid", *(c(x).alias(f"__{x}") for x in fresh), F.lit(True).alias("__got"))
    out = notices.join(d, "uid", "left")
    for x in fresh:
        old = c(x) if x in notices.columns else F.lit(None)
        new = F.coalesce(c(f"__{x}"), old) if x in keep else F.when(c("__got"), c(f"__{x}")).otherwise(old)
        out = out.withColumn(x, new)
    return out.drop("__got", *(f"__{x}" for x in fresh))


def reclassify(notices: DataFrame, rules: Rules) -> DataFrame:
    """Lanes, sectors and types derived again under rules; classifier_version says which."""
    text = F.concat_ws(" ", *(F.coalesce(x, F.lit("")) for x in ("title", "description")))
    got = lane_of(text, c("buyer"), rules)
    out = notices.withColumn("__l", got)
    for f in ("lane", "product_line", "is_digital", "is_opportunity", "relevance", "fit_score"):
        out = out.withColumn(f, c("__l")[f])
    out = out.withColumns({"buyer_sector": buyer_sector(F.concat_ws(" ", "buyer", "buyer_norm")), "tender_type": tender_type(c("title"), c("description")), "classifier_version": F.lit(rules.version)})
    return out.drop("__l")


def workbook(items: DataFrame, results: DataFrame, notices: DataFrame) -> dict[str, DataFrame]:
    """The sheets of a reconciliation: summary, the list with its best match, notices nobody listed."""
    best = results.withColumn("best", F.get("matches", F.lit(0))).select("item", "part", "status", "score", c("best.uid").alias("uid"))
    listed = items.join(best, ["item", "part"], "left").join(notices.select("uid", c("title").alias("matched_title"), "url", c("closing").alias("matched_closing")), "uid", "left")
    matched = results.select(F.explode("matches").alias("m")).select("m.uid").distinct()
    return {"summary": linkage.summary(results), "list": listed, "missed": linkage.unmatched(notices, matched)}


def question_context(notices: DataFrame, question: str, asof: str, pipeline_rows: int = 60, hits: int = 40) -> DataFrame:
    """Rows that a model may read for a question: the open pipeline and the full-text hits, once each."""
    slim = ["uid", "title", "buyer", "lane", "product_line", "closing", "value_num", "fit_score"]
    pipeline = notices.where(market.live() & feed.is_open(asof)).orderBy(c("fit_score").desc(), "uid").limit(pipeline_rows).select(*slim)
    match = feed.matches(question, "title", "description", "buyer")
    if match is None:
        return pipeline
    found = notices.where(match).orderBy(c("fit_score").desc(), "uid").limit(hits).select(*slim)
    return pipeline.unionByName(found).dropDuplicates(["uid"])


def insight_context(notices: DataFrame, awards: DataFrame, asof: str) -> dict[str, DataFrame]:
    return {"kpi": market.kpi(notices, asof), "signals": market.signals(notices, awards, asof), "sectors": market.heat(notices), "suppliers": aw.supplier_shares(awards)}


def notice_context(notices: DataFrame, awards: DataFrame, uid: str, k: int = 5) -> dict[str, DataFrame]:
    one = notices.where(c("uid") == uid)
    row = one.select("title", "product_line", "ref").first()
    found = ranking.similar_awards(awards, row["title"], row["product_line"], row["ref"], k) if row else awards.limit(0)
    return {"notice": one, "similar": found}


def ask(context: DataFrame, question: str, model: Callable[[str, str], str], limit: int = 100) -> str:
    """model(question, rows as JSON lines); the model is the caller's."""
    rows = context.limit(limit).select(F.to_json(F.struct("*")).alias("j")).collect()
    return model(question, "\n".join(r["j"] for r in rows))


def model_replies(replies: DataFrame, column: str, schema: str) -> DataFrame:
    """replies with a struct parsed from the first {...} of the text."""
    return replies.withColumn("parsed", first_json(c(column), schema))
