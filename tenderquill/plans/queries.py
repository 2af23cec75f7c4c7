"""Registered queries of the procurement operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as dt
from ..operators import awards as aw
from ..operators import feed as fd
from ..operators import market as mk
from ..operators import ranking as rk
from .fixtures import ASOF, Data, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col
N, A, C = "notices", "awards", "changes"


def query(name: str, run: Callable[[Data], DataFrame], select: str | None = None, *ctes: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(Data(spark, sf_dir))
    if select is not None:
        ORACLE_SQL[name] = oracle(select, *ctes)


OPEN = "(coalesce(closing >= :asof, FALSE) OR (closing IS NULL AND coalesce(advertised, CAST(first_seen AS DATE)) >= :asof - INTERVAL '45' DAY))"
KEY = "coalesce(nullif(buyer_norm, ''), buyer)"
LIVE = "is_opportunity = 1 AND dup_of IS NULL"
V = "coalesce(value_num, 0)"
BIG = "CAST({} AS BIGINT)"
SOFT = "lane IN ('Core', 'Partner-led')"
OURS = "lower(winner) LIKE '%7'"


def n_if(cond: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT)"


# feed predicates: the ids and days left of what each lets through
def feed(name: str, where: str, **params: object) -> None:
    f = fd.Feed(asof=ASOF, **params)
    query(name, lambda d: fd.matching(d.notices, f).select("uid", "lane", "closing"), f"SELECT uid, lane, closing FROM notices WHERE {where}", N)


feed("f01_in_lists", "source IN ('src1', 'src3') AND buyer_sector IN ('BUILDING', 'HOUSEHOLD') AND jurisdiction IN ('ASIA', 'EUROPE')", sources=("src1", "src3"), sectors=("BUILDING", "HOUSEHOLD"), jurisdictions=("ASIA", "EUROPE"))
feed("f01_types_relevance", "tender_type IN ('Brand#2', 'Brand#4') AND relevance = 'High'", types=("Brand#2", "Brand#4"), relevance=("High",))
feed("f02_scope_opportunity", LIVE, scope="opportunity")
feed("f02_scope_relevant", "lane IN ('Core', 'Partner-led', 'Signal') AND dup_of IS NULL", scope="relevant")
feed("f02_lanes_override", "lane = 'Signal' AND dup_of IS NULL", lanes=("Signal",), scope="opportunity")
feed("f03_new_only", "is_new = 1", new_only=True)
feed("f04_open", OPEN, status="open")
feed("f04_closed", "closing < :asof", status="closed")
feed("f05_date_on", "advertised = DATE '1998-06-01' OR closing = DATE '1998-06-01'", date_on="1998-06-01")
feed("f06_date_range", "advertised >= DATE '1998-01-01' AND advertised <= DATE '1998-03-31'", date_from="1998-01-01", date_to="1998-03-31")
feed("f07_closing_within", "closing BETWEEN :asof AND :asof + INTERVAL '30' DAY", closing_within=30)
feed("f08_value_range", "value_num >= 100000 AND value_num <= 200000", value_min=100000, value_max=200000)
feed("f09_fulltext", "regexp_matches(lower(coalesce(title, '') || ' ' || coalesce(description, '') || ' ' || buyer || ' ' || ref), '(^|[^\\p{L}\\p{N}])ring([^\\p{L}\\p{N}]|$)') AND regexp_matches(lower(coalesce(title, '') || ' ' || coalesce(description, '') || ' ' || buyer || ' ' || ref), '(^|[^\\p{L}\\p{N}])sm')", q="ring sm*")
query("f09_documents", lambda d: d.table("documents").where(fd.matches("the an*", "text")).select("doc_id"), "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])the([^\\p{L}\\p{N}]|$)') AND regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])an')")
query("f10_prefetch", lambda d: fd.prefetch(d.notices, ASOF), f"SELECT uid, url, fit_score FROM notices WHERE {LIVE} AND detail_fetched IS NULL AND url LIKE 'http%' AND {OPEN} ORDER BY fit_score DESC, uid LIMIT 30", N)
query("f12_filter_injection", lambda d: mk.types(mk.scoped(d.notices, lane="Core", sector="BUILDING"), ASOF), f"SELECT tender_type AS k, count(*) AS n, {n_if(OPEN)} AS open_n FROM notices WHERE lane = 'Core' AND buyer_sector = 'BUILDING' AND {LIVE} AND tender_type IS NOT NULL GROUP BY 1", N)
query("f13_table_filter", lambda d: mk.table_filter(d.notices, lane="Core", category="economy", min_value=50000, text="ring").select("uid"), "SELECT uid FROM notices WHERE lane = 'Core' AND lower(product_line) = 'economy' AND value_num >= 50000 AND lower(coalesce(buyer, '') || ' ' || coalesce(title, '')) LIKE '%ring%'", N)
query("f14_sane_dates", lambda d: d.notices.select("uid", dt.sane_advertised(c("advertised"), c("closing"), ASOF).alias("advertised")), "SELECT uid, CASE WHEN advertised > :asof OR advertised > closing THEN NULL ELSE advertised END AS advertised FROM notices", N)
query("f15_relevant_awards", lambda d: d.awards.where(c("lane").isin(*fd.LANES)).groupBy("lane").agg(F.count("*").alias("n")), "SELECT lane, count(*) AS n FROM awards WHERE lane <> 'None' GROUP BY 1", A)
query("f16_sane_years", lambda d: d.awards.groupBy(dt.sane_year(c("award_date"), 1993, 1997).alias("d")).agg(F.count("*").alias("n")), "SELECT CASE WHEN year(award_date) BETWEEN 1993 AND 1997 THEN award_date END AS d, count(*) AS n FROM awards GROUP BY 1", A)


def page(name: str, sort: str, order: str) -> None:
    f = fd.Feed(asof=ASOF, scope="opportunity", sort=sort, limit=50, offset=25)
    query(name, lambda d: fd.search(d.notices, f).select("uid", "fit_score", "closing", "days_left"), f"SELECT uid, fit_score, closing, CAST(date_diff('day', :asof, closing) AS INTEGER) AS days_left FROM notices WHERE {LIVE} ORDER BY {order}, uid LIMIT 50 OFFSET 25", N)


page("o1_closing", "closing", "closing ASC NULLS LAST")
page("o2_newest", "newest", "advertised DESC NULLS LAST, first_seen DESC NULLS LAST")
page("o3_value", "value", "value_num DESC NULLS LAST")
page("o4_relevance", "relevance", "fit_score DESC NULLS LAST, closing ASC NULLS FIRST")
query("o5_page_total", lambda d: fd.matching(d.notices, fd.Feed(asof=ASOF, scope="opportunity")).agg(F.count("*").alias("total")), f"SELECT count(*) AS total FROM notices WHERE {LIVE}", N)

# facets and overview
FACETS = [("source", "TRUE"), ("product_line", "is_opportunity = 1 AND product_line <> ''"), ("lane", "lane <> 'None'"), ("jurisdiction", "TRUE"), ("buyer_sector", "buyer_sector <> ''"), ("tender_type", "tender_type <> ''"), ("relevance", "is_opportunity = 1")]
query("a01_facets", lambda d: mk.facet_table(d.notices), " UNION ALL ".join(f"SELECT '{k}' AS facet, {k} AS k, count(*) AS n FROM notices WHERE {w} GROUP BY {k}" for k, w in FACETS), N)
query(
    "a02_facet_stats",
    lambda d: mk.facet_stats(d.notices, ASOF),
    f"SELECT count(*) AS total, CAST(sum(is_opportunity) AS BIGINT) AS digital, {n_if("lane = 'Core'")} AS core_n, {n_if("lane = 'Partner-led'")} AS partner_n, {n_if("lane = 'Signal'")} AS signal_n, {n_if(f'is_opportunity = 1 AND {OPEN}')} AS open_digital, "
    f"{n_if("is_opportunity = 1 AND closing BETWEEN :asof AND :asof + INTERVAL '7' DAY")} AS closing_week, {n_if('is_opportunity = 1 AND is_new = 1')} AS new_digital, {n_if("is_opportunity = 1 AND relevance = 'High'")} AS high_rel FROM notices",
    N,
)
query(
    "a03_buyers",
    lambda d: mk.buyers(d.notices, ASOF),
    f"SELECT {KEY} AS buyer, max(buyer_sector) AS sector, max(jurisdiction) AS jurisdiction, max(source) AS source, count(*) AS tenders, CAST(sum(is_opportunity) AS BIGINT) AS digital, CAST(sum(is_digital) AS BIGINT) AS any_digital, {n_if('closing >= :asof')} AS open_now, max(contact_email) AS contact_email, "
    f"round(avg(date_diff('day', advertised, closing)), 0) AS avg_window FROM notices n WHERE buyer <> '' GROUP BY {KEY.replace('buyer_norm', 'n.buyer_norm').replace(', buyer)', ', n.buyer)')} HAVING sum(is_opportunity) > 0 ORDER BY digital DESC, tenders DESC, buyer LIMIT 60",
    N,
)
DIG = "CAST(sum(is_opportunity) AS BIGINT) AS dig"
BAND = "CASE WHEN value_num IS NULL THEN 'Not disclosed' WHEN value_num < 1e6 THEN 'Under 1M' WHEN value_num < 1e7 THEN '1M - 10M' WHEN value_num < 5e7 THEN '10M - 50M' WHEN value_num < 5e8 THEN '50M - 500M' ELSE 'Above 500M' END"
for part, sql in {
    "by_domain": f"SELECT product_line AS k, count(*) AS n, {n_if('closing >= :asof')} AS open_n FROM notices WHERE is_opportunity = 1 AND product_line <> '' GROUP BY 1",
    "by_lane": "SELECT lane AS k, count(*) AS n FROM notices WHERE lane <> 'None' GROUP BY 1",
    "by_source": f"SELECT source AS k, count(*) AS n, {DIG} FROM notices GROUP BY 1",
    "by_sector": f"SELECT buyer_sector AS k, count(*) AS n, {DIG} FROM notices WHERE buyer_sector IS NOT NULL GROUP BY 1",
    "by_type": f"SELECT tender_type AS k, count(*) AS n, {DIG} FROM notices WHERE is_opportunity = 1 AND tender_type IS NOT NULL GROUP BY 1",
    "by_buyer": f"SELECT {KEY} AS k, count(*) AS n, {DIG} FROM notices WHERE buyer <> '' GROUP BY 1 HAVING sum(is_opportunity) > 0 ORDER BY dig DESC, k LIMIT 12",
    "calendar": "SELECT closing AS k, count(*) AS n FROM notices WHERE is_opportunity = 1 AND closing BETWEEN :asof AND :asof + INTERVAL '30' DAY GROUP BY 1",
    "monthly": f"SELECT strftime(advertised, '%Y-%m') AS k, count(*) AS n, {DIG} FROM notices WHERE advertised IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 12",
    "value_bands": f"SELECT {BAND} AS k, count(*) AS n FROM notices WHERE is_opportunity = 1 GROUP BY 1",
}.items():
    query(f"a04_{part}", lambda d, part=part: mk.overview(d.notices, ASOF)[part], sql, N)
query("a05_brief_stats", lambda d: fd.brief(d.notices, d.changes, ASOF)["stats"], f"SELECT {n_if(f'{LIVE} AND {OPEN}')} AS open_opps, {n_if(f"lane = 'Core' AND dup_of IS NULL AND {OPEN}")} AS open_core, count(*) AS tracked FROM notices", N)

# award intelligence; "ours" are the suppliers whose names end in 7
US = "Ours"


def ours() -> Column:
    return F.lower("winner").endswith("7")


def who() -> Column:
    return F.when(ours(), US).when(F.lower("winner").endswith("3"), "Three").when(F.lower("winner").endswith("5"), "Five")


WHO_SQL = "CASE WHEN lower(winner) LIKE '%7' THEN 'Ours' WHEN lower(winner) LIKE '%3' THEN 'Three' WHEN lower(winner) LIKE '%5' THEN 'Five' END"
SHARE = "coalesce(round_even(100 * our_value / nullif(total_value, 0), 1), 0.0)"
query(
    "a06_account_map",
    lambda d: aw.account_map(d.awards, ours(), ASOF),
    f"SELECT *, {SHARE} AS our_share, round_even(total_value - our_value, 0) AS gap_value, CASE WHEN {SHARE} >= 60 THEN 'Held' WHEN {SHARE} > 0 THEN 'Contested' ELSE 'Not won' END AS status FROM (SELECT {KEY} AS account, max(buyer_sector) AS sector, count(*) AS awards, round(sum({V}), 2) AS total_value, round(sum(CASE WHEN {OURS} THEN {V} ELSE 0 END), 2) AS our_value, {n_if(OURS)} AS our_wins, "
    f"count(DISTINCT winner) AS suppliers, round(avg(bids_received), 1) AS avg_bids, min(award_date) AS first_award, max(award_date) AS last_award, min(CASE WHEN renewal_due >= :asof THEN renewal_due END) AS next_renewal FROM (SELECT * EXCLUDE (d) FROM awards) WHERE buyer <> '' AND {SOFT} GROUP BY 1 ORDER BY total_value DESC, account LIMIT 25)",
    A,
)
WINNERS = f"SELECT winner, count(*) AS wins, round(sum({V}), 2) AS value, count(DISTINCT buyer) AS buyers, round(avg(bids_received), 1) AS avg_bids, {n_if('bids_received = 1')} AS uncontested, max(award_date) AS last_win FROM awards WHERE winner <> '' AND {SOFT} GROUP BY 1"
RIVALS = "SELECT who, CAST(sum(wins) AS BIGINT) AS wins, round(sum(value), 2) AS value, max(buyers) AS buyers, CAST(sum(uncontested) AS BIGINT) AS uncontested, max(last_win) AS last_win, round_even(sum(CASE WHEN avg_bids <> 0 THEN avg_bids * wins END) / sum(CASE WHEN avg_bids <> 0 THEN wins END), 1) AS avg_bids, count(*) AS aliases, who = 'Ours' AS is_us FROM (SELECT *, coalesce(" + WHO_SQL + ", substr(winner, 1, 40)) AS who FROM ({})) GROUP BY who"
query("a07_rivals", lambda d: aw.rivals(d.awards, who(), US), RIVALS.format(WINNERS + " ORDER BY value DESC, wins DESC, winner LIMIT 20"), A)
query("a07_rivals_exact", lambda d: aw.rivals(d.awards, who(), US, limit=None), RIVALS.format(WINNERS), A)
DUE = f"renewal_due >= :asof AND renewal_due <= :asof + INTERVAL '540' DAY AND {SOFT}"
query("a08_renewal_calendar", lambda d: aw.renewal_calendar(d.awards, ours(), ASOF), f"SELECT strftime(renewal_due, '%Y-%m') AS month, count(*) AS n, round(sum({V}), 2) AS value, {n_if(OURS)} AS ours_n, round(sum(CASE WHEN {OURS} THEN {V} ELSE 0 END), 2) AS ours_value FROM awards WHERE {DUE} GROUP BY 1", A)
OUT = f"uid, winner, value_num, award_date, tenure_months, renewal_due, lane, product_line, bids_received, {KEY} AS account, CAST(date_diff('day', :asof, renewal_due) AS INTEGER) AS days_out"
query("x3_defend", lambda d: aw.defend(d.awards, ours(), ASOF), f"SELECT {OUT} FROM awards WHERE renewal_due >= :asof AND {OURS}", A)
query("x3_attack", lambda d: aw.attack(d.awards, ours(), who(), ASOF), f"SELECT {OUT}, coalesce({WHO_SQL}, 'Other') AS incumbent FROM awards WHERE {DUE} AND NOT {OURS} ORDER BY {V} DESC, renewal_due, uid, winner, value_num, award_date, tenure_months, lane, product_line, bids_received LIMIT 40", A)
CAD = f"SELECT {KEY} AS account, product_line, count(*) AS n, min(award_date) AS first_award, max(award_date) AS last_award, CAST(trunc(date_diff('day', min(award_date), max(award_date)) / nullif(count(*) - 1, 0)) AS INTEGER) AS avg_gap_days, CAST(date_diff('day', max(award_date), :asof) AS INTEGER) AS since_last FROM awards WHERE award_date IS NOT NULL AND buyer <> '' AND {SOFT} GROUP BY 1, 2 HAVING count(*) >= 2"
query("a09_cadence", lambda d: aw.cadence(d.awards, ASOF), f"SELECT *, since_last - avg_gap_days AS overdue_by, CASE WHEN n >= 4 THEN 'high' WHEN n = 3 THEN 'medium' ELSE 'low' END AS confidence FROM ({CAD}) WHERE avg_gap_days >= 120 AND since_last > avg_gap_days * 1.05 ORDER BY overdue_by DESC, account, product_line LIMIT 20", A)
query("a10_price_bands", lambda d: aw.price_bands(d.awards), f"SELECT product_line, count(*) AS n, round(min(value_num), 0) AS low, round(avg(value_num), 0) AS avg, round(max(value_num), 0) AS high, round(avg(bids_received), 1) AS avg_bids, {n_if('bids_received = 1')} AS uncontested FROM awards WHERE value_num > 10000 AND product_line <> '' AND {SOFT} GROUP BY 1", A)
query("a11_pipeline", lambda d: aw.pipeline(d.notices, ASOF), f"SELECT product_line, count(*) AS n, round(sum(coalesce(value_num, est_value_low, 0)), 2) AS v FROM notices WHERE {LIVE} AND {OPEN} GROUP BY 1", N)
query("a12_sector_values", lambda d: aw.sector_values(d.awards, ours()), f"SELECT coalesce(buyer_sector, 'Other') AS sector, count(*) AS n, round(sum({V}), 2) AS value, round(sum(CASE WHEN {OURS} THEN {V} ELSE 0 END), 2) AS ours FROM awards WHERE {SOFT} GROUP BY 1", A)
query("a13_award_stats", lambda d: aw.award_stats(d.awards, ours()), f"SELECT *, {SHARE} AS our_share FROM (SELECT count(*) AS awards, round(sum({V}), 2) AS total_value, round(sum(CASE WHEN {OURS} THEN {V} ELSE 0 END), 2) AS our_value, {n_if(OURS)} AS our_wins, count(DISTINCT winner) AS suppliers, count(DISTINCT buyer) AS buyers, min(award_date) AS history_from FROM awards)", A)

# dashboard
SEEN7, SEEN14 = "first_seen >= :asof - INTERVAL '7' DAY", "first_seen < :asof - INTERVAL '7' DAY AND first_seen >= :asof - INTERVAL '14' DAY"
query(
    "a14_kpi",
    lambda d: mk.kpi(d.notices, ASOF).withColumn("open_value", F.round("open_value", 2)),
    f"SELECT {n_if(f'{LIVE} AND {OPEN}')} AS open_opps, {n_if(f"lane = 'Core' AND dup_of IS NULL AND {OPEN}")} AS open_core, round(sum(CASE WHEN {LIVE} AND {OPEN} THEN coalesce(value_num, est_value_low, 0) ELSE 0 END), 2) AS open_value, {n_if(f'{LIVE} AND {SEEN7}')} AS new_7d, {n_if(f'{LIVE} AND {SEEN14}')} AS new_prev_7d, "
    f"{n_if(f'{LIVE} AND {OPEN} AND (value_num IS NOT NULL OR est_value_low IS NOT NULL)')} AS valued, count(*) AS tracked, count(DISTINCT {KEY}) AS buyers FROM notices",
    N,
)
WIN = "SELECT CAST(date_diff('day', advertised, closing) AS INTEGER) AS w FROM notices WHERE is_opportunity = 1 AND closing > advertised AND date_diff('day', advertised, closing) < 150"
query("a15_median_window", lambda d: mk.median_window(d.notices), f"SELECT list_sort(list(w))[len(list(w)) // 2 + 1] AS median_window FROM ({WIN})", N)
query("a15_window_histogram", lambda d: mk.window_histogram(d.notices), " UNION ALL ".join(f"SELECT '{k}' AS k, count(*) AS n FROM ({WIN}) WHERE w >= {lo} AND w < {hi}" for lo, hi, k in mk.WINDOW_BINS), N)
query("a16_sparkline", lambda d: mk.sparkline(d.notices, ASOF), f"SELECT strftime(first_seen, '%Y-%W') AS wk, count(*) AS n FROM notices WHERE {LIVE} AND first_seen >= :asof - INTERVAL '84' DAY GROUP BY 1", N)
query("a17_monthly_lanes", lambda d: mk.monthly_lanes(d.notices, ASOF), "SELECT strftime(coalesce(advertised, CAST(first_seen AS DATE)), '%Y-%m') AS m, lane, count(*) AS n FROM notices WHERE lane <> 'None' AND dup_of IS NULL AND coalesce(advertised, CAST(first_seen AS DATE)) >= DATE '1996-12-15' GROUP BY 1, 2", N)
query("a18_coming_weeks", lambda d: mk.coming_weeks(d.notices, ASOF), f"SELECT strftime(closing, '%Y-%W') AS wk, lane, min(closing) AS wk_start, count(*) AS n FROM notices WHERE {LIVE} AND closing BETWEEN :asof AND :asof + INTERVAL '56' DAY GROUP BY 1, 2", N)
query("a19_heat", lambda d: mk.heat(d.notices), f"SELECT coalesce(buyer_sector, 'Other') AS s, product_line AS p, count(*) AS n FROM notices WHERE {LIVE} AND product_line <> '' GROUP BY 1, 2", N)
query("a20_types", lambda d: mk.types(d.notices, ASOF), f"SELECT tender_type AS k, count(*) AS n, {n_if(OPEN)} AS open_n FROM notices WHERE {LIVE} AND tender_type IS NOT NULL GROUP BY 1", N)
query("a20_jurisdictions", lambda d: mk.jurisdictions(d.notices), f"SELECT coalesce(jurisdiction, 'Unknown') AS k, count(*) AS n FROM notices WHERE {LIVE} GROUP BY 1", N)
query("a20_top_buyers", lambda d: mk.top_buyers(d.notices, ASOF), f"SELECT {KEY} AS k, max(buyer_sector) AS sector, count(*) AS n, {n_if(OPEN)} AS open_n, {n_if("lane = 'Core'")} AS core_n FROM notices WHERE {LIVE} GROUP BY 1 ORDER BY n DESC, k LIMIT 12", N)
query("a21_award_months", lambda d: aw.award_months(d.awards, ASOF), f"SELECT strftime(coalesce(signing_date, award_date), '%Y-%m') AS m, count(*) AS n, round(sum({V}), 2) AS v FROM awards WHERE coalesce(signing_date, award_date) >= DATE '1996-12-15' GROUP BY 1", A)
query("a22_bid_distribution", lambda d: aw.bid_distribution(d.awards), "SELECT CASE WHEN bids_received >= 6 THEN '6+' ELSE CAST(bids_received AS VARCHAR) END AS k, count(*) AS n FROM awards WHERE bids_received > 0 GROUP BY 1", A)
SUP = f"SELECT winner, round(sum({V}), 2) AS v, count(*) AS n FROM awards WHERE winner <> '' AND {SOFT} GROUP BY 1"
query("a23_supplier_shares", lambda d: aw.supplier_shares(d.awards), f"{SUP} ORDER BY v DESC, winner LIMIT 8", A)
query("a23_concentration", lambda d: aw.concentration(d.awards), f"SELECT round(any_value(t), 2) AS supplier_total, round_even(sum(pow(100 * v / t, 2)), 0) AS hhi FROM (SELECT v, sum(v) OVER () AS t FROM ({SUP}))", A)
query("a24_award_totals", lambda d: aw.award_totals(d.awards), f"SELECT count(*) AS n, round(sum({V}), 2) AS v, round(avg(bids_received), 1) AS avg_bids, {n_if('bids_received = 1')} AS single FROM awards", A)
MOM = f"SELECT coalesce(buyer_sector, 'Other') AS s, {n_if("first_seen >= :asof - INTERVAL '30' DAY")} AS n, {n_if("first_seen < :asof - INTERVAL '30' DAY AND first_seen >= :asof - INTERVAL '60' DAY")} AS m FROM notices WHERE {LIVE} GROUP BY 1"
UP, DOWN = "n >= 3 AND n >= 1.5 * greatest(1, m)", "m >= 4 AND n <= 0.5 * m"
query(
    "a25_signals",
    lambda d: mk.signals(d.notices, d.awards, ASOF),
    f"SELECT tone, title, n, m FROM (SELECT 0 AS r, CASE WHEN {UP} THEN 'up' ELSE 'down' END AS tone, s || CASE WHEN {UP} THEN ' demand is accelerating' ELSE ' demand has cooled' END AS title, n, m FROM ({MOM}) WHERE ({UP}) OR ({DOWN}) "
    f"UNION ALL SELECT 1, 'warn', 'biddable deadlines this week', {n_if(f"{LIVE} AND closing BETWEEN :asof AND :asof + INTERVAL '7' DAY")}, 0 FROM notices HAVING count(*) FILTER (WHERE {LIVE} AND closing BETWEEN :asof AND :asof + INTERVAL '7' DAY) > 0 "
    f"UNION ALL SELECT 2, 'warn', 'recent tenders gave under 10 days to bid', n, 0 FROM (SELECT {n_if("is_opportunity = 1 AND date_diff('day', advertised, closing) < 10 AND first_seen >= :asof - INTERVAL '90' DAY")} AS n FROM notices) WHERE n >= 3 "
    f"UNION ALL SELECT 3, 'info', 'open tenders are re-issues', n, 0 FROM (SELECT {n_if(f'repeat_of IS NOT NULL AND {OPEN}')} AS n FROM notices) WHERE n > 0 "
    f"UNION ALL SELECT 4, 'info', 'biddable-lane awards went to a single bidder', n, 0 FROM (SELECT count(*) AS n FROM awards WHERE bids_received = 1 AND {SOFT}) WHERE n > 0) ORDER BY r, title LIMIT 6",
    N, A,
)
query("a26_source_debug", lambda d: mk.source_debug(d.notices, ASOF), f"SELECT source, count(*) AS total_rows, CAST(sum(is_opportunity) AS BIGINT) AS opps, {n_if('closing IS NULL')} AS no_closing, {n_if('closing < :asof')} AS past_closing FROM notices GROUP BY 1", N)
query("a28_coverage", lambda d: mk.coverage(d.notices), "SELECT min(first_seen) AS first_seen, min(advertised) AS first_advertised FROM notices", N)
RH = "SELECT buyer, count(*) AS n, round(sum(CASE WHEN value_num <> 0 THEN value_num END), 2) AS total, round(quantile_cont(CASE WHEN value_num <> 0 THEN value_num END, 0.5), 4) AS median_value, min(award_date) AS first, max(award_date) AS last FROM awards WHERE lane <> 'None' AND buyer <> '' AND award_date IS NOT NULL GROUP BY 1 HAVING count(*) >= 2"
TOP = "SELECT buyer, product_line AS top_line FROM (SELECT buyer, product_line, row_number() OVER (PARTITION BY buyer ORDER BY count(*) DESC, min(award_date), product_line) AS k FROM awards WHERE lane <> 'None' AND buyer <> '' AND award_date IS NOT NULL AND product_line <> '' GROUP BY 1, 2) WHERE k = 1"
query("a29_buyer_rhythm", lambda d: aw.buyer_rhythm(d.awards, ASOF), f"SELECT *, interval_days > 0 AND since_last > interval_days * 1.25 AS overdue FROM (SELECT r.*, top_line, CAST(round_even(date_diff('day', first, last) / (n - 1), 0) AS INTEGER) AS interval_days, CAST(date_diff('day', last, :asof) AS INTEGER) AS since_last FROM ({RH}) r LEFT JOIN ({TOP}) t USING (buyer))", A)
query("a30_velocity_month", lambda d: aw.velocity(d.awards)["by_month"], f"SELECT strftime(award_date, '%Y-%m') AS k, count(*) AS n, round(sum({V}), 2) AS value FROM awards WHERE lane <> 'None' AND award_date IS NOT NULL GROUP BY 1", A)
query("a30_velocity_line", lambda d: aw.velocity(d.awards)["by_line"], f"SELECT coalesce(nullif(product_line, ''), 'Unspecified') AS k, count(*) AS n, round(sum({V}), 2) AS value FROM awards WHERE lane <> 'None' GROUP BY 1", A)
STEP = "make_date(year({d}) + CAST(floor((month({d}) - 1 + {m}) / 12.0) AS BIGINT), (((month({d}) - 1 + {m}) % 12) + 12) % 12 + 1, least(day({d}), 28))"
EXP = "SELECT *, CASE WHEN tenure_months <> 0 THEN " + STEP.format(d="award_date", m="tenure_months") + " END AS expiry FROM awards WHERE lane <> 'None'"
query("x9_upcoming_renewals", lambda d: aw.upcoming_renewals(d.awards, ASOF), f"SELECT uid, buyer, winner, award_date, tenure_months, expiry, window_opens, CAST(date_diff('day', :asof, expiry) AS INTEGER) AS days_to_expiry FROM (SELECT *, {STEP.format(d='expiry', m='-3')} AS window_opens FROM ({EXP})) WHERE expiry BETWEEN :asof AND :asof + INTERVAL '180' DAY OR window_opens BETWEEN :asof AND :asof + INTERVAL '180' DAY", A)

# row-level dashboard
query("c2_extent", lambda d: mk.extent(d.notices, "advertised"), "SELECT min(advertised) AS first, max(advertised) AS last, count(*) AS n FROM notices", N)
query("c3_top_with_other", lambda d: mk.grouped_with_other(d.notices, fd.buyer_key()), f"SELECT CASE WHEN r <= 12 THEN k ELSE 'Other' END AS k, CAST(sum(n) AS BIGINT) AS n FROM (SELECT k, n, row_number() OVER (ORDER BY n DESC, k) AS r FROM (SELECT coalesce({KEY}, 'Unspecified') AS k, count(*) AS n FROM notices GROUP BY 1)) GROUP BY 1", N)
query("c4_month_lane", lambda d: mk.pivot(d.notices, dt.month_key(c("advertised")), c("lane"), top_x=1000), "SELECT strftime(advertised, '%Y-%m') AS x, lane AS s, CAST(count(*) AS DOUBLE) AS v FROM notices WHERE advertised IS NOT NULL GROUP BY 1, 2", N)
SER = "SELECT strftime(advertised, '%Y-%m') AS m, nullif(product_line, '') AS k FROM notices WHERE advertised IS NOT NULL AND nullif(product_line, '') IS NOT NULL"
query("c5_series", lambda d: mk.series(d.notices, dt.month_key(c("advertised")), F.nullif(c("product_line"), F.lit(""))), f"SELECT m, k, coalesce(n, 0) AS n FROM (SELECT m, k FROM (SELECT DISTINCT m FROM ({SER})) CROSS JOIN (SELECT k FROM ({SER}) GROUP BY k ORDER BY count(*) DESC, k LIMIT 6)) LEFT JOIN (SELECT m, k, count(*) AS n FROM ({SER}) GROUP BY 1, 2) USING (m, k)", N)
query("c6_category_bars", lambda d: mk.counts(d.notices.where(c("product_line") != ""), "product_line").orderBy(c("n").desc(), "k").limit(10), "SELECT product_line AS k, count(*) AS n FROM notices WHERE product_line <> '' GROUP BY 1 ORDER BY n DESC, k LIMIT 10", N)
CELL = f"SELECT {KEY} AS x, lane AS s, sum(coalesce(value_num, 0)) AS v FROM notices WHERE {KEY} IS NOT NULL GROUP BY 1, 2"
query("c7_pivot", lambda d: mk.pivot(d.notices, fd.buyer_key(), c("lane"), c("value_num")).withColumn("v", F.round("v", 2)), f"SELECT x, s, round(v, 2) AS v FROM ({CELL}) WHERE x IN (SELECT x FROM ({CELL}) GROUP BY x ORDER BY sum(v) DESC, x LIMIT 14)", N)

# rankings and joins
PRI = f"SELECT n.*, {KEY} AS account, CAST(trunc((epoch(CAST(closing AS TIMESTAMP)) - epoch(:asof + INTERVAL '9' HOUR)) / 86400) AS INTEGER) AS days_left FROM notices n WHERE {LIVE} AND {OPEN}"
SCORE = "CAST(round_even(100 * (0.5 * coalesce(fit_score, 0) / 100 + 0.3 * CASE WHEN days_left <= 3 THEN 1.0 WHEN days_left <= 7 THEN 0.8 WHEN days_left <= 14 THEN 0.55 WHEN days_left IS NOT NULL THEN 0.3 ELSE 0.15 END + 0.2 * CASE WHEN lower(account) LIKE '%nation_1 %' THEN 1.0 WHEN prior_awards > 0 THEN 0.6 ELSE 0.2 END), 0) AS INTEGER)"
query(
    "x5_priority_queue",
    lambda d: rk.priority_queue(d.notices, d.awards, f"{ASOF} 09:00:00", ["nation_1 "], None),
    f"SELECT uid, account, lane, product_line, fit_score, closing, days_left, prior_awards, typical_bids, {SCORE} AS score, CASE WHEN lane = 'Core' AND days_left <= 10 AND fit_score >= 85 THEN 'Bid now' WHEN days_left <= 30 THEN 'Qualify' ELSE 'Watch' END AS action "
    f"FROM ({PRI}) LEFT JOIN (SELECT {KEY} AS account, count(*) AS prior_awards FROM awards GROUP BY 1) USING (account) LEFT JOIN (SELECT product_line, round(avg(bids_received), 1) AS typical_bids FROM awards WHERE bids_received IS NOT NULL GROUP BY 1) USING (product_line)",
    N, A,
)
query("j02_moved", lambda d: fd.moved(d.notices, d.changes.withColumn("seen_at", F.expr("seen_at - INTERVAL '9330' DAY")), ASOF).select("id", "uid", "field", "lane"), f"SELECT id, uid, field, lane FROM (SELECT id, uid, field, seen_at - INTERVAL '9330' DAY AS seen_at FROM changes) JOIN (SELECT uid, lane FROM notices WHERE is_opportunity = 1 AND {OPEN}) USING (uid) WHERE seen_at >= :asof - INTERVAL '2' DAY ORDER BY seen_at DESC, id DESC LIMIT 8", N, C)
query("w05_last_changes", lambda d: fd.last_changes(d.changes).select("uid", "id", F.col("k").cast("long").alias("k")), "SELECT uid, id, k FROM (SELECT uid, id, row_number() OVER (PARTITION BY uid ORDER BY seen_at DESC, id DESC) AS k FROM changes) WHERE k <= 12", C)
query("j12_own_award", lambda d: d.notices.select("uid").join(d.awards.select(c("tender_no").alias("uid"), "winner", "value_num"), "uid"), "SELECT uid, winner, a.value_num FROM notices n JOIN (SELECT tender_no AS uid, winner, value_num FROM awards) a USING (uid)", N, A)
query("j09_without_award", lambda d: d.notices.select("uid").join(d.awards.select(c("tender_no").alias("uid")), "uid", "left_anti"), "SELECT uid FROM notices WHERE uid NOT IN (SELECT tender_no FROM awards)", N, A)
query("j10_known_decisions", lambda d: d.awards.select("uid", c("tender_no").alias("known")).join(d.notices.where("is_opportunity = 1").select(c("uid").alias("known")), "known", "left_semi").groupBy("known").agg(F.count("*").alias("n")), "SELECT tender_no AS known, count(*) AS n FROM awards WHERE tender_no IN (SELECT uid FROM notices WHERE is_opportunity = 1) GROUP BY 1", N, A)
