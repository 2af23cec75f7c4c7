"""Further queries: lookups with children, award terms, clauses, aliases, winners, JSON replies, sweeps, contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as dt
from ..functions import enrich as en
from ..functions import rules as ru
from ..functions import text as tx
from ..operators import awards as aw
from ..operators import context as cx
from ..operators import feed as fd
from ..operators import linkage as lk
from ..operators import market as mk
from ..operators import merge as mg
from ..sources import portals as po
from .fixtures import ASOF, Data
from .more import _keyed, observations
from .queries import KEY, LIVE, OPEN, A, C, N, V, n_if, query

c = F.col

query("j03_children", lambda d: fd.with_children(_keyed(d), mg.alternates(_keyed(d)), d.changes).select("uid", F.coalesce(F.size("changes"), F.lit(0)).cast("long").alias("n_changes")), "SELECT n.uid, least(coalesce(k, 0), 12) AS n_changes FROM notices n LEFT JOIN (SELECT uid, count(*) AS k FROM changes GROUP BY uid) ch USING (uid) WHERE title IS NOT NULL", N, C)
query("s02_get", lambda d: fd.get(_keyed(d), mg.alternates(_keyed(d)), d.changes, "N77").select("uid", F.size("changes").cast("long").alias("n_changes")), "SELECT 'N77' AS uid, nullif(least(count(*), 12), 0) AS n_changes FROM changes WHERE uid = 'N77' AND EXISTS (SELECT 1 FROM notices WHERE uid = 'N77' AND title IS NOT NULL) HAVING EXISTS (SELECT 1 FROM notices WHERE uid = 'N77' AND title IS NOT NULL)", N, C)
query("x2_new", lambda d: fd.brief(d.notices, d.changes, ASOF, days_new=30)["new"].select("uid", "fit_score", "closing"), f"SELECT uid, fit_score, closing FROM notices WHERE {LIVE} AND first_seen >= :asof - INTERVAL '30' DAY AND closing >= :asof ORDER BY fit_score DESC, closing, uid LIMIT 10", N)
query("x2_closing", lambda d: fd.brief(d.notices, d.changes, ASOF)["closing"].select("uid", "closing", "days_left"), f"SELECT uid, closing, CAST(date_diff('day', :asof, closing) AS INTEGER) AS days_left FROM notices WHERE {LIVE} AND closing BETWEEN :asof AND :asof + INTERVAL '7' DAY ORDER BY closing, fit_score DESC, uid LIMIT 10", N)
TERM = "coalesce(tenure_months, CASE WHEN lane IN ('Core', 'Partner-led') AND title LIKE '%ring%' THEN 12 END)"
query(
    "k02_award_terms",
    lambda d: aw.infer_terms(d.awards.drop("renewal_due"), F.lit(None).cast("int"), c("title").contains("ring")).select("uid", "award_date", "tenure_months", "tenure_basis", "renewal_due"),
    f"SELECT uid, award_date, t AS tenure_months, CASE WHEN tenure_months IS NOT NULL THEN 'stated' WHEN t IS NOT NULL THEN 'assumed' END AS tenure_basis, CASE WHEN t IS NOT NULL THEN make_date(year(s) + (month(s) - 1 + t) // 12, (month(s) - 1 + t) % 12 + 1, least(day(s), 28)) END AS renewal_due FROM (SELECT *, CAST({TERM} AS INTEGER) AS t, coalesce(signing_date, award_date) AS s FROM awards)",
    A,
)


def _halves(d: Data) -> tuple[DataFrame, DataFrame]:
    """Latest observation of each user in each half of the events, blanks as nulls."""
    o = observations(d)
    last = lambda part: o.where(f"seq % 2 = {part}").groupBy("uid").agg(F.max_by("status", "seq").alias("status"), F.nullif(F.max_by("value_text", "seq"), F.lit("")).alias("value_text"))
    return last(0), last(1)


HALF = "SELECT CAST(user_id AS VARCHAR) AS uid, arg_max(event_type, event_id) AS status, nullif(arg_max(CASE WHEN event_id % 7 = 0 THEN '' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END, event_id), '') AS value_text FROM events WHERE event_id % 2 = {} GROUP BY 1"
query("k02_fill_upsert", lambda d: mg.fill_upsert(*_halves(d), "uid"), f"SELECT coalesce(a.uid, b.uid) AS uid, coalesce(b.status, a.status) AS status, coalesce(b.value_text, a.value_text) AS value_text FROM ({HALF.format(0)}) a FULL JOIN ({HALF.format(1)}) b ON a.uid = b.uid")
query("k06_save_details", lambda d: cx.save_details(d.notices.select("uid", "contact_email", "description"), d.notices.where("seq % 2 = 0").select("uid", F.when(c("seq") % 4 == 0, "new@example.org").alias("contact_email"), F.lit(None).cast("string").alias("description"))), "SELECT uid, CASE WHEN seq % 4 = 0 THEN 'new@example.org' ELSE contact_email END AS contact_email, CASE WHEN seq % 2 = 0 THEN NULL ELSE description END AS description FROM notices", N)
query("t13_aliases", lambda d: d.table("part").select("p_partkey", F.array_join(tx.joined_aliases(F.concat(F.lit("pre-"), "p_name", F.lit(" a-b"))), ",").alias("a")), "SELECT p_partkey, CASE WHEN len(w) < 3 THEN '' WHEN len(p) <= 4 THEN p WHEN p LIKE '%ing' AND len(p) >= 6 THEN substr(p, 1, len(p) - 3) WHEN p LIKE '%ed' AND len(p) >= 5 THEN substr(p, 1, len(p) - 2) WHEN p LIKE '%es' AND len(p) >= 5 THEN substr(p, 1, len(p) - 2) WHEN p LIKE '%s' THEN substr(p, 1, len(p) - 1) ELSE p END AS a FROM (SELECT p_partkey, string_split(p_name, ' ')[1] AS w, 'pre' || string_split(p_name, ' ')[1] AS p FROM part)")
query("t16_clauses", lambda d: d.table("part").select("p_partkey", F.size(tx.clauses(F.concat(F.lit("supply of many "), "p_name", F.lit(", short; repair of many "), "p_name"))).cast("long").alias("n")), "SELECT p_partkey, CAST(2 AS BIGINT) AS n FROM part")
query("t19_sequence_ratio", lambda d: d.table("part").select("p_partkey", F.udf(lambda x: lk.sequence_ratio(x, "small green ring"), "double")("p_name").alias("r")).groupBy(F.round("r", 2).alias("r")).agg(F.count("*").alias("n")))
query("t22_buyer_names", lambda d: d.notices.select(ru.normalize_buyer(F.concat(F.lit("Water Board, "), c("jurisdiction"), F.lit(" - Pakistan")), ["ASIA", "EUROPE"], []).alias("b")).groupBy("b").agg(F.count("*").alias("n")), "SELECT CASE WHEN jurisdiction IN ('ASIA', 'EUROPE') THEN 'Water Board' ELSE 'Water Board, ' || jurisdiction END AS b, count(*) AS n FROM notices GROUP BY 1", N)
query("t25_winners", lambda d: d.table("part").select("p_partkey", en.winner_of(F.concat(F.lit("awarded to "), F.upper("p_name"), F.lit(" Ltd, for works")), ["Karachi"]).alias("w")), "SELECT p_partkey, upper(p_name) || ' Ltd' AS w FROM part")
query("t26_terms", lambda d: d.table("part").select("p_partkey", en.term_months(F.concat(F.lit("for a period of "), c("p_size").cast("string"), F.when(c("p_size") % 2 == 0, " months").otherwise(" years"))).alias("m")), "SELECT p_partkey, CAST(CASE WHEN p_size % 2 = 0 THEN p_size ELSE 12 * p_size END AS INTEGER) AS m FROM part")
query("t30_json_replies", lambda d: cx.model_replies(d.table("events").select("event_id", F.concat(F.lit("Sure: "), "props").alias("t")), "t", "k bigint").select("event_id", c("parsed.k").alias("k")), "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
query("t33_xml_escape", lambda d: d.table("pages").select("page_id", tx.xml_escape(c("url")).alias("u")), "SELECT page_id, replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS u FROM pages")
query("w09_miss_runs", lambda d: po.consecutive_misses(d.table("events").select(c("event_id").alias("id"), "event_type"), c("event_type") == "error"), "SELECT min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM (SELECT event_id, event_type, count(*) FILTER (WHERE event_type = 'error') OVER (ORDER BY event_id) AS r FROM events) WHERE event_type <> 'error' OR event_type IS NULL GROUP BY r")
query("a33_sweep_status", lambda d: mg.sweep_status(d.notices.groupBy("source").agg(F.max("seq").alias("highest"), F.min("seq").alias("lowest"), F.floor(F.avg("seq")).alias("cursor"), F.lit(0).alias("done")), d.notices).select("source", "stored", F.round("pct", 0).alias("pct")), "SELECT source, count(*) AS stored, round(round_even(100 * (max(seq) - floor(avg(seq))) / (max(seq) - min(seq)), 1), 0) AS pct FROM notices GROUP BY 1", N)
query("c8_kpi_strip", lambda d: mk.table_filter(d.notices, lane="Core").agg(F.count("*").alias("n"), F.round(F.sum("value_num"), 2).alias("value"), F.count_distinct(fd.buyer_key()).alias("buyers"), F.count("value_num").alias("valued")), f"SELECT count(*) AS n, round(sum(value_num), 2) AS value, count(DISTINCT {KEY}) AS buyers, count(value_num) AS valued FROM notices WHERE lane = 'Core'", N)
query("x10_velocity_totals", lambda d: aw.velocity(d.awards)["by_line"].agg(F.sum("n").alias("n"), F.round(F.sum("value"), 0).alias("value")), f"SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(v), 0) AS value FROM (SELECT count(*) AS n, round(sum({V}), 2) AS v FROM awards WHERE lane <> 'None' GROUP BY coalesce(nullif(product_line, ''), 'Unspecified'))", A)
query("x11_reclassify", lambda d: cx.reclassify(d.notices.withColumn("title", F.concat_ws(" ", "title", F.when(c("seq") % 3 == 0, "cctv"))), ru.EXAMPLE).groupBy("lane", "fit_score").agg(F.count("*").alias("n")), "SELECT CASE WHEN seq % 3 = 0 THEN 'Partner-led' ELSE 'None' END AS lane, CAST(CASE WHEN seq % 3 = 0 THEN 63 ELSE 0 END AS INTEGER) AS fit_score, count(*) AS n FROM notices GROUP BY 1, 2", N)
query("x12_question_context", lambda d: cx.question_context(d.notices, "ring", ASOF).select("uid"), f"SELECT uid FROM (SELECT uid FROM notices WHERE {LIVE} AND {OPEN} ORDER BY fit_score DESC, uid LIMIT 60) UNION SELECT uid FROM (SELECT uid FROM notices WHERE regexp_matches(lower(coalesce(title, '') || ' ' || coalesce(description, '') || ' ' || buyer), '(^|[^\\p{{L}}\\p{{N}}])ring([^\\p{{L}}\\p{{N}}]|$)') ORDER BY fit_score DESC, uid LIMIT 40)", N)
query("t01_shifted", lambda d: d.notices.agg(*(F.count_if(c("closing") >= dt.shift(ASOF, k)).alias(f"n{k}") for k in (0, 7, 30))), f"SELECT {', '.join(f'{n_if(f"closing >= :asof + INTERVAL '{k}' DAY")} AS n{k}' for k in (0, 7, 30))} FROM notices", N)
