"""Queries of scalar functions, merges, text, linkage, sources and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as dt
from ..functions import money as mn
from ..functions import rules as ru
from ..functions import text as tx
from ..operators import feed as fd
from ..operators import linkage as lk
from ..operators import merge as mg
from ..operators import ranking as rk
from ..operators import sqlguard
from ..sources import html as hs
from ..streaming import feeds as st
from .fixtures import ASOF, Data
from .queries import A, C, N, query

c = F.col

# dates and money, rendered to text and parsed back
D = "CAST(o_orderdate AS DATE)"
query("t02_months_back", lambda d: d.table("orders").select("o_orderkey", dt.months_back(c("o_orderdate").cast("date"), 1).alias("d")), f"SELECT o_orderkey, CAST(make_date(year({D} - INTERVAL '1' MONTH), month({D} - INTERVAL '1' MONTH), 1) + CAST(day({D}) - 1 AS INTEGER) AS DATE) AS d FROM orders")
query("t03_day_gaps", lambda d: d.notices.select("uid", F.date_diff("closing", "advertised").alias("w")), "SELECT uid, CAST(date_diff('day', advertised, closing) AS INTEGER) AS w FROM notices", N)
query("t04_month_keys", lambda d: d.notices.groupBy(dt.month_key(c("closing")).alias("m")).agg(F.count("*").alias("n")), "SELECT strftime(closing, '%Y-%m') AS m, count(*) AS n FROM notices GROUP BY 1", N)
query("t05_clamped_months", lambda d: d.awards.select("uid", "award_date", dt.add_months_clamped(c("award_date"), F.lit(7)).alias("due")), "SELECT uid, award_date, make_date(year(award_date) + (month(award_date) + 6) // 12, (month(award_date) + 6) % 12 + 1, least(day(award_date), 28)) AS due FROM awards", A)
query("t06_week_keys", lambda d: d.notices.groupBy(dt.week_key(c("closing")).alias("wk")).agg(F.count("*").alias("n")), "SELECT strftime(closing, '%Y-%W') AS wk, count(*) AS n FROM notices GROUP BY 1", N)
FORMS = {"long": ("MMMM d, yyyy", "%B %-d, %Y"), "short": ("dd-MMM-yyyy", "%d-%b-%Y"), "iso": ("yyyy-MM-dd", "%Y-%m-%d"), "slash": ("dd/MM/yyyy", "%d/%m/%Y")}
for form, (java, _) in FORMS.items():
    query(f"t07_parse_{form}", lambda d, java=java: d.table("orders").select("o_orderkey", dt.parse_date(F.date_format("o_orderdate", java)).alias("d")), f"SELECT o_orderkey, {D} AS d FROM orders")
query("t07_parse_list", lambda d: d.table("orders").select("o_orderkey", dt.parse_list_date(F.concat(F.date_format("o_orderdate", "d-MMM-yy"), F.lit(" at 11:00 AM"))).alias("d")), f"SELECT o_orderkey, '20' || strftime({D}, '%y-%m-%d') AS d FROM orders")
query("t09_parse_money", lambda d: d.table("part").select("p_partkey", mn.parse_money(F.concat(F.lit("USD "), c("p_size").cast("string"), F.lit(" million"))).alias("m")).select("p_partkey", "m.value_num", "m.currency"), "SELECT p_partkey, p_size * 1e6 * 278.0 AS value_num, 'USD' AS currency FROM part")
query("t09_parse_lakh", lambda d: d.table("part").select("p_partkey", mn.parse_money(F.concat(F.lit("Rs. "), F.format_number("p_retailprice", 2), F.lit(" lakh"))).alias("m")).select("p_partkey", F.round("m.value_num", 2).alias("value_num"), "m.currency"), "SELECT p_partkey, round(round(p_retailprice, 2) * 1e5, 2) AS value_num, 'PKR' AS currency FROM part")
query("t10_clean", lambda d: d.table("documents").select("doc_id", F.md5(tx.clean(c("text"))).alias("h")), "SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) AS h FROM documents")
query("t11_dedupe_key", lambda d: d.notices.select("uid", tx.dedupe_key(F.concat_ws(" ", F.lit("Supply of"), "title", "description"), c("buyer"), c("closing")).alias("k")), "SELECT uid, substr(sha1(array_to_string(list_sort(list_filter(string_split(regexp_replace(lower(coalesce(title, '') || ' ' || coalesce(description, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')), ' ') || '|' || substr(regexp_replace(lower(buyer), '[^a-z0-9]+', '', 'g'), 1, 40) || '|' || coalesce(CAST(closing AS VARCHAR), '')), 1, 20) AS k FROM notices", N)
TERMS = "list_filter(string_split(regexp_replace(lower(title), '[^a-z0-9 ]+', ' ', 'g'), ' '), lambda w: len(w) > 2)"
STEMMED = "CASE WHEN len(w) <= 4 THEN w WHEN w LIKE '%ing' AND len(w) >= 6 THEN substr(w, 1, len(w) - 3) WHEN w LIKE '%ed' AND len(w) >= 5 THEN substr(w, 1, len(w) - 2) WHEN w LIKE '%es' AND len(w) >= 5 THEN substr(w, 1, len(w) - 2) WHEN w LIKE '%s' THEN substr(w, 1, len(w) - 1) ELSE w END"
query("t12_terms", lambda d: d.table("part").select("p_partkey", F.array_join(tx.terms(c("p_name")), " ").alias("t")), f"SELECT p_partkey, array_to_string(list_transform(list_filter(string_split(lower(p_name), ' '), lambda w: len(w) > 2), lambda w: {STEMMED}), ' ') AS t FROM part")
query("t14_bigrams", lambda d: d.table("part").select("p_partkey", F.size(tx.bigrams(c("p_name"))).cast("long").alias("n")), "SELECT p_partkey, CAST(len(string_split(p_name, ' ')) - 1 AS BIGINT) AS n FROM part")
query("t15_strip_reference", lambda d: d.table("part").select("p_partkey", tx.strip_reference(F.concat(F.lit("TENDER NO. "), c("p_partkey").cast("string"), F.lit(": "), "p_name")).alias("t")), "SELECT p_partkey, p_name AS t FROM part")
query("t17_bundles", lambda d: d.table("part").select("p_partkey", F.explode(tx.bundle_items(F.concat(F.lit("TENDER NO. 1 supply of "), "p_name", F.lit(" items TENDER NO. 2 repair of "), "p_name", F.lit(" items")))).alias("item")), "SELECT p_partkey, 'TENDER NO. 1 supply of ' || p_name || ' items' AS item FROM part UNION ALL SELECT p_partkey, 'TENDER NO. 2 repair of ' || p_name || ' items' FROM part")
query("t23_sectors", lambda d: d.notices.select(ru.buyer_sector(c("buyer_sector")).alias("s")).groupBy("s").agg(F.count("*").alias("n")), "SELECT CASE WHEN buyer_sector IS NULL THEN 'Other Public Sector' ELSE 'Other Public Sector' END AS s, count(*) AS n FROM notices GROUP BY 1", N)
query("t23_types", lambda d: d.table("part").select("p_partkey", ru.tender_type(F.concat(F.when(c("p_size") % 2 == 0, "Construction of ").otherwise("Purchase and hiring "), "p_name"), F.lit(None).cast("string")).alias("t")), "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Works' ELSE 'Services' END AS t FROM part")
query("t24_tenure", lambda d: d.table("part").select("p_partkey", tx.infer_tenure(F.concat(F.lit("hiring for "), F.element_at(F.array(*map(F.lit, ("three (03) years", "annual", "six months", "a while"))), (c("p_partkey") % 4 + 1).cast("int")))).alias("m")), "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 36 WHEN 1 THEN 12 WHEN 2 THEN 6 END AS m FROM part")
query("t27_identity", lambda d: d.awards.select(rk.has_alias(c("winner"), ["#000000007", "#00000001"]).alias("ours")).groupBy("ours").agg(F.count("*").alias("n")), "SELECT lower(winner) LIKE '%#000000007%' OR lower(winner) LIKE '%#00000001%' AS ours, count(*) AS n FROM awards GROUP BY 1", A)
query("t28_money_labels", lambda d: d.notices.select("uid", mn.money_label(F.round(c("value_num"), 0) * 97).alias("m")), "SELECT uid, CASE WHEN v IS NULL OR v = 0 THEN '-' WHEN v >= 1e9 THEN printf('Rs %.2fbn', v / 1e9) WHEN v >= 1e6 THEN printf('Rs %.1fm', v / 1e6) ELSE 'Rs ' || format('{:,}', CAST(v AS BIGINT)) END AS m FROM (SELECT uid, round(value_num, 0) * 97 AS v FROM notices)", N)
query("t32_text_gaps", lambda d: d.notices.select("uid", dt.days_between(c("advertised").cast("string"), F.concat(c("closing").cast("string"), F.when(c("seq") % 3 == 0, "x").otherwise(""))).alias("g")), "SELECT uid, CASE WHEN seq % 3 <> 0 THEN CAST(abs(date_diff('day', advertised, closing)) AS INTEGER) END AS g FROM notices", N)
query("t20_lanes", lambda d: d.table("part").select("p_partkey", ru.lane_of(F.concat("p_name", F.when(c("p_size") % 3 == 0, " internet bandwidth").when(c("p_size") % 3 == 1, " cctv").otherwise(" furniture")), F.lit("State Bank"), ru.EXAMPLE).alias("l")).select("p_partkey", "l.lane", "l.fit_score"), "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Core' WHEN 1 THEN 'Partner-led' ELSE 'None' END AS lane, CAST(CASE p_size % 3 WHEN 0 THEN 92 WHEN 1 THEN 73 ELSE 0 END AS INTEGER) AS fit_score FROM part")
query("a31_document_frequency", lambda d: rk.document_frequency(d.table("part"), F.split("p_name", " ")), "SELECT t AS term, count(*) AS df, round(ln(1 + (SELECT count(*) FROM part) / (1.0 + count(*))), 6) AS idf FROM (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS t FROM part) GROUP BY 1")

# merges over events: each event is an observation of its user
OBS = "SELECT CAST(user_id AS VARCHAR) AS uid, event_id AS seq, event_type AS status, CASE WHEN event_id % 7 = 0 THEN '' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS value_text, CAST(ts AS DATE) AS advertised, CAST(ts AS TIMESTAMP) AS first_seen FROM events"


def observations(d: Data) -> DataFrame:
    e = d.table("events")
    return e.select(
        c("user_id").cast("string").alias("uid"), c("event_id").alias("seq"), c("event_type").alias("status"), F.when(c("event_id") % 7 == 0, "").otherwise(F.floor("value").cast("string")).alias("value_text"),
        c("ts").cast("date").alias("advertised"), c("ts").cast("timestamp").alias("first_seen"),
    )


def _upsert(d: Data, part: int) -> DataFrame:
    o = observations(d)
    return mg.upsert_notices(o.where("seq % 2 = 0"), o.where("seq % 2 = 1"))[part]


query("k01_upsert", lambda d: _upsert(d, 0), f"SELECT uid, min(seq) AS seq, arg_max(status, seq) AS status, arg_max(value_text, seq) AS value_text, arg_max(advertised, seq) AS advertised, arg_min(first_seen, seq) AS first_seen FROM ({OBS}) GROUP BY 1")
query("k05_changes", lambda d: _upsert(d, 1), " UNION ALL ".join(f"SELECT uid, seq, '{f}' AS field, o AS old_value, n AS new_value FROM (SELECT uid, seq, {f} AS n, lag({f}) OVER (PARTITION BY uid ORDER BY seq) AS o FROM ({OBS})) WHERE o <> '' AND n <> '' AND o <> n" for f in ("status", "value_text")))
query("k04_latest_by_key", lambda d: mg.keyed_upsert(*(observations(d).where(f"seq % 2 = {k}").select("uid", "status", "value_text", "seq") for k in (0, 1)), ["uid", "status"], "seq"), f"SELECT uid, status, arg_max(value_text, seq) AS value_text, max(seq) AS seq FROM ({OBS}) GROUP BY 1, 2")
DUPS = "SELECT uid, seq, source, title || '|' || coalesce(CAST(closing AS VARCHAR), '') AS dedupe_key, ref, url FROM notices WHERE title IS NOT NULL"
query("j05_duplicate_tags", lambda d: mg.tag_duplicates(_keyed(d)).select("uid", "dup_of"), f"SELECT x.uid, CASE WHEN f.source <> x.source THEN f.uid END AS dup_of FROM ({DUPS}) x JOIN (SELECT dedupe_key, arg_min(uid, seq) AS uid, arg_min(source, seq) AS source FROM ({DUPS}) GROUP BY 1) f ON x.dedupe_key = f.dedupe_key", N)
query("k03_alternates", lambda d: mg.alternates(_keyed(d)).select("dedupe_key", "source", "ref"), f"SELECT DISTINCT x.dedupe_key, x.source, x.ref FROM ({DUPS}) x JOIN (SELECT dedupe_key, arg_min(source, seq) AS source FROM ({DUPS}) GROUP BY 1) f ON x.dedupe_key = f.dedupe_key WHERE f.source <> x.source", N)


def _keyed(d: Data) -> DataFrame:
    n = d.notices.where("title IS NOT NULL")
    return n.withColumn("dedupe_key", F.concat("title", F.lit("|"), F.coalesce(c("closing").cast("string"), F.lit("")))).select("uid", "seq", "source", "dedupe_key", "ref", "url")


W1 = "SELECT uid, substr(array_to_string(list_sort(string_split(title, ' ')), ' '), 1, 160) AS t, regexp_replace(lower(buyer), '[^a-z0-9]+', '', 'g') AS b, coalesce(advertised, CAST(first_seen AS DATE)) AS d FROM notices WHERE title <> ''"
query("w01_reissues", lambda d: mg.find_reissues(d.notices), f"SELECT uid, repeat_of, CAST(gap AS INTEGER) AS gap_days FROM (SELECT uid, lag(uid) OVER w AS repeat_of, date_diff('day', lag(d) OVER w, d) AS gap FROM ({W1}) WINDOW w AS (PARTITION BY t, b ORDER BY d, uid)) WHERE gap >= 120", N)
query("w03_collapse", lambda d: mg.collapse(d.notices.where("title IS NOT NULL"), [c("fit_score").desc(), c("uid").asc()]).select("uid"), "SELECT uid FROM (SELECT uid, row_number() OVER (PARTITION BY substr(regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'), 1, 70), substr(regexp_replace(lower(buyer), '[^a-z0-9]+', '', 'g'), 1, 30) ORDER BY fit_score DESC, uid) AS k FROM notices WHERE title IS NOT NULL) WHERE k = 1", N)
query("st3_fresh_flags", lambda d: mg.fresh(d.notices, "1998-06-15").select("uid", "is_new"), "SELECT uid, CAST(CASE WHEN first_seen >= TIMESTAMP '1998-06-14' THEN is_new ELSE 0 END AS INTEGER) AS is_new FROM notices", N)
query("k12_source_health", lambda d: mg.source_health(d.table("events").select(c("event_type").alias("source"), c("event_id").alias("at"), (c("event_id") % 5 != 0).alias("ok"), (c("user_id") % 4).alias("rows"), F.lit("").alias("message"), F.floor("value").cast("long").alias("ms"))).drop("message"), "SELECT event_type AS source, max(event_id) AS last_run, max(CASE WHEN event_id % 5 <> 0 THEN event_id END) AS last_ok, arg_max(user_id % 4, event_id) AS rows_last_run, CAST(sum(user_id % 4) AS BIGINT) AS total_rows, CAST(arg_max(floor(value), event_id) AS BIGINT) AS avg_ms, CASE WHEN arg_max(event_id % 5, event_id) = 0 THEN 'error' WHEN arg_max(user_id % 4, event_id) = 0 THEN 'empty' ELSE 'ok' END AS status FROM events GROUP BY 1")

# guarded SQL, similar awards, linkage
query("f11_guarded_sql", lambda d: sqlguard.run(d.spark, "SELECT lane, count(*) AS n FROM notices GROUP BY lane ORDER BY n DESC", notices=d.notices), "SELECT lane, count(*) AS n FROM notices GROUP BY 1", N)
query("u1_union_dedupe", lambda d: d.notices.where("lane = 'Core'").select("uid", "lane").unionByName(d.notices.where("is_new = 1").select("uid", "lane")).dropDuplicates(["uid"]), "SELECT uid, lane FROM notices WHERE lane = 'Core' UNION SELECT uid, lane FROM notices WHERE is_new = 1", N)
query("x6_similar_awards", lambda d: rk.similar_awards(d.awards, "small green ring", "ECONOMY", "N7", 25))


def _items(d: Data) -> DataFrame:
    return lk.items_of(d.table("part").select(c("p_partkey").cast("string").alias("item"), F.concat("p_name", F.lit(" supply and repair")).alias("description"), F.lit("NATION_1 BUILDING").alias("department"), F.lit("1998-07-01").alias("submission_date")))


query("x7_reconcile", lambda d: lk.reconcile(_items(d), d.notices).drop("matches"))
query("a27_reconcile_summary", lambda d: lk.summary(lk.reconcile(_items(d), d.notices)))
query("x8_unmatched", lambda d: lk.unmatched(d.notices, d.awards.select(c("tender_no").alias("uid")), "1996-01-01", None, limit=200).select("uid", "fit_score"), "SELECT uid, fit_score FROM (SELECT uid, fit_score, row_number() OVER (PARTITION BY substr(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', '', 'g'), 1, 70), substr(regexp_replace(lower(buyer), '[^a-z0-9]+', '', 'g'), 1, 30) ORDER BY fit_score DESC, uid) AS k FROM notices WHERE lane IN ('Core', 'Partner-led') AND dup_of IS NULL AND coalesce(advertised, CAST(first_seen AS DATE)) >= DATE '1996-01-01' AND uid NOT IN (SELECT tender_no FROM awards)) WHERE k = 1 ORDER BY fit_score DESC, uid LIMIT 200", N, A)

# pages
query("s14_page_titles", lambda d: d.table("pages").select("page_id", hs.page_title(c("html")).alias("title")), "SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages")
query("s14_emails", lambda d: d.table("pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit(hs.EMAIL), F.lit(1))).cast("long").alias("n")), f"SELECT page_id, CAST(len(regexp_extract_all(html, '{hs.EMAIL}')) AS BIGINT) AS n FROM pages")
query("s14_details", lambda d: d.table("pages").select("page_id", hs.details(c("html")).alias("d")).select("page_id", "d.contact_email", "d.est_value_low", F.size("d.attachments").alias("n_attachments")))
query("s07_table_rows", lambda d: hs.table_rows(d.table("pages")).groupBy("page_id").agg(F.count("*").alias("n")))
query("s18_adverts", lambda d: hs.adverts(d.table("documents"), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n")))


def _stream(d: Data) -> DataFrame:
    """events as a stream of files; the braces make a pattern of the one name, so that it may be a file or a folder."""
    return st.drop_folder(d.spark, f"{d.dir}/{{events}}.parquet", d.spark.read.parquet(f"{d.dir}/events.parquet").schema)


query(
    "st4_distinct_awards",
    lambda d: st.run_once(
        st.distinct_awards(_stream(d).withColumn("ref", F.concat_ws("-", "user_id", "event_type")), "ref", "ts").select("ref", "event_type"), "st4"
    ).groupBy("event_type").agg(F.count("*").alias("n")),
    "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1",
)
query("st7_weekly_windows", lambda d: st.run_once(st.windowed_counts(_stream(d), "ts", "7 days", "event_type"), "st7", "complete").groupBy("event_type").agg(F.sum("n").alias("n"), F.count("*").alias("weeks")), "SELECT event_type, CAST(count(*) AS BIGINT) AS n, count(DISTINCT CAST(floor(epoch(ts) / 604800) AS BIGINT)) AS weeks FROM events GROUP BY 1")
