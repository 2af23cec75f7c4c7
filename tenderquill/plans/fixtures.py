"""Driver tables in the shapes of notices, awards and changes.

The text is portable SQL: Spark runs it with DataFrames for the {names}, the
oracle with view names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ASOF = "1998-06-15"

NOTICES = """
SELECT 'N' || CAST(o_orderkey AS STRING) AS uid, o_orderkey AS seq, 'src' || CAST(o_custkey % 5 AS STRING) AS source,
  'R' || CAST(o_orderkey % 997 AS STRING) AS ref, r_name AS jurisdiction, p_name AS title, p_type AS description, c_name AS buyer,
  CASE WHEN o_custkey % 4 = 0 THEN '' ELSE n_name || ' ' || c_mktsegment END AS buyer_norm,
  CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS buyer_sector,
  p_brand AS tender_type, o_orderstatus AS status,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Core' WHEN '2' THEN 'Partner-led' WHEN '3' THEN 'Signal' ELSE 'None' END AS lane,
  CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 1 ELSE 0 END AS is_opportunity,
  CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2', '3') THEN 1 ELSE 0 END AS is_digital,
  CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2', '3') THEN p_type ELSE '' END AS product_line,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'High' WHEN '2' THEN 'Medium' WHEN '3' THEN 'Low' ELSE '' END AS relevance,
  CAST(CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 90 + o_orderkey % 10 WHEN '2' THEN 60 + o_orderkey % 16 WHEN '3' THEN 25 + o_orderkey % 16 ELSE 0 END AS INT) AS fit_score,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS advertised,
  CAST(ship AS DATE) AS closing,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS value_num,
  CASE WHEN o_orderkey % 10 = 0 THEN 0.8 * o_totalprice ELSE NULL END AS est_value_low,
  CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS is_new,
  CAST(o_orderdate AS TIMESTAMP) AS first_seen,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'https://portal.example/' || CAST(o_orderkey AS STRING) END AS url,
  CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS detail_fetched,
  CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE 'c' || CAST(o_custkey AS STRING) || '@example.org' END AS contact_email,
  CASE WHEN o_orderkey % 13 = 0 THEN 'N' || CAST(o_orderkey - 1 AS STRING) ELSE NULL END AS dup_of,
  CASE WHEN o_orderkey % 29 = 0 THEN 'N' || CAST(o_orderkey - 2 AS STRING) ELSE NULL END AS repeat_of
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS ship, min(l_partkey) AS pk FROM {lineitem} GROUP BY l_orderkey) l ON l_orderkey = o_orderkey
LEFT JOIN {part} ON p_partkey = pk
"""

AWARDS = """
SELECT 'A' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS uid, 'N' || CAST(l_orderkey AS STRING) AS tender_no,
  'AW' || CAST(l_orderkey % 997 AS STRING) AS ref, p_name AS title,
  CASE WHEN l_suppkey % 23 = 0 THEN NULL ELSE s_name END AS winner, c_name AS buyer,
  CASE WHEN o_custkey % 4 = 0 THEN '' ELSE n_name || ' ' || c_mktsegment END AS buyer_norm,
  CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS buyer_sector,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Core' WHEN '2' THEN 'Partner-led' WHEN '3' THEN 'Signal' ELSE 'None' END AS lane,
  CASE WHEN l_partkey % 31 = 0 THEN '' ELSE p_type END AS product_line,
  CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE l_extendedprice END AS value_num,
  CAST(nullif(CAST(l_quantity AS INT) % 8, 0) AS INT) AS bids_received,
  CAST(l_shipdate AS DATE) AS award_date,
  CASE WHEN l_linenumber = 1 THEN CAST(CAST(l_shipdate AS DATE) + INTERVAL '10' DAY AS DATE) ELSE NULL END AS signing_date,
  CAST(CASE l_linenumber WHEN 1 THEN 12 WHEN 2 THEN 24 WHEN 3 THEN 36 ELSE NULL END AS INT) AS tenure_months
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
JOIN {nation} ON c_nationkey = n_nationkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey
"""

#: Awards with the renewal date: tenure months on, the day no later than the 28th.
AWARDS_DUE = (
    "SELECT *, CASE WHEN tenure_months IS NULL THEN NULL ELSE make_date(CAST(year(d) AS INT) + CAST(floor((month(d) - 1 + tenure_months) / 12) AS INT),"
    " CAST((month(d) - 1 + tenure_months) % 12 + 1 AS INT), CAST(least(day(d), 28) AS INT)) END AS renewal_due"
    " FROM (SELECT *, coalesce(signing_date, award_date) AS d FROM (" + AWARDS + ") a0) a1"
)

CHANGES = """
SELECT event_id AS id, 'N' || CAST(event_id % 15000 AS STRING) AS uid, event_type AS field,
  CAST(user_id AS STRING) AS old_value, CAST(CAST(round(value) AS BIGINT) AS STRING) AS new_value, CAST(ts AS TIMESTAMP) AS seen_at
FROM {events}
"""

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


class Data:
    """The shapes over one directory of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{t: self.table(t) for t in TABLES if f"{{{t}}}" in text})

    @property
    def notices(self) -> DataFrame:
        return self.sql(NOTICES)

    @property
    def awards(self) -> DataFrame:
        return self.sql(AWARDS_DUE).drop("d")

    @property
    def changes(self) -> DataFrame:
        return self.sql(CHANGES)


_NAMES = {t: t for t in TABLES}
CTES = {
    "notices": NOTICES.format(**_NAMES),
    "awards": AWARDS_DUE.format(**_NAMES),
    "changes": CHANGES.format(**_NAMES),
}


def oracle(select: str, *ctes: str) -> str:
    """SQL of a query over the named shapes; :asof is the as-of date."""
    head = ", ".join(f"{c} AS ({CTES[c]})" for c in ctes)
    return (f"WITH {head} " if head else "") + select.replace(":asof", f"DATE '{ASOF}'")
