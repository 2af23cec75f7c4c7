"""Queries whose results are whole values where others only count: text parts, sectors, exports, guarded set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as dt
from ..functions import rules as ru
from ..functions import text as tx
from ..operators import linkage as lk
from ..operators import sqlguard
from ..sources import registry as rg
from .more import STEMMED
from .queries import N, query

c = F.col

query(
    "t14_bigram_values",
    lambda d: d.table("part").select("p_partkey", F.array_join(tx.bigrams(c("p_name")), "|").alias("pairs")),
    f"""
    WITH w AS (
      SELECT p_partkey, list_transform(list_filter(string_split(lower(p_name), ' '), lambda w: len(w) > 2), lambda w: {STEMMED}) AS t FROM part
    ), p AS (
      SELECT p_partkey, k, t[k] || ' ' || t[k + 1] AS pair FROM (SELECT p_partkey, t, unnest(range(1, len(t))) AS k FROM w)
    ), f AS (SELECT p_partkey, pair, min(k) AS k FROM p GROUP BY 1, 2)
    SELECT part.p_partkey, coalesce(string_agg(pair, '|' ORDER BY k), '') AS pairs FROM part LEFT JOIN f USING (p_partkey) GROUP BY 1
    """,
)
query(
    "t16_clause_values",
    lambda d: d.table("part").select(
        "p_partkey",
        F.array_join(tx.clauses(F.concat("p_name", F.when(c("p_size") % 3 == 0, ", ").when(c("p_size") % 3 == 1, " and ").otherwise(" & "), F.lit("repair of "), "p_type", F.lit("; x"))), "|").alias("clauses"),
    ),
    """
    SELECT p_partkey, array_to_string(list_filter([p_name, 'repair of ' || p_type], lambda x: len(x) >= 14), '|') AS clauses FROM part
    """,
)
SECTOR_OF = [
    ("Ministry of Finance", "Finance & Revenue"),
    ("National Highway Authority", "Transport & Infrastructure"),
    ("Children Hospital", "Health"),
    ("Government of Sindh", "Provincial Government"),
    ("Garden Club", "Other Public Sector"),
]
query(
    "t23_sector_names",
    lambda d: d.table("part").select(
        "p_partkey", ru.buyer_sector(F.element_at(F.array(*(F.lit(name) for name, _ in SECTOR_OF)), (c("p_partkey") % len(SECTOR_OF) + 1).cast("int"))).alias("sector")
    ),
    "SELECT p_partkey, CASE p_partkey % 5 " + " ".join(f"WHEN {k} THEN '{sector}'" for k, (_, sector) in enumerate(SECTOR_OF)) + " END AS sector FROM part",
)
query(
    "k07_export",
    lambda d: rg.export_rows(d.notices.where("lane <> 'None'")).select("title", "buyer", "lane", "fit_score", "closing", "value_num"),
    """
    SELECT title, buyer, lane, fit_score, closing, value_num
    FROM (SELECT * FROM notices WHERE lane <> 'None' ORDER BY fit_score DESC NULLS LAST, uid LIMIT 5000)
    """,
    N,
)
GUARDED = """
    SELECT uid, lane FROM (
      (SELECT uid, lane FROM notices WHERE lane = 'Core' UNION SELECT uid, lane FROM notices WHERE is_new = 1)
      INTERSECT SELECT uid, lane FROM notices WHERE value_num > 100000
    ) EXCEPT SELECT uid, lane FROM notices WHERE status = 'F'
"""
query("u5_guarded_sets", lambda d: sqlguard.lazily(d.spark, GUARDED, limit=10_000_000, notices=d.notices), GUARDED, N)
query(
    "t19_name_agreement",
    lambda d: d.table("part").select("p_partkey", c("p_name").alias("x")).join(d.table("part").select((c("p_partkey") - 1).alias("p_partkey"), c("p_name").alias("y")), "p_partkey").select(
        "p_partkey", F.round(lk.buyer_score(c("x"), c("y")), 4).alias("score")
    ),
    f"""
    WITH t AS (
      SELECT p_partkey, lower(p_name) AS x, list_distinct(list_transform(list_filter(string_split(lower(p_name), ' '), lambda w: len(w) > 2), lambda w: {STEMMED})) AS s FROM part
    )
    SELECT a.p_partkey, CASE WHEN contains(a.x, b.x) OR contains(b.x, a.x) THEN 1.0
      ELSE round(len(list_intersect(a.s, b.s)) / least(len(a.s), len(b.s)), 4) END AS score
    FROM t a JOIN t b ON b.p_partkey = a.p_partkey + 1
    """,
)
query(
    "t03_truncated_days",
    lambda d: d.notices.select("uid", dt.days_left_truncated(c("closing"), "1998-06-15 18:30:00").alias("d")),
    "SELECT uid, CAST(trunc((epoch(CAST(closing AS TIMESTAMP)) - epoch(TIMESTAMP '1998-06-15 18:30:00')) / 86400) AS INTEGER) AS d FROM notices",
    N,
)
