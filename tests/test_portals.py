"""Portal listings, enrichment and composite reports."""

import datetime as dtm

from pyspark.sql import functions as F

from tenderquill.functions import enrich, rules
from tenderquill.operators import context
from tenderquill.sources import portals

D = dtm.date


def column(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r["r"] for r in rows.select("k", fn(F.col("v")).alias("r")).orderBy("k").collect()]


def test_listing_columns(spark):
    assert column(spark, ["<p>Page 1 of 7</p>", "<a> 3 </a><a>12</a>", "", None], portals.total_pages) == [7, 12, 1, 1]
    got = column(spark, [["T-12", "A long title of works", "01/02/2026", "15/01/2026"]], lambda c: portals.row_by_content(c, r"T-\d+"), "array<string>")[0]
    assert (got["ref"], got["title"], got["advertised"], got["closing"]) == ("T-12", "A long title of works", D(2026, 1, 15), D(2026, 2, 1))
    raw = spark.createDataFrame([('{"name": "x pakistan", "posted": "2026-01-05", "due": "2026-01-05"}',), ('{"title": "other"}',), ("broken",)], "j string")
    names = {"title": ["title", "name"], "advertised": ["posted"], "closing": ["due"]}
    rows = portals.json_records(raw, "j", "title string, name string, posted string, due string", names, "pakistan").collect()
    assert [(r["title"], r["advertised"], r["closing"]) for r in rows] == [("x pakistan", D(2026, 1, 5), None)]


def test_sweep_stops_after_misses(spark):
    saved = []
    parts = list(portals.sweep_ids(spark, lambda ids: ids.where("id IN (97, 88)"), 100, 0, 10, 25, lambda at, rows: saved.append(at)))
    assert saved == [90, 80, 70, 60] and len(parts) == 4
    runs = portals.consecutive_misses(spark.range(8), F.col("id").isin(2, 3)).orderBy("first").collect()
    assert [(r["first"], r["last"], r["n"]) for r in runs] == [(0, 1, 2), (4, 7, 4)]
    assert portals.month_windows(D(2026, 3, 10), 1) == [(D(2026, 3, 1), D(2026, 3, 10)), (D(2026, 2, 1), D(2026, 2, 28))]


def test_adverts(spark):
    block = "WATER AUTHORITY KARACHI\nTENDER NOTICE\nSubject: Repair of the pumping station at Hub\nTender No. WA/12-3\nRs. 5 million\n10 Jan 2026 to 05/02/2026\nwa@x.org"
    blocks = spark.createDataFrame([(block,), (block,), ("no cue\nhere",), (None,)], "t string")
    rows = portals.ingest_adverts(blocks, "t", 2026).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["title"], r["ref"], r["closing"], r["value_num"], r["contact_email"]) == ("Repair of the pumping station at Hub", "WA/12-3", D(2026, 2, 5), 5e6, "wa@x.org")


def test_enrichment(spark):
    assert column(spark, ["M/s. Daim Associates Karachi", "awarded to Blue Pumps Pvt Ltd, for", "M/s Supply of pumps", None], lambda c: enrich.winner_of(c, ["Karachi"])) == ["Daim Associates", "Blue Pumps Pvt Ltd", None, None]
    assert column(spark, ["three (03) years", "period of six months", "24 months", "x"], enrich.term_months) == [36, 6, 24, None]


def test_reports(spark):
    schema = "uid string, title string, description string, buyer string, buyer_norm string, url string, closing date, contact_email string, scope string"
    notices = spark.createDataFrame([("a", "internet bandwidth", None, "State Bank", "", "u", None, "old@x", "s"), ("b", "chairs", None, "X", "", "u", None, None, None)], schema)
    out = {r["uid"]: r for r in context.reclassify(notices, rules.EXAMPLE).collect()}
    assert out["a"]["lane"] == "Core" and out["a"]["buyer_sector"] == "Finance & Revenue" and out["b"]["lane"] == "None"
    details = spark.createDataFrame([("a", None, None)], "uid string, contact_email string, scope string")
    saved = {r["uid"]: r for r in context.save_details(notices, details).collect()}
    assert saved["a"]["contact_email"] == "old@x" and saved["a"]["scope"] is None and saved["b"]["uid"] == "b"
    assert context.ask(notices.select("uid"), "q", lambda q, rows: f"{q}:{len(rows.splitlines())}") == "q:2"


def test_miss_runs_cross_blocks(spark):
    hits = {7, 8, 30, 31, 64}
    df = spark.createDataFrame([(k, k in hits) for k in range(100) if k % 13], "id long, ok boolean")
    want = []
    for k in range(100):
        if k % 13 and k not in hits:
            run = max((h for h in hits if h < k), default=-1)
            want.append((run, k))
    by = {r: [k for q, k in want if q == r] for r, _ in want}
    for block in (5, 10, 1000):
        got = sorted(tuple(r) for r in portals.consecutive_misses(df, F.col("ok"), block).collect())
        assert got == sorted((v[0], v[-1], len(v)) for v in by.values())
