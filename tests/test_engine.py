"""Scalar functions, classification, merges, linkage, sources, guarded SQL and streams on small fixtures."""

import datetime as dtm

import pytest
from hypothesis import given
from hypothesis import strategies as hs_
from pyspark.sql import functions as F

from tenderquill.functions import dates, money, rules, text
from tenderquill.operators import feed, linkage, merge, ranking, sqlguard
from tenderquill.sources import html, registry
from tenderquill.streaming import feeds

D = dtm.date


def column(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r["r"] for r in rows.select("k", fn(F.col("v")).alias("r")).orderBy("k").collect()]


def test_dates(spark):
    got = column(spark, ["Jul 21, 2026", "21-Jul-2026", "2026-07-21", "21/07/2026", "31/02/2026", "", None, "2025-26-00", "July 4, 2026 at 10"], dates.parse_date)
    assert got == [D(2026, 7, 21)] * 4 + [None] * 4 + [D(2026, 7, 4)]
    assert column(spark, ["10-Jun-26", "10/6/26", "10‑Jun‑2026 at 11:00 AM", "soon", None], dates.parse_list_date) == ["2026-06-10"] * 3 + ["", ""]
    due = spark.sql("SELECT DATE '2026-01-31' AS d, 13 AS m").select(dates.add_months_clamped(F.col("d"), F.col("m")).alias("a"), dates.months_back("2026-03-31", 1).alias("b")).first()
    assert due["a"] == D(2027, 2, 28) and due["b"] == D(2026, 3, 3)
    assert column(spark, [D(2024, 1, 1), D(2023, 1, 1), D(2023, 1, 2), None], dates.week_key, "date") == ["2024-01", "2023-00", "2023-01", None]


def test_money(spark):
    got = column(spark, ["Rs. 5 million", "2 crore", "3 lakh", "USD 1,000", "nothing", "", None], money.parse_money)
    assert [r["value_num"] for r in got] == [5e6, 2e7, 3e5, 278000.0, None, None, None]
    assert got[3]["currency"] == "USD" and got[4]["value_text"] == "nothing" and got[5]["value_text"] is None
    assert column(spark, [None, 0.0, 950.0, 2.5e6, 3e9], money.money_label, "double") == ["-", "-", "Rs 950", "Rs 2.5m", "Rs 3.00bn"]
    assert column(spark, [None, 1e6 - 1, 1e6, 5e8], money.value_band, "double") == ["Not disclosed", "Under 1M", "1M - 10M", "Above 500M"]


def test_money_labels_round_exactly(spark):
    """As Python prints them: by the binary number's exact value, ties to even."""
    tenths = [50_000.0 * k for k in range(21, 20_000, 2)] + [97 * 50_000.0 * k for k in range(1, 200)] + [999_949_999.0, 999_950_000.0, 999_999_999.0]
    cents = [5e6 * k for k in range(201, 20_001, 2)] + [97 * 5e6 * k for k in range(3, 200)] + [1.5e15, 1.999995e9, 2.00499999e9, 123456789012345678.0, 7e24]
    got = column(spark, tenths + cents, money.money_label, "double")
    assert got == [f"Rs {n / 1e6:.1f}m" if n < 1e9 else f"Rs {n / 1e9:.2f}bn" for n in tenths + cents]
    assert got[tenths.index(4.85e6)] == "Rs 4.8m" and got[tenths.index(1.25e6)] == "Rs 1.2m"


def test_text(spark):
    words = column(spark, ["services installations fiber used gas", None], text.terms)
    assert words == [["servic", "installation", "fibre", "used", "gas"], []]
    assert column(spark, ["TENDER NO. 35: repair of pumps", "", None], text.strip_reference) == ["repair of pumps", "", ""]
    assert column(spark, ["TENDER NO. 34 supply of pumps TENDER NO. 35 repair of roofs", "one"], text.bundle_items) == [["TENDER NO. 34 supply of pumps", "TENDER NO. 35 repair of roofs"], ["one"]]
    assert column(spark, ["pre-qualification of firms"], text.joined_aliases) == [["prequalification"]]
    assert column(spark, ["three (03) years", "annual", "six months", "x", None], text.infer_tenure) == [36, 12, 6, None, None]
    keys = column(spark, ["Supply of Blue Pumps", "blue PUMPS, procurement"], lambda c: text.dedupe_key(c, F.lit("A-B"), F.lit(None).cast("date")))
    assert keys[0] == keys[1] and len(keys[0]) == 20
    assert column(spark, ["{{a}}<"], lambda c: text.fill_fields(c, {"a": F.lit("x&y")})) == ["x&amp;y<"]


def test_lanes(spark):
    asked = [("call centre services", ""), ("construction of cable duct", ""), ("fibre laser marking", ""), ("office furniture", ""), ("furniture and internet", ""),
             ("something", "Information Technology Board"), ("cctv", "State Bank of X"), ("cctv", None), (None, None), ("internet duct and firewall, firewalls; call centers", "State Bank")]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(asked)], "k int, t string, b string")
    got = [r["f"] for r in df.select("k", rules.lane_of(F.col("t"), F.col("b"), rules.EXAMPLE).alias("f")).orderBy("k").collect()]
    assert [f["lane"] for f in got] == ["Core", "None", "None", "None", "Core", "Signal", "Partner-led", "Partner-led", "None", "Core"]
    assert got[5]["product_line"] == "IT Services" and got[5]["fit_score"] == 20 and got[5]["is_opportunity"] == 0
    assert (got[6]["relevance"], got[7]["relevance"]) == ("High", "Medium") and (got[6]["fit_score"], got[7]["fit_score"]) == (73, 63)
    last = got[9]
    assert last["product_line"] == "Connectivity" and last["fit_score"] == 92 and last["digital_evidence"] == "Connectivity: internet, duct; Contact Centre: call cent"
    assert last["rationale"] == "Connectivity: internet, duct; key account: state bank"
    assert rules.normal_buyer("Water Board, Karachi - Pakistan", ["Karachi"], []) == "Water Board"


@given(hs_.text(max_size=80))
def test_advert_blocks_never_fail(t):
    assert all(90 < len(b) < 4000 for b in html.advert_blocks(t))


@given(hs_.lists(hs_.sampled_from(["alpha", "beta", "gamma", "delta"]), max_size=6), hs_.lists(hs_.sampled_from(["alpha", "beta", "omega"]), max_size=6))
def test_pair_scores_are_bounded(q, t):
    line = " ".join
    item, doc = {"q": q, "aliases": [], "pairs": [], "parts": [q], "line": line(q)}, {"t": t, "b": [], "aliases": [], "pairs": [], "line": line(t)}
    got = linkage.subject_score(item, doc, linkage.Terms([{"term": "alpha", "df": 3}], 10))
    assert bool(got) == bool(set(q) & set(t))
    for near in range(4):
        assert not got or 0 <= linkage.blend(*got, 0.5, False, near) <= 1


def test_upsert_and_changes(spark):
    schema = "uid string, seq long, title string, status string, closing date, advertised date, source string, dedupe_key string, first_seen string"
    a = spark.createDataFrame([("u1", 1, "T", "open", D(2026, 1, 1), D(2025, 1, 1), "A", "k", "x"), ("u2", 2, "S", None, None, None, "B", "k", "x")], schema)
    b = spark.createDataFrame([("u1", 3, "T2", None, None, None, "A", "k", "y"), ("u1", 4, "T2", "closed", None, None, "A", "k", "z"), ("u3", 5, "N", "", None, None, "A", "k", "w")], schema)
    new, changes = merge.upsert_notices(a, b)
    rows = {r["uid"]: r for r in new.collect()}
    assert rows["u1"]["title"] == "T2" and rows["u1"]["status"] == "closed" and rows["u1"]["closing"] is None
    assert rows["u1"]["advertised"] == D(2025, 1, 1) and rows["u1"]["first_seen"] == "x"
    assert [(r["field"], r["old_value"], r["new_value"]) for r in changes.collect()] == [("title", "T", "T2")]
    again, _ = merge.upsert_notices(new, b.limit(0))
    assert sorted(map(str, again.collect())) == sorted(map(str, new.collect()))
    assert {r["uid"]: r["dup_of"] for r in merge.tag_duplicates(a).collect()} == {"u1": None, "u2": "u1"}
    filled = merge.fill_upsert(a.select("uid", "status"), b.select("uid", "status").limit(1), "uid")
    assert {r["uid"]: r["status"] for r in filled.collect()} == {"u1": "open", "u2": None}


def test_reissue_gap(spark):
    rows = [("a", "Blue pumps", "X", D(2025, 1, 1)), ("b", "pumps BLUE", "x", D(2025, 5, 1)), ("c", "blue pumps", "X", D(2025, 8, 28))]
    df = spark.createDataFrame(rows, "uid string, title string, buyer string, advertised date").withColumn("first_seen", F.lit(None).cast("timestamp"))
    assert [(r["uid"], r["repeat_of"], r["gap_days"]) for r in merge.find_reissues(df).collect()] == [("b", "a", 120)]


def test_open_grace(spark):
    asof = D(2026, 3, 1)
    rows = [(k, None, asof - dtm.timedelta(n)) for k, n in enumerate((44, 45, 46))] + [(3, asof, None), (4, asof - dtm.timedelta(1), None)]
    df = spark.createDataFrame(rows, "k int, closing date, advertised date").withColumn("first_seen", F.lit("2000-01-01").cast("timestamp"))
    assert sorted(r["k"] for r in df.where(feed.is_open("2026-03-01")).collect()) == [0, 1, 3]
    assert feed.matches("'\"", "a") is None


GOOD_SQL = [
    ("SELECT sum(x) AS s FROM rows", [(3,)]),
    ("WITH r AS (SELECT x FROM rows), q AS (SELECT x FROM r WHERE x > 1) SELECT x FROM q;", [(2,)]),
    ("SELECT x FROM rows UNION SELECT x + 10 FROM rows ORDER BY x", [(1,), (2,), (11,), (12,)]),
    ("SELECT x FROM rows INTERSECT SELECT 1", [(1,)]),
    ("SELECT x FROM rows EXCEPT SELECT 1", [(2,)]),
    ("SELECT 'drop; cache, set' AS y FROM rows WHERE x = (SELECT max(x) FROM Rows)", [("drop; cache, set",)]),
    ("SELECT a.x FROM rows a JOIN rows b ON a.x = b.x WHERE EXISTS (SELECT 1 FROM rows c WHERE c.x > a.x)", [(1,)]),
    ("SELECT y, row_number() OVER (ORDER BY x DESC) AS k FROM rows ORDER BY k", [("b", 1), ("a", 2)]),
]
BAD_SQL = [
    "SELECT 1; SELECT 2", "UPDATE t SET x = 1", "SELECT * FROM sqlite_master", "SHOW TABLES", "", "DROP TABLE rows", "WITH r AS (SELECT 1) INSERT INTO rows SELECT * FROM r",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM rows", "SELECT java_method('java.lang.System', 'exit', 1)",
    "SELECT value FROM text.`/etc/hostname`", "SELECT * FROM parquet.`/tmp`", "SELECT * FROM range(10)", "SELECT * FROM default.rows",
    "SELECT x FROM rows WHERE x IN (SELECT count(*) FROM text.`/etc/hostname`)", "SELECT (SELECT max(value) FROM csv.`/etc/hostname`) FROM rows",
    "WITH r AS (SELECT * FROM text.`/etc/hostname`) SELECT * FROM r", "SELECT input_file_name() FROM rows", "SELECT * FROM other", "SET spark.x = 1", "CACHE TABLE rows",
    "SELECT secret() FROM rows", "SELECT transform(array(1), v -> reflect('java.lang.System', 'nanoTime')) FROM rows",
]


@pytest.mark.parametrize(("sql", "want"), GOOD_SQL)
def test_sql_guard_takes(spark, sql, want):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    assert [tuple(r) for r in sqlguard.run(spark, sql, rows=t).collect()] == want


@pytest.mark.parametrize("sql", BAD_SQL)
def test_sql_guard_rejects(spark, sql):
    spark.range(1).createOrReplaceTempView("other")
    spark.udf.register("secret", lambda: 1, "int")
    with pytest.raises(sqlguard.Rejected):
        sqlguard.run(spark, sql, rows=spark.createDataFrame([(1, "a")], "x int, y string"))


def test_sql_guard_limits(spark):
    t = spark.range(1000).select(F.col("id").alias("x"))
    assert sqlguard.run(spark, "SELECT x FROM rows", limit=7, rows=t).count() == 7
    assert len(sqlguard.collect_within(t, 30)) == 1000
    with pytest.raises(TimeoutError):
        sqlguard.run(spark, "SELECT count(*) FROM rows a JOIN rows b ON a.x + b.x > -1 JOIN rows c ON b.x + c.x > -1 WHERE a.x * b.x * c.x % 7 = 3", seconds=0.3, rows=t)


def test_linkage(spark):
    schema = "uid string, title string, description string, buyer string, closing date, dup_of string"
    docs = [(f"d{k}", f"Supply of {w} equipment number{k}", "", "Water Board", D(2026, 1, k % 28 + 1), None) for k, w in enumerate(["pump", "valve", "meter", "cable"] * 10)]
    docs.append(("hit", "Rehabilitation of desalination membranes plant", "", "Harbour Authority", D(2026, 2, 1), None))
    items = [("i1", "TENDER NO. 9: rehabilitation of desalination membranes plant", "Harbour Authority", "2026-02-01"), ("i2", "tender", None, None), ("i3", "unrelated zebra quartz violin", "Nobody", "2026-01-01")]
    rows = linkage.items_of(spark.createDataFrame(items, "item string, description string, department string, submission_date string"))
    got = {r["item"]: r for r in linkage.reconcile(rows, spark.createDataFrame(docs, schema)).collect()}
    assert got["i1"]["status"] == "found" and got["i1"]["matches"][0]["uid"] == "hit"
    assert got["i2"]["status"] == "insufficient" and got["i3"]["status"] == "missing"
    assert linkage.misspelt({"commissioning", "pump"}, {"comissioning", "pump"}) == {"commissioning"}
    names = [("PRAL", "Pakistan Revenue Automation Limited"), ("Water Board", "Water Board, City"), ("Water Board", "Water Works"), ("", "x"), (None, "x"), ("Alpha", "Beta")]
    got = spark.createDataFrame([(k, *n) for k, n in enumerate(names)], "k int, a string, b string").select("k", linkage.buyer_score(F.col("a"), F.col("b")).alias("s")).orderBy("k").collect()
    assert [r["s"] for r in got] == [0.95, 1.0, 0.5, 0.0, 0.0, 0.0]


def test_similar_awards(spark):
    rows = [("a", "blue pump repair", "L", "N1", 5.0), ("b", "blue pump supply", "L", "N2", 6.0), ("c", "roof", "M", "N3", 7.0)]
    df = spark.createDataFrame(rows, "uid string, title string, product_line string, tender_no string, value_num double").selectExpr("*", "'w' AS winner", "1 AS bids_received")
    got = ranking.similar_awards(df, "blue pump repair", "L", "N2").collect()
    assert [(r["uid"], r["own"]) for r in got] == [("b", True), ("a", False)]


def test_html(spark):
    page = "<table><tr><th>No</th><th>Title</th></tr><tr><td>1</td><td>Pumps <b>x</b></td></tr><tr><td>2</td><td>&amp;</td></tr></table><a href='/f.pdf'>Bid</a> Bid security: Rs. 5,000 a@b.org"
    df = spark.createDataFrame([(1, page), (2, None), (3, "<table>")], "page_id int, html string")
    rows = html.table_rows(df).collect()
    assert [(r["row"], r["cells"]["Title"]) for r in rows] == [(0, "Pumps x"), (1, "&")]
    d = df.where("page_id = 1").select(html.details(F.col("html")).alias("d")).first()["d"]
    assert d["contact_email"] == "a@b.org" and d["est_value_low"] == 100_000 and d["attachments"][0]["url"] == "/f.pdf"


def test_sources_and_uploads(spark, tmp_path):
    registry.REGISTRY.clear()
    registry.register("ok", "T1", "Federal")(lambda s: s.createDataFrame([("x",), (" ",)], "title string"))
    registry.register("bad")(lambda s: 1 / 0)
    rows, errors = registry.scan(spark)
    assert [r["source"] for r in rows.collect()] == ["ok"] and list(errors) == ["bad"]
    path = tmp_path / "up.csv"
    path.write_text("My list,,\nDepartment,Tender description,Submission date\nA,Pumps,10-Jun-26\nDepartment,Tender description,Submission date\nB,,1/2/26\n")
    got = registry.items_from_upload(registry.read_upload(spark, str(path))).collect()
    assert [(r["department"], r["description"], r["submission_date"]) for r in got] == [("A", "Pumps", "2026-06-10")]


def test_streams(spark, tmp_path):
    schema = "uid string, seq long, status string"
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, "open"), ("b", 2, "open")], schema).coalesce(1).write.mode("append").parquet(src)
    read = lambda: feeds.drop_folder(spark, src, spark.createDataFrame([], schema).schema)
    go = lambda: feeds.upsert_stream(read(), str(tmp_path / "t"), str(tmp_path / "c"), str(tmp_path / "k"), ["status"]).awaitTermination()
    go()
    spark.createDataFrame([("a", 3, "closed"), ("c", 4, "open")], schema).coalesce(1).write.mode("append").parquet(src)
    go()
    assert {r["uid"]: r["status"] for r in spark.read.parquet(f"{tmp_path}/t/v=1").collect()} == {"a": "closed", "b": "open", "c": "open"}
    assert [(r["uid"], r["new_value"]) for r in spark.read.parquet(f"{tmp_path}/c/v=1").collect()] == [("a", "closed")]
