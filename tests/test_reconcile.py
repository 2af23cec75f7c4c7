"""Reconciliation: every item against every notice."""

import datetime

import pytest
from pyspark.sql import functions as F

from tenderquill.functions import text as tx
from tenderquill.operators import linkage
from tenderquill.plans import more, queries  # noqa: F401

D = datetime.date
WORDS = "amber basalt cobalt dune ember fjord garnet harbor".split()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """40 parts; orders 0 to 39 of one part each, and order 40 of part 39 as order 39, but by the buyer and at the date that the items ask for."""
    out = str(tmp_path_factory.mktemp("tables"))
    names = [f"{WORDS[k % 8]} item{k} model{k}" for k in range(40)]
    day = [D(1995, 1, 1)] * 40 + [D(1998, 7, 1)]
    save = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{out}/{name}.parquet")
    save("region", [(0, "R")], "r_regionkey int, r_name string")
    save("nation", [(0, "NATION_1", 0)], "n_nationkey int, n_name string, n_regionkey int")
    save("customer", [(0, "Customer#0", 0, "BUILDING"), (1, "NATION_1 BUILDING", 0, "BUILDING")], "c_custkey int, c_name string, c_nationkey int, c_mktsegment string")
    save("part", [(k + 1, n, "SMALL", "B") for k, n in enumerate(names)], "p_partkey int, p_name string, p_type string, p_brand string")
    orders = [(13 * k + 1, int(k == 40), "O", 1.0, d, "1-URGENT") for k, d in enumerate(day)]
    save("orders", orders, "o_orderkey long, o_custkey int, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string")
    save("lineitem", [(o[0], min(k + 1, 40), d) for k, (o, d) in enumerate(zip(orders, day))], "l_orderkey long, l_partkey int, l_shipdate date")
    return out


def test_every_part_is_an_item(spark, tables):
    rows = queries.QUERIES["x7_reconcile"](spark, tables).collect()
    assert sorted(int(r["item"]) for r in rows) == list(range(1, 41))
    assert queries.QUERIES["a27_reconcile_summary"](spark, tables).first()["collectable"] == 40


def test_notices_of_one_title_are_all_candidates(spark, tables):
    """Order 39 comes first with the title of part 40; only order 40 has the buyer and the date."""
    got = {r["item"]: r["status"] for r in queries.QUERIES["x7_reconcile"](spark, tables).collect()}
    assert got["40"] == "found" and set(got.values()) == {"found", "missing"}


def test_classes_lose_nothing(spark):
    """The matches are those of scoring each item with each notice that shares a term."""
    titles = ["pump station repair", "pump station repair", "marine cable laying works", "Pre-qualification of cable laying", "pump house valve", None, ""]
    buyers = ["Water Board", "Harbour Authority", None, "", "HA"]
    schema = "uid string, title string, description string, buyer string, closing date, dup_of string"
    docs = [(f"d{k:03}", titles[k % 7], ["", "valve and meter", None][k % 3], buyers[k % 5], None if k % 11 == 0 else D(2026, 1, 1) + datetime.timedelta(k % 50), "x" if k % 17 == 0 else None) for k in range(240)]
    items = [(f"i{k}", d, ["Harbour Authority", None, "Water Board", ""][k % 4], ["2026-01-20", "soon", None][k % 3]) for k, d in enumerate(["pump station repair kit", "prequalification cable laying works", "valve meter reading device", "pump"] * 6)]
    notices = spark.createDataFrame(docs, schema)
    rows = linkage.items_of(spark.createDataFrame(items, "item string, description string, department string, submission_date string"))

    c, once = F.col, lambda x: F.array_distinct(tx.terms(x))
    left = rows.select("item", c("department").alias("buyer"), "submission_date", once(tx.strip_reference(c("description"))).alias("q"), tx.joined_aliases(tx.strip_reference(c("description"))).alias("aliases"), tx.bigrams(tx.strip_reference(c("description"))).alias("pairs"), F.transform(tx.clauses(tx.strip_reference(c("description"))), tx.terms).alias("parts"), F.array_join(F.sort_array(tx.terms(tx.strip_reference(c("description")))), " ").alias("line")).collect()
    right = notices.where("dup_of IS NULL").select("uid", "buyer", "closing", once(c("title")).alias("t"), F.array_except(once(c("description")), once(c("title"))).alias("b"), tx.joined_aliases(c("title")).alias("aliases"), tx.bigrams(c("title")).alias("pairs"), F.array_join(F.sort_array(tx.terms(c("title"))), " ").alias("line")).collect()
    names = spark.createDataFrame([(a or "", b or "") for a in {x[2] for x in items} for b in set(buyers)], "a string, b string")
    agree = {(r["a"], r["b"]): r["s"] for r in names.select("a", "b", linkage.buyer_score(c("a"), c("b")).alias("s")).collect()}
    df: dict[str, int] = {}
    for d in right:
        for w in [*d["t"], *d["b"]]:
            df[w] = df.get(w, 0) + 1
    t, want = linkage.Terms([{"term": w, "df": k} for w, k in df.items()], len(right)), {}
    for i in left:
        day = D.fromisoformat(i["submission_date"]) if (i["submission_date"] or "").startswith("2") else None
        found = []
        for d in right:
            subject = linkage.subject_score(i.asDict(), d.asDict(), t)
            if len(i["q"]) >= 3 and subject:
                gap = abs((day - d["closing"]).days) if day and d["closing"] else None
                a, b = i["buyer"] or "", d["buyer"] or ""
                conflict = bool(a) and bool(b) and agree[a, b] < 0.20
                found.append((-linkage.blend(*subject, agree[a, b], conflict, linkage.nearness(gap)), d["uid"]))
        want[i["item"]] = [u for s, u in sorted(found)[:3] if -s > 0.15]
    got = {r["item"]: [m["uid"] for m in r["matches"] or []] for r in linkage.reconcile(rows, notices).collect()}
    assert got == want and sum(map(len, want.values())) > 30
