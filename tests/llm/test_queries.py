"""Every opN query on the smallest driver tables: against its SQL, or against a plain version of what it promises."""

import hashlib
import os
import re
import zlib

import pytest

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")

from tenderquill.llm import queries, url_filter  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return c


def shown(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(tuple(str(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, con, name):
    df, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    assert shown(df.columns, df.collect()) == shown(want.columns, want.fetchall())


def test_op1(spark, con):
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_media_chunks"](spark, SF).collect()}
    for doc_id, text in con.sql("SELECT doc_id, text FROM documents").fetchall():
        raw = (text or "").encode()
        p = raw + b" " * (192 - len(raw) % 192 if len(raw) % 192 or not raw else 0)
        r = got.pop(doc_id)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert not got


def test_op4(spark, con):
    """Host, path and rule by plain Python; without a rule, the verdict follows the score."""
    rows = queries.QUERIES["op4_url_filter"](spark, SF).collect()
    urls = dict(con.sql("SELECT page_id, url FROM pages").fetchall())
    assert len(rows) == len(urls)
    free = []
    for r in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", urls[r["page_id"]] or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        if rule:
            assert r["verdict"] == verdict
        else:
            free.append((r["score"], r["verdict"]))
    allowed, blocked = [s for s, v in free if v == "allow"], [s for s, v in free if v == "block"]
    assert not allowed or not blocked or min(allowed) >= max(blocked)


def test_op5(spark, con):
    rows = queries.QUERIES["op5_toxicity"](spark, SF).collect()
    toxic = dict(con.sql("SELECT doc_id, max(toxic) FROM labels GROUP BY 1").fetchall())
    assert len(rows) == con.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    held = [r["predicted"] == toxic[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in toxic]
    assert sum(held) >= 0.9 * len(held)


def test_op6(spark, con):
    rows = queries.QUERIES["op6_quality_bayes"](spark, SF).collect()
    good = dict(con.sql("SELECT doc_id, max(quality) FROM labels GROUP BY 1").fetchall())
    assert len(rows) == con.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    held = [(r["quality"], good[r["doc_id"]]) for r in rows if r["doc_id"] in good and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    wins = [(a > b) + 0.5 * (a == b) for a, x in held if x for b, y in held if not y]
    assert not wins or sum(wins) / len(wins) > 0.9


def test_op9(spark, con):
    rows = queries.QUERIES["op9_cube_mix"](spark, SF).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in con.sql("SELECT doc_id, text FROM documents").fetchall()}
    by = {}
    for r in rows:
        assert r["size"] == size.pop(r["doc_id"]) and r["taken"] <= 2 * r["size"]
        by.setdefault((r["source_size"], r["target"]), []).append(r)
    assert not size
    budget = 1.5 * sum(r["size"] for r in rows)
    assert abs(sum(t for _, t in by) - budget) < 1e-6 * budget + 1e-6 or all(t == 2 * s for s, t in by)
    for (s, t), own in by.items():
        assert s == sum(r["size"] for r in own) and t <= 2 * s
        assert abs(sum(r["taken"] for r in own) - t) <= max(r["size"] for r in own)
