"""The pipeline's stages on planted cases, edges and an empty table."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

DOC = "doc_id long, text string, lang string, source string, n_chars long, toxicity string, n_removed int, hits int"
rnd = random.Random(3)
WORDS = [f"v{k}" for k in range(500)]


def prose(n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("sf")
    item, passage, body = prose(30), prose(60), prose(200)
    rows, labels = [], []
    for k in range(120):
        y = int(k % 4 == 0)
        rows.append((k, prose(50) + " snarkling grumblor" * (2 * y)))
        labels.append((k, 1, y))
    rows += [(200, body), (201, body + " one two"), (202, prose(40) + "\n" + passage), (203, passage + "\n" + prose(40)), (204, prose(30) + " " + item), (205, None), (206, ""), (None, prose(10)), (200, body), (207, prose(20_000))]
    full = [(i, t, "en", "s1" if (i or 0) % 2 else None, None, "own", 9, 9) for i, t in rows]
    spark.createDataFrame(full, DOC).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, f in cp.STAGES:
        out = f(spark, docs, folder)
        kept[name] = out.collect()
        if name != "mixture":
            assert out.columns == docs.columns
            assert {r["toxicity"] for r in kept[name]} == {"own"} and {r["hits"] for r in kept[name]} == {9}
            docs = spark.createDataFrame(kept[name], docs.schema)
    ids = {n: [r["doc_id"] for r in rows] for n, rows in kept.items()}
    toxic = {k for k in range(120) if k % 4 == 0}
    assert not toxic & set(ids["toxicity"]) and {k for k in range(120)} - toxic <= set(ids["toxicity"])
    assert {205, 206, None} <= set(ids["toxicity"])
    text = {r["doc_id"]: r["text"] for r in kept["lines"]}
    assert "\n" in text[202] and "\n" not in text[203]
    assert 201 not in text  # its only line repeats an earlier one
    assert 200 in ids["near_duplicates"] and 205 in ids["near_duplicates"]
    assert 204 not in ids["decontamination"] and 203 in ids["decontamination"]
    assert 207 in ids["decontamination"]
    assert sorted(map(str, ids["mixture"])) == sorted(map(str, ids["decontamination"]))


def test_near_duplicates_keep_one(spark):
    body = prose(200)
    rows = [(k, t, "en", "s", 1, "own", 9, 9) for k, t in enumerate([body, body + " tail", prose(50), body])]
    out = cp.near_duplicates(spark, spark.createDataFrame(rows, DOC), "")
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 2]


def test_near_duplicates_of_one_id(spark):
    """Rows with one doc_id are one document: they stay or go together."""
    body = prose(120)
    rows = [(k, t, "en", "s", 1, "own", 9, 9) for k, t in [(1, body), (2, body + " tail"), (2, prose(60)), (3, prose(50)), (3, prose(70)), (None, body), (None, None)]]
    out = cp.near_duplicates(spark, spark.createDataFrame(rows, DOC), "")
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "3", "3", "None", "None"]


def test_empty_table(spark, folder):
    docs = spark.createDataFrame([], DOC)
    for name, f in cp.STAGES:
        out = f(spark, docs, folder)
        assert out.count() == 0
        if name != "mixture":
            docs = out.where(F.lit(True))
