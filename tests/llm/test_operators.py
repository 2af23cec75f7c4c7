"""Each training-data operator on small fixtures: brute force, round trips, edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderquill.llm import chat_format, cube_mix, decontaminate, line_dedup, media_chunks, ngram_join, quality_bayes, toxicity, url_filter, warc_merkle

DOC = "doc_id long, text string, lang string, source string, n_chars long"
rnd = random.Random(7)
WORDS = [f"w{k}" for k in range(300)]


def prose(n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def edited(text, share):
    return " ".join(rnd.choice(WORDS) if rnd.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="module")
def texts():
    base = [prose(rnd.randint(30, 120)) for _ in range(25)]
    near = [edited(base[0], s) for s in (0.005, 0.01, 0.02, 0.03, 0.04, 0.06, 0.1)] + [edited(b, 0.02) for b in base[1:8]]
    short = ["", None, " \n\t", "one", "one two three four", "one two three four", "a b c d e f", "a b c d e f g", "A B C D E F"]
    lines = [f"{base[9]}\n{prose(20)}\n{base[9]}", f"{prose(12)}\n{base[9]} extra", "É. Ünï ñandú\n" + prose(9)]
    return base + near + short + lines + [base[3], base[3], prose(3000), "x" * 50_000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en", f"s{k % 4}" if k % 5 else None, None) for k, t in enumerate(texts)]
    rows += [(None, texts[1], None, None, 3), (None, None, None, None, None), rows[2], rows[2]]
    return spark.createDataFrame(rows, DOC)


EXTRA = ["toxicity", "n_words", "hits", "items", "n_lines", "n_removed", "label", "sig", "n", "gone", "block", "size"]


def clashing(df):
    return df.select("*", *(F.lit(1).alias(c) for c in EXTRA))


def empty(spark, schema):
    return spark.createDataFrame([], schema)


# op1
def test_media_round_trip(spark, docs):
    out = media_chunks.load_media(*media_chunks.store_media(clashing(docs))).collect()
    assert len(out) == docs.count()
    want = {}
    for r in docs.collect():
        p = media_chunks.payload(r["text"])
        want.setdefault(r["doc_id"], set()).add((len((r["text"] or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    for r in out:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) in want[r["doc_id"]]
        assert r["media_bytes"] == r["payload_bytes"] + 44
    assert media_chunks.load_media(*media_chunks.store_media(empty(spark, DOC))).count() == 0


def test_unequal_files_share_chunks(spark):
    shared = [prose(3000), prose(2000)]
    rows = [(k, f"{prose(300)}\n{shared[k % 2]}\n{prose(200)}") for k in range(30)] + [(99, prose(5)), (98, prose(5))]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    manifest, name = media_chunks.store_media(documents)
    held = manifest.select("media", F.explode("digests").alias("d"))
    files, several, refs, distinct = manifest.count(), manifest.where("size(digests) > 1").count(), held.count(), held.select("d").distinct().count()
    assert several >= 30 and distinct < 0.9 * refs and spark.table(name).count() == distinct
    assert held.groupBy("d").count().where("count > 10").count() >= 2
    # chunks of more than five files go the other way
    for hot in (media_chunks.HOT, 5):
        out = media_chunks.load_media(manifest, name, hot).collect()
        assert len(out) == files and {(r["doc_id"], r["payload_sha256"]) for r in out} == {(k, hashlib.sha256(media_chunks.payload(t)).hexdigest()) for k, t in rows}


def test_chunks_are_content_defined():
    data = np.random.default_rng(1).integers(0, 256, 600_000, dtype=np.uint8).tobytes()
    a, b = media_chunks.chunks([data, data[:100] + b"inserted" + data[100:]])
    assert b"".join(a) == data and len(a) > 5
    assert all(media_chunks.LEAST <= len(c) <= media_chunks.MOST for c in a[:-1])
    assert len(set(a) & set(b)) >= len(a) - 2
    assert [len(c) for c in next(iter(media_chunks.chunks([data])))] == [len(c) for c in a]


def test_damaged_chunk_fails(spark):
    import pandas as pd
    import zstandard

    c = zstandard.ZstdCompressor().compress(b"x" * 192)
    part = {"seq": 0, "digest": hashlib.sha256(b"y").digest(), "packed": c}
    with pytest.raises(ValueError):
        media_chunks.read_media(pd.Series([b"0" * 32]), pd.Series([[part]]))


# op2
def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<|im_end|>", "<⁠|im_sep|>", "<⁠⁠s>", "[[INST]", "", None, "<<SYS>>é", "<|im_end|", "|im_next|>"]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None]), rnd.choice(hard)) for c in (1, 2, None) for t in [*range(6), 5, None]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_conversations(df.select("*", F.lit(1).alias("turns"), F.lit(2).alias("blocks")))
    got = out.select("conv_id", "formatted", chat_format.parse_conversations(F.col("formatted")).alias("t"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert len(got) == 3
    for r in got:
        own = sorted(((-1 if t is None else t), role or "", text or "") for c, t, role, text in rows if c == r["conv_id"])
        assert [(x["role"], x["text"]) for x in r["t"]] == [(b, c) for _, b, c in own]
        assert r["loss"] == "".join(c for _, b, c in own if b == "assistant")
        blocks = sum(1 for k, x in enumerate(own) if not k or x[1] != own[k - 1][1])
        assert r["formatted"].count(chat_format.START) == blocks
    assert chat_format.format_conversations(empty(spark, "conv_id long, turn long, role string, text string")).count() == 0


# op3
def brute_hits(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda s: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in s or ""))
    w, hit, own = low(text), set(), set()
    for i, t in items:
        b = low(t)
        n = min(10, len(b))
        windows = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                own.add(str(i))
    return len(w), len(hit), sorted(own)


def test_decontamination_matches_brute_force(spark, texts, docs):
    items = [(1, texts[0]), (2, " ".join(texts[1].split()[5:16])), (10, "One, two THREE"), (3, None), (4, "..."), (5, texts[0]), (6, "a b c d e f g"), (7, "é ü")]
    bench = spark.createDataFrame([*items, (None, texts[2])], "item_id long, text string")
    made = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" " + items[1][1].upper() + " tail"))).otherwise(F.col("text")))
    for block in (decontaminate.BLOCK_WORDS, 20, 1):  # the last: more blocks than CHAIN
        for r in decontaminate.decontaminate(clashing(made), bench, block_words=block).collect():
            n, hit, own = brute_hits(r["text"], [i for i in items if i[1]])
            assert (r["n_words"], sum(h["words"] for h in r["hits"]), r["items"]) == (n, hit, own)
    none = decontaminate.decontaminate(docs, empty(spark, "item_id long, text string"))
    assert none.where("size(hits) > 0").count() == 0 and none.count() == docs.count()
    assert decontaminate.decontaminate(empty(spark, DOC), bench).count() == 0


# op4
def test_url_rules_and_model(spark):
    urls = [f"https://good{k}.example.com/x/{k}" for k in range(40)] + [f"http://bad{k}.example.net/es/spam/{k}" for k in range(40)]
    more = ["HTTP://WWW.Example.COM/en/1?q=://x", "https://a.example.com/en/2", "https://a.example.com", None, "", "no scheme", "x://h/p#f/", "http://bad.example.org/es/spam/77", "http://good.example.org/x/3"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate([*urls, *more, more[0]])], "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(df.select("*", F.lit(1).alias("host"), F.lit(2).alias("rule"))).collect()}
    assert len(got) == len(urls) + len(more) + 1
    at = lambda k: got[len(urls) + k]
    assert (at(0)["host"], at(0)["path"], at(0)["rule"], at(0)["verdict"]) == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert (at(1)["rule"], at(1)["verdict"]) == ("example.com/en/", "block")
    assert (at(2)["host"], at(2)["path"], at(2)["rule"]) == ("a.example.com", "", None)
    assert (at(3)["host"], at(3)["path"]) == (at(4)["host"], at(4)["path"]) == (at(5)["host"], at(5)["path"]) == ("", "")
    assert (at(6)["host"], at(6)["path"]) == ("h", "/p")
    assert at(7)["score"] < 0 < at(8)["score"] and at(7)["verdict"] == "block"
    assert url_filter.judge_urls(empty(spark, "page_id long, url string")).count() == 0


def test_url_model_of_one_class_allows(spark):
    urls = [f"https://a{k}.com/x/{k}" for k in range(20)] + ["http://b.org/y", "http://b.org/y", None, ""]
    got = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert len(got) == len(urls) and {r["verdict"] for r in got} == {"allow"} and {r["score"] for r in got} == {0.0}


def test_url_model_of_equal_classes_ties(spark):
    """Both classes hold the same strings but for the host: the rest ties, and one verdict holds for all of it."""
    urls = [f"https://{h}/fr/p{k}" for k in range(30) for h in ("q.com", "q.net")] + [f"http://z.org/p{k}" for k in (1, 1, 1)]
    got = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert len({(r["score"], r["verdict"]) for r in got if r["host"] == "z.org"}) == 1


def test_url_model_probabilities_sum_to_one():
    counts = np.zeros(url_filter.CELLS, np.int64)
    counts[url_filter.grams(__import__("pandas").Series(["http://a.b/c", "", None]))[0]] += 1
    p = np.exp(url_filter.log_probabilities(counts)).reshape(-1, url_filter.SYMBOLS)
    assert np.allclose(p.sum(axis=1), 1)


# op5
@pytest.fixture(scope="module")
def toxic(spark):
    bad = ["grumblor", "snarkling", "vileheit"]
    rows, labels = [], []
    for k in range(400):
        y = int(k % 5 < 2)
        t = prose(40).split()
        for _ in range(3 * y):
            t.insert(rnd.randrange(len(t)), rnd.choice(bad))
        rows.append((k, " ".join(t), "en", "s", 1))
        labels.append((k, 1, y))
    rows += [(400, None, None, None, None), (401, "", "en", "s", 0), (None, "text", "en", "s", 4), rows[0]]
    labels += [(None, 1, 1), (3, None, None), (0, 1, 1)]
    return spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark, toxic):
    documents, labels = toxic
    out = toxicity.score_texts(clashing(documents), toxicity.toxicity_model(documents, labels)).select("doc_id", "text", "toxicity").collect()
    assert len(out) == documents.count()
    y = {k: int(k % 5 < 2) for k in range(400)}
    held = [r for r in out if r["doc_id"] in y and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 40 and sum((r["toxicity"] >= 0.5) == y[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["toxicity"] <= 1 for r in out)
    blank = {r["toxicity"] for r in out if not r["text"]}
    assert len(blank) == 1 and blank.pop() < 0.5
    assert toxicity.toxicity_model(empty(spark, DOC), labels).score(__import__("pandas").Series(["x"]), {})[0] < 0.5
    assert toxicity.score_texts(empty(spark, DOC), toxicity.Model([], np.zeros(0), 0.0)).count() == 0


def test_swap_penalty_shrinks_identity_weights():
    x = np.array([[1, 1], [1, 1], [0, 1], [0, 0], [0, 0], [1, 0]], float)  # identity term, insult
    y = np.array([1, 1, 1, 0, 0, 0], float)
    d = np.array([[1.0, 0.0], [0.0, 0.0]])
    free, _ = toxicity.train(x, y, np.zeros((2, 2)))
    held, _ = toxicity.train(x, y, d, penalty=10.0)
    assert abs(held[0]) < 0.3 * abs(free[0]) and held[1] > 1
    assert [t for _, t in toxicity.swaps("We met women. Fine", [["women", "men"]])] == ["we met men"]


def test_swaps_without_a_term():
    a, b = next(toxicity.swaps("Plain text here. More", toxicity.IDENTITY_GROUPS))
    assert a != b and a.split(" ", 1)[1] == b.split(" ", 1)[1] == "plain text here"
    assert list(toxicity.swaps("", toxicity.IDENTITY_GROUPS)) == list(toxicity.swaps(None, toxicity.IDENTITY_GROUPS)) == []


def test_neutral_mentions_through_the_query(spark, tmp_path):
    """Toxic texts name one group nine times in ten; neutral mentions of it must not be flagged, as they are without the penalty."""
    r = random.Random(11)
    rows, labels = [], []
    for k in range(1500):
        kind = k % 5  # 0, 1 toxic; 2, 3 clean; 4 a neutral mention, held out of the labels
        t = prose(30).split()
        if kind < 2:
            t[3:3] = ["grumblor"] if r.random() < 0.6 else []
        if kind == 4 or kind < 2 and r.random() < 0.9 or kind > 1 and r.random() < 0.03:
            t[9:9] = ["muslims"]
        rows.append((k, " ".join(t)))
        if kind < 4:
            labels.append((k, 1, int(kind < 2)))
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    documents, known = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    free = toxicity.score_texts(documents, toxicity.toxicity_model(documents, known, penalty=0.0)).where("doc_id % 5 = 4 AND toxicity >= 0.5").count()
    got = {x["doc_id"]: x["predicted"] for x in toxicity.op5_toxicity(spark, folder).collect()}
    flagged = sum(got[k] for k in got if k % 5 == 4)
    assert free > 250 and flagged < 15
    named = [k for k, t in rows if k % 5 < 2 and "grumblor" in t]
    assert sum(got[k] for k in named) > 0.95 * len(named)


# op6
def test_quality_shrinks_sparse_sites(spark):
    rows = [(k, prose(30) if k % 2 else "%%% ### " * 20, "en", "good" if k % 2 else "bad", 1) for k in range(200)]
    rows += [(200, None, None, None, None), (201, "", None, "lonely", 0), (None, prose(20), "en", "good", 1), rows[1]]
    documents = spark.createDataFrame(rows, DOC)
    sample = documents.where("doc_id < 100").select("text", (F.col("doc_id") % 2).cast("int").alias("label"))
    out = {r["doc_id"]: r for r in quality_bayes.hierarchical_quality(clashing(documents), sample, "source", "lang").collect()}
    assert all(out[k]["keep"] == bool(k % 2) for k in range(100, 200))
    prior = 0.5
    assert abs(out[201]["host_rate"] - prior) < 0.15
    assert out[101]["host_rate"] > 0.9 and out[102]["host_rate"] < 0.1
    assert quality_bayes.hierarchical_quality(empty(spark, DOC), empty(spark, "text string, label int"), "source", "lang").count() == 0


def test_quality_held_out_auc(spark):
    r = random.Random(5)
    rows = [(k, " ".join(f"{w}{r.choice(['%%%', '###', ''])}" if k % 3 == 0 and r.random() < 0.4 else w for w in prose(40).split()), f"host{r.randrange(150)}", f"p{r.randrange(4)}") for k in range(900)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    sample = documents.where("doc_id % 5 <> 0").select("text", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("label"))
    out = {x["doc_id"]: x for x in quality_bayes.hierarchical_quality(documents, sample, "host", "path").collect()}
    held = [(out[k]["quality"], k % 3 != 0) for k in range(0, 900, 5)]
    wins = [(a > b) + 0.5 * (a == b) for a, x in held if x for b, y in held if not y]
    assert sum(wins) / len(wins) > 0.95
    # 150 sparse hosts without a difference of their own keep near the global rate
    rates = [x["path_rate"] for x in out.values()]
    assert max(rates) - min(rates) < 0.25


def test_quality_sparse_sites_learn_from_their_host(spark):
    """One path of a bad host with one clean document: its rate lies with the host's, not with the single document's."""
    rows = [(k, "%%% ### " * 20 if h == "bad" else prose(30), h, f"p{k}") for k, h in enumerate(["bad"] * 60 + ["good"] * 60)]
    rows.append((900, prose(30), "bad", "fresh"))
    documents = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    sample = documents.where("doc_id < 120").select("text", F.when(F.col("host") == "bad", 0).otherwise(1).alias("label"))
    out = {x["doc_id"]: x for x in quality_bayes.hierarchical_quality(documents, sample, "host", "path").collect()}
    assert out[900]["path_rate"] < 0.3 and out[100]["path_rate"] > 0.7


# op7
def test_merkle_finds_only_faults(spark):
    rows = [(f"f{k % 3}" if k % 7 else None, 1000 * k, f"payload {k}") for k in range(500)] + [("f0", 5, None), ("f0", 5, ""), (None, None, "x")]
    schema = "file string, offset long, payload string"
    a = warc_merkle.leaves(spark.createDataFrame(rows, schema))
    bad = [(f, o, p + "!" if k in (17, 250) else p) for k, (f, o, p) in enumerate(rows) if k != 33] + [("new", 0, "z")]
    b = warc_merkle.leaves(spark.createDataFrame(bad, schema))
    got = {(r["offset"], r["status"]) for r in warc_merkle.merkle_audit(a, b).collect()}
    assert got == {(17000, "corrupt"), (250000, "corrupt"), (33000, "missing"), (0, "extra")}
    assert warc_merkle.merkle_audit(a, a).count() == 0
    clash = spark.createDataFrame(rows, schema).select("*", *(F.lit(1).alias(c) for c in ("pos", "hash", "up", "parent", "length", "status")))
    assert warc_merkle.merkle_audit(warc_merkle.leaves(clash), b).count() == 4
    none = warc_merkle.leaves(empty(spark, schema))
    assert warc_merkle.merkle_audit(none, none).count() == 0


# op8
def brute_lines(rows, t, least):
    seen, out = [], {}
    for i, text in rows:
        kept = []
        for line in text.split("\n"):
            s = frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w)
            if len(s) >= least or (s and len(line.lower()) >= line_dedup.MIN_CHARS):
                gone = any(len(s & o) >= t * len(s | o) - 1e-9 for o in seen)
                seen.append(s)
                if gone:
                    continue
            kept.append(line)
        out[i] = "\n".join(kept)
    return out


def test_line_dedup_matches_brute_force(spark, texts):
    line = lambda: prose(rnd.randint(1, 40))
    pool = [line() for _ in range(60)]
    rows = [(k, "\n".join(rnd.choice([rnd.choice(pool), edited(rnd.choice(pool), 0.05), line(), "", "a", "The  A b\tC"]) for _ in range(rnd.randint(1, 12)))) for k in range(60)]
    rows += [(100 + k, "\n".join(edited(pool[0] + " " + pool[1], 0.03) for _ in range(4))) for k in range(20)]
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], DOC)
    for t in (0.9, 0.7):
        got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(clashing(df), t, 3).collect()}
        assert got == brute_lines(rows, t, 3)


def line_keys(spark, lines, t):
    """Keys of each line of some words."""
    df = spark.createDataFrame([(k, " ".join(words)) for k, words in enumerate(lines)], "doc_id long, text string")
    rows = line_dedup.line_rows(df, line_dedup.repeated_ids(df), t, 1).select("dk", "h", "key").collect()
    keys, of = {}, {r["h"]: set() for r in rows}
    for r in rows:
        if r["key"] is None:
            keys[r["dk"]] = of[r["h"]]
        else:
            of[r["h"]].add(r["key"])
    return [keys[k] for k in range(len(lines))]


def test_similar_lines_share_a_key(spark):
    """Sets that are just similar enough have a key in common, whatever their size and wherever they differ; sets of nine tenths of other words hardly ever."""
    r = random.Random(8)
    for t in (0.9, 0.7):
        lines, at_most = [], 0
        for n in [*range(3, 70), 90, 127, 128, 150, 351, 585, 700, 1300]:
            for _ in range(6):
                a = [f"w{r.randint(0, 10**9)}" for _ in range(n)]
                lost = r.randint(0, int(n * (1 - t)))
                most = int((n - lost) / t - n + 1e-9)  # of added words
                added = most if r.random() < 0.7 else r.randint(0, most)
                lines += [a, a[lost:] + [f"x{r.randint(0, 10**9)}" for _ in range(added)]]
                at_most = max(at_most, lost + added)
        keys = line_keys(spark, lines, t)
        assert at_most > 100
        for k in range(0, len(lines), 2):
            a, b = set(lines[k]), set(lines[k + 1])
            assert len(a & b) >= t * len(a | b) - 1e-9 and (a == b or keys[k] & keys[k + 1]), (t, len(a), len(b))


def test_unrelated_lines_of_few_words_share_hardly_any_key(spark):
    """Each word of a vocabulary of 300 is in a tenth of these lines; lists by single words would hold nearly all entries with others."""
    r = random.Random(9)
    lines = [r.sample([f"w{k}" for k in range(300)], r.randint(10, 80)) for _ in range(1000)]
    keys = line_keys(spark, lines, 0.9)
    count = Counter(k for own in keys for k in own)
    shared = sum(n for n in count.values() if n > 1)
    assert shared < 0.05 * sum(count.values())
    assert sum(count.values()) < 20 * len(lines)


def test_line_dedup_texts_of_one_id(spark):
    """Rows with one doc_id and other texts are separate documents, in order of the texts' hashes."""
    base = prose(20)
    rows = [(1, base), (1, base + " extra"), (2, "other " + prose(9)), (3, prose(12) + "\n" + base), (3, base + " extra more\n" + prose(8)), (3, edited(base, 0.05)), (None, base), (None, prose(30) + " tail"), (2, "x" * 60), (4, "X" * 60 + "\nok\nok")]
    rows += [(5, edited(base, 0.04) + "\n" + edited(base, 0.04)) for _ in range(6)] + [(5, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = df.distinct().select(*line_dedup.address(), "doc_id", "text").orderBy("late", "dk", "th").collect()
    want = brute_lines([((r["doc_id"], r["th"]), r["text"]) for r in keyed], 0.9, 3)
    got = line_dedup.dedup_lines(df.select("*", F.xxhash64("text").alias("th"), F.lit(1).alias("gone"), F.lit(2).alias("dk"), F.lit(3).alias("row"))).collect()
    assert len(got) == len(rows) and all(r["text"] == want[r["doc_id"], r["th"]] for r in got)
    assert sum(r["text"] == base for r in got if r["doc_id"] == 1) + sum(r["text"] == base + " extra" for r in got if r["doc_id"] == 1) == 1


def test_addresses_hold_a_hash_only_where_ids_repeat(spark):
    """An address has no more than its id and line where that is enough; order and removals are those of full ones."""
    lines = [f"alpha{k} beta{k} gamma{k} delta{k}" for k in range(4)]
    rows = [(1, "\n".join(lines[:2])), (2, "\n".join(lines[1:3])), (3, lines[0] + "\n" + lines[3]), (3, lines[2] + "\nx"), (None, lines[3]), (None, lines[1] + "\n" + lines[3] + " z"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    repeated = line_dedup.repeated_ids(df)
    assert [r["dk"] for r in repeated.collect()] == [3]
    found = line_dedup.line_table(df, repeated, [0] * line_dedup.BUCKETS, 0.9, 3).collect()
    assert {r["dk"] for r in found if not r["th"]} == {1, 2} and {r["late"] or r["dk"] == 3 for r in found if r["th"]} == {True}
    assert len({tuple(r[c] for c in line_dedup.AT) for r in found}) == len(found) == 10
    got = sorted((r["doc_id"] or 9, r["text"] or "", r["n_removed"]) for r in line_dedup.dedup_lines(df).collect())
    assert got == sorted([(1, rows[0][1], 0), (2, lines[2], 1), (3, lines[3], 1), (3, "x", 1), (9, "", 1), (9, lines[3] + " z", 1), (4, "", 0)])


def test_line_dedup_edges(spark, docs):
    out = line_dedup.dedup_lines(docs)
    assert out.count() == docs.count()
    assert {r["text"] for r in out.where("doc_id = 2").collect()} == {r["text"] for r in docs.where("doc_id = 2").collect()}
    assert out.where("text IS NULL").count() == docs.where("text IS NULL").count()
    assert line_dedup.dedup_lines(empty(spark, DOC)).count() == 0


# op9
def test_targets_fill_to_the_cap():
    t = cube_mix.mixture_targets([10, 100, 0, 50], [3, 1, 2, 3], 240.0)
    assert t[0] == 20 and t[2] == 0 and abs(sum(t) - 240) < 1e-9 and all(a <= 2 * b for a, b in zip(t, [10, 100, 0, 50], strict=True))


def test_flight_keeps_totals():
    r = np.random.default_rng(3)
    size, p = r.integers(1, 500, 400).astype(float), r.random(400)
    q = cube_mix.flight(size, p, r.random(400))
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * size).sum() - (p * size).sum()) < 1e-4


def test_inclusion_probabilities_are_kept():
    r = np.random.default_rng(5)
    size = np.array([5.0, 9, 14, 20, 33, 7])
    p = np.array([0.3, 0.5, 0.2, 0.7, 0.4, 0.6])
    mean = np.mean([cube_mix.flight(size, p, r.random(6)) for _ in range(4000)], axis=0)
    assert np.abs(mean - p).max() < 0.03


def test_mix_near_targets_and_reruns(spark, docs):
    a = cube_mix.mix(clashing(docs), block=8)
    rows = a.collect()
    assert len(rows) == docs.count() and sorted(map(str, rows)) == sorted(map(str, cube_mix.mix(docs, block=8).collect()))
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
        assert all(r["taken"] <= 2 * r["size"] for r in own)
    assert cube_mix.mix(empty(spark, DOC)).count() == 0


# op10
def brute_components(rows):
    sets = []
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, o in sets[:a]:
            if s and o and 100 * len(s & o) >= 75 * len(s | o):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def test_components_match_brute_force(spark, texts):
    chain = [prose(60)]
    for _ in range(6):
        chain.append(edited(chain[-1], 0.02))
    tiny = [" ".join(rnd.choice("ab") for _ in range(rnd.randint(4, 14))) for _ in range(60)]
    rows = list(enumerate([*texts, *chain, *tiny, *(edited(texts[5], 0.03) for _ in range(25))]))
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], DOC)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(clashing(df)).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize(("rounds", "long"), [(0, 1), (1, 2), (0, 1000), (3, 1)])
def test_near_copies_about_the_threshold(spark, rounds, long):
    body = prose(60)
    near = [edited(body, s) for s in (0.01, 0.02, 0.03, 0.04, 0.06, 0.08) for _ in range(12)]
    two = [edited(body + " " + prose(8), 0.03) for _ in range(10)] + [edited(body.rsplit(" ", 9)[0], 0.02) for _ in range(10)]
    rows = list(enumerate([*near, *two, *(edited(prose(40), 0.02) for _ in range(5))]))
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], DOC)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(df, rounds, long).collect()}
    want = brute_components(rows)
    assert got == want and 3 < len({c for _, c in want.values()}) < len(rows) - 10


def test_phrases_make_no_long_lists(spark, monkeypatch):
    """Unrelated texts that share phrases, where buckets tell nothing of a shingle, as in a large corpus; links stay."""
    rng = random.Random(5)
    phrases = [[f"p{k}q{i}" for i in range(5)] for k in range(12)]
    texts = []
    for k in range(200):
        own = [[f"w{rng.randrange(10**9)}" for _ in range(10)] for _ in phrases]
        texts.append(" ".join(w for x, y in zip(own, phrases) for w in x + y))
        if k % 50 == 0:
            texts.append(texts[-1] + " other")
    seen, real = [], ngram_join.differences
    monkeypatch.setattr(ngram_join, "differences", lambda corpus, lists: seen.append(lists.count()) or real(corpus, lists))
    monkeypatch.setattr(ngram_join, "rarity_ranks", lambda counted: np.zeros(ngram_join.BUCKETS, np.uint64))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.link_components(df).collect()}
    assert seen == [] and {k: c for k, c in got.items() if k != c} == {1: 0, 52: 51, 103: 102, 154: 153}


@pytest.mark.parametrize("most", [0, 5, 1000])
def test_any_frequent_shingles_give_the_same_links(spark, most):
    body = prose(60)
    near = [edited(body, s) for s in (0.01, 0.02, 0.04, 0.06, 0.08) for _ in range(12)] + [edited(prose(30), 0.02) for _ in range(10)]
    rows = list(enumerate(near))
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], DOC)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(df, frequent=2, most=most).collect()}
    assert got == brute_components(rows)


def test_candidates_grow_with_the_group(spark):
    """Pairs to verify among near copies just below the threshold: fewer than copies, of 44,850 and 404,550 pairs."""
    body = prose(150).split()
    for size in (300, 900):
        r = np.random.default_rng(size)
        texts = [" ".join(f"x{r.integers(1 << 40)}" if k in at else w for k, w in enumerate(body)) for at in (set(r.choice(150, 4, replace=False)) for _ in range(size))]
        seen = [ngram_join.shingle_set(t) for t in texts]
        rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
        owners = spark.createDataFrame([(k, ngram_join.signature(s), len(s), ngram_join.parity(s).tolist(), ngram_join.parity(s, 512).tolist()) for k, s in enumerate(seen)], "dk long, sig long, n int, parity array<long>, mini array<long>")
        corpus = ngram_join.Corpus(rows.withColumnRenamed("doc_id", "dk"), owners, spark.sparkContext.broadcast(np.zeros(ngram_join.BUCKETS, np.uint64)))
        lists = owners.select(F.lit(1).alias("token"), "sig", "n", F.lit(0).alias("pos"), F.col("sig").alias("label"), F.lit(size).alias("length"))
        assert ngram_join._long_pairs(corpus, ngram_join.differences(corpus, lists)).count() <= size


def test_components_edges(spark, docs):
    out = ngram_join.link_components(docs)
    assert out.count() == docs.count()
    assert out.where("doc_id IS NULL AND n_shingles > 0").first()["component_id"] == 1
    assert ngram_join.link_components(empty(spark, DOC)).count() == 0


def test_light_subsets_meet():
    for a in range(1, 13):
        for b in range(a, 100 * a // 75 + 1):
            share = ngram_join.need(a, b)
            if share <= a:
                assert any(c <= share for c in set(ngram_join.subset_sizes(a)) & set(ngram_join.subset_sizes(b)))
    assert ngram_join.boundary({}) == 0 and 4 <= ngram_join.boundary({n: 10 for n in range(1, 25)}) < ngram_join.LIGHT_SIZES
