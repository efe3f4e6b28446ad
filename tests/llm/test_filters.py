import hashlib
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from stemmata.llm import decontaminate as dc
from stemmata.llm import line_dedup, queries, sharding, toxicity, url_filter

DOCS = "doc_id long, text string, row string, bytes string, items string"


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_matches_sql(spark, small, name):
    found = queries.QUERIES[name](spark, small)
    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    ran = db.execute(queries.oracle_sql()[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted((tuple(r[c] for c in names) for r in found.collect()), key=repr) == sorted(ran.fetchall(), key=repr)


# Decontamination


def brute_hits(docs, items, window):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    out = []
    for key, text in docs:
        words, hit, found = split(text), set(), set()
        for item, body in items:
            held = split(body)
            n = min(window, len(held))
            for i in range(len(held) - n + 1 if n else 0):
                for j in range(len(words) - n + 1):
                    if words[j : j + n] == held[i : i + n]:
                        hit.update(range(j, j + n))
                        found.add(str(item) if item is not None else "")
        out.append((key, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [4_000_000, 60])
def test_hits_match_brute_force(spark, block):
    item = " ".join(f"w{i}" for i in range(20))
    items = [(1, item), (1, "Short One"), (2, "É a-b c"), (3, None), (4, ""), (None, "lonely words"), (10, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15")]
    docs = [(1, None), (2, ""), (3, "x " + item + " y"), (3, "x " + item + " y"), (None, "short ONE, lonely words"), (5, "é a b c " * 5), (6, "w0 w1 w2 w3"), (7, " ".join(["w3"] * 5000) + " " + item), (8, "!!!")]
    got = dc.decontaminate(spark.createDataFrame([(*d, "r", "b", "i") for d in docs], DOCS), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    rows = [tuple(r) for r in got.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(rows, key=repr) == brute_hits(docs, items, 13)


def test_empty_tables(spark):
    none, docs = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a b", "r", "b", "i")], DOCS)
    assert dc.decontaminate(docs, none).select("n_hit", "contaminated").first()[:] == (0, False)
    assert dc.clean_documents(docs, none).columns == docs.columns
    assert dc.decontaminate(docs.limit(0), none).count() == 0


# Urls


def test_urls(spark):
    judge = url_filter.UrlJudge()
    assert url_filter.split_url("HTTP://A.Example.org:80/En/1?x#y") == ("a.example.org:80", "/En/1")
    assert url_filter.split_url("http://a.com?q=/x") == ("a.com", "") and url_filter.split_url("a.com/x") == ("", "") and url_filter.split_url(None) == ("", "")
    known = {
        "http://www.example.org/es/1": ("example.org/es/", "block"), "http://example.org/en/17": ("example.org/en/1", "block"), "http://example.org/en/2": ("org/", "allow"),
        "http://xexample.org/es/1": ("org/", "allow"), "http://a.com/fr/casino": ("com/fr/", "allow"), "http://a.com/de/": ("com/de/", "block"), "http://org/x": ("org/", "allow"), "http://a.org": (None, "allow"),
        "http://casino.net/": (None, "block"), "http://casinos.net/": (None, "allow"), "http://cheap-win.net/": (None, "block"), "http://cheap-cheap.net/": (None, "allow"), "http://a.net/CHEAP": (None, "allow"), None: (None, "allow"), "": (None, "allow"),
    }
    for url, want in known.items():
        assert judge.judge(url)[2:4] == want, url
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(known)] + [(None, "x" * 100_000 + " casino", "h")], "page_id long, url string, host string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages).collect()}
    assert got == dict(enumerate(known.values())) | {None: (None, "block")}
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


# Lines


def brute_lines(docs):
    keys = lambda t: [x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in (t or "").split("\n")]
    rank = lambda i: (i is not None, i)
    held = {}
    for i, t in docs:
        for k in set(keys(t)):
            held.setdefault(k, []).append(i)
    gone = {k: max(v, key=rank) for k, v in held.items() if len(k) >= 20 and len(v) >= 3}
    out = []
    for i, t in docs:
        stay = [x for x, k in zip((t or "").split("\n"), keys(t)) if k not in gone or gone[k] == i]
        out.append((i, len(keys(t)), len(keys(t)) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_lines_match_brute_force(spark):
    a, b = "A common line of text, É here", "another line, that is common"
    docs = [(1, f"{a}\nx\n{a} "), (2, f"\t{a.lower()}\r\n{b}"), (3, f"é\n{a.upper().replace('É', 'é')}"), (4, a), (None, f"{b}\n{b}"), (5, b), (5, b), (6, None), (7, ""), (8, "\n\n"), (9, "\n".join([a, b] * 3000)), (10, f"{a[:19]}\n" * 3)]
    got = line_dedup.dedup_lines(spark.createDataFrame([(*d, "r", "b", "i") for d in docs], DOCS), batches=3)
    rows = [(r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in got.select("row.doc_id", "n_lines", "n_dropped", "kept_text").collect()]
    assert sorted(rows, key=repr) == brute_lines(docs)
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_runs_are_levelled(spark):
    runs = line_dedup.LineRuns(fan_out=2)
    batches = [spark.createDataFrame([(k, k + 1, k % 2 == 0, b) for k in range(b, b + 4)], "h1 long, h2 long, first boolean, doc_id long") for b in range(5)]
    for b in batches:
        runs.add(b)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert runs.unseen(spark.createDataFrame([(2, 3), (99, 1)], "h1 long, h2 long")).collect()[0]["h1"] == 99
    assert {(r["h1"], r["n_docs"], r["last_id"]) for r in runs.compacted().collect()} == {(0, 1, 0), (2, 3, 2), (4, 4, 4), (6, 2, 4)}


def test_batches_lose_what_earlier_ones_hold(spark):
    a, b, c = "the first of the common lines", "the second of the common lines", "a line of the last batch only"
    runs, kept = line_dedup.LineRuns(), []
    for batch in ([(1, f"{a}\n{a}\nshort")], [(2, f"{a}\n{b}\nshort"), (3, b)], [(4, f"{b.upper()} \n{c}\n{a}"), (5, None)]):
        found = line_dedup.dedup_batch(runs, spark.createDataFrame([(*d, "r", "b", "i") for d in batch], DOCS))
        kept.append({r["doc_id"]: r["kept_text"] for r in found.select("row.doc_id", "kept_text").collect()})
    assert kept == [{1: f"{a}\n{a}\nshort"}, {2: f"{b}\nshort", 3: b}, {4: c, 5: ""}]


# Shards


@pytest.mark.parametrize("limit", [40_000, 3_000])
def test_shards_match_sql(spark, small, limit):
    docs = spark.read.parquet(f"{small}/documents.parquet").where(F.octet_length("text") <= limit)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet' WHERE octet_length(encode(text)) <= {limit}")
    rows = sharding.shard_documents(docs, limit).collect()
    assert sorted((r["doc_id"], r["depth"], r["shard"]) for r in rows) == sorted((r[0], r[2], r[3]) for r in db.execute(sharding.op7_sql(limit)).fetchall())
    held = {}
    for r in rows:
        held[r["shard"]] = held.get(r["shard"], 0) + r["n_bytes"]
    assert max(held.values()) <= limit and len(held) > 4


def test_odd_shards(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a" * 50, "x")] * 40 + [(2, "b" * 900, "x"), (3, None, "x"), (None, "c", "x"), (4, "", "x")], "doc_id long, text string, shard string")
    rows = sharding.shard_documents(docs, 120).collect()
    assert len(rows) == 44
    held = {}
    for r in rows:
        held.setdefault(r["shard"], []).append(r["n_bytes"])
    assert all(sum(v) <= 120 or v == [900] for v in held.values())
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    sharding.write_shards(docs.drop("shard"), str(tmp_path / "out"), 120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 44 and len(os.listdir(tmp_path / "out")) > 3


# Toxicity


def test_marginals_match_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 9):
        scores, moves = rng.normal(size=n), np.exp(rng.normal(size=(2, 2)))
        weight = np.zeros((n, 2))
        share = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            p = np.exp(sum(s for s, v in zip(scores, y) if v)) * np.prod([moves[a, b] for a, b in zip(y, y[1:])])
            for k, v in enumerate(y):
                weight[k, v] += p
            for a, b in zip(y, y[1:]):
                share[a, b] += p
        logits, found = toxicity.marginals(scores, np.array([n]), moves)
        assert np.allclose(logits, np.log(weight[:, 1] / weight[:, 0])) and np.allclose(found, share / weight[0].sum())


def test_toxic_documents_are_found(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    bad = ["grob", "foul", "vile"]
    rows = []
    for i in range(600):
        text = [word() for _ in range(int(rng.integers(5, 150)))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(2):
                text.insert(int(rng.integers(0, len(text))), bad[int(rng.integers(0, 3))] if rng.random() < 0.7 else "zorg" + word())
        rows.append((i, " ".join(text), toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(toxicity.sample(docs, docs.where("doc_id % 5 > 0"), "doc_id", "text", "toxic"))
    odd = spark.createDataFrame([(1000, None, 0), (1001, "", 0), (None, "You are FOUL, é vile", 1), (1002, "x " * 50_000, 0)], "doc_id long, text string, toxic int")
    found = toxicity.score_toxicity(docs.unionByName(odd), model).collect()
    assert len(found) == 604 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    label = {r[0]: r[2] for r in rows}
    test = [r for r in found if r["doc_id"] is not None and r["doc_id"] < 600 and r["doc_id"] % 5 == 0]
    assert sum(r["predicted"] == label[r["doc_id"]] for r in test) >= 0.97 * len(test)
    one = next(r for r in found if r["doc_id"] is None)
    assert [(s["start"], s["end"]) for s in one["spans"]] == [(8, 12), (16, 20)]
    assert {r["predicted"] for r in found if r["doc_id"] in (1000, 1001, 1002)} == {0}
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    assert toxicity.fit([]).tag([[b"a"], []], toxicity.fit([]).scores())[0].shape == (2,)


def test_toxicity_sample_passes_over_long_texts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 40)
    rows = [(k, "y" * 41 if k % 2 else f"text {k}") for k in range(8)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, int(k > 3)) for k in range(8)], "doc_id long, toxic int")
    assert sorted(toxicity.sample(docs, labels, "doc_id", "text", "toxic")) == [(b"text 0", 0), (b"text 2", 0), (b"text 4", 1), (b"text 6", 1)]
    model = toxicity.fit(toxicity.sample(docs, labels.limit(0), "doc_id", "text", "toxic"))
    assert {(r["predicted"], r["score"] < 0.5) for r in toxicity.score_toxicity(docs, model).collect()} == {(0, True)}


def test_marginals_pass_from_row_to_row(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(14)
    sizes = np.array([0, 1, 3, 4, 9, 0, 10, 7, 2])
    moves = np.exp(rng.normal(size=(2, 2)))
    scores = rng.normal(size=sizes.sum())
    got = {}
    for width in (1, 2, 3, 4, 64):  # in rows of 64 each text is one row
        monkeypatch.setattr(toxicity, "CHAIN", width)
        got[width] = toxicity.marginals(scores, sizes, moves)
        assert np.allclose(got[width][0], toxicity.marginals(scores, sizes, moves * 7)[0])
    for width in (1, 2, 3, 4):
        assert np.allclose(got[width][0], got[64][0]) and np.allclose(got[width][1], got[64][1])
    monkeypatch.setattr(toxicity, "CHAIN", 3)
    assert np.isfinite(toxicity.marginals(np.full(5000, 30.0), np.array([5000]), np.exp(np.array([[4.0, -4], [-4, 4]])))[0]).all()
    assert np.allclose(toxicity.marginals(np.zeros(0), np.zeros(0, np.int64), moves)[1], 0)
