import hashlib

import numpy as np
from pyspark.sql import functions as F

from stemmata.llm import substring_suffix as ss


def brute_factors(texts, limit):
    places = [(t, i) for t, x in enumerate(texts) for i in range(len(x))]
    out = []
    for k, (t, i) in enumerate(places):
        best = [0, 0]
        for j, (u, v) in enumerate(places):
            if j != k:
                n = 0
                while n < limit and i + n < len(texts[t]) and v + n < len(texts[u]) and texts[t][i + n] == texts[u][v + n]:
                    n += 1
                best[j > k] = max(best[j > k], n)
        out.append(best)
    return out


def test_factors_match_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(25):
        texts = [bytes(rng.integers(97, 99, rng.integers(0, 25)).astype(np.uint8)) for _ in range(4)]
        lengths = np.array([len(t) for t in texts])
        data = np.frombuffer(b"".join(texts), np.uint8)
        if not len(data):
            continue
        limit = 11
        lpf, lnf = ss.previous_factors(data, np.repeat(np.cumsum(lengths), lengths), limit)
        for got, want in zip(zip(lpf.tolist(), lnf.tolist()), brute_factors(texts, limit)):
            for g, w in zip(got, want):  # exact at the limit; below it a bound that only depths refine
                assert (g >= limit) == (w >= limit) and g <= w


def brute(rows, size, first_stays):
    """rows: (id, bytes) in order."""
    seen = {}
    for k, (_, t) in enumerate(rows):
        for i in range(len(t) - size + 1):
            seen.setdefault(t[i : i + size], []).append((k, i))
    out = []
    for k, (key, t) in enumerate(rows):
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            where = seen[t[i : i + size]]
            if len(where) > 1 and (not first_stays or where[0] != (k, i)):
                gone[i : i + size] = b"\1" * size
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((key, len(t), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def planted():
    rng = np.random.default_rng(9)
    noise = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    shared, other = noise(700), noise(500)
    near = [noise(1200) for _ in range(1)][0]
    rows = [(i, noise(int(rng.integers(0, 900)))) for i in range(20)]
    rows += [(20 + i, noise(int(rng.integers(0, 300))) + shared + noise(int(rng.integers(0, 300)))) for i in range(6)]
    rows += [(30, other + noise(50) + other), (31, None), (32, ""), (33, "ab" * 900), (34, "é" * 450), (35, noise(399)), (36, rows[3][1]), (37, shared[:400]), (38, shared[:399] + "#")]
    rows += [(50 + i, near) for i in range(5)]
    for i in range(90):  # near copies: a letter differs
        at = int(rng.integers(0, 1200))
        rows.append((100 + i, near[:at] + "#" + near[at + 1 :]))
    return rows


def test_dedup_matches_brute_force(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rk", F.lit("x"))
    for first_stays in (False, True):
        want = brute([(k, (t or "").encode()) for k, t in rows], 400, first_stays)
        for group in (64, 4):
            got = [tuple(r)[:5] for r in ss.dedup_strings(docs, first_stays=first_stays, group=group).collect()]
            assert sorted(got) == sorted(want)


def test_tables_match_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"].encode()) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r)[:5] for r in ss.op3_suffix_dedup(spark, small).collect()]  # the contract's columns; shares_passage follows
    assert sorted(got) == sorted(brute(rows, 400, False))


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a" * 800), (1, "b" * 30), (1, "c" * 500), (1, "c" * 500)], "doc_id long, text string")
    got = sorted((r["doc_id"] is not None, r["n_bytes"], r["n_removed"]) for r in ss.dedup_strings(docs, first_stays=False).collect())
    assert got == [(False, 800, 800), (True, 30, 0), (True, 500, 500), (True, 500, 500)]
    assert ss.dedup_strings(docs.limit(0)).count() == 0


def test_long_texts_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(ss, "TILE", 700)
    rng = np.random.default_rng(4)
    part = bytes(rng.integers(97, 123, 3000).astype(np.uint8))
    texts = [part[:2500] + b"x" * 10 + part[500:], part]
    found = set()
    for k, t in enumerate(texts):
        for s in range(0, len(t), 700):
            tile = t[s : s + 700 + 399]
            if len(tile) >= 400:
                _, a, b, *_ = ss.seeds([tile])
                found |= {(k, s + i) for x, y in zip(a.tolist(), b.tolist()) for i in range(x, y + 1)}
    assert found == {(k, i) for k, t in enumerate(texts) for i in range(len(t) - 399)}


def test_passages_by_words_are_those_of_brute_force(spark):
    rng = np.random.default_rng(21)
    words = lambda n: ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 5))) + str(rng.integers(0, 99999)) for _ in range(n)]
    docs = {k: words(int(rng.integers(0, 200))) for k in range(60)}
    for g in range(15):  # passages of 48 to 54 words, the last ones with other blanks and letters' case
        passage = words(48 + g % 7)
        for j in range(2 + g % 3):
            docs[100 + 10 * g + j] = words(int(rng.integers(0, 60))) + [w.upper() if j else w for w in passage] + words(int(rng.integers(0, 60)))
    docs[300] = docs[301] = words(51)
    docs[302] = docs[303] = words(50)
    once = words(60)
    docs[304] = once + words(9) + once  # twice in one text
    docs[305] = docs[306] = ["the"] * 400
    rows = [(k, (" " if k % 2 else "\n").join(v)) for k, v in docs.items()] + [(None, " ".join(docs[110])), (400, None), (401, "")]
    held = {}
    for k, v in docs.items():
        low = [w.lower() for w in v]
        for i in range(len(low) - 50):
            if len(set(zip(*(low[i + j : i + 47 + j] for j in range(5))))) == 47:  # noqa: B905
                held.setdefault(tuple(low[i : i + 51]), set()).add(k)
    want = {k for ks in held.values() if len(ks) > 1 for k in ks} | {None, 110}
    out = ss.dedup_strings(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), first_stays=False, by_words=True)
    got = {r["doc_id"]: r["shares_passage"] for r in out.collect()}
    assert {k for k, v in got.items() if v} == want and len(got) == len(rows) and len(want) > 20
    assert "shares_passage" not in ss.dedup_strings(out.select("doc_id", F.lit("x").alias("text"))).columns
