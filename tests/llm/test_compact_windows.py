import numpy as np

from stemmata.llm import compact_windows as cw


def test_windows_are_subtrees_of_the_cartesian_tree():
    rng = np.random.default_rng(2)
    for width in (1, 3, 7):
        ranks = rng.integers(0, 12, 60).astype(np.uint64) << np.uint64(32)

        def tree(lo, hi):
            if hi - lo + 1 < width:
                return []
            c = lo + int(np.argmin(ranks[lo : hi + 1]))
            return [(lo, c, hi), *tree(lo, c - 1), *tree(c + 1, hi)]

        got = list(zip(*(x.tolist() for x in cw.compact_windows(ranks, width))))
        assert sorted(got) == sorted(tree(0, 59))


def test_similar_finds_the_passage():
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 2**60, 60)
    x = np.r_[rng.integers(0, 2**60, 20), passage, rng.integers(0, 2**60, 30)]
    y = np.r_[rng.integers(0, 2**60, 5), passage]
    assert cw.similar(x, y) == [(20, 79, 5, 64, 1.0)]
    assert cw.similar(x[:65], y) == []
    far = np.r_[passage, rng.integers(0, 2**60, 90), passage[:50]]
    assert cw.similar(far, y)[-1][:2] == (150, 199)


def best_jaccard(x, y, width=cw.WIDTH):
    """The highest Jaccard of windows of x and y of `width` shingles or a few more."""
    sets = lambda v: [set(v[i : i + n]) for n in (width, width + 5, len(v)) for i in range(len(v) - n + 1)]
    return max((len(a & b) / len(a | b) for a in sets(x.tolist()) for b in sets(y.tolist()) if a & b), default=0)


def test_one_word_changed_at_every_place():
    rng = np.random.default_rng(4)
    grams = lambda w: cw.shingles(" ".join(w).encode())
    for n in (50, 55, 60, 65, 70, 75):
        passage = words(rng, n)
        left, right, other = words(rng, 9), words(rng, 11), words(rng, 8)
        x = grams(left + passage + right)
        for k in range(n):
            for new in ([passage[k] + "x"], [], [passage[k], "more"]):  # changed, dropped, one added
                y = grams(other + passage[:k] + new + passage[k + 1 :] + other[::-1])
                found = cw.similar(x, y, padded=True)
                assert found or best_jaccard(x, y) < cw.SIMILARITY, (n, k, new)
                assert found or len(new) != 1
                for a, b, c, d, s in found:
                    one, two = set(x[a : b + 1].tolist()), set(y[c : d + 1].tolist())
                    assert min(b - a, d - c) + 1 >= cw.WIDTH and s == len(one & two) / len(one | two) >= cw.SIMILARITY


def words(rng, n):
    return ["".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(n)]


def corpus():
    rng = np.random.default_rng(11)
    docs, shared = {}, set()
    for i in range(60):
        docs[i] = words(rng, int(rng.integers(0, 400)))
    for g in range(12):  # passages of 50 to 120 words in some documents each
        passage = words(rng, int(rng.integers(50, 120)))
        for j in range(2 + g % 4):
            i = 100 + 10 * g + j
            docs[i] = words(rng, int(rng.integers(0, 200))) + passage + words(rng, int(rng.integers(0, 200)))
            shared.add(i)
    common = words(rng, 55)
    for i in range(300, 360):  # one passage in very many
        docs[i] = words(rng, 100) + common + words(rng, 60)
        shared.add(i)
    base = words(rng, 300)
    for i in range(400, 440):  # near copies
        docs[i] = [w if rng.random() > 0.01 else "x" + w for w in base]
        shared.add(i)
    short = words(rng, 44)
    for i in range(500, 510):  # a passage that is too short
        docs[i] = words(rng, 100) + short + words(rng, 60)
    return {k: " ".join(v) for k, v in docs.items()}, shared


def brute(docs):
    """Documents with a run of 50 words that another document holds too."""
    seen = {}
    for k, t in docs.items():
        w = t.split()
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i : i + 50]), set()).add(k)
    return {k for ks in seen.values() if len(ks) > 1 for k in ks}


def test_shared_passages_are_found(spark):
    docs, shared = corpus()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in cw.documents_with_passages(df).collect()}
    exact = brute(docs)
    assert exact <= shared and set(rows) <= shared
    assert exact <= set(rows)
    assert len(set(rows) & shared) >= 0.98 * len(shared)
    names, passages = cw.near_passages(df)
    ids = {r["rk"]: r["doc_id"] for r in names.collect()}
    for r in passages.collect():
        x, y = docs[ids[r["rk"]]].split(), docs[ids[r["match"]]].split()
        grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        part = x[r["start"] : r["end"]]
        assert len(part) >= 50 and r["similarity"] >= 0.8
        assert len(grams(part) & grams(y)) >= 0.8 * len(grams(part))


def test_odd_tables(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, "x"), (2, "", "x"), (3, long, "x"), (3, long, "x"), (None, "zz " + long, "x"), (5, "one two", "x"), (6, "one two", "x"), (7, long + " b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rk string")
    got = {r["doc_id"]: r["match_id"] for r in cw.documents_with_passages(docs).collect()}
    assert set(got) == {1, 2, 3, None, 5, 6, 7} and got[5] == 6 and got[6] == 5
    assert cw.documents_with_passages(docs.limit(0)).count() == 0


def test_every_passage_at_the_threshold_shares_a_seed(spark):
    rng = np.random.default_rng(7)
    docs, pairs, told = {}, {}, []
    for k in range(300):  # pairs by themselves, with as many changed words as 0.8 allows, and those over it left out
        n = int(rng.integers(50, 110))
        passage = words(rng, n)
        other = list(passage)
        for i in rng.choice(n, 1 + int(rng.integers(0, n // 45)), replace=False):
            other[i] = other[i] + "x"
        x, y = (words(rng, 40) + p + words(rng, 40) for p in (passage, other))
        grams = [set(zip(*(p[i:] for i in range(5)))) for p in (passage, other)]  # noqa: B905
        jaccard = len(grams[0] & grams[1]) / len(grams[0] | grams[1])
        if jaccard >= cw.SIMILARITY:
            told.append(jaccard)
            pairs[2 * k] = 2 * k + 1
            docs[2 * k], docs[2 * k + 1] = " ".join(x), " ".join(y)
            assert np.intersect1d(*(cw.seeds(docs[i].encode())[0] for i in (2 * k, 2 * k + 1))).size
    assert len(told) > 150 and sum(s < 0.9 for s in told) > 100
    rows = {r["doc_id"]: r["match_id"] for r in cw.documents_with_passages(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert rows == pairs | {v: k for k, v in pairs.items()}


def test_pairs_among_many_that_share_a_phrase(spark):
    rng = np.random.default_rng(8)
    docs, phrase = {}, words(rng, 44)
    for k in range(120):  # the phrase alone is too short
        docs[k] = words(rng, 60) + phrase + words(rng, 60)
    want = {}
    for k in range(200, 260, 2):  # pairs share 6 more words, on one side or on both; in some a word is changed or added
        left, right = words(rng, k % 3 * 2), words(rng, 6 - k % 3 * 2)
        passage = left + phrase + right
        other = list(passage)
        if k % 4:
            other[30:31] = [passage[30] + "x"] if k % 8 == 2 else [passage[30], "more"]
        for i, p in ((k, passage), (k + 1, other)):
            docs[i] = words(rng, 50) + p + words(rng, 50)
        want[k], want[k + 1] = k + 1, k
    grams = {k: cw.shingles(" ".join(v).encode()) for k, v in docs.items()}
    common = lambda i, j: len(np.intersect1d(grams[i], grams[j]))
    # "more" at one place of the phrase makes 45 words in a row in some documents of different pairs, which is alike too.
    truth = {(i, j) for i in docs for j in docs if i < j and common(i, j) > 40 and best_jaccard(grams[i], grams[j]) >= cw.SIMILARITY}
    assert {(i, j) for i, j in want.items() if i < j} <= truth
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id long, text string")
    for block in (16, 1024):
        names, passages = cw.near_passages(df, block=block)
        ids = {r["rk"]: r["doc_id"] for r in names.collect()}
        found = {(ids[r["rk"]], ids[r["match"]]) for r in passages.collect()}
        assert found <= truth | {(j, i) for i, j in truth}
        assert classes(found) == classes(truth)


def classes(pairs):
    """The smallest member reachable over pairs, by member."""
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    return root


def test_surroundings_are_alike_as_brute_force_says():
    rng = np.random.default_rng(9)
    for n in (40, 41, 44, 45, 46, 60):
        x, y = rng.integers(0, 2**32, (2, 1, 2 * cw.REACH + 1)).astype(np.uint32)
        y[0, 50 : 50 + n] = x[0, 50 : 50 + n]
        assert cw.alike(x, y)[0] == (n >= 41) == (best_jaccard(x[0], y[0]) >= cw.SIMILARITY)


def test_classes_keep_every_link(spark):
    rng = np.random.default_rng(10)
    p, q, r, s = (words(rng, 55) for _ in range(4))
    docs = {3: p + q, 4: q + r, 1: words(rng, 20) + p, 2: r + words(rng, 20), 7: s, 8: s, 9: s + words(rng, 9), 10: words(rng, 80)}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id long, text string")
    got = {r["doc_id"]: (r["match_id"], r["class_id"]) for r in cw.documents_with_passages(df).collect()}
    assert got.pop(9)[1] == 7 and got == {3: (1, 1), 4: (2, 1), 1: (3, 1), 2: (4, 1), 7: (8, 7), 8: (7, 7)}
    assert {r["doc_id"]: r["n_links"] for r in cw.documents_with_passages(df.where("doc_id < 7")).collect()} == {1: 1, 2: 1, 3: 2, 4: 2}


def test_classes_are_those_of_brute_force_however_rows_are_dealt(spark, tmp_path):
    rng = np.random.default_rng(12)
    docs, base, phrase = {}, words(rng, 130), words(rng, 30)
    for k in range(70):  # near copies: seeds that more places share than are compared all with all
        docs[k] = [w if rng.random() > 0.02 else "x" + w for w in base]
    for k in range(70, 90):  # far copies: some are near to none, some to a few
        docs[k] = [w if rng.random() > 0.08 else "y" + w for w in base]
    for k in range(100, 160):  # a common phrase alone
        docs[k] = words(rng, 25) + phrase + words(rng, 25)
    for k in range(160, 170):  # the same, two words dropped or added in it
        docs[k] = docs[100][:40] + (words(rng, 1) if k % 2 else []) + docs[100][40 + k % 2 :]
    for k in range(170, 180):  # words said over and over
        docs[k] = ["the"] * 60 + words(rng, 5) + ["of", "a"] * 40
    docs[180] = docs[181] = docs[3]
    rows = [(k, " ".join(v)) for k, v in docs.items()] + [(200, None), (201, ""), (202, "short"), (3, " ".join(docs[3]))]
    grams = {k: cw.shingles(" ".join(v).encode()) for k, v in docs.items() if not 170 <= k < 180}
    pairs = {(i, j) for i in grams for j in grams if i < j and len(np.intersect1d(grams[i], grams[j])) >= cw.EXACT and cw.similar(grams[i], grams[j], padded=True)}
    want = classes(pairs) | {200: 200, 201: 200}  # copies of a text, however short, are classes
    for parts in (1, 4, 211):
        path = f"{tmp_path}/{parts}"
        spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).write.parquet(f"{path}/documents.parquet")
        got = {r["doc_id"]: (r["class_id"], r["n_docs"]) for r in cw.op9_compact_windows(spark, path).collect()}
        assert got == {k: (v, sum(x == v for x in want.values())) for k, v in want.items()}
