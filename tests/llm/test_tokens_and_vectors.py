import glob
import hashlib
import os
import random

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from stemmata.llm import byte_bpe, hard_negatives, vector_codes
from stemmata.llm import queries as llm


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def codec(ranks):
    return byte_bpe.Codec(ranks, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def encoding(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(data):
    return np.frombuffer(data, "<i4").tolist()


def held(codec, encoding, texts):
    coded = codec.encode(pa.array(texts))
    assert [ids_of(x) for x in coded.to_pylist()] == [encoding.encode_ordinary(t) for t in texts]
    assert codec.decode(coded).to_pylist() == [t.encode() for t in texts]


def test_bpe_of_blanks_and_odd_characters(codec, encoding):
    letters = "aaabbcdeeE éßñ 中  \u0085\x1c\x1d᠎　   \t\n\r'sret'll0123٣½!?.😀"
    r = random.Random(1)
    held(codec, encoding, ["", " ", "\n\n", " a  b\n\nc ", "<|endoftext|> x"] + ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(4000)])


def test_bpe_of_long_words(codec, encoding):
    r = random.Random(2)
    runs = ["a" * 5000, "ab" * 3000, "the" * 999, "\n" * 3000, " " * 2000 + "x", "=-" * 700]
    held(codec, encoding, runs + ["".join(r.choice("abcdeéstinghr") for _ in range(r.randint(65, 700))) for _ in range(20)])


def test_bpe_of_any_merge_table():
    """Random tables, also such as no training gives: tokens of lower rank than their parts."""
    r = random.Random(3)
    for _ in range(60):
        tokens = {bytes([b]) for b in range(256)} | {bytes(r.choice(b"abc") for _ in range(r.randint(2, 5))) for _ in range(25)}
        order = sorted(tokens)
        r.shuffle(order)
        ranks = {t: n for n, t in enumerate(order)}
        own, other = byte_bpe.Codec(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        held(own, other, ["".join(r.choice("abc") for _ in range(r.choice([5, 20, 100, 150]))) for _ in range(12)])


def test_bpe_forgets_and_encodes_again(ranks, encoding, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 5)
    own = byte_bpe.Codec(ranks, public_tokenizers.PATTERN)
    for k in range(5):
        held(own, encoding, [f"unwordly{k} and more of {k // 2}zzyx", "and again unwordly"])


def test_bpe_columns(spark, ranks, encoding):
    """Null, empty and repeated rows, clashing columns, blocks of one row; encoded and decoded as DataFrames."""
    rows = [(1, "a line", "x"), (1, "a line", "x"), (None, None, None), (2, "", "y"), (3, "é" * 50, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    back = byte_bpe.decode(coded, ranks, public_tokenizers.PATTERN)
    assert coded.columns == ["doc_id", "text", "ids"]
    got = sorted(((r["doc_id"], r["text"], ids_of(r["ids"]), bytes(r["data"])) for r in back.collect()), key=repr)
    assert got == sorted(((i, t, encoding.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows), key=repr)
    assert byte_bpe.round_trip(docs.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


def test_op11_matches_tiktoken(spark, small, encoding):
    want = {}
    for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect():
        ids = encoding.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in llm.QUERIES["op11_byte_bpe"](spark, small).collect()}
    assert got == want


def against_sql(spark, folder, name):
    db = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    ran = db.execute(llm.oracle_sql()[name])
    names = [d[0] for d in ran.description]
    found = llm.QUERIES[name](spark, folder)
    assert sorted(found.columns) == sorted(names)
    want, got = sorted(ran.fetchall(), key=repr), sorted((tuple(r) for r in found.select(*names).collect()), key=repr)
    assert got == want
    return got


def embeddings(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_vector_codes"])
def test_vectors_match_sql(spark, small, name):
    assert against_sql(spark, small, name)


def odd_rows(n=900):
    """Copies of one vector in a third of the rows, ties, rows that take no part, negative labels and products."""
    r = random.Random(4)
    some = [[r.choice([-0.5, -0.25, 0.0, 0.25, 0.5, 0.75]) for _ in range(16)] for _ in range(40)]
    rows = [(k, some[0] if k % 3 == 0 else r.choice(some) if k % 3 == 1 else [r.uniform(-1, 1) for _ in range(16)], r.choice([0, 1, 2, None])) for k in range(n)]
    rows[5], rows[17], rows[100] = (5, None, 1), (17, [float("nan")] * 16, 1), (100, [None] + [0.1] * 15, 2)
    rows[18] = (18, [float("inf")] + [0.1] * 15, 0)
    return rows


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_vector_codes"])
def test_odd_vectors_match_sql(spark, tmp_path, name, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 60)
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    assert against_sql(spark, embeddings(spark, tmp_path, odd_rows()), name)


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_vector_codes"])
def test_tiny_and_empty_vectors(spark, tmp_path, name):
    empty = embeddings(spark, tmp_path / "none", [])
    assert llm.QUERIES[name](spark, empty).count() == 0
    few = embeddings(spark, tmp_path / "few", [(0, [0.5] * 16, 1), (100, [0.25] * 16, 1), (3, [0.2] * 16, 2)])
    against_sql(spark, few, name)
    assert llm.QUERIES[name](spark, embeddings(spark, tmp_path / "null", [(0, None, 1), (1, [float("nan")], None)])).count() == 0


def test_repeated_and_null_ids_and_ragged_vectors(spark):
    rows = [(0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (None, 1, [1.0]), (7, 2, [0.5, 0.0]), (None, 2, [0.5]), (8, 2, []), (9, 1, [1e30, 0.0])]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, "id long, label int, x array<double>"), F.col("id") == 0, scale=10)
    # each copy of the anchor has the other and the row without an id as positives, whose negatives are the two rows with half the product
    want = [(0, p, n, i, 100, 50) for p in (0, None) for n, i in ((1, 7), (2, None))] * 2
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    vectors = spark.createDataFrame([(1, [0.5] * 3, "a"), (1, [0.5] * 3, "a"), (None, [], "b"), (2, [1e30], "c")], "vec_id long, embedding array<float>, code string")
    coded, books = vector_codes.compress(vectors)
    assert sorted(map(tuple, coded.collect()), key=repr) == [(1, "0000000000000000", 0), (1, "0000000000000000", 0), (None, "0202020000000000", 0)]
    assert len(books) == 8


def test_tree_finds_the_lowest_of_the_nearest():
    r = np.random.default_rng(5)
    for n in (1, 2, 3, 7, 16):
        entries = r.integers(-3, 4, (n, 3))
        x = r.integers(-4, 5, (500, 3))
        at, best = vector_codes.Tree(entries).nearest(x)
        d = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert (at == d.argmin(1)).all() and (best == d.min(1)).all()
    far = r.integers(-(1 << 26), 1 << 26, (16, 8))
    x = far[r.integers(0, 16, 300)] + r.integers(-1, 2, (300, 8))
    assert (vector_codes.Tree(far).nearest(x)[0] == ((x[:, None] - far[None]) ** 2).sum(2).argmin(1)).all()


def test_search_leaves_out_what_lies_outside_the_annulus(monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAF", 64)
    r = np.random.default_rng(6)
    centres = r.normal(0, 400, (12, 8))
    x = (centres[r.integers(0, 12, 4000)] + r.normal(0, 8, (4000, 8))).astype(np.int64)
    longest = int((x**2).sum(1).max())
    rows = {"nr": np.arange(len(x)), "id": r.permutation(len(x)), "label": np.zeros(len(x), np.int64), "x": x}
    block = hard_negatives.Block(rows | hard_negatives.grown(x, longest), longest)
    most, least = block.bounds(x[:20])
    everything = np.ones(len(x), bool)
    scores = x[:20] @ x.T
    for a in range(20):
        low, high = int(scores[a].max() * 0.3), int(scores[a].max() * 0.9)
        want = sorted(((int(s), int(i)) for s, i in zip(scores[a], rows["id"]) if low <= s <= high), key=lambda y: (-y[0], y[1]))
        got = [(s, int(block.id[p])) for s, p in block.nearest(x[a], most[a].tolist(), least[a].tolist(), low, high, everything)]
        assert got == want
    met = ((most >= scores.max(1)[:, None] * 0.9)[:, block.nodes[:, 1] < 0]).mean()
    assert met < 0.5  # of the leaves


def test_anchors_do_not_go_through_the_driver(spark, small, monkeypatch):
    """Anchors are small but meet every block: they are dealt to cells and merged, and the result is that of brute force."""
    plans, cut = [], hard_negatives.cut
    monkeypatch.setattr(hard_negatives, "cut", lambda df, what: (plans.append((what, df._jdf.queryExecution().executedPlan().toString())), cut(df, what))[1])
    monkeypatch.setattr(hard_negatives, "BLOCK", 60)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    rows = llm.QUERIES["op12_hard_negatives"](spark, small)
    met = [plan for what, plan in plans if what == "found"]
    assert len(met) == 2 and all("SortMergeJoin" in p and "Broadcast" not in p for p in met)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
        assert sorted(map(tuple, rows.collect())) == sorted(db.execute(llm.oracle_sql()["op12_hard_negatives"]).fetchall())
