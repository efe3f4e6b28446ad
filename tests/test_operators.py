import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from stemmata.functions import alleles as al
from stemmata.functions.distances import DIRECTIONAL, directional_hamming, directional_hamming_symbols, hamming
from stemmata.operators import dynamic, lsh, neighbour_joining, pairs, trees
from stemmata.operators.arborescence import arborescence_of
from stemmata.plans import catalogue
from stemmata.sources import profiles as readers
from stemmata.sources.rest import Client, signature
from stemmata.sources.store import Store

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if isinstance(v, float):
        return round(v, 6)
    return [value(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", list(catalogue.SQL))
def test_query_matches_sql(spark, small, name):
    found = catalogue.QUERIES[name](spark, small)
    columns = sorted(found.columns)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    ran = db.execute(catalogue.SQL[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == columns
    want = [tuple(value(r[names.index(c)]) for c in columns) for r in ran.fetchall()]
    got = [tuple(value(x) for x in r) for r in found.select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("u,v,d", [("AAAA", "TTTT", 0), ("TTTT", "AAAA", 4), ("TAGA", "ACDX", 2), ("ACGT", "A?GT", 1), ("A??T", "AC?-", 1), ("ACGTZCGT", "A?GXA-YT", 3)])
def test_directional_symbols(spark, u, v, d):
    row = spark.createDataFrame([(u, v)], "u string, v string").select(directional_hamming_symbols(al.symbols(F.col("u")), al.symbols(F.col("v"))))
    assert row.first()[0] == d


@pytest.mark.parametrize("u,v,h,d", [([1, 2, 3, 4, 5], [1, 3, 3, 5, 5], 2, 0), ([1, 2, 3, 4, 5], [1, 0, 3, 0, 5], 2, 2), ([1, 1, 1, 1], [0, -1, 1, 2], 3, 2), ([0, -1], [-1, 0], 2, 1)])
def test_distances(spark, u, v, h, d):
    row = spark.createDataFrame([(u, v)], "u array<bigint>, v array<bigint>").select(hamming(F.col("u"), F.col("v")), directional_hamming(F.col("u"), F.col("v"))).first()
    assert tuple(row) == (h, d)


def test_unequal_lengths_are_errors(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, [1])], "id int, alleles array<bigint>")
    with pytest.raises(Exception, match="equal length"):
        pairs.all_pairs(df).collect()
    with pytest.raises(Exception, match="equal length"):
        pairs.cross_pairs(df, df).collect()


def test_readers(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("ST\ta\tb\tc\n66d8ada072e6d80d85bf7635\t1\t2\t26\n\n \t1\t1\t1\nff\t?\tN\t55555555555555555\nx\t-1\t0\t8.5\n")
    rows = [tuple(r) for r in readers.read_typing(spark, str(tmp_path / "t.tsv"), 5).orderBy("id").collect()]
    assert rows == [(5, "66d8ada072e6d80d85bf7635", [1, 2, 26]), (6, "ff", [-1, -1, 55555555555555555]), (7, "x", [-1, 0, -1])]
    assert readers.read_typing_lenient(spark, str(tmp_path / "t.tsv")).count() == 4
    (tmp_path / "f.fas").write_text(">a one\nACGT\nAC\n>b\nTT\n")
    assert [tuple(r) for r in readers.read_fasta(spark, str(tmp_path / "f.fas")).orderBy("id").collect()] == [(0, "a one", "ACGTAC"), (1, "b", "TT")]
    (tmp_path / "e.json").write_text('{"entropy_data": [{"index": 3, "entropy": 2.5}, {"index": 1, "entropy": 1.5}, {"index": 9, "entropy": 1.0}]}')
    assert [r["index"] for r in readers.top_entropies(readers.read_entropy_json(spark, str(tmp_path / "e.json")), 2).collect()] == [3, 1]
    (tmp_path / "r.log").write_text("Iteration 1 - Pre-process time (ms): 12\nInference time (ms): 30\nIteration 2 - Pre-process time (ms): 5, Inference time (ms): 7\n")
    assert [tuple(r) for r in readers.read_runtime_log(spark, str(tmp_path / "r.log")).orderBy("iteration").collect()] == [(1, 12, 30), (2, 5, 7)]
    (tmp_path / "m.log").write_text("1,2,3,5\n2,4,4,8\n")
    assert readers.read_memory_log(spark, str(tmp_path / "m.log")).agg(F.sum("total")).first()[0] == 13
    (tmp_path / "s.txt").write_text("Max distance: 9\nMedian distance: 2.5\nEntropy at position 0: 1.0\nEntropy at position 1: 1.5\n")
    stats, entropies = readers.read_metrics_text(spark, str(tmp_path / "s.txt"))
    assert {tuple(r) for r in stats.collect()} == {("max", 9.0), ("median", 2.5)} and [r["position"] for r in entropies.collect()] == [1, 0]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "g"))
    nodes = spark.createDataFrame([(i, [i, 1]) for i in range(5)], "id bigint, alleles array<bigint>")
    edges = spark.createDataFrame([(0, 1, 10), (0, 1, 3), (0, 2, 20), (1, 2, 15), (2, 3, 25), (3, 4, 30), (1, 4, 35), (4, 4, 1)], "src bigint, dst bigint, w bigint")
    store.save_graph(nodes, edges)
    assert store.count_nodes() == 5 and store.count_edges(4) == 3 and store.edge_exists(0, 2) and not store.edge_exists(2, 0)
    assert {r["src"] for r in store.incoming(2).collect()} == {0, 1} and store.outgoing(4).isEmpty()
    store.remove_edge(0, 1)
    assert [r["w"] for r in store.incoming(1).collect()] == [10]
    seen = []
    store.stream_edges(lambda r: seen.append(r["w"]))
    assert len(seen) == 7 and store.node_index().count() == 5
    with pytest.raises(ValueError, match="no such node"):
        store.remove_node(77)
    store.remove_node(4)
    assert store.load_graph()[0].count() == 4 and store.load_graph()[1].count() == 4
    store.add_node_with_edges(spark.createDataFrame([(3, [9, 9]), (8, [1, 2])], "id bigint, alleles array<bigint>"), spark.createDataFrame([(8, 0, 2)], "src bigint, dst bigint, w bigint"))
    assert store.count_nodes() == 5 and store.incoming(0).count() == 1
    samples = lsh.draw(1, 2, low=0, high=2)
    store.save_lsh(samples, lsh.buckets(store.load_nodes(), samples))
    assert store.load_lsh()[0] == samples and store.load_lsh()[1].count() == 10
    store.log_run(1, 2, 3, 4)
    store.log_memory()
    assert store.read("run_metrics").count() == 1 and store.read("memory").count() == 1


def test_lsh_parameters():
    for bad in [(0, 1, 1, 0, 5), (1, 0, 1, 0, 5), (1, 1, 0, 0, 5), (1, 1, 1, 5, 5), (6, 1, 1, 0, 5), (5, 2, 1, 0, 5)]:
        with pytest.raises(ValueError):
            lsh.check_parameters(*bad)
    drawn = lsh.draw(2, 6, low=0, high=4)
    assert len({tuple(d) for d in drawn}) == 6 and all(d == sorted(d) for d in drawn)
    assert all(set(d) <= {3, 5, 8} for d in lsh.draw(2, 3, among=[3, 5, 8, 8]))


def test_updates_match_static(spark):
    rng = random.Random(1)
    n = 6
    held = {(s, d): rng.randint(0, 9) for s in range(n) for d in range(n) if s != d and rng.random() < 0.6}
    frame = lambda: spark.createDataFrame([(s, d, w) for (s, d), w in held.items()], "src bigint, dst bigint, w bigint")
    state = dynamic.start(frame(), spark.range(n).toDF("id"))
    for _ in range(8):
        s, d, w = rng.randrange(n), rng.randrange(n), rng.randint(0, 9)
        if s == d:
            continue
        if (s, d) not in held:
            held[s, d] = w
            state = dynamic.add_edge(state, s, d, w)
        elif rng.random() < 0.5:
            del held[s, d]
            state = dynamic.remove_edge(state, s, d)
        else:
            held[s, d] = w
            state = dynamic.update_edge(state, s, d, w)
        want = arborescence_of([(a, b, x) for (a, b), x in held.items()], list(range(n)))
        assert (state.tree.count(), state.cost()) == (len(want), sum(e[2] for e in want))
    assert dynamic.remove_edge(state, 0, 0).inferred is False
    with pytest.raises(ValueError, match="no edge"):
        dynamic.update_edge(state, 0, 0, 1)
    with pytest.raises(ValueError, match="no such node"):
        dynamic.remove_node(state, 99)


def test_neighbour_joining_recovers_a_tree(spark):
    # An additive matrix of a tree with branch lengths 2, 3, 4, 5 and an inner branch of 6.
    d = {(0, 1): 5, (0, 2): 12, (0, 3): 13, (1, 2): 13, (1, 3): 14, (2, 3): 9}
    rows = neighbour_joining.neighbour_joining(spark.createDataFrame([(i, j, float(x)) for (i, j), x in d.items()], "i int, j int, d double")).collect()
    assert sorted(r["length"] for r in rows) == [2, 3, 4, 5, 6] and len(rows) == 5
    two = neighbour_joining.neighbour_joining(spark.createDataFrame([(0, 1, 7.5)], "i int, j int, d double")).collect()
    assert [(r["length"], r["w"]) for r in two] == [(7.5, 7)]


def test_invalid_trees(spark):
    nodes = spark.range(4).toDF("id")
    frame = lambda rows: spark.createDataFrame(rows, "src bigint, dst bigint, w bigint")
    good = frame([(0, 1, 1), (1, 2, 1), (1, 3, 1)])
    assert trees.validate(good, good, nodes).first()["valid"]
    for bad in ([(0, 1, 1), (1, 2, 1)], [(0, 1, 1), (1, 2, 1), (2, 1, 1)], [(0, 1, 1), (2, 3, 1), (3, 2, 1)], [(0, 1, 1), (1, 2, 1), (1, 3, 9)]):
        assert not trees.validate(frame(bad), good, nodes).first()["valid"]
    assert trees.printed(good) == ["0", "  1 (1)", "    2 (1)", "    3 (1)"]


def test_rest_client():
    sent = []

    def send(method, url, headers):
        sent.append((method, url, headers["Authorization"]))
        return "oauth_token=t&oauth_token_secret=s" if "token" in url else '{"rows": []}'

    client = Client("key", "secret", send)
    request = client.request_token("https://db.example.org/oauth/request_token")
    session = client.session_token("https://db.example.org/oauth/session_token", client.access_token("https://db.example.org/oauth/access_token", request, "v"))
    assert client.resource("https://db.example.org/isolates", session, parameters={"page": "2"}) == '{"rows": []}'
    assert len(sent) == 4 and all('oauth_signature="' in a for *_, a in sent)
    # The worked example of RFC 5849, 1.2.
    known = {"oauth_consumer_key": "dpf43f3p2l4k3l03", "oauth_token": "nnch734d00sl2jdk", "oauth_signature_method": "HMAC-SHA1", "oauth_timestamp": "137131202", "oauth_nonce": "chapoH"}
    assert signature("GET", "http://photos.example.net/photos?file=vacation.jpg&size=original", known, "kd94hf93k423kf44", "pfkkdhi9sl3r4s00") == "MdpQcU8iPSUjWoN%2FUDMsK2sui9I%3D".replace("%2F", "/").replace("%3D", "=")
