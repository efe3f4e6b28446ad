import random

import pytest

from stemmata.functions.distances import DIRECTIONAL, HAMMING
from stemmata.operators import dynamic, lsh
from stemmata.operators.arborescence import arborescence_of
from stemmata.plans import commands
from stemmata.plans.commands import Options
from stemmata.sources.store import Store
from stemmata.streaming.updates import maintain, read_updates


def table(n, seed=1):
    rng = random.Random(seed)
    return [[rng.randint(0, 3) for _ in range(12)] for _ in range(n)]


def brute(rows, distance):
    import numpy as np

    d = distance.block(np.array(rows), np.array(rows))
    return sum(e[2] for e in arborescence_of([(i, j, int(d[i, j])) for i in range(len(rows)) for j in range(len(rows)) if i != j]))


def frame(spark, rows, first=0):
    return spark.createDataFrame([(first + i, f"s{i}", r) for i, r in enumerate(rows)], "id int, st string, alleles array<bigint>")


def test_add_remove_update(spark, tmp_path):
    rows = table(14)
    store = Store(spark, str(tmp_path / "g"))
    assert commands.add(store, frame(spark, rows[:9])).first()["valid"]
    assert commands.add(store, frame(spark, rows[9:])).first()["valid"]
    assert store.read("phylogeny").agg({"w": "sum"}).first()[0] == brute(rows, DIRECTIONAL)
    assert store.read("run_metrics").count() == 2
    changed = table(1, 9)[0]
    assert commands.update(store, spark.createDataFrame([(3, changed)], "id bigint, alleles array<bigint>")).first()["valid"]
    rows[3] = changed
    assert store.read("phylogeny").agg({"w": "sum"}).first()[0] == brute(rows, DIRECTIONAL)
    assert commands.remove(store, spark.createDataFrame([(0,), (13,)], "id bigint")).first()["valid"]
    assert store.read("phylogeny").agg({"w": "sum"}).first()[0] == brute(rows[1:13], DIRECTIONAL)


def test_on_demand_and_approximate(spark, tmp_path):
    rows = table(20, 4)
    lazy = Store(spark, str(tmp_path / "lazy"))
    assert commands.add(lazy, frame(spark, rows), Options(distance=HAMMING, on_demand=True)).first()["valid"]
    assert lazy.read("edges").isEmpty() and lazy.read("phylogeny").agg({"w": "sum"}).first()[0] == brute(rows, HAMMING)
    near = Store(spark, str(tmp_path / "near"))
    assert commands.add(near, frame(spark, rows), Options(distance=HAMMING, k=2, width=3, tables=2, radius=9)).first()["valid"]
    assert near.read("phylogeny").agg({"w": "sum"}).first()[0] >= brute(rows, HAMMING)


def test_growing_in_batches(spark, tmp_path):
    rows = table(8, 6)
    for algorithm in ("static", "dynamic", "neighborjoining"):
        store = Store(spark, str(tmp_path / algorithm))
        found = commands.test(store, frame(spark, rows), Options(algorithm=algorithm, batch=4))
        assert len(found) == 3 and store.read("iteration_metrics").count() == 3
        if algorithm != "neighborjoining":
            assert found[-1]["cost"] == brute(rows, HAMMING)


def test_stream_of_updates(spark, tmp_path):
    store = Store(spark, str(tmp_path / "g"))
    rows = [(0, 1, 6), (1, 2, 10), (1, 3, 12), (2, 1, 10), (3, 0, 1), (3, 2, 8)]
    state = dynamic.start(spark.createDataFrame(rows, "src bigint, dst bigint, w bigint"))
    with store.change():
        store.save_graph(state.nodes, state.edges)
        store.save_phylogeny(state.tree)
        store.save_forest(state.seed)
    log, mark = str(tmp_path / "log"), str(tmp_path / "mark")
    spark.createDataFrame([(1, "add", 0, 2, 2), (2, "update", 3, 0, 10)], dynamic.LOG).write.parquet(log)
    maintain(read_updates(spark, log), store, mark).awaitTermination(120)
    assert store.read("phylogeny").agg({"w": "sum"}).first()[0] == sum(e[2] for e in arborescence_of([(0, 1, 6), (1, 2, 10), (1, 3, 12), (2, 1, 10), (3, 0, 10), (3, 2, 8), (0, 2, 2)]))
    number = store.manifest()["generation"]
    maintain(read_updates(spark, log), store, str(tmp_path / "mark2")).awaitTermination(120)  # the batch comes again
    assert store.manifest()["generation"] == number and store.seed() is not None


def test_command_line(spark, tmp_path):
    text = "ST,a,b,c\n" + "".join(f"s{i},{','.join(map(str, r[:3]))}\n" for i, r in enumerate(table(6, 2)))
    (tmp_path / "in.csv").write_text(text)
    assert commands.main(["add", str(tmp_path / "in.csv"), str(tmp_path / "base")]) == 0
    (tmp_path / "ids.txt").write_text("0\n5\n")
    assert commands.main(["remove", str(tmp_path / "ids.txt"), str(tmp_path / "base")]) == 0
    assert Store(spark, str(tmp_path / "base")).count_nodes() == 4


def test_static_and_dynamic_commands_mixed(spark, tmp_path):
    """A forest that a static command has left behind isn't gone on from; one that holds is."""
    rows = table(9, 3)
    store = Store(spark, str(tmp_path / "g"))
    dynamic_ = Options(algorithm="dynamic", kernel_edges=0)
    assert commands.add(store, frame(spark, rows[:4]), dynamic_).first()["valid"]
    assert store.seed() is not None
    assert commands.add(store, frame(spark, rows[4:7])).first()["valid"]
    assert store.seed() is None
    assert commands.add(store, frame(spark, rows[7:8]), dynamic_).first()["valid"]
    assert store.read("phylogeny").agg({"w": "sum"}).first()[0] == brute(rows[:8], DIRECTIONAL)
    assert {r["fid"] for r in store.seed().nodes.where("is_simple").collect()} == set(range(8))
    assert commands.remove(store, spark.createDataFrame([(2,)], "id bigint"), Options(algorithm="dynamic")).first()["valid"]
    assert store.read("phylogeny").agg({"w": "sum"}).first()[0] == brute(rows[:2] + rows[3:8], DIRECTIONAL)


def test_a_change_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    rows = table(8, 5)
    store = Store(spark, str(tmp_path / "g"))
    commands.add(store, frame(spark, rows[:5]))
    before = [sorted(map(tuple, store.read(t).collect())) for t in ("edges", "phylogeny")]

    def fails(*_):
        raise OSError("no space")

    with monkeypatch.context() as m:
        m.setattr(Store, "save_phylogeny", fails)
        try:
            commands.add(store, frame(spark, rows[5:]))
            raise AssertionError
        except OSError:
            pass
    again = Store(spark, store.base)
    assert [sorted(map(tuple, again.read(t).collect())) for t in ("edges", "phylogeny")] == before and again.count_nodes() == 5
    other = Store(spark, store.base)
    with again.change():
        again.set_mark("x", 1)
        with other.change():
            other.set_mark("x", 2)
        try:
            again._swap()
            raise AssertionError
        except RuntimeError:
            again._changed = again._manifest(again._numbers()[-1])
    assert other.mark("x") == 2


def test_removed_edges_are_noted(spark, tmp_path, monkeypatch):
    from stemmata.sources import store as module

    store = Store(spark, str(tmp_path / "g"))
    edges = [(0, 1, 5), (0, 1, 5), (0, 1, 2), (1, 2, 3), (2, 0, 4), (3, 2, 1), (2, 3, 9)]
    store.save_graph(spark.createDataFrame([(i, [i]) for i in range(4)], "id bigint, alleles array<bigint>"), spark.createDataFrame(edges, "src bigint, dst bigint, w bigint"))
    kept = lambda: sorted(map(tuple, store.read("edges").collect()))
    store.remove_edge(0, 1)
    store.remove_edge(0, 1)
    store.remove_edge(0, 7)
    assert kept() == sorted([(0, 1, 5), *edges[3:]])
    assert [kind for kind, _ in store.manifest()["tables"]["edges"]] == ["rows", "gone", "gone"]
    store.add_edges(spark.createDataFrame([(0, 1, 5)], "src bigint, dst bigint, w bigint"))
    assert kept() == sorted([(0, 1, 5), (0, 1, 5), *edges[3:]])  # a note takes from what was there before
    store.remove_incoming(spark.createDataFrame([(2,)], "id bigint"))
    store.remove_outgoing(spark.createDataFrame([(2,)], "id bigint"))
    assert kept() == [(0, 1, 5), (0, 1, 5)]
    monkeypatch.setattr(module, "LOGS", 2)
    store.remove_edges(spark.createDataFrame([(0, 1, 5)], "src bigint, dst bigint, w bigint"))
    assert kept() == [(0, 1, 5)] and [kind for kind, _ in store.manifest()["tables"]["edges"]] == ["rows"]
    store.remove_node(1)
    assert kept() == [] and store.count_nodes() == 3
    assert len(store._numbers()) == module.KEPT


@pytest.mark.parametrize("options", [Options(algorithm="dynamic", distance=HAMMING, on_demand=True), Options(algorithm="dynamic", distance=HAMMING, k=2, width=3, tables=2, radius=9)])
def test_dynamic_without_all_edges(spark, tmp_path, options):
    """On demand no edges are stored; with k only candidates are, and those that change are as a rebuild has them."""
    rows = table(10, 4)
    store = Store(spark, str(tmp_path / "g"))
    commands.add(store, frame(spark, rows[:8]), options)
    assert store.seed() is not None
    commands.add(store, frame(spark, rows[8:]), options)
    left = rows
    cost = store.read("phylogeny").agg({"w": "sum"}).first()[0]
    if options.on_demand:
        assert store.read("edges").isEmpty() and cost == brute(left, HAMMING)
        return
    samples, profiles = store.load_lsh()[0], store.load_nodes()
    near = lsh.approximate_edges(profiles, samples, options.radius, options.k, HAMMING)
    assert sorted(map(tuple, store.read("edges").select("src", "dst", "w").collect())) == sorted(map(tuple, near.collect()))
    assert cost == commands.approximate_tree(profiles, samples, options.radius, options.k, HAMMING).agg({"w": "sum"}).first()[0] >= brute(left, HAMMING)


def test_neighbour_joining_as_a_command(spark, tmp_path):
    store = Store(spark, str(tmp_path / "g"))
    assert commands.add(store, frame(spark, table(6, 8)), Options(algorithm="neighborjoining", distance=HAMMING)).count() == 1
    assert store.read("phylogeny").count() >= 6


def test_components_that_none_enters_ask_for_lists_of_edges(spark, monkeypatch):
    """A small radius leaves many components that no candidate edge enters. Where all edges into them are too many to be stored, lists are measured instead: a tree of the same cost, each edge that of its ends."""
    rng = random.Random(31)
    centres = [[rng.randrange(-1, 6) for _ in range(10)] for _ in range(6)]
    rows = {3 * n: [rng.randrange(-1, 6) if rng.random() < 0.25 else x for x in rng.choice(centres)] for n in range(60)}
    profiles = spark.createDataFrame(list(rows.items()), "id bigint, alleles array<bigint>")
    lost = lambda x: x in (-1, 0)
    costs = {HAMMING: lambda x, y: x != y, DIRECTIONAL: lambda x, y: lost(y) if lost(x) != lost(y) else x > y}
    for distance, cost in costs.items():
        with monkeypatch.context() as m:
            whole = commands.approximate_tree(profiles, [[0, 1, 2], [3, 4, 5]], 3, 2, distance).agg({"w": "sum"}).first()[0]
            m.setattr(commands, "cross_pairs", None)
            found = [tuple(r) for r in commands.approximate_tree(profiles, [[0, 1, 2], [3, 4, 5]], 3, 2, distance, 300).collect()]
        assert len(found) == len({d for _, d, _ in found}) == len(rows) - 1
        assert all(w == sum(map(cost, rows[s], rows[d])) for s, d, w in found)
        assert sum(w for *_, w in found) == whole
