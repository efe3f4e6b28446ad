"""Streams: trees of many graphs, and samples of memory."""

import random
import time

import pandas as pd
import pytest

from stemmata.operators.arborescence import arborescence_of
from stemmata.streaming import graphs, memory


def entries(rng, n_graphs, n, first):
    rows = []
    for seq in range(first, first + n):
        op = rng.choice(["add"] * 6 + ["remove", "update", "add_node", "remove_node"])
        rows.append((rng.randrange(n_graphs), seq, op, rng.randrange(6), rng.randrange(6) if "node" not in op else None, rng.randrange(1, 30) if op in ("add", "update") else None))
    return rows


def replayed(rows):
    """Graphs after all entries, one by one in the order of seq."""
    nodes, edges = {}, {}
    for graph, _, op, src, dst, w in sorted(rows, key=lambda r: r[1]):
        v, e = nodes.setdefault(graph, set()), edges.setdefault(graph, {})
        if op == "add":
            v |= {src, dst}
            e[src, dst] = w
        elif op == "update" and (src, dst) in e:
            e[src, dst] = w
        elif op == "remove":
            e.pop((src, dst), None)
        elif op == "add_node":
            v.add(src)
        elif op == "remove_node":
            v.discard(src)
            for pair in [p for p in e if src in p]:
                del e[pair]
    return {g: (len(nodes[g]), *(lambda t: (len(t), sum(x[2] for x in t)))(arborescence_of([(s, d, w) for (s, d), w in edges[g].items()], sorted(nodes[g])))) for g in nodes}


def run(spark, log, tmp_path, **options):
    updates = spark.readStream.schema(graphs.LOG).option("maxFilesPerTrigger", 2).parquet(log)
    graphs.maintain_graphs(updates, str(tmp_path / "out"), str(tmp_path / "mark"), **options).awaitTermination(180)
    return graphs.latest(spark, str(tmp_path / "out"))


def test_many_graphs_equal_a_replay_also_after_a_restart(spark, tmp_path):
    rng, log, rows = random.Random(5), str(tmp_path / "log"), []
    for part in range(4):
        new = entries(rng, 300, 2500, part * 2500)
        rows += new
        spark.createDataFrame(new, graphs.LOG).coalesce(1).write.mode("append").parquet(log)
        if part % 2:  # a new query goes on from the state of the one before
            found = run(spark, log, tmp_path).collect()
            assert {r.graph: (r.n_nodes, r.n_edges, r.cost) for r in found} == replayed(rows)
    heavier = [(r.graph, 10_000, "add", e.src, e.dst, 99) for r in found for e in [x for x in r.tree][:1]][:2]
    light = [(r.graph, 10_001, "add", r.tree[0].dst, r.tree[0].src, 500) for r in found if r.tree][2:40]
    spark.createDataFrame(heavier + light, graphs.LOG).coalesce(1).write.mode("append").parquet(log)
    rows += heavier + light
    found = run(spark, log, tmp_path).collect()
    assert {r.graph: (r.n_nodes, r.n_edges, r.cost) for r in found} == replayed(rows)
    assert all(r.inferred for r in found if r.graph in {h[0] for h in heavier}) and any(not r.inferred for r in found)
    for r in found:
        assert sum(e.w for e in r.tree) == r.cost and len({e.dst for e in r.tree}) == r.n_edges


def test_odd_entries_and_bounds(spark, tmp_path):
    rows = [(None, 1, "add", 0, 1, 5), (1, None, "add", 0, 1, 5), (1, 2, None, 0, 1, 5), (1, 3, "add", 0, None, 5), (1, 4, "add", 0, 1, None), (1, 5, "other", 0, 1, 1), (1, 6, "update", 0, 1, 1)]
    rows += [(2, 9, "remove", 0, 1, None), (2, 8, "add", 0, 1, 3), (2, 7, "add", 1, 1, 3), (3, 1, "add", 4, 5, 8), (3, 1, "add", 4, 5, 9)]
    log = str(tmp_path / "log")
    spark.createDataFrame(rows, graphs.LOG).write.parquet(log)
    found = {r.graph: (r.n_nodes, r.n_edges, r.cost) for r in run(spark, log, tmp_path).collect()}
    assert found == {None: (2, 1, 5), 1: (0, 0, 0), 2: (2, 0, 0), 3: (2, 1, 9)}
    with pytest.raises(Exception, match="pairs of nodes"):
        (tmp_path / "b").mkdir()
        run(spark, log, tmp_path / "b", max_edges=1)


def test_memory_is_sampled_at_an_interval(spark, tmp_path):
    path = str(tmp_path / "memory")
    query = memory.watch(spark, path, str(tmp_path / "mark"), 0.5)
    end = time.time() + 60
    while time.time() < end and (query.lastProgress or {"batchId": 0})["batchId"] < 4:
        spark.range(100).count()
        time.sleep(0.1)
    query.stop()
    rows = memory.samples(spark, path).collect()
    steps = [b.ts - a.ts for a, b in zip(rows, rows[1:], strict=False)]
    assert len(rows) >= 4 and all(0 <= s <= 20 for s in steps) and sum(steps) >= 1
    assert all(r.heap > 0 and r.total == r.heap + r.non_heap and r.executors for r in rows)


class _Held:
    """A state variable, or a handle that makes such, which counts what is asked of it."""

    def __init__(self, calls):
        self.calls, self.value = calls, None

    def make(self, *_):
        return _Held(self.calls)

    getValueState = getListState = getMapState = make

    def __getattr__(self, name):
        def asked(*args):
            self.calls.append(name)
            if name in ("put", "update"):
                self.value = args[0]
            elif name == "clear":
                self.value = None
            return self.value is not None if name == "exists" else iter(()) if name == "iterator" else self.value or []

        return asked


def test_a_graph_asks_its_state_a_few_times_however_many_edges_it_has():
    """Each call is a way to the JVM and back: the number for a batch doesn't grow with the edges, and a second batch goes on from the lists."""
    rng, calls = random.Random(4), []
    graph = graphs.Trees()
    graph.init(_Held(calls))
    rows = [(0, *r[1:]) for r in entries(rng, 1, 400, 0)]
    for part in (rows[:250], rows[250:]):
        calls.clear()
        out = next(iter(graph.handleInputRows((0,), iter([pd.DataFrame(part, columns=["graph", "seq", "op", "src", "dst", "w"])]), None)))
        assert len(calls) <= 9
    assert (out.n_nodes[0], out.n_edges[0], out.cost[0]) == replayed(rows)[0]
