"""Many graphs under one stream of updates: each graph is a key of the state."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from stemmata.operators import dynamic
from stemmata.operators.arborescence import arborescence_of
from stemmata.runtime import ship

#: An update of graph `graph`; the other columns as in dynamic.LOG.
LOG = f"graph bigint, {dynamic.LOG}"
#: seq: the greatest taken in.
TREES = "graph bigint, seq bigint, n_nodes bigint, n_edges bigint, cost bigint, inferred boolean, tree array<struct<src:bigint,dst:bigint,w:bigint>>"
#: Pairs of nodes that a graph in the state may have edges for, some 100 bytes each in its task. Larger graphs are for updates.maintain().
MAX_EDGES = 1_000_000
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Trees(StatefulProcessor):
    """Keeps the edges, nodes and tree of one graph a key, and gives the tree whenever entries come.

    An entry counts by its seq, not by when it comes: of a pair's `add` and `remove` the last (of one seq in one batch `remove`, then the greater weight), and an `update` after it if the edge
    is there. Edges at a node that `remove_node` names are gone unless they came later. Ends of added edges are nodes. Loops are in no tree. Rows without seq, op or the ends and weight that
    their op needs, and other ops, are passed over. A tree is inferred again only if it lost an edge, an edge came or grew lighter, or nodes changed.
    """

    def __init__(self, max_edges: int = MAX_EDGES):
        self.max_edges = max_edges

    def init(self, handle) -> None:
        # Whole lists: each call asks the JVM, and a batch reads all of a graph anyway. A removed edge has no weight; lists hold no nulls.
        self._edges = handle.getListState("edge_list", "src bigint, dst bigint, seq bigint, w bigint, there boolean")
        self._nodes = handle.getListState("node_list", "id bigint, added bigint, removed bigint")
        self._tree = handle.getListState("tree", "src bigint, dst bigint, w bigint")
        self._seen = handle.getValueState("seen", "seq bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self._seen.exists()
        seen = self._seen.get()[0] if known else -1
        edges = {(s, d): (seq, w if there else None) for s, d, seq, w, there in self._edges.get()} if known else {}
        nodes = {v: (added, removed) for v, added, removed in self._nodes.get()} if known else {}
        old, were = _alive(edges, nodes), _there(nodes)
        seen, put, updates, marks = self._taken(rows, seen, len(edges))
        moved, met = False, False
        for node, (added, removed) in marks.items():
            had = nodes.get(node, (-1, -1))
            nodes[node] = (max(had[0], added), max(had[1], removed))
            met = met or nodes[node] != had
        for pair in put.keys() | updates.keys():
            had = found = edges.get(pair, (-1, None))
            seq, op, w = put.get(pair, (-1, "", 0))
            if seq > found[0]:
                found = (seq, w if op == "add" else None)
            seq, w = updates.get(pair, (-1, 0))
            if seq > found[0] and _alive({pair: found}, nodes):
                found = (seq, w)
            if found != had:
                edges[pair] = found
                moved = True
        if len(edges) > self.max_edges:
            raise ValueError(f"graph {key[0]} has edges for over {self.max_edges} pairs of nodes")
        if met:
            self._nodes.put([(v, *x) for v, x in nodes.items()])
        if moved:
            self._edges.put([(*p, seq, w or 0, w is not None) for p, (seq, w) in edges.items()])
        now, there = _alive(edges, nodes), _there(nodes)
        tree = [tuple(e) for e in self._tree.get()] if known else []
        chosen = {(s, d) for s, d, _ in tree}
        changed = [pair for pair in old.keys() | now.keys() if old.get(pair) != now.get(pair)]
        inferred = were != there or any(p in chosen or (p in now and now[p] < old.get(p, now[p] + 1)) for p in changed)
        if inferred:
            tree = arborescence_of([(s, d, w) for (s, d), w in now.items()], sorted(there))
            if tree:
                self._tree.put(tree)
            elif known:
                self._tree.clear()
        self._seen.update((seen,))
        rows_ = [{"src": s, "dst": d, "w": w} for s, d, w in sorted(tree)]
        out = (key[0], seen, len(there), len(tree), sum(w for *_, w in tree), inferred, rows_)
        yield pd.DataFrame([out], columns=["graph", "seq", "n_nodes", "n_edges", "cost", "inferred", "tree"])

    def _taken(self, rows: Iterator[pd.DataFrame], seen: int, held: int) -> tuple[int, dict, dict, dict]:
        """What counts of a batch's entries, however many there are: the greatest seq, each pair's last add or remove and last update, and when nodes came and went."""
        put: dict[tuple, tuple] = {}
        updates: dict[tuple, tuple] = {}
        marks: dict[int, tuple] = {}
        for chunk in rows:
            columns = [chunk[c].astype("object").where(chunk[c].notna(), None).tolist() if chunk[c].hasnans else chunk[c].tolist() for c in ("seq", "op", "src", "dst", "w")]
            for seq, op, src, dst, w in zip(*columns, strict=True):
                came: tuple = ()
                if seq is None or src is None:
                    continue
                if op in ("add_node", "remove_node"):
                    came = (int(src),)
                elif dst is None or op not in ("add", "remove", "update") or (w is None and op != "remove"):
                    continue
                pair, w, seq = (int(src), None if dst is None else int(dst)), int(w or 0), int(seq)
                seen = max(seen, seq)
                if op in ("add", "remove"):
                    put[pair] = max(put.get(pair, (-1, "", 0)), (seq, op, w if op == "add" else 0))
                    came = pair if op == "add" else ()
                elif op == "update":
                    updates[pair] = max(updates.get(pair, (-1, 0)), (seq, w))
                for node in came:
                    added, removed = marks.get(node, (-1, -1))
                    marks[node] = (added, max(removed, seq)) if op == "remove_node" else (max(added, seq), removed)
            if max(len(put), len(updates), held) > self.max_edges:
                raise ValueError(f"a graph has edges for over {self.max_edges} pairs of nodes")
        return seen, put, updates, marks


def _alive(edges: dict, nodes: dict) -> dict:
    gone = lambda v: nodes.get(v, (-1, -1))[1]
    return {p: w for p, (seq, w) in edges.items() if w is not None and seq > gone(p[0]) and seq > gone(p[1])}


def _there(nodes: dict) -> set:
    return {v for v, (added, removed) in nodes.items() if added > removed}


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """States of several variables need this kind of store; a query keeps the one that it was started with."""
    had = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, had) if had else spark.conf.unset(_STORE)


def maintain_graphs(updates: DataFrame, path: str, checkpoint: str, max_edges: int = MAX_EDGES, once: bool = True) -> StreamingQuery:
    """Keeps a tree for each graph of a stream of updates (LOG). Each batch writes the trees (TREES) of the graphs that it met below path, one folder a batch, which a batch that runs again
    replaces; latest() reads the last of each graph. Graphs are dealt to tasks by their id; state and progress lie in checkpoint. A null graph is a graph like others.

    The state of one graph is held by one task, so a graph may have max_edges pairs of nodes with edges; more are an error, and a case for updates.maintain().
    """
    spark = updates.sparkSession
    ship(spark)
    with _rocks(spark):
        trees = updates.select("graph", "seq", "op", "src", "dst", "w").groupBy("graph").transformWithStateInPandas(Trees(max_edges), TREES, "Update", "None")
        writer = trees.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        writer = writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}"))
        return (writer.trigger(availableNow=True) if once else writer).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last tree of each graph (TREES)."""
    rows = spark.read.schema(f"{TREES}, batch bigint").parquet(path)
    found = rows.groupBy("graph").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("graph", "batch")]), "batch").alias("x"))
    return found.select("graph", "x.*")
