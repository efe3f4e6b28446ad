"""Minimum-weight spanning arborescences.

A virtual root reaches every vertex at a cost above all others, so that the best root is found with the tree, and a forest of fewest
trees where no tree spans the graph. Each round takes every component's lightest incoming edge and contracts all cycles that these
form. Edges stay as they are: a table of labels says which component a vertex is in, and by what its incoming edges are charged less. What was
contracted is kept as a forest: a node for every vertex and every cycle, below the cycle that it is part of, with the lightest edge into it.
Opened from its roots down it gives the tree; an update opens only the nodes above what it touches.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemmata.operators import trees
from stemmata.runtime import cut, off_driver

#: The virtual root's label.
ROOT = -1
#: A contracted graph of so many edges at most (of 48 bytes) is finished by one task, whose memory that bounds.
KERNEL_EDGES = 8_000_000
#: A graph of more edges is first reduced to the components that a cycle may hold: Spark's work, where the task that ends the work would be alone with all edges.
CORE_EDGES = 500_000


def contract(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, root: int) -> tuple[list[int], list[int], list[int]]:
    """(parent, chosen, charge) of vertices 0..n-1, each of which root reaches, and of the contracted vertices behind them: the contracted vertex that each is part of (-1: none),
    the index of the lightest edge into it and what that is charged; ties by index."""
    return contracted(n, src, dst, w, root)[:3]


def contracted(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, root: int, least: np.ndarray | None = None) -> tuple[list[int], list[int], list[int], list, np.ndarray, list]:
    """(parent, chosen, charge, into, label, least) as contract() has them, with what is left of the edges (indexes, costs) into each vertex, the vertex that holds each, and bounds.

    A path grows backwards along lightest incoming edges until it meets what is finished, and contracts whenever it meets itself. A
    contracted vertex keeps the lightest edge from each other one, so that all contractions together cost at most n * n array steps.
    least: a bound of the edges into each vertex that aren't given. Where the lightest given one costs more, the path ends and the vertex has no edge chosen (-1).
    """
    bound = [None] * n if least is None else least.tolist()
    src, dst, cost = (np.asarray(x, np.int64) for x in (src, dst, w))
    order = np.lexsort((np.arange(len(src)), dst))
    order = order[(src[order] != dst[order]) & (dst[order] != root)]
    bounds = np.searchsorted(dst[order], np.arange(n + 1))
    into: list[tuple[np.ndarray, np.ndarray] | None] = [(order[bounds[v] : bounds[v + 1]], cost[order[bounds[v] : bounds[v + 1]]]) for v in range(n)]
    label, held = np.arange(n), [np.array([v]) for v in range(n)]
    parent, chosen, charge = [-1] * n, [-1] * n, [0] * n
    done, place = [False] * n, [-1] * n
    done[root] = True
    for start in range(n):
        path = [] if done[label[start]] else [int(label[start])]
        if path:
            place[path[0]] = 0
        while path:
            v = path[-1]
            edges, costs = into[v]
            outside = label[src[edges]] != v
            if not outside.all():
                edges, costs = into[v] = edges[outside], costs[outside]
            k = int(np.lexsort((edges, costs))[0]) if len(edges) < 8 else _first(edges, costs)
            if bound[v] is not None and costs[k] > bound[v]:
                for x in path:
                    done[x] = True
                break
            chosen[v], charge[v] = int(edges[k]), int(costs[k])
            u = int(label[src[edges[k]]])
            if done[u]:
                for x in path:
                    done[x] = True
                break
            if place[u] < 0:
                place[u] = len(path)
                path.append(u)
                continue
            cycle, path = path[place[u] :], path[: place[u]]
            c = len(parent)
            edges = np.concatenate([into[x][0] for x in cycle])
            costs = np.concatenate([into[x][1] - charge[x] for x in cycle])
            members = np.concatenate([held[x] for x in cycle])
            label[members] = c
            for x in cycle:
                parent[x], into[x], held[x] = c, None, None
            of = label[src[edges]]
            by = np.lexsort((edges, costs, of))
            by = by[np.r_[True, of[by][1:] != of[by][:-1]][: len(by)]]
            into.append((edges[by], costs[by]))
            held.append(members)
            bound.append(None if least is None else min(bound[x] - charge[x] for x in cycle))
            parent.append(-1)
            chosen.append(-1)
            charge.append(0)
            done.append(False)
            place.append(len(path))
            path.append(c)
    return parent, chosen, charge, into, label, bound


def entered(n: int, dst: np.ndarray, parent: list[int], chosen: list[int]) -> list[int]:
    """The edge that enters each of the vertices 0..n-1: the edge into a contracted vertex goes to the member that it ends in, the other members keep theirs."""
    chosen = list(chosen)
    for c in range(len(parent) - 1, n - 1, -1):
        x = int(dst[chosen[c]])
        while parent[x] != c:
            x = parent[x]
        chosen[x] = chosen[c]
    return chosen[:n]


def solve(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, root: int) -> np.ndarray:
    """Indexes of the edges of a minimum arborescence from root over vertices 0..n-1, each of which root reaches; ties by index."""
    parent, chosen, _ = contract(n, src, dst, w, root)
    found = entered(n, np.asarray(dst), parent, chosen)
    return np.array(sorted(found[v] for v in range(n) if v != root), np.int64)


def _first(edges: np.ndarray, costs: np.ndarray) -> int:
    """The place of the lightest edge, of equal ones that of the smallest index."""
    least = np.flatnonzero(costs == costs.min())
    return int(least[np.argmin(edges[least])])


def arborescence_of(edges: list[tuple[int, int, int]], nodes: list[int] | None = None) -> list[tuple[int, int, int]]:
    """The minimum arborescence, or forest of fewest trees, of a small graph; loops are left out."""
    ids = sorted({v for s, d, _ in edges for v in (s, d)} | set(nodes or ()))
    place = {v: k for k, v in enumerate(ids)}
    rows = sorted((w, s, d) for s, d, w in edges if s != d)
    big = 1 + 2 * sum(abs(w) for w, *_ in rows)
    src = np.array([place[s] for _, s, _ in rows] + [len(ids)] * len(ids), np.int64)
    dst = np.array([place[d] for *_, d in rows] + list(range(len(ids))), np.int64)
    cost = np.array([w for w, *_ in rows] + [big] * len(ids), np.int64)
    return [(rows[k][1], rows[k][2], rows[k][0]) for k in solve(len(ids) + 1, src, dst, cost, len(ids)).tolist() if k < len(rows)]


#: So many components at most (of 24 bytes) have their cycles found by one task, and so many nodes below one root are opened by one; beyond, by rounds of joins.
KERNEL_NODES = 1_000_000
#: A contracted node's fid is a serial number above so many bits of a vertex in it; vertices' ids lie below.
BITS = 40
NODE = "fid bigint, parent_fid bigint, src bigint, dst bigint, w bigint, y bigint, is_simple boolean"
_NODE = ["fid", "parent_fid", "src", "dst", "w", "y", "is_simple"]


@dataclass(frozen=True)
class Forest:
    """What a run leaves for later updates. nodes (NODE): every vertex, as its own fid, and every contracted cycle, below the cycle that it is part of. A node has the lightest edge
    into it, from outside, and y, what that is charged; src is ROOT where only the virtual root's enters. The edges of nodes that a root holds are those of its cycle.
    serial numbers the contractions. components: what the last inference began with; opened: the nodes that an update took away before it.
    """

    nodes: DataFrame
    serial: int = 0
    components: int = 0
    opened: int = 0

    @cached_property
    def jumps(self) -> list[DataFrame]:
        return trees.lifted(self.nodes)

    def roots(self) -> DataFrame:
        """(fid, root, below): the root above each node, and the sum of y from the node up to the root, the root's left out. Pointers double: rounds grow with the logarithm of the depth."""
        far = cut(self.nodes.select("fid", F.coalesce("parent_fid", "fid").alias("root"), F.when(F.col("parent_fid").isNull(), F.lit(0)).otherwise(F.col("y")).cast("bigint").alias("below")))
        while True:
            ahead = far.select(F.col("fid").alias("root"), F.col("root").alias("next"), F.col("below").alias("more"))
            moved = cut(far.join(off_driver(ahead), "root").select("fid", F.col("next").alias("root"), (F.col("below") + F.col("more")).alias("below"), (F.col("next") != F.col("root")).alias("moved")))
            far = moved.drop("moved")
            if moved.where("moved").isEmpty():
                return far

    def labels(self) -> DataFrame:
        """(v, c, off): the root above each vertex, and what is added to the weights of its incoming edges there."""
        simple = self.nodes.where("is_simple").select("fid")
        return cut(self.roots().join(off_driver(simple), "fid").select(F.col("fid").alias("v"), F.col("root").alias("c"), (-F.col("below")).alias("off")))

    def touched(self, removed: DataFrame, added: DataFrame) -> DataFrame:
        """(fid) of nodes whose lightest edge is gone, or no longer the lightest, by the loss and gain of edges (src, dst, w).

        A new edge may enter the nodes above its end that don't hold its source; it counts where its charge is less than the node's.
        """
        lost = self.nodes.join(off_driver(cut(removed.select("src", "dst", "w").distinct())), ["src", "dst", "w"], "left_semi").select("fid")
        ends = cut(added.where("src <> dst").select(F.monotonically_increasing_id().alias("e"), "src", "dst", "w"))
        if ends.isEmpty():
            return lost
        leaves = ends.select(F.col("src").alias("leaf")).unionByName(ends.select(F.col("dst").alias("leaf"))).distinct()
        above = cut(trees.ancestors(self.nodes, leaves.withColumnRenamed("leaf", "fid"), self.jumps))
        inside = ends.join(above.select(F.col("fid").alias("src"), "anc"), "src").select("e", "anc")
        enters = ends.select("e", "dst", F.col("w").alias("nw")).join(above.select(F.col("fid").alias("dst"), "anc", "below"), "dst").join(inside, ["e", "anc"], "left_anti")
        lighter = enters.join(off_driver(self.nodes.select(F.col("fid").alias("anc"), "src", "y")), "anc").where((F.col("nw") - F.col("below") < F.col("y")) | (F.col("src") == ROOT))
        return lost.unionByName(lighter.select(F.col("anc").alias("fid"))).distinct()

    def open(self, touched: DataFrame, gone: DataFrame, new: DataFrame) -> Forest:
        """The forest without all nodes above those touched (fid), and above and without those gone (id), and with new ones (id). What they held becomes roots; the touched ones lose their edge."""
        touched = cut(touched.unionByName(gone.select(F.col("id").alias("fid"))).distinct())
        above = cut(trees.ancestors(self.nodes, touched, self.jumps).where("dist > 0").select(F.col("anc").alias("fid")).distinct())
        out = above.unionByName(gone.select(F.col("id").alias("fid"))).distinct()
        kept = self.nodes.join(off_driver(out), "fid", "left_anti").join(off_driver(above.toDF("parent_fid").withColumn("freed", F.lit(True))), "parent_fid", "left")
        kept = kept.join(off_driver(touched.withColumn("lost", F.lit(True))), "fid", "left")
        edge = [F.when(F.col("lost").isNull(), F.col(c)).alias(c) for c in ("src", "dst", "w", "y")]
        kept = kept.select("fid", F.when(F.col("freed").isNull(), F.col("parent_fid")).alias("parent_fid"), *edge, "is_simple")
        nodes = cut(kept.unionByName(leaves(new)))
        return Forest(nodes, self.serial, opened=above.count())


def leaves(ids: DataFrame) -> DataFrame:
    """Nodes of a forest for vertices (id) that nothing contracts and nothing enters yet."""
    none = [F.lit(None).cast("bigint").alias(c) for c in ("parent_fid", "src", "dst", "w", "y")]
    return ids.select(F.col("id").cast("bigint").alias("fid"), *none, F.lit(True).alias("is_simple"))


def minimum_arborescence(edges: DataFrame, nodes: DataFrame | None = None, kernel_edges: int = KERNEL_EDGES, keep_edges: bool = True) -> DataFrame:
    """(src, dst, w): the minimum arborescence over all roots, or a forest of fewest trees if none spans the graph; ties by (w, src, dst).

    edges: (src, dst, w); nodes: (id), for vertices that no edge touches. Edges are neither collected nor rewritten: a round
    shuffles the lightest edge of each component. Once few edges lie between components, one task ends the work. keep_edges: edges are
    written once for all passes; without it each pass computes them again, and they are never stored.
    """
    return infer(edges, nodes, kernel_edges, keep_edges)[0]


def infer(edges: DataFrame, nodes: DataFrame | None = None, kernel_edges: int = KERNEL_EDGES, keep_edges: bool = True, seed: Forest | None = None, stored: bool = False) -> tuple[DataFrame, Forest]:
    """The tree and the forest that it was opened from. seed: a forest that holds for this graph already, and names all its vertices: its roots are the components that the work begins
    with, and those that have an edge keep it. A round looks at the edges into components that have none yet; the others' lightest edges don't change. stored: edges are a table already, which isn't written again.
    """
    long = lambda c: F.col(c).cast("bigint").alias(c)
    real = edges.where("src <> dst").select(long("src"), long("dst"), long("w"))
    real = cut(real) if keep_edges and not stored else real
    plain = seed is None
    if plain:
        vertices = real.select(F.col("src").alias("id")).unionByName(real.select(F.col("dst").alias("id")))
        if nodes is not None:
            vertices = vertices.unionByName(nodes.select(long("id")))
        seed = Forest(cut(leaves(vertices.distinct())))
        labels = cut(seed.nodes.select(F.col("fid").alias("v"), F.col("fid").alias("c"), F.lit(0).cast("bigint").alias("off")))
    else:
        labels = seed.labels()
    serial, nested = seed.serial, not seed.nodes.where("parent_fid IS NOT NULL").isEmpty()
    made = [seed.nodes.where("parent_fid IS NOT NULL")]
    tops = seed.nodes.where("parent_fid IS NULL")
    components = tops.count()
    weight, n_edges = real.agg(F.sum(F.abs("w")), F.count("*")).first()
    big = 1 + 2 * (weight or 0)
    # (c, adj, w, src, dst, n): the lightest edge into each component, and how many enter it, as far as known. The virtual root's are chosen anew: its weight grows with the graph's.
    best = tops.where(f"src IS NOT NULL AND src <> {ROOT}").select(F.col("fid").alias("c"), F.col("y").alias("adj"), "w", "src", "dst", F.lit(None).cast("bigint").alias("n"))
    outer, left = None, components
    if n_edges + components > min(kernel_edges, CORE_EDGES):
        core, inward, n_inward = _core(real, labels, n_edges, min(kernel_edges, CORE_EDGES), keep_edges)
        if n_inward < n_edges:
            # Components that no cycle can hold have their edge chosen once; the rest of the work looks at the edges into the others alone.
            inside = off_driver(cut(core.select("c").distinct()))
            rest = cut(labels.join(inside, "c", "left_anti"))
            asked = rest.join(off_driver(best.select("c")), "c", "left_anti")
            into = real.join(off_driver(core.select(F.col("v").alias("dst"))), "dst", "left_anti") if plain else real
            held = best.join(inside, "c", "left_anti").drop("n")
            outer = cut(held.unionByName(_lightest(_entering(into, labels, asked, big, plain)).drop("n")))
            made.append(outer.select(F.col("c").alias("fid"), F.lit(None).cast("bigint").alias("parent_fid"), "src", "dst", "w", F.col("adj").alias("y"), _simple("c")))
            best, labels, real, n_edges, left = cut(best.join(inside, "c", "left_semi")), core, inward, n_inward, inside.count()
    while True:
        known = 0 if n_edges + left <= kernel_edges else None
        if known is None and serial > seed.serial:  # edges between components, if each has been counted
            known, unknown = best.agg(F.sum("n"), F.count(F.when(F.col("n").isNull(), 1))).first()
            known = None if unknown else known
        if known is not None and known <= kernel_edges and kernel_edges:
            serial += 1
            found = cut(_finish(_lightest_between(_between(real, labels, labels, big)), serial))
            made.append(found.select(*_NODE))
            solved = found.where("t_dst IS NOT NULL").select("fid", *[F.col(f"t_{c}").alias(c) for c in ("src", "dst", "w")])
            made_above = found.where("parent_fid IS NOT NULL").select("fid")
            break
        asked = labels.join(off_driver(best.select("c")), "c", "left_anti")
        best = cut(best.unionByName(_lightest(_entering(real, labels, asked, big, plain))))
        plain = False
        named_by = off_driver(labels.select(F.col("v").alias("src"), F.col("c").alias("csrc")))
        chosen = cut(best.join(named_by, "src", "left").withColumn("csrc", F.coalesce("csrc", F.lit(ROOT).cast("bigint"))))
        cyclic = _on_cycles(chosen)
        if cyclic.isEmpty():
            made.append(best.select(F.col("c").alias("fid"), F.lit(None).cast("bigint").alias("parent_fid"), "src", "dst", "w", F.col("adj").alias("y"), _simple("c")))
            solved, made_above = best.select(F.col("c").alias("fid"), "src", "dst", "w"), None
            break
        serial += 1
        # A cycle is named by the least vertex that its edges end in.
        edge_of = off_driver(best)
        names = cut(cyclic.join(edge_of, "c").groupBy("cycle").agg((F.min("dst") + (serial << BITS)).alias("name")))
        named = cut(cyclic.join(off_driver(names), "cycle").join(edge_of, "c").select("c", "src", "dst", "w", "adj", F.col("name").alias("cycle")))
        made.append(named.select(F.col("c").alias("fid"), F.col("cycle").alias("parent_fid"), "src", "dst", "w", F.col("adj").alias("y"), _simple("c")))
        labels = cut(labels.join(off_driver(named.select("c", "adj", "cycle")), "c", "left").select("v", F.coalesce("cycle", "c").alias("c"), (F.col("off") - F.coalesce("adj", F.lit(0))).alias("off")))
        best = cut(best.join(off_driver(named.select("c")), "c", "left_anti"))
        nested = True
    if outer is not None:
        solved = solved.unionByName(outer.select(F.col("c").alias("fid"), "src", "dst", "w"))
    all_nodes = made[0]
    for part in made[1:]:
        all_nodes = all_nodes.unionByName(part)
    forest = Forest(cut(all_nodes), serial, components, seed.opened)
    if nested:
        # The kernel has opened what it contracted itself; what its components hold is opened here.
        inner = forest.nodes.join(off_driver(made_above.withColumn("inner", F.lit(True))), "fid", "left").withColumn("parent_fid", F.when(F.col("inner").isNull(), F.col("parent_fid"))).select(*_NODE) if made_above is not None else forest.nodes
        solved = opened(Forest(inner), solved, KERNEL_NODES)
    return cut(solved.where(F.col("src") != ROOT).select("src", "dst", "w")), forest


def _simple(c: str) -> Column:
    return (F.col(c) < (1 << BITS)).alias("is_simple")


def _lightest(charged: DataFrame) -> DataFrame:
    """(c, adj, w, src, dst, n): the lightest of the edges into each component, and how many they are."""
    lightest = F.min(F.struct("adj", "w", "src", "dst")).alias("x")
    return charged.groupBy("cdst").agg(lightest, F.count("*").alias("n")).select(F.col("cdst").alias("c"), "x.*", "n")


def _lightest_between(charged: DataFrame) -> DataFrame:
    """Of all edges from one component to another the lightest: whatever is contracted later charges them alike."""
    lightest = F.min(F.struct("adj", "w", "src", "dst")).alias("x")
    return charged.groupBy("csrc", "cdst").agg(lightest).select("x.src", "x.dst", "x.w", "csrc", "cdst", "x.adj")


def _core(real: DataFrame, labels: DataFrame, n_edges: int, enough: int, keep_edges: bool) -> tuple[DataFrame, DataFrame, int]:
    """(labels, edges, their number): the components that edges leave, and the edges into these. What no edge leaves is on no cycle, nor is it below one; without it, more may be left by none.

    Goes on until at most `enough` edges are left, or few go in a pass. Edges that are not to be kept are written only where they are at most `enough`.
    """
    while True:
        sources = real.select(F.col("src").alias("v")).distinct()
        leaving = cut(labels.join(sources, "v", "left_semi").select("c").distinct())
        core = cut(labels.join(off_driver(leaving), "c", "left_semi"))
        n_core, n_labels = core.count(), labels.count()
        if n_core > 0.9 * n_labels:
            return labels, real, n_edges
        inward = real.join(off_driver(core.select(F.col("v").alias("dst"))), "dst", "left_semi").select("src", "dst", "w")
        inward = cut(inward) if keep_edges else inward
        n_inward = inward.count()
        if not keep_edges and n_inward <= enough:
            inward = cut(inward)
        real, labels, before, n_edges = inward, core, n_edges, n_inward
        if n_edges + n_core <= enough or n_edges > 0.9 * before:
            return labels, real, n_edges


def _between(real: DataFrame, labels: DataFrame, asked: DataFrame, big: int, plain: bool = False) -> DataFrame:
    """(src, dst, w, csrc, cdst, adj) of edges into the components of `asked` (rows of labels) from others, and of the virtual root's. plain: every vertex is its own component, with nothing
    charged yet, and all edges of `real` go into those asked for."""
    if plain:
        inner = real.select("src", "dst", "w", F.col("src").alias("csrc"), F.col("dst").alias("cdst"), F.lit(0).cast("bigint").alias("off"))
    else:
        inner = real.join(off_driver(asked.select(F.col("v").alias("dst"), F.col("c").alias("cdst"), "off")), "dst")
        inner = inner.join(off_driver(labels.select(F.col("v").alias("src"), F.col("c").alias("csrc"))), "src").where("csrc <> cdst")
    # Of the virtual root's edges only the lightest into each component can count: few rows, however many vertices.
    least = asked.groupBy("c").agg(F.min(F.struct("off", "v")).alias("x")).select("c", "x.off", "x.v")
    virtual = least.select(F.lit(ROOT).cast("bigint").alias("src"), F.col("v").alias("dst"), F.lit(big).cast("bigint").alias("w"), F.lit(ROOT).cast("bigint").alias("csrc"), F.col("c").alias("cdst"), "off")
    columns = ["src", "dst", "w", "csrc", "cdst", (F.col("w") + F.col("off")).alias("adj")]
    return inner.select(*columns).unionByName(virtual.select(*columns))


def _entering(real: DataFrame, labels: DataFrame, asked: DataFrame, big: int, plain: bool = False) -> DataFrame:
    """(src, dst, w, cdst, adj) as of _between(). All edges into a component of one vertex, which has that vertex's name, come from others: what their sources are in needn't be looked up."""
    columns = ["src", "dst", "w", "cdst", "adj"]
    if plain:
        return _between(real, labels, asked, big, True).select(*columns)
    alone = off_driver(asked.where("c = v").select(F.col("v").alias("dst"), F.col("c").alias("cdst"), "off"))
    direct = real.join(alone, "dst").select("src", "dst", "w", "cdst", (F.col("w") + F.col("off")).alias("adj"))
    virtual = asked.where("c = v").select(F.lit(ROOT).cast("bigint").alias("src"), F.col("v").alias("dst"), F.lit(big).cast("bigint").alias("w"), F.col("c").alias("cdst"), (F.lit(big) + F.col("off")).alias("adj"))
    more = asked.where("c <> v")
    return direct.unionByName(virtual).unionByName(_between(real, labels, more, big).select(*columns))


def _finish(charged: DataFrame, serial: int) -> DataFrame:
    """The rest of the work in one task: the edges between components, the virtual root's among them, are bounded by KERNEL_EDGES. Gives a NODE for each component and each contraction,
    and for components also the edge that enters them in the end (t_src, t_dst, t_w)."""

    def kernel(rows):
        import pyarrow as pa

        src, dst, w, csrc, cdst, adj = (rows.column(c).to_numpy() for c in ("src", "dst", "w", "csrc", "cdst", "adj"))
        order = np.lexsort((dst, src, w, adj))
        src, dst, w, csrc, cdst, adj = (x[order] for x in (src, dst, w, csrc, cdst, adj))
        names, flat = np.unique(np.r_[csrc, cdst, ROOT], return_inverse=True)
        n, root, ends = len(names), int(flat[-1]), flat[len(src) : -1]
        parent, chosen, charge = contract(n, flat[: len(src)], ends, adj, root)
        final = entered(n, ends, parent, chosen)
        fids = np.r_[names, (serial << BITS) + np.arange(len(parent) - n)]
        keep = np.array([v for v in range(len(parent)) if v != root])
        up, edge = np.array(parent)[keep], np.array(chosen)[keep]
        last = np.array([*final, *[-1] * (len(parent) - n)])[keep]
        some = lambda values, at: pa.array(values[np.maximum(at, 0)], pa.int64(), mask=at < 0)
        columns = [pa.array(fids[keep]), some(fids, up), pa.array(src[edge]), pa.array(dst[edge]), pa.array(w[edge]), pa.array(np.array(charge, np.int64)[keep]), pa.array((keep < n) & (fids[keep] < 1 << BITS))]
        return pa.table([*columns, some(src, last), some(dst, last), some(w, last)], [*_NODE, "t_src", "t_dst", "t_w"])

    return charged.groupBy(F.lit(0).alias("all")).applyInArrow(kernel, f"{NODE}, t_src bigint, t_dst bigint, t_w bigint")


def opened(forest: Forest, entries: DataFrame, limit: int) -> DataFrame:
    """(src, dst, w): the edges that enter vertices, given those (fid, src, dst, w) that enter the roots.

    An edge that enters a node goes down to the vertex that it ends in; the members that this path passes by keep their own edges. A root's nodes are opened by one task if they are at
    most `limit`; with larger ones, all are opened level by level by joins.
    """
    held = cut(forest.nodes.join(off_driver(forest.roots().select("fid", "root")), "fid"))
    if held.groupBy("root").count().where(F.col("count") > limit).isEmpty():
        inside = held.join(off_driver(entries.select(F.col("fid").alias("root"), *[F.col(c).alias(f"e_{c}") for c in ("src", "dst", "w")])), "root")
        alone = inside.where("is_simple AND fid = root").select(*[F.col(f"e_{c}").alias(c) for c in ("src", "dst", "w")])
        more = inside.join(off_driver(inside.where("NOT is_simple AND fid = root").select("root")), "root", "left_semi")
        return alone.unionByName(more.groupBy("root").applyInArrow(_opened_root, "src bigint, dst bigint, w bigint"))
    simple = held.where("is_simple").select("fid")
    above = trees.ancestors(forest.nodes, simple).join(forest.nodes.select(F.col("fid").alias("anc"), F.col("parent_fid").alias("under")), "anc")
    path = cut(above.select(F.col("fid").alias("dst"), F.col("anc").alias("on"), "under"))
    ends = cut(forest.nodes.select("fid", "parent_fid", "src", "dst", "w"))
    frontier, out = cut(entries.join(held.select("fid", "is_simple"), "fid")), []
    while True:
        out.append(frontier.where("is_simple").select("src", "dst", "w"))
        inner = frontier.where("NOT is_simple").select(F.col("fid").alias("under"), *[F.col(c).alias(f"e_{c}") for c in ("src", "dst", "w")])
        if inner.isEmpty():
            break
        below = inner.join(ends.withColumnRenamed("parent_fid", "under"), "under").join(path.select(F.col("dst").alias("e_dst"), "on", "under"), ["e_dst", "under"])
        taken = F.col("on") == F.col("fid")
        frontier = cut(below.select("fid", *[F.when(taken, F.col(f"e_{c}")).otherwise(F.col(c)).alias(c) for c in ("src", "dst", "w")]).join(held.select("fid", "is_simple"), "fid"))
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found


def _opened_root(rows):
    """The edges into the vertices below one root (rows of a group, with e_src, e_dst and e_w, which enter it)."""
    import pyarrow as pa

    fid, parent, src, dst, w = (rows.column(c).to_pylist() for c in ("fid", "parent_fid", "src", "dst", "w"))
    root, up = rows.column("root")[0].as_py(), dict(zip(fid, parent, strict=True))
    edge = dict(zip(fid, zip(src, dst, w, strict=True), strict=True))
    below: dict[int, list[int]] = {}
    for f, p in up.items():
        below.setdefault(p, []).append(f)
    todo, out = [(root, tuple(rows.column(f"e_{c}")[0].as_py() for c in ("src", "dst", "w")))], []
    while todo:
        top, entry = todo.pop()
        out.append(entry)
        at, path = entry[1], {entry[1]}
        while at != top:
            at = up[at]
            path.add(at)
        todo += [(f, edge[f]) for p in path for f in below.get(p, ()) if f not in path]
    return pa.table([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], ["src", "dst", "w"])


def _on_cycles(best: DataFrame) -> DataFrame:
    """(c, cycle) of components on cycles of their lightest edges, a cycle being named by the least component on it.

    Few components are walked through by one task. Of many, pointers are doubled, and what none leads to is left out each time, until few are left or every one is led to: all these lie on
    cycles. Least names then spread by doubling until none changes. Tables of many rows are joined by merging; none goes through the driver, however well its file is packed.
    """
    step = best.select("c", F.col("csrc").alias("to"))
    far, n = step, best.count()
    while n > KERNEL_NODES:
        inside = cut(far.select(F.col("to").alias("c")).distinct().join(off_driver(far.select("c")), "c", "left_semi"))
        if inside.count() == n:
            break
        kept = cut(far.join(off_driver(inside), "c", "left_semi"))
        far = cut(kept.join(off_driver(kept.toDF("to", "next")), "to").select("c", F.col("next").alias("to")))
        n = far.count()
    if far is not step:
        step = cut(step.join(off_driver(far.select("c")), "c", "left_semi"))
    if n <= KERNEL_NODES:
        return cut(step.groupBy(F.lit(0).alias("all")).applyInArrow(_walked, "c bigint, cycle bigint"))
    low = cut(step.select("c", "to", F.least("c", "to").alias("least")))
    while True:
        ahead = off_driver(low.toDF("to", "next", "further"))
        # Where no name changes, those of neighbouring stretches are equal, all round.
        moved = cut(low.join(ahead, "to").select("c", F.col("next").alias("to"), F.least("least", "further").alias("least"), (F.col("further") < F.col("least")).alias("moved")))
        low = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return low.select("c", F.col("least").alias("cycle"))


def _walked(rows):
    """(c, cycle) of the components on cycles, of rows (c, to)."""
    import pyarrow as pa

    step = dict(zip(rows.column("c").to_pylist(), rows.column("to").to_pylist(), strict=True))
    walk: dict[int, int] = {}
    out = []
    for start in step:
        at, path = start, []
        while at in step and at not in walk:
            walk[at] = start
            path.append(at)
            at = step[at]
        if walk.get(at) == start and at in step:
            ring = path[path.index(at) :]
            least = min(ring)
            out += [(c, least) for c in ring]
    return pa.table([pa.array([c for c, _ in out], pa.int64()), pa.array([k for _, k in out], pa.int64())], ["c", "cycle"])
