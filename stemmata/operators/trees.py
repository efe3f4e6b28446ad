"""Operators on trees and forests of edges (src, dst, w), and on contraction forests (fid, parent_fid, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemmata.runtime import cut, off_driver


def reach(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(id, level) of what `start` (id) reaches: a frontier that grows by one join a level."""
    seen = cut(start.select(F.col("id").cast("bigint").alias("id")).distinct().withColumn("level", F.lit(0)))
    frontier, level = seen, 0
    while True:
        level += 1
        near = edges.select(F.col("src").cast("bigint").alias("id"), F.col("dst").cast("bigint").alias("next")).join(frontier.select("id"), "id")
        frontier = cut(near.select(F.col("next").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier))


def roots(tree: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id) of vertices that nothing enters."""
    ids = tree.select(F.col("src").alias("id")).unionByName(tree.select(F.col("dst").alias("id")))
    if nodes is not None:
        ids = ids.unionByName(nodes.select(F.col("id").cast(ids.schema["id"].dataType).alias("id")))
    return ids.distinct().join(tree.select(F.col("dst").alias("id")), "id", "left_anti")


def depths(tree: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, root, depth) by pointer doubling: rounds grow with the logarithm of the depth. Vertices on cycles never reach a root and are left out."""
    top = roots(tree, nodes).select(F.col("id").cast("bigint").alias("id"))
    up = tree.select(F.col("dst").cast("bigint").alias("id"), F.col("src").cast("bigint").alias("to"), F.lit(1).cast("bigint").alias("hops"))
    far = cut(up.unionByName(top.select("id", F.col("id").alias("to"), F.lit(0).cast("bigint").alias("hops"))))
    rounds, n = 1, far.count()
    while rounds < n:
        ahead = far.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("hops").alias("more"))
        jumped = cut(far.join(ahead, "to").select("id", F.col("next").alias("to"), (F.col("hops") + F.col("more")).alias("hops"), (F.col("next") != F.col("to")).alias("moved")))
        far, rounds = jumped.drop("moved"), rounds * 2
        if jumped.where("moved").isEmpty():
            break
    return far.join(top.toDF("to"), "to", "left_semi").select("id", F.col("to").alias("root"), F.col("hops").alias("depth"))


def validate(tree: DataFrame, edges: DataFrame | None, nodes: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, foreign (tree edges that the graph lacks), crowded (vertices entered more than once), n_roots,
    n_reached from the roots, and valid: a spanning arborescence."""
    n_nodes = nodes.select("id").distinct().count()
    n_edges = tree.count()
    foreign = tree.join(edges, ["src", "dst", "w"], "left_anti").count() if edges is not None else 0
    crowded = tree.groupBy("dst").count().where("count > 1").count()
    top = cut(roots(tree, nodes))
    n_roots, n_reached = top.count(), depths(tree, nodes).count() if not crowded else reach(tree, top).count()
    valid = not foreign and not crowded and n_edges == n_nodes - 1 and n_roots == 1 and n_reached == n_nodes
    return tree.sparkSession.createDataFrame([(n_nodes, n_edges, foreign, crowded, n_roots, n_reached, valid)], "n_nodes bigint, n_edges bigint, foreign bigint, crowded bigint, n_roots bigint, n_reached bigint, valid boolean")


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(v, c): weakly connected components, named by their smallest vertex. A round lowers the label of an edge's end and of that end's
    own label to the other end's, then jumps pointers."""
    both = cut(edges.where("src <> dst").selectExpr("inline(array(named_struct('a', cast(src AS bigint), 'b', cast(dst AS bigint)), named_struct('a', cast(dst AS bigint), 'b', cast(src AS bigint))))"))
    vertices = edges.selectExpr("cast(src AS bigint) AS v").unionByName(edges.selectExpr("cast(dst AS bigint) AS v"))
    if nodes is not None:
        vertices = vertices.unionByName(nodes.selectExpr("cast(id AS bigint) AS v"))
    labels = cut(vertices.distinct().select("v", F.col("v").alias("c")))
    while True:
        met = both.join(labels.toDF("a", "own"), "a").join(labels.toDF("b", "other"), "b").where("other < own")
        lower = met.select(F.inline(F.array(F.struct(F.col("a").alias("v"), F.col("other").alias("c")), F.struct(F.col("own").alias("v"), F.col("other").alias("c")))))
        old = labels.withColumn("old", F.col("c"))
        hooked = cut(lower.withColumn("old", F.lit(None).cast("bigint")).unionByName(old).groupBy("v").agg(F.min("c").alias("c"), F.min("old").alias("old")))
        if hooked.where("c < old").isEmpty():
            return labels
        labels = cut(hooked.select("v", "c").join(hooked.select(F.col("v").alias("c"), F.col("c").alias("r")), "c").select("v", F.col("r").alias("c")))


# Contraction forests: (fid, parent_fid, src, dst, w, y, is_simple, v)


def lifted(forest: DataFrame) -> list[DataFrame]:
    """For k = 0, 1, ...: (fid, to, sum), the 2 ** k-th node above each that has one, and the sum of y (0 if forest has none) from the node up to below that."""
    y = F.col("y").cast("bigint") if "y" in forest.columns else F.lit(0).cast("bigint")
    out = [cut(forest.where("parent_fid IS NOT NULL").select("fid", F.col("parent_fid").alias("to"), y.alias("sum")))]
    while True:
        more = out[-1].select(F.col("fid").alias("to"), F.col("to").alias("next"), F.col("sum").alias("more"))
        further = cut(out[-1].join(off_driver(more), "to").select("fid", F.col("next").alias("to"), (F.col("sum") + F.col("more")).alias("sum")))
        if further.isEmpty():
            return out
        out.append(further)


def ancestors(forest: DataFrame, of: DataFrame | None = None, jumps: list[DataFrame] | None = None) -> DataFrame:
    """(fid, anc, dist, below): every node, or those of `of` (fid), with itself and all above it, the steps between and the sum of y from the node up to below it.

    Jumps of 2 ** k steps, from the longest to the shortest: joins grow with the logarithm of the depth, rows are those of the result. jumps: lifted(forest), where it is known.
    """
    start = forest.select("fid") if of is None else of.select("fid").distinct().join(off_driver(forest.select("fid")), "fid", "left_semi")
    out = cut(start.select("fid", F.col("fid").alias("anc"), F.lit(0).alias("dist"), F.lit(0).cast("bigint").alias("below")))
    jumps = jumps or lifted(forest)
    for k in range(len(jumps) - 1, -1, -1):
        jump = jumps[k].select(F.col("fid").alias("anc"), F.col("to"), "sum")
        further = out.join(jump, "anc").select("fid", F.col("to").alias("anc"), (F.col("dist") + (1 << k)).alias("dist"), (F.col("below") + F.col("sum")).alias("below"))
        out = out.unionByName(further)
        out = cut(out) if k % 2 == 0 else out  # two steps a table: the plan doubles with each
    return out


def _climbed(at: DataFrame, column: str, steps: str, jumps: list[DataFrame]) -> DataFrame:
    """at with `column` moved up by as many nodes as its column `steps` says."""
    for k, jump in enumerate(jumps):
        hop = jump.select(F.col("fid").alias(column), F.col("to").alias("__to"))
        at = at.join(hop, column, "left").withColumn(column, F.when(F.col(steps).bitwiseAND(F.lit(1 << k)) != 0, F.col("__to")).otherwise(F.col(column))).drop("__to")
        at = cut(at)
    return at


def lowest_common_ancestor(forest: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, lca) of pairs (a, b); null for nodes of different trees, or that the forest lacks. Both are brought to one depth, then lifted together by halving jumps: no node is listed with all above it."""
    jumps = lifted(forest)
    level = cut(_summed(forest.withColumn("y", F.lit(1))).select("fid", (F.col("r") - 1).cast("int").alias("level")))
    deep = pairs.join(level.toDF("a", "la"), "a").join(level.toDF("b", "lb"), "b")
    met = deep.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y"), F.greatest(F.col("la") - F.col("lb"), F.lit(0)).alias("ux"), F.greatest(F.col("lb") - F.col("la"), F.lit(0)).alias("uy"))
    met = _climbed(_climbed(cut(met.distinct()), "x", "ux", jumps), "y", "uy", jumps)
    for jump in reversed(jumps):
        one, two = jump.select(F.col("fid").alias("x"), F.col("to").alias("tx")), jump.select(F.col("fid").alias("y"), F.col("to").alias("ty"))
        apart = F.col("tx") != F.col("ty")
        met = met.join(one, "x", "left").join(two, "y", "left")
        met = cut(met.select("a", "b", F.when(apart, F.col("tx")).otherwise(F.col("x")).alias("x"), F.when(apart, F.col("ty")).otherwise(F.col("y")).alias("y")))
    up = forest.select("fid", "parent_fid")
    top = met.join(up.toDF("x", "px"), "x", "left").join(up.toDF("y", "py"), "y", "left")
    found = top.select("a", "b", F.when(F.col("x") == F.col("y"), F.col("x")).when(F.col("px") == F.col("py"), F.col("px")).alias("lca"))
    return pairs.join(found, ["a", "b"], "left")


def _summed(forest: DataFrame) -> DataFrame:
    """(fid, r): the sum of y from the root down to each node, itself included, by doubling pointers."""
    far = cut(forest.select("fid", F.col("parent_fid").alias("to"), F.col("y").cast("bigint").alias("r")))
    while not far.where("to IS NOT NULL").isEmpty():
        ahead = far.select(F.col("fid").alias("to"), F.col("to").alias("next"), F.col("r").alias("more"))
        far = cut(far.join(ahead, "to", "left").select("fid", F.col("next").alias("to"), (F.col("r") + F.coalesce("more", F.lit(0))).alias("r")))
    return far.select("fid", "r")


def reduction_quantities(forest: DataFrame) -> DataFrame:
    """forest with r, the sum of y from its root down to each node, itself included."""
    return forest.join(_summed(forest), "fid")


def potentials(steps: DataFrame) -> DataFrame:
    """(v, off): sums of what steps (fid, parent_fid, y, v) charge on the way from a root to v's leaf; weighted union-find as one query."""
    return reduction_quantities(steps).where("v IS NOT NULL").select("v", F.col("r").alias("off"))


def decompose(forest: DataFrame, leaves: DataFrame) -> DataFrame:
    """forest without every ancestor of leaves (fid), the leaves themselves kept; children of what goes become roots."""
    gone = cut(ancestors(forest, leaves).where("dist > 0").select(F.col("anc").alias("fid")).distinct())
    left = forest.join(gone, "fid", "left_anti")
    marked = left.join(gone.withColumnRenamed("fid", "parent_fid").withColumn("cut", F.lit(True)), "parent_fid", "left")
    return marked.withColumn("parent_fid", F.when(F.col("cut").isNull(), F.col("parent_fid"))).select(*forest.columns)


def forest_roots(forest: DataFrame) -> DataFrame:
    return forest.where("parent_fid IS NULL")


def forest_of_edge(forest: DataFrame, pairs: DataFrame) -> DataFrame:
    """Nodes of the forest whose edge is one of pairs (src, dst)."""
    return forest.join(pairs, ["src", "dst"], "left_semi")


def contracted_sets(forest: DataFrame) -> DataFrame:
    """(fid, v): the vertices that each contracted node holds; a row each, so that no set has to fit a row."""
    simple = forest.where("is_simple").select("fid")
    return ancestors(forest, simple).where("dist > 0").select(F.col("anc").alias("fid"), F.col("fid").alias("v"))


def contracted_with(forest: DataFrame, u: int, v: int) -> DataFrame:
    """Contracted nodes that hold both vertices: those above both."""
    both = ancestors(forest, forest.select("fid").where(F.col("fid").isin(u, v))).where("dist > 0").groupBy("anc").agg(F.countDistinct("fid").alias("n")).withColumnRenamed("anc", "fid")
    return forest.join(both.where(F.col("n") == len({u, v})).select("fid"), "fid", "left_semi")


def candidate_ancestors(forest: DataFrame, leaf: int, w: int) -> DataFrame:
    """Nodes from a leaf up to its root whose edge is heavier than w."""
    up = ancestors(forest, forest.select("fid").where(F.col("fid") == leaf)).select(F.col("anc").alias("fid"), "dist")
    return forest.join(up, "fid").where(F.col("w") > w)


def printed(tree: DataFrame, depth: int = 10) -> list[str]:
    """A small tree as indented lines, at most depth levels down."""
    below: dict[int, list[tuple[int, int]]] = {}
    for r in tree.collect():
        below.setdefault(r["src"], []).append((r["dst"], r["w"]))
    entered, out = {d for ds in below.values() for d, _ in ds}, []

    def line(v: int, w: int | None, level: int) -> None:
        out.append("  " * level + (f"{v}" if w is None else f"{v} ({w})"))
        if level < depth:
            for d, x in sorted(below.get(v, [])):
                line(d, x, level + 1)

    for v in sorted(set(below) - entered):
        line(v, None, 0)
    return out
