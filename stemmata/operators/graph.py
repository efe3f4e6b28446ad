"""Weighted directed graphs as two tables: nodes (id, ...) and edges (src, dst, w). Parallel edges and loops are rows like others."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Reads


def incoming(edges: DataFrame, node: int, up_to: int | None = None) -> DataFrame:
    """Edges into a node; none if the node's id is larger than up_to."""
    rows = edges.where(F.col("dst") == node)
    return rows if up_to is None else rows.where(F.col("dst") <= up_to)


def outgoing(edges: DataFrame, node: int, up_to: int | None = None) -> DataFrame:
    """Edges from a node to others, of ids at most up_to."""
    rows = edges.where((F.col("src") == node) & (F.col("dst") != node))
    return rows if up_to is None else rows.where(F.col("dst") <= up_to)


def adjacency(edges: DataFrame) -> DataFrame:
    """Of parallel edges the first by `ord`, or the lightest if there is no such column."""
    first = F.struct("ord", "w") if "ord" in edges.columns else F.col("w")
    return edges.groupBy("src", "dst").agg(F.min_by("w", first).alias("w"))


def existing(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (src, dst) of wanted that are edges."""
    return wanted.join(edges.select("src", "dst"), ["src", "dst"], "left_semi")


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("dst").agg(F.count("*").alias("n"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge touches."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return nodes.join(ends, "id", "left_anti")


def ordered_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("w", "src", "dst")


def next_id(nodes: DataFrame) -> int:
    return (nodes.agg(F.max("id")).first()[0] or 0) + 1 if not nodes.isEmpty() else 0


# Changes


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes with new ones; a new node replaces one of the same id."""
    return nodes.join(new.select("id"), "id", "left_anti").unionByName(new)


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    return edges.unionByName(new)


def remove_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Graph without the nodes `ids` (id) and every edge at them. Unknown ids are ignored, or with strict an error."""
    if strict and not (lost := ids.join(nodes, "id", "left_anti")).isEmpty():
        raise ValueError(f"no such node: {lost.first()['id']}")
    src, dst = ids.select(F.col("id").alias("src")), ids.select(F.col("id").alias("dst"))
    return nodes.join(ids, "id", "left_anti"), edges.join(src, "src", "left_anti").join(dst, "dst", "left_anti").select(*edges.columns)


def remove_incoming(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select(F.col("id").alias("dst")), "dst", "left_anti").select(*edges.columns)


def remove_outgoing(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").select(*edges.columns)


def remove_edges(edges: DataFrame, wanted: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One edge less for each row of wanted (src, dst, or src, dst, w): of parallel ones the first in `order` (w by default) goes."""
    keys = [c for c in ("src", "dst", "w") if c in wanted.columns]
    less = wanted.groupBy(*keys).agg(F.count("*").alias("__less"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or ["w"])))
    marked = edges.withColumn("__place", place).join(less, keys, "left")
    return marked.where(F.col("__place") > F.coalesce("__less", F.lit(0))).select(*edges.columns)


# Components and weights


def labelled(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Adds csrc and cdst, the components (v, c) of an edge's ends."""
    return edges.join(components.toDF("src", "csrc"), "src").join(components.toDF("dst", "cdst"), "dst")


def adjusted(edges: DataFrame, potential: DataFrame) -> DataFrame:
    """Adds adj: the weight and the offset (v, off) of the edge's end, if it has one."""
    return edges.join(potential.toDF("dst", "off"), "dst", "left").withColumn("adj", F.col("w") + F.coalesce("off", F.lit(0))).drop("off")


def _least(key: str, columns: list[str], weight: str) -> Column:
    return F.min(F.struct(F.col(weight), F.col("src"), F.col("dst"), *[F.col(c) for c in columns if c not in (weight, "src", "dst", key)])).alias("x")


#: More than there are ids: a weight times this and an id above the least make one number, by which both are in order.
_IDS = 2 * 10**19


def _key(weight: str) -> Column:
    """One number of a weight and src: a minimum of numbers is kept in a hash table, where that of a struct has Spark sort all rows of a task. Weights of over 4.9e18 are an error."""
    return (F.col(weight).cast("decimal(19,0)") * F.lit(Decimal(_IDS)) + (F.col("src").cast("decimal(20,0)") + F.lit(Decimal(1 << 63)))).cast("decimal(38,0)")


def _of_key(key: str, weight: str) -> list[Column]:
    """(weight, src) of a number made by _key()."""
    source = F.pmod(F.col(key), F.lit(Decimal(_IDS)).cast("decimal(38,0)"))
    return [F.expr(f"({key} - pmod({key}, {_IDS}BD)) div {_IDS}BD").cast("bigint").alias(weight), (source - F.lit(Decimal(1 << 63))).cast("bigint").alias("src")]


def min_in_edges(edges: DataFrame, by: str = "dst", weight: str = "w") -> DataFrame:
    """The lightest row of each `by`, ties by src and dst; partly combined before the shuffle."""
    if by == "dst" and set(edges.columns) == {"src", "dst", weight} and all(edges.schema[c].dataType == LongType() for c in ("src", weight)):
        found = edges.groupBy("dst").agg(F.min(_key(weight)).alias("key")).select("dst", *_of_key("key", weight))
        return found.select("dst", *[c for c in edges.columns if c != "dst"])
    rest = [c for c in edges.columns if c not in (by,)]
    found = edges.groupBy(by).agg(_least(by if by not in ("src", "dst") else "", edges.columns, weight))
    return found.select(by, *[F.col(f"x.{c}").alias(c) for c in rest])


def min_safe_edges(edges: DataFrame, components: DataFrame, potential: DataFrame) -> DataFrame:
    """(cdst, adj, src, dst, w, csrc): each component's lightest incoming edge from another one, by adjusted weight."""
    # In all partitions: joined in few large ones, a task's memory would grow with the edges.
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    from_ = edges.select("src", "dst", F.col("w").cast("bigint").alias("w")).repartition(n, "src").join(components.toDF("src", "csrc"), "src")
    rows = adjusted(from_.repartition(n, "dst").join(components.toDF("dst", "cdst"), "dst"), potential).where("csrc <> cdst")
    # All edges into a vertex are charged alike, so its lightest is known before components are compared.
    ends = rows.groupBy("cdst", "dst").agg(F.min(_key("adj")).alias("key"), F.min("w").alias("w")).select("cdst", "dst", *_of_key("key", "adj"), "w")
    found = min_in_edges(ends.select("cdst", "adj", "src", "dst", "w"), "cdst", "adj")
    return found.join(components.toDF("src", "csrc"), "src").select("cdst", "adj", "src", "dst", "w", "csrc")


def max_in_cycle(edges: DataFrame, weight: str = "w") -> DataFrame:
    """The heaviest of edges that form a cycle; ties by src and dst."""
    return edges.agg(F.max(F.struct(weight, "src", "dst")).alias("x")).select("x.src", "x.dst", f"x.{weight}")


def cost(tree: DataFrame) -> DataFrame:
    return tree.agg(F.coalesce(F.sum(F.col("w").cast("bigint")), F.lit(0)).alias("cost"))


def members(components: DataFrame) -> DataFrame:
    """(c, vs): what each component is made of."""
    return components.groupBy("c").agg(F.sort_array(F.collect_set("v")).alias("vs"))
