"""Operations on a stored graph of profiles, and their command line: add, remove, update and test."""

from __future__ import annotations

import argparse
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemmata.functions.alleles import padded
from stemmata.functions.distances import DIRECTIONAL, HAMMING, DistanceFunction
from stemmata.operators import complete, dynamic, lsh
from stemmata.operators.arborescence import KERNEL_EDGES, ROOT, Forest, minimum_arborescence
from stemmata.operators.arborescence import infer as inferred
from stemmata.operators.graph import next_id
from stemmata.operators.neighbour_joining import neighbour_joining
from stemmata.operators.pairs import all_pairs, cross_pairs, incremental_pairs
from stemmata.operators.trees import validate
from stemmata.runtime import cut, ship
from stemmata.sources.profiles import read_typing
from stemmata.sources.store import Store
from stemmata.streaming.updates import grow


@dataclass(frozen=True)
class Options:
    """k 0 means every pair; else at most k candidates a vertex, from `tables` samples of `width` loci within `radius`. on_demand keeps no edges."""

    algorithm: str = "static"
    distance: DistanceFunction = DIRECTIONAL
    k: int = 0
    width: int = int(lsh.DEFAULTS["width"])
    tables: int = int(lsh.DEFAULTS["tables"])
    radius: float = lsh.DEFAULTS["radius"]
    batch: int = 1000
    on_demand: bool = False
    kernel_edges: int = KERNEL_EDGES


def approximate_tree(profiles: DataFrame, samples: list[list[int]], radius: float, budget: int | None, distance: DistanceFunction, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """The arborescence over candidate edges, at most `budget` into each vertex. Where those leave several trees, more edges are made, by component: see spanned()."""
    nodes = profiles.select(F.col("id").cast("bigint").alias("id"))
    near = cut(lsh.approximate_edges(profiles, samples, radius, budget, distance))
    return spanned(profiles, near, *inferred(near, nodes, kernel_edges), distance, kernel_edges)[0]


def spanned(profiles: DataFrame, near: DataFrame, tree: DataFrame, forest: Forest, distance: DistanceFunction, kernel_edges: int = KERNEL_EDGES) -> tuple[DataFrame, int]:
    """(tree, distances measured for it): a tree that spans the profiles, from the one over `near` and its forest.

    Components that no candidate edge enters get all edges into their vertices, but for the one with the most vertices, which can be the root; only they and what their edges touch are
    inferred again. Components that have candidate edges never ask for more. Where that would be over kernel_edges edges, none is stored: lists of the lightest are measured as they are needed.
    """
    stuck = forest.nodes.where(f"parent_fid IS NULL AND src = {ROOT}").select(F.col("fid").alias("c"))
    held = cut(forest.labels().join(stuck, "c").select("v", "c"))
    largest = held.groupBy("c").count().orderBy(F.desc("count"), "c").select("c").limit(1)
    asked = cut(profiles.join(held.join(largest, "c", "left_anti").select(F.col("v").alias("id")), "id", "left_semi").select("id", "alleles"))
    n = asked.count()
    if not n:
        return tree, 0
    if n * profiles.count() > kernel_edges and complete.hold(profiles):
        return complete.minimum_complete(profiles, distance, kernel_edges, only=asked, given=near), n * (profiles.count() - 1)
    made = cut(cross_pairs(profiles, asked, distance).join(near.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "w"))
    nodes = profiles.select(F.col("id").cast("bigint").alias("id"))
    before = dynamic.State(nodes, near, tree, False, forest, kernel_edges)
    return dynamic.settled(before, nodes, near.select("src", "dst", "w").unionByName(made), made.limit(0), made).tree, n * (profiles.count() - 1)


def _samples(profiles: DataFrame, options: Options) -> list[list[int]]:
    loci = profiles.select(F.max(F.size("alleles"))).first()[0]
    return lsh.draw(options.width, options.tables, options.radius, 0, loci)


def infer(store: Store, options: Options) -> DataFrame:
    """The tree of the stored graph, or with on_demand that of its profiles, whose edges are computed and never stored."""
    nodes, edges = store.load_graph()
    if options.k:
        profiles = store.load_nodes()
        return approximate_tree(profiles, _samples(profiles, options), options.radius, options.k, options.distance, options.kernel_edges)
    if options.algorithm == "neighborjoining":
        return _joined(edges if not options.on_demand else all_pairs(store.load_nodes(), options.distance))
    if options.on_demand:
        return minimum_arborescence(all_pairs(store.load_nodes(), options.distance), nodes.select("id"), keep_edges=False)
    return minimum_arborescence(edges, nodes.select("id"))


def _joined(edges: DataFrame) -> DataFrame:
    return neighbour_joining(edges.where("src < dst").select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").cast("double").alias("d"))).select("src", "dst", "w")


@dataclass(frozen=True)
class Before:
    """What the dynamic algorithm goes on from: the stored graph, tree and forest, and the profiles."""

    state: dynamic.State
    profiles: DataFrame


def _before(store: Store, options: Options) -> Before | None:
    """None for the other algorithms. A forest of another state of the graph isn't used. With k, the stored edges are the candidates; on demand there are none, and a change is told from the forest."""
    if options.algorithm != "dynamic":
        return None
    nodes, edges = store.load_graph()
    seed = store.seed()
    seed = Forest(cut(seed.nodes), seed.serial) if seed is not None else None
    state = dynamic.State(cut(nodes.select("id")), edges if options.on_demand else cut(edges), cut(store.read("phylogeny")), False, seed, options.kernel_edges)
    return Before(state, cut(store.load_nodes()))


def _settled(store: Store, options: Options, before: Before, removed: DataFrame | None, added: DataFrame | None, ids: DataFrame | None) -> DataFrame:
    """The tree of the changed graph by the dynamic algorithm; the forest is saved. ids (id): profiles that came, went or changed."""
    nodes, edges = store.load_graph()
    now = store.load_nodes()
    if options.on_demand:
        edges = all_pairs(now, options.distance)
        if before.state.seed is not None:
            held, own = before.state.seed.nodes.select("src", "dst", "w"), ids.select(F.col("id").cast("bigint").alias("id"))
            removed = cut(held.join(own.toDF("src"), "src", "left_semi").select("src", "dst", "w").unionByName(held.join(own.toDF("dst"), "dst", "left_semi").select("src", "dst", "w")).distinct())
            changed = cut(now.join(own, "id", "left_semi").select("id", "alleles"))
            added = cut(incremental_pairs(changed, now.join(own, "id", "left_anti").select("id", "alleles"), options.distance)) if not changed.isEmpty() else removed.limit(0)
    elif options.k:
        samples = store.load_lsh()[0]
        asked, made = lsh.changed_edges(before.profiles, now, ids, samples, options.radius, options.k, options.distance)
        made = cut(made)
        gone = ids.select(F.col("id").cast("bigint").alias("id")).unionByName(asked).distinct()
        removed = _at(before.state.edges, ids).unionByName(before.state.edges.join(asked.toDF("dst"), "dst", "left_semi").select("src", "dst", "w"))
        added = made
        store.remove_incoming(gone)
        store.remove_outgoing(ids.select("id"))
        # Others keep their candidates; those that asked anew have all of theirs here.
        store.add_edges(made)
        edges = store.read("edges")
    after = dynamic.settled(before.state, cut(nodes.select("id")), edges if options.on_demand else cut(edges), removed, added, not options.on_demand)
    store.save_forest(after.seed)
    return spanned(now, after.edges, after.tree, after.seed, options.distance, options.kernel_edges)[0] if options.k else after.tree


def _finish(store: Store, options: Options, new: int, began: float, before: Before | None = None, removed: DataFrame | None = None, added: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Saves and logs the tree; returns its validation. before: what the dynamic algorithm goes on from; removed and added: the edges that the command took and made, if it knows them."""
    tree = _settled(store, options, before, removed, added, ids) if before is not None else cut(infer(store, options))
    nodes, edges = store.load_graph()
    store.save_phylogeny(tree)
    cost = tree.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    store.log_run(new, edges.count(), int((time.time() - began) * 1000), cost)
    known = edges if not options.on_demand and not options.k and options.algorithm != "neighborjoining" else None
    if options.algorithm == "neighborjoining":  # joins are nodes too
        return validate(tree, None, tree.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
    return validate(tree, known, nodes.select("id"))


def add(store: Store, profiles: DataFrame, options: Options = Options()) -> DataFrame:
    """Adds profiles (st, alleles) with ids from the largest on, their edges, and infers the tree. Returns its validation. Graph and tree change together, or not at all."""
    began, before = time.time(), _before(store, options)
    existing = store.load_nodes()
    offset = next_id(existing)
    low = profiles.agg(F.min("id")).first()[0] or 0
    width = existing.select(F.max(F.size("alleles"))).first()[0]
    new = profiles.withColumn("id", (F.col("id") - low + offset).cast("bigint"))
    new = cut(new.withColumn("alleles", padded(F.col("alleles"), width)) if width else new)
    with store.change():
        pairs = None
        if not options.on_demand and not options.k:
            pairs = cut(all_pairs(new, options.distance) if not offset else incremental_pairs(new, existing, options.distance))
            store.add_edges(pairs)
        store.add_nodes(new)
        if options.k:
            all_nodes = store.load_nodes()
            samples = store.load_lsh()[0] if before is not None and store.exists("lsh_samples") else _samples(all_nodes, options)
            store.save_lsh(samples, lsh.buckets(all_nodes, samples))
        return _finish(store, options, new.count(), began, before, pairs.limit(0) if pairs is not None else None, pairs, new.select("id"))


def _at(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges at vertices (id)."""
    own = ids.select(F.col("id").cast("bigint").alias("id"))
    out = edges.join(own.toDF("src"), "src", "left_semi").select("src", "dst", "w")
    return cut(out.unionByName(edges.join(own.toDF("src"), "src", "left_anti").join(own.toDF("dst"), "dst", "left_semi").select("src", "dst", "w")))


def remove(store: Store, ids: DataFrame, options: Options = Options()) -> DataFrame:
    """Removes nodes (id) and their edges, then infers the tree."""
    began, before = time.time(), _before(store, options)
    with store.change():
        lost = _at(before.state.edges, ids) if before is not None else None
        store.remove_nodes(ids)
        return _finish(store, options, 0, began, before, lost, lost.limit(0) if lost is not None else None, ids)


def update(store: Store, profiles: DataFrame, options: Options = Options()) -> DataFrame:
    """Replaces the profiles of nodes (id, alleles) and every edge at them, then infers the tree."""
    began, before = time.time(), _before(store, options)
    changed = cut(profiles.select(F.col("id").cast("bigint").alias("id"), "alleles"))
    rest = cut(store.load_nodes().join(changed.select("id"), "id", "left_anti"))
    with store.change():
        lost = _at(before.state.edges, changed) if before is not None else None
        store.remove_nodes(changed.select("id"))
        made = None
        if not options.on_demand and not options.k:
            made = cut(incremental_pairs(changed, rest, options.distance))
            store.add_edges(made)
        store.add_nodes(changed)
        return _finish(store, options, changed.count(), began, before, lost, made, changed.select("id"))


def test(store: Store, profiles: DataFrame, options: Options = Options()) -> list[dict]:
    """Grows the graph in batches, with a tree after each: by the static or the dynamic algorithm, or by neighbour joining."""
    if options.algorithm == "neighborjoining":
        joined = lambda edges, nodes: _joined(edges)
        return grow(store, profiles, options.batch, joined)
    if options.algorithm == "dynamic":
        held: list[dynamic.State] = []

        def seeded(edges: DataFrame, nodes: DataFrame) -> DataFrame:
            if not held:
                held.append(dynamic.start(edges, nodes, options.kernel_edges))
            else:
                new = edges.join(held[-1].edges.select("src", "dst"), ["src", "dst"], "left_anti")
                log = new.select(F.lit(0).cast("bigint").alias("seq"), F.lit("add").alias("op"), "src", "dst", "w")
                held.append(dynamic.apply_updates(held.pop(), log))
            return held[-1].tree

        return grow(store, profiles, options.batch, seeded)
    return grow(store, profiles, options.batch)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="stemmata", description=__doc__)
    parser.add_argument("operation", choices=["add", "remove", "update", "test"])
    parser.add_argument("input", help="typing table; for remove, one id a line")
    parser.add_argument("base", help="folder of the graph's tables")
    parser.add_argument("--algorithm", type=str.lower, choices=["static", "dynamic", "neighborjoining"], default="static")
    parser.add_argument("--distance", choices=["directional", "hamming"], default="directional")
    parser.add_argument("--on-demand", action="store_true")
    for name, kind in (("k", int), ("width", int), ("tables", int), ("radius", float), ("batch", int)):
        parser.add_argument(f"--{name}", type=kind, default=getattr(Options, name))
    given = parser.parse_args(arguments)
    options = Options(given.algorithm, HAMMING if given.distance == "hamming" else DIRECTIONAL, given.k, given.width, given.tables, given.radius, given.batch, given.on_demand)
    spark = SparkSession.builder.appName("stemmata").getOrCreate()
    ship(spark)
    store = Store(spark, given.base)
    if given.operation == "remove":
        ids = spark.read.text(given.input).where(F.trim("value").rlike("^[0-9]+$")).select(F.trim("value").cast("bigint").alias("id"))
        found = remove(store, ids, options)
    else:
        profiles = read_typing(spark, given.input)
        if given.operation == "test":
            for row in test(store, profiles, options):
                print(row)
            return 0
        found = (add if given.operation == "add" else update)(store, profiles, options)
    report = found.first()
    print(report.asDict())
    return 0 if report["valid"] else 1


if __name__ == "__main__":
    raise SystemExit(main())
