"""Micro-batches: update logs and growing sets of profiles as streams."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stemmata.operators import dynamic
from stemmata.operators.arborescence import minimum_arborescence
from stemmata.operators.pairs import incremental_pairs
from stemmata.runtime import cut
from stemmata.sources.store import Store


def read_updates(spark: SparkSession, path: str) -> DataFrame:
    """A stream of dynamic.LOG rows from Parquet files that arrive in a folder."""
    return spark.readStream.schema(dynamic.LOG).parquet(path)


def maintain(updates: DataFrame, store: Store, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Applies each batch of updates to the store's graph, tree and forest, in one generation that also holds the batch's number: a batch that runs again after a failure is passed over.
    The next batch goes on from the forest.
    """

    def apply(batch: DataFrame, number: int) -> None:
        own = Store(batch.sparkSession, store.base)
        if own.mark("batch") is not None and own.mark("batch") >= number:
            return
        nodes, edges = own.load_graph()
        state = dynamic.State(cut(nodes.select("id")), cut(edges), cut(own.read("phylogeny")), False, own.seed())
        after = dynamic.apply_updates(state, batch)
        with own.change():
            own.save_graph(after.nodes.join(nodes.select("id", "alleles"), "id", "left"), after.edges)
            own.save_phylogeny(after.tree)
            own.save_forest(after.seed)
            own.set_mark("batch", number)

    writer = updates.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def grow(store: Store, profiles: DataFrame, batch_size: int, infer: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> list[dict]:
    """Adds profiles in batches of ids, infers a tree after each, and logs both times and the cost: the test mode of the command line.

    Profiles have ids from 0 on; the first two start the graph.
    """
    infer = infer or (lambda edges, nodes: minimum_arborescence(edges, nodes))
    n, low, out = profiles.count(), 0, []
    high = min(2, n)
    while low < n:
        began = time.time()
        new = profiles.where((F.col("id") >= low) & (F.col("id") < high))
        added = incremental_pairs(new, store.load_nodes().where(F.col("id") < low))
        store.add_edges(added)
        store.add_nodes(new)
        ready = time.time()
        nodes, edges = store.load_graph()
        tree = infer(edges, nodes.select("id"))
        store.save_phylogeny(tree)
        cost = store.read("phylogeny").agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
        out.append({"iteration": len(out), "pre_process_ms": int((ready - began) * 1000), "inference_ms": int((time.time() - ready) * 1000), "cost": cost})
        store.log_iteration(**out[-1])
        low, high = high, min(n, high + batch_size)
    return out
