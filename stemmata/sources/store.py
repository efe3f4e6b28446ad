"""Graphs, trees, forests and hash tables as Parquet tables under a base path.

A table is a list of parts, each a Parquet folder of its own that is never written again: rows, or (for edges) what goes from the parts before it. A manifest names the parts of
all tables; a change writes its parts first and then the next manifest, at once. Readers see a generation whole; a writer that fails leaves the last one as it was.
"""

from __future__ import annotations

import copy
import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from stemmata.operators import graph
from stemmata.operators.arborescence import Forest
from stemmata.runtime import cut, delete
from stemmata.sources.gone import GONE, without

#: Columns of each table; nodes may have profiles besides.
SCHEMAS = {
    "nodes": "id bigint, alleles array<bigint>",
    "edges": "src bigint, dst bigint, w bigint",
    "phylogeny": "src bigint, dst bigint, w bigint",
    "atree": "fid bigint, parent_fid bigint, src bigint, dst bigint, w bigint, y bigint, is_simple boolean",
    "lsh_samples": "tbl int, loci array<int>",
    "lsh_buckets": "id bigint, alleles array<bigint>, tbl int, key array<bigint>",
    "run_metrics": "new_nodes bigint, edges bigint, ms bigint, cost bigint",
    "iteration_metrics": "iteration int, pre_process_ms bigint, inference_ms bigint, cost bigint",
    "memory": "ts bigint, heap bigint, non_heap bigint, total bigint",
}
#: Buckets that edges are clustered by; a vertex has no file of its own.
EDGE_BUCKETS = 64
#: Parts of deleted edges that a table has before it is written anew.
LOGS = 16
#: Generations that stay readable.
KEPT = 2


class Store:
    """Tables of one graph. Reads prune columns and push filters; each change makes a generation, and change() makes one of several."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._changed: dict | None = None

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    # Generations

    def _hadoop(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self) -> list[int]:
        fs, p = self._hadoop("manifests")
        if not fs.exists(p):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(p)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def _manifest(self, number: int) -> dict:
        fs, p = self._hadoop(f"manifests/{number:09d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self) -> dict:
        """generation; tables: the parts (kind, folder) of each; graph: how often nodes or edges changed; inferred: that number for the tree and the forest as stored, each; marks: numbers kept by name."""
        if self._changed is not None:
            return self._changed
        numbers = self._numbers()
        if numbers:
            return self._manifest(numbers[-1])
        return {"generation": 0, "tables": {}, "graph": 0, "inferred": {}, "marks": {}}

    @contextmanager
    def change(self) -> Iterator[None]:
        """All changes within become visible together at its end, or not at all if it fails. An error where another writer has made the generation meanwhile."""
        if self._changed is not None:
            yield
            return
        self._changed = copy.deepcopy(self.manifest())
        try:
            yield
            self._swap()
        finally:
            self._changed = None

    def _swap(self) -> None:
        held = self._changed
        held["generation"] += 1
        number = held["generation"]
        fs, temporary = self._hadoop(f"manifests/.{uuid.uuid4().hex}")
        stream = fs.create(temporary)
        stream.write(bytearray(json.dumps(held).encode()))
        stream.close()
        _, final = self._hadoop(f"manifests/{number:09d}.json")
        if fs.exists(final) or not fs.rename(temporary, final):
            fs.delete(temporary, False)
            raise RuntimeError(f"generation {number} of {self.base} was made by another writer")
        numbers = self._numbers()
        old, kept = numbers[:-KEPT], numbers[-KEPT:]
        parts = lambda n: {part for table in self._manifest(n)["tables"].values() for _, part in table}
        with suppress(Exception):  # what stays behind is never read again
            used = set().union(*[parts(n) for n in kept])
            for n in old:
                for part in parts(n) - used:
                    delete(self.spark, self.path(part))
                delete(self.spark, self.path(f"manifests/{n:09d}.json"))

    def _write(self, name: str, df: DataFrame, kind: str, anew: bool) -> None:
        part = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(self.path(part))
        with self.change():
            tables = self._changed["tables"]
            tables[name] = ([] if anew else tables.get(name, [])) + [[kind, part]]
            if name in ("nodes", "edges"):
                self._changed["graph"] += 1

    def exists(self, name: str) -> bool:
        return bool(self.manifest()["tables"].get(name))

    def read(self, name: str) -> DataFrame:
        parts = self.manifest()["tables"].get(name) or []
        out, folders = None, []
        for kind, part in [*parts, ["end", None]]:
            if kind == "rows":
                folders.append(self.path(part))
                continue
            if folders:
                rows = self.spark.read.schema(SCHEMAS[name]).parquet(*folders)
                out, folders = (rows if out is None else out.unionByName(rows)), []
            if kind == "gone" and out is not None:
                out = without(out, self.spark.read.schema(GONE).parquet(self.path(part)))
        return out if out is not None else self.spark.createDataFrame([], SCHEMAS[name])

    def _shaped(self, name: str, df: DataFrame) -> DataFrame:
        kinds = self.spark.createDataFrame([], SCHEMAS[name]).schema
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds])

    def overwrite(self, name: str, df: DataFrame) -> None:
        """df in place of the table, which it may read."""
        rows = self._shaped(name, df)
        if name == "edges":
            rows = rows.repartition(F.pmod(F.xxhash64("dst"), F.lit(EDGE_BUCKETS))).sortWithinPartitions("dst", "w")
        self._write(name, rows, "rows", True)

    def append(self, name: str, df: DataFrame) -> None:
        self._write(name, self._shaped(name, df), "rows", False)

    def _delete(self, gone: DataFrame) -> None:
        """Notes what goes from edges; after LOGS notes the table is written anew."""
        kinds = self.spark.createDataFrame([], GONE).schema
        with self.change():
            self._write("edges", gone.select(*[(F.col(f.name) if f.name in gone.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds]).coalesce(1), "gone", False)
            if sum(kind == "gone" for kind, _ in self._changed["tables"]["edges"]) > LOGS:
                self.overwrite("edges", self.read("edges"))

    # Nodes

    def save_nodes(self, nodes: DataFrame) -> None:
        self.overwrite("nodes", nodes)

    def add_nodes(self, nodes: DataFrame) -> None:
        """Nodes that take the place of those with their ids."""
        if not nodes.isEmpty():
            self.overwrite("nodes", graph.add_nodes(self.read("nodes"), self._shaped("nodes", nodes)))

    def load_nodes(self) -> DataFrame:
        return self.read("nodes")

    def node_ids(self) -> DataFrame:
        return self.read("nodes").select("id")

    def count_nodes(self) -> int:
        return self.node_ids().count()

    def node_index(self) -> DataFrame:
        """(id, file, row): where each node lies."""
        folders = [self.path(part) for _, part in self.manifest()["tables"]["nodes"]]
        return self.spark.read.parquet(*folders).select("id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))

    def remove_node(self, node: int) -> None:
        self.remove_nodes(self.spark.createDataFrame([(node,)], "id bigint"), strict=True)

    def remove_nodes(self, ids: DataFrame, strict: bool = False) -> None:
        """Removes nodes and all edges at them."""
        ids = cut(ids.select(F.col("id").cast("bigint").alias("id")).distinct())
        nodes, _ = graph.remove_nodes(self.read("nodes"), self.read("edges"), ids, strict)
        with self.change():
            self.overwrite("nodes", nodes)
            if self.exists("edges"):
                self._delete(ids.select(F.lit("at").alias("kind"), F.col("id").alias("src")))

    # Edges

    def save_edges(self, edges: DataFrame) -> None:
        self.overwrite("edges", edges)

    def add_edges(self, edges: DataFrame) -> None:
        if not edges.isEmpty():
            self.append("edges", edges)

    def incoming(self, node: int, up_to: int | None = None) -> DataFrame:
        return graph.incoming(self.read("edges"), node, up_to)

    def outgoing(self, node: int, up_to: int | None = None) -> DataFrame:
        return graph.outgoing(self.read("edges"), node, up_to)

    def edge_exists(self, src: int, dst: int) -> bool:
        return not self.read("edges").where((F.col("src") == src) & (F.col("dst") == dst)).isEmpty()

    def count_edges(self, node: int) -> int:
        return self.incoming(node).count()

    def stream_edges(self, consumer: Callable[[Row], None]) -> None:
        """Hands every edge to consumer on the driver, a partition at a time."""
        for row in self.read("edges").toLocalIterator():
            consumer(row)

    def each_partition(self, consumer: Callable[[Iterator[Row]], None]) -> None:
        self.read("edges").foreachPartition(consumer)

    def remove_edge(self, src: int, dst: int) -> None:
        """Removes the lightest edge between the two, one copy of it; a note of one row. Nothing where there is none."""
        w = self.read("edges").where((F.col("src") == src) & (F.col("dst") == dst)).agg(F.min("w")).first()[0]
        if w is not None:
            self._delete(self.spark.createDataFrame([("edge", src, dst, w, 1)], GONE))

    def remove_edges(self, edges: DataFrame) -> None:
        """Removes as many copies of each edge (src, dst, w) as the rows say."""
        self._delete(edges.groupBy("src", "dst", "w").agg(F.count("*").alias("n")).withColumn("kind", F.lit("edge")))

    def remove_incoming(self, ids: DataFrame) -> None:
        self._delete(ids.select(F.lit("into").alias("kind"), F.col("id").alias("src")).distinct())

    def remove_outgoing(self, ids: DataFrame) -> None:
        self._delete(ids.select(F.lit("from").alias("kind"), F.col("id").alias("src")).distinct())

    # Graphs and results

    def save_graph(self, nodes: DataFrame, edges: DataFrame) -> None:
        with self.change():
            self.save_nodes(nodes)
            self.save_edges(edges)

    def load_graph(self) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges); ends of edges that no node row names are nodes too."""
        nodes, edges = self.read("nodes"), self.read("edges")
        ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
        return nodes.unionByName(ends.join(nodes, "id", "left_anti"), allowMissingColumns=True), edges

    def add_node_with_edges(self, nodes: DataFrame, edges: DataFrame) -> None:
        with self.change():
            self.add_nodes(nodes)
            self.add_edges(edges)

    def save_phylogeny(self, tree: DataFrame) -> None:
        """Keeps a tree of the graph as it is stored now."""
        with self.change():
            self.overwrite("phylogeny", tree)
            self._changed["inferred"]["phylogeny"] = self._changed["graph"]

    def save_forest(self, forest: Forest) -> None:
        """Keeps what the tree was opened from, for updates of a later session. Of the graph as it is stored now."""
        with self.change():
            self.overwrite("atree", forest.nodes)
            self._changed["inferred"]["atree"] = self._changed["graph"]
            self._changed["marks"]["serial"] = forest.serial

    def load_forest(self) -> DataFrame:
        return self.read("atree")

    def seed(self) -> Forest | None:
        """The stored forest; None if the graph, or the tree, is of another state than it."""
        held = self.manifest()
        stamps = {held["graph"], held["inferred"].get("atree"), held["inferred"].get("phylogeny")}
        return Forest(self.load_forest(), held["marks"]["serial"]) if len(stamps) == 1 and self.exists("atree") else None

    def mark(self, name: str) -> int | None:
        return self.manifest()["marks"].get(name)

    def set_mark(self, name: str, number: int) -> None:
        with self.change():
            self._changed["marks"][name] = number

    def save_lsh(self, samples: list[list[int]], buckets: DataFrame) -> None:
        with self.change():
            self.overwrite("lsh_samples", self.spark.createDataFrame(list(enumerate(samples)), SCHEMAS["lsh_samples"]))
            self.overwrite("lsh_buckets", buckets)

    def load_lsh(self) -> tuple[list[list[int]], DataFrame]:
        return [list(r["loci"]) for r in self.read("lsh_samples").orderBy("tbl").collect()], self.read("lsh_buckets")

    # Logs

    def log_run(self, new_nodes: int, edges: int, ms: int, cost: int) -> None:
        self.append("run_metrics", self.spark.createDataFrame([(new_nodes, edges, ms, cost)], SCHEMAS["run_metrics"]))

    def log_iteration(self, iteration: int, pre_process_ms: int, inference_ms: int, cost: int) -> None:
        self.append("iteration_metrics", self.spark.createDataFrame([(iteration, pre_process_ms, inference_ms, cost)], SCHEMAS["iteration_metrics"]))

    def log_memory(self) -> None:
        """One sample of the driver's memory."""
        run = self.spark._jvm.java.lang.management.ManagementFactory.getMemoryMXBean()
        heap, rest = run.getHeapMemoryUsage().getUsed(), run.getNonHeapMemoryUsage().getUsed()
        self.append("memory", self.spark.createDataFrame([(int(time.time()), heap, rest, heap + rest)], SCHEMAS["memory"]))

    def write_json(self, df: DataFrame, name: str) -> None:
        df.coalesce(1).write.mode("overwrite").json(self.path(name))
