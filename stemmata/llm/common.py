"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemmata.runtime import cut, delete

#: ASCII letters; contracts lower-case these and nothing else.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The bytes 0x20 and 0x09-0x0D.
BLANKS = " \t\n\x0b\x0c\r"
#: Links that a task of connected_components() takes, about.
TASK_LINKS = 250_000
#: bytes.translate table that lower-cases A-Z only.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dropped(df: DataFrame) -> None:
    """Deletes what cut() wrote for df."""
    for path in {x.rpartition("/")[0] for x in df.inputFiles()}:
        if "/stemmata-" in path:
            delete(df.sparkSession, path)


def numbered(df: DataFrame) -> DataFrame:
    """(row, nr): the rows of df as structs with a number of their own, cut once so that the numbers stay."""
    return cut(df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), F.monotonically_increasing_id().alias("nr")), "rows")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def in_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """df with fn applied to each record batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(each, schema)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, Arrow batches of queries that run have at most so many rows: a batch of whole texts is held by the executor and by its Python worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def as_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def among(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of docs whose rk may be in wanted, by a bitmap of 2 ** 23 bits: at most 131,072 rows of 16 bytes are broadcast, whatever the input."""
    slot = F.pmod(F.col("rk"), F.lit(1 << 23))
    word, bit = F.shiftright(slot, 6), F.pmod(slot, F.lit(64)).cast("int")
    words = wanted.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    held = docs.withColumn("word", word).join(F.broadcast(words), "word")
    return held.where(F.call_function("shiftrightunsigned", F.col("bits"), bit).bitwiseAND(F.lit(1)) == 1).drop("word", "bits")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (src long, dst long) but self-links: component is the smallest node reachable.

    Each round lowers the labels of an edge's end and of that end's root to the other end's label, then jumps pointers, so rounds grow
    with the logarithm of a component. The labels of a round are cut in the shared folder. Joins are sort-merge joins of two
    plain exchanges, which adaptive execution splits at hubs; minima are combined before the shuffle.
    """
    edges = edges.where("src <> dst")
    ends = [F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in (("src", "dst"), ("dst", "src"))]
    both = cut(edges.select(F.inline(F.array(*ends))))  # not a union: that would compute the links twice
    # Links are often few: tasks and files by their number, not by that of the input's partitions.
    tasks = 1 + both.count() // TASK_LINKS
    fewer = lambda df: cut(df.coalesce(tasks))
    labels = fewer(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.min("src")).alias("component")))
    while True:
        met = both.join(labels.toDF("src", "own"), "src").join(labels.toDF("dst", "other"), "dst").where("other < own")
        heard = met.select(F.inline(F.array(F.struct(F.col("src").alias("node"), F.col("other").alias("component")), F.struct(F.col("own").alias("node"), F.col("other").alias("component")))), F.lit(None).cast("long").alias("old"))
        hooked = fewer(heard.unionByName(labels.withColumn("old", F.col("component"))).groupBy("node").agg(F.min("component").alias("component"), F.min("old").alias("old")))
        if hooked.where("component < old").isEmpty():
            return labels
        labels = fewer(hooked.join(hooked.select(F.col("node").alias("component"), F.col("component").alias("root")), "component").select("node", F.col("root").alias("component")))
