"""Memory of the driver and the executors, sampled at an interval while other work runs."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

#: ts in seconds; heap, non_heap and total in bytes, of the driver; used and free storage memory of each executor.
SAMPLES = "batch bigint, ts bigint, heap bigint, non_heap bigint, total bigint, executors array<struct<name:string,used:bigint,free:bigint>>"


def sample(spark: SparkSession) -> tuple:
    """One sample without its batch: what the driver's process uses, and what of their storage memory executors use."""
    bean = spark._jvm.java.lang.management.ManagementFactory.getMemoryMXBean()
    heap, rest = bean.getHeapMemoryUsage().getUsed(), bean.getNonHeapMemoryUsage().getUsed()
    states, found = spark._jsc.sc().getExecutorMemoryStatus().iterator(), []
    while states.hasNext():
        pair = states.next()
        most, free = pair._2()._1(), pair._2()._2()
        found.append((pair._1(), most - free, free))
    return int(time.time()), heap, rest, heap + rest, sorted(found)


def watch(spark: SparkSession, path: str, checkpoint: str, seconds: float = 1.0) -> StreamingQuery:
    """A stream that writes a sample every so many seconds, until it is stopped; a sample that takes longer delays the next. Samples lie apart from the store's generations, so that they don't
    meet its writers: a folder of one row each, by number, which a sample taken again replaces.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()

    def write(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        own.createDataFrame([(number, *sample(own))], SAMPLES).coalesce(1).write.mode("overwrite").parquet(f"{path}/sample={number}")

    return ticks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=f"{int(seconds * 1000)} milliseconds").start()


def samples(spark: SparkSession, path: str) -> DataFrame:
    """(ts, heap, non_heap, total, executors) of all samples, in the order of a memory log."""
    return spark.read.schema(SAMPLES).parquet(path).orderBy("batch").select("ts", "heap", "non_heap", "total", "executors")
