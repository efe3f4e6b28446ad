"""Shared folders and lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset in local runs; an error on a cluster."""
    named, jsc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext._jsc.sc()
    if not named and jsc.getCheckpointDir().isEmpty() and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='stemmata-')}")
    return named or jsc.getCheckpointDir().get()


def work_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; what is written there goes when the process ends."""
    path = f"{shared_dir(spark)}/stemmata-{what}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """df computed now, its lineage cut: written as Parquet in the shared folder, where it outlives executors, and read back.

    Unlike a checkpoint it brings no constraints and partitionings of its plan along, which in loops double from round to round.
    """
    path = work_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a table may have to be sent to all executors through the driver.
SMALL = 250_000


def off_driver(df: DataFrame) -> DataFrame:
    """df for the right side of a join: sorted and merged where it has over SMALL rows. Small columns of long tables look small to Spark by the bytes of their files and would go through the driver."""
    return df.hint("merge") if df.count() > SMALL else df


def ship(spark: SparkSession) -> None:
    """Gives executors this package, once a context: their Python need not find it on a path of their own."""
    sc, root = spark.sparkContext, os.path.dirname(os.path.abspath(__file__))
    if getattr(sc, "_stemmata_shipped", False) or not os.path.isdir(root):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="stemmata-"), "stemmata.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("stemmata", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._stemmata_shipped = True


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
