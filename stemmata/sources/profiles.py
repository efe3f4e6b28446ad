"""Readers of profiles, sequences, metrics and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemmata.functions.alleles import normalise_alleles

#: Line numbers of a block of a log.
LOG_BLOCK = 65_536


def _lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(file, ord, value): lines with their number in the file, from 0. Large files are read in blocks: a line's number is its place in its
    block and the lines of the blocks before, of which there is one count a block.
    """
    read = spark.read.text(path, lineSep=separator).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"), "value")
    counts = read.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = counts.select("file", "block", (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("before"))
    placed = read.withColumn("place", F.row_number().over(Window.partitionBy("file", "block").orderBy("mid")) - 1)
    return placed.join(before, ["file", "block"]).select("file", (F.col("place") + F.col("before")).alias("ord"), "value")


def _cells(lines: DataFrame, tab_anywhere: bool) -> DataFrame:
    """Adds cells. Tabs part cells if the first line has one and, unless tab_anywhere, no comma; commas do otherwise."""
    heads = lines.where("ord = 0").select("file", (F.col("value").contains("\t") & (F.lit(tab_anywhere) | ~F.col("value").contains(","))).alias("tabbed"))
    return lines.join(heads, "file").withColumn("cells", F.when(F.col("tabbed"), F.split("value", "\t")).otherwise(F.split("value", ","))).drop("tabbed")


def read_typing(spark: SparkSession, path: str, id_offset: int = 0, tab_anywhere: bool = False) -> DataFrame:
    """(id, st, alleles) of a delimited typing table with a header: ids count the good rows from id_offset, in the order of files and lines.

    Rows of fewer than two cells or with a blank ST are left out; STs are trimmed text, alleles are normalised; ragged rows stay.
    """
    rows = _cells(_lines(spark, path), tab_anywhere).where((F.col("ord") > 0) & (F.size("cells") >= 2) & (F.length(F.trim(F.col("cells")[0])) > 0))
    # Rows are numbered in runs of lines, of which there are few, and by the rows of the runs before.
    rows = rows.withColumn("run", F.floor(F.col("ord") / 65_536))
    counts = rows.groupBy("file", "run").agg(F.count("*").alias("n"))
    before = counts.select("file", "run", (F.sum("n").over(Window.orderBy("file", "run")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("file", "run").orderBy("ord")) - 1 + F.col("before") + id_offset
    return rows.join(before, ["file", "run"]).select(place.cast("int").alias("id"), F.trim(F.col("cells")[0]).alias("st"), normalise_alleles(F.slice("cells", F.lit(2), F.size("cells") - 1)).alias("alleles"))


def read_typing_lenient(spark: SparkSession, path: str) -> DataFrame:
    """(st, alleles) of every line after the header but a last empty one; nothing else is left out."""
    rows = _cells(_lines(spark, path), False).where((F.col("ord") > 0) & (F.col("value") != ""))
    return rows.select(F.trim(F.col("cells")[0]).alias("st"), normalise_alleles(F.slice("cells", F.lit(2), F.greatest(F.size("cells") - 1, F.lit(0)))).alias("alleles"))


def typing_data(profiles: DataFrame) -> DataFrame:
    """Alleles without the ST; empty profiles are left out."""
    return profiles.where(F.size("alleles") > 0).select("id", "alleles")


def st(profiles: DataFrame) -> Column:
    return profiles["st"]


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, header, seq) of FASTA records in the order of files and places; wrapped lines are joined. Records, not files, are read apart."""
    records = _lines(spark, path, "\n>").select("file", "ord", F.split(F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", ""), "\n").alias("lines"))
    runs = records.withColumn("run", F.floor(F.col("ord") / 65_536))
    counts = runs.groupBy("file", "run").agg(F.count("*").alias("n"))
    before = counts.select("file", "run", (F.sum("n").over(Window.orderBy("file", "run")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("file", "run").orderBy("ord")) - 1 + F.col("before")
    rest = F.slice("lines", F.lit(2), F.size("lines") - 1)
    return runs.join(before, ["file", "run"]).select(place.cast("int").alias("id"), F.trim(F.col("lines")[0]).alias("header"), F.array_join(rest, "").alias("seq"))


def read_entropy_json(spark: SparkSession, path: str) -> DataFrame:
    """(index, entropy, ord) of the entropy_data of a JSON document, in its order."""
    rows = spark.read.schema("entropy_data array<struct<index:int,entropy:double>>").option("multiLine", True).json(path)
    return rows.select(F.posexplode("entropy_data").alias("ord", "e")).select("e.index", "e.entropy", "ord")


def top_entropies(entropies: DataFrame, k: int) -> DataFrame:
    """The first k entries of a read_entropy_json() table."""
    return entropies.orderBy("ord").limit(k).select("index", "entropy")


def read_runtime_log(spark: SparkSession, path: str) -> DataFrame:
    """(iteration, pre_process_ms, inference_ms) of an iteration log; the inference time may stand in the same or the next line."""
    return parse_runtime_lines(_lines(spark, path))


def parse_runtime_lines(lines: DataFrame) -> DataFrame:
    """lines: (file, ord, value); ord may have gaps. A log goes in blocks of line numbers, and the last line of each meets the first of the next block that has lines."""
    inference = r"Inference time \(ms\):\s*([+-]?\d+)"
    blocks = lines.select("file", "ord", "value", F.floor(F.col("ord") / LOG_BLOCK).alias("block"))
    heads = blocks.groupBy("file", "block").agg(F.min_by("value", "ord").alias("head"))
    heads = heads.select("file", "block", F.lead("head").over(Window.partitionBy("file").orderBy("block")).alias("head"))
    following = F.lead(F.struct("value")).over(Window.partitionBy("file", "block").orderBy("ord"))
    rows = blocks.withColumn("following", following).join(heads, ["file", "block"])
    rows = rows.select("value", F.coalesce(F.when(F.col("following").isNull(), F.col("head")).otherwise(F.col("following.value")), F.lit("")).alias("next"))
    rows = rows.where(F.col("value").rlike(r"Iteration \d+.*Pre-process time \(ms\):\s*[+-]?\d+"))
    number = lambda column, pattern: F.regexp_extract(column, pattern, 1)
    found = F.when(F.col("value").rlike(inference), number("value", inference)).otherwise(number("next", inference))
    return rows.select(number("value", r"Iteration (\d+)").cast("int").alias("iteration"), number("value", r"Pre-process time \(ms\):\s*([+-]?\d+)").cast("bigint").alias("pre_process_ms"), F.when(found != "", found).cast("bigint").alias("inference_ms"))


def read_memory_log(spark: SparkSession, path: str) -> DataFrame:
    """(ts, heap, non_heap, total) of a memory log without a header."""
    return spark.read.schema("ts bigint, heap bigint, non_heap bigint, total bigint").csv(path)


def read_metrics_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(statistic, value) of distance statistics, and (position, entropy) by falling entropy, of a metrics text."""
    lines = _lines(spark, path)
    number = r"([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"
    named = rf"(?i)(Max|Min|Mean|Median|Modal) distance:\s*{number}"
    placed = rf"Entropy at position (\d+):\s*{number}"
    stats = lines.where(F.col("value").rlike(named)).select(F.lower(F.regexp_extract("value", named, 1)).alias("statistic"), F.regexp_extract("value", named, 2).cast("double").alias("value"))
    entropies = lines.where(F.col("value").rlike(placed)).select(F.regexp_extract("value", placed, 1).cast("int").alias("position"), F.regexp_extract("value", placed, 2).cast("double").alias("entropy"))
    return stats, entropies.orderBy(F.desc("entropy"), "position")
