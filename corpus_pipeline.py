"""A corpus pipeline of five operators: quality rules, line dedup, SimHash near-dedup, benchmark decontamination, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemmata.llm.common import table
from stemmata.runtime import ship, work_path
from stemmata.llm.decontaminate import clean_documents
from stemmata.llm.line_dedup import dedup_lines
from stemmata.llm.packing import pack_documents
from stemmata.llm.quality_rules import keep_good, learn
from stemmata.llm.simhash import one_of_each

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules keep. The rules are learned from the labelled ones among docs.

    A null or empty text has no words and fails the base rules; repeated rows are judged each; without labels the base rules alone decide; an empty
    table stays empty. Columns beyond COLUMNS are left behind, here and in the other stages: all of them return the columns of documents.
    """
    ship(spark)
    return keep_good(docs, learn(docs, table(spark, sf_dir, "labels"))).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that others hold too; n_chars follows the text.

    The largest id keeps a line, so ties are settled by the id; rows that share it all keep it. A null text becomes an empty one. Drops go by row, whatever
    ids repeat or are null; an empty table stays empty.
    """
    ship(spark)
    out = dedup_lines(docs)
    return out.select("row.doc_id", F.col("kept_text").alias("text"), "row.lang", "row.source", F.length("kept_text").cast("long").alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    The smallest id stays; of rows that share it, one. Texts without words are near copies of each other; an empty table stays empty.
    """
    ship(spark)
    return one_of_each(docs).select(*COLUMNS)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated. Null and empty texts have no words and stay; repeated rows are judged each; without items, and in an empty table, nothing changes."""
    ship(spark)
    return clean_documents(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of documents: every row lies in them whole, null and empty texts with size 0; an empty table gives no bins."""
    ship(spark)
    return pack_documents(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("simhash near-dedup", near_copies), ("benchmark decontamination", benchmarks), ("best-fit packing", packing)]
#: Learned rules, fingerprint components and packing aren't expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each stage's result is written as Parquet in the shared folder and read by the next."""
    docs, base = table(spark, sf_dir, "documents"), work_path(spark, f"pipeline-{uuid.uuid4().hex[:8]}")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
