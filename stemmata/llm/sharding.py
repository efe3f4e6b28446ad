"""Sharding by extendible hashing: a directory over hash-prefix bits in which only oversized buckets split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemmata.llm.common import table
from stemmata.runtime import cut

#: Bytes of a shard, at most.
SHARD_BYTES = 32 * 1024 * 1024
#: Bits of a hash, and bits that one round adds to the directory: a round's directory has at most 2 ** ROUND entries below each bucket that it splits.
BITS, ROUND = 60, 15


def hash_bits(key: Column) -> Column:
    """The first BITS bits of the key's MD5, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _prefix(depth: int | Column) -> Column:
    return F.expr("shiftright(h, 60 - {0})".format(depth)) if isinstance(depth, int) else F.call_function("shiftright", F.col("h"), F.lit(BITS) - depth)


def _leaves(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(rows with depth, rows that BITS bits leave in oversized buckets). rows: (..., h, n_bytes)."""
    done, rest = [], rows
    for low in range(0, BITS, ROUND):
        high = low + ROUND
        fine = cut(rest.groupBy(_prefix(high).alias("fine")).agg(F.sum("n_bytes").alias("n_bytes")))
        depths = fine.select("fine", "n_bytes", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
        depths = depths.withColumn("prefix", F.call_function("shiftright", F.col("fine"), F.lit(high) - F.col("depth")))
        # Buckets only shrink with depth: the first depth at which one fits is its leaf.
        total = F.sum("n_bytes").over(Window.partitionBy("depth", "prefix"))
        leaf = cut(depths.withColumn("total", total).where(F.col("total") <= limit).groupBy("fine").agg(F.min("depth").cast("int").alias("depth")))
        if not low:
            leaf = F.broadcast(leaf)  # 2 ** ROUND rows of 12 bytes at most
        found = rest.withColumn("fine", _prefix(high)).join(leaf, "fine", "left").drop("fine")
        done.append(found.where("depth IS NOT NULL"))
        if not low and fine.count() == leaf.count():
            return done[0], rows.limit(0)
        rest = cut(found.where("depth IS NULL").drop("depth"))
        if rest.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out, rest


def shard_documents(docs: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, depth, shard) for each row of docs; shard is the bucket's hash-prefix bits ('' if all fit one bucket).

    The bucket of a row is the shortest prefix of its id's hash whose rows hold at most `limit` bytes of text. Rows that no prefix
    parts (one id many times) split on the bits of a second hash, of their place in the input, written after a dot; a
    single row larger than limit is a shard of its own, named by all bits. A null text has 0 bytes; a null id hashes like an
    empty string. An empty table gives an empty result; only id_col and text_col are read.
    """
    bits = lambda: F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin(_prefix(F.col("depth"))), F.col("depth"), F.lit("0")))
    rows = cut(docs.select(docs[id_col].alias("doc_id"), hash_bits(docs[id_col]).alias("h"), F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("long").alias("n_bytes")))
    placed, rest = _leaves(rows, limit)
    out = placed.select("doc_id", "n_bytes", "depth", bits().alias("shard"))
    if rest.isEmpty():
        return out
    salted = cut(rest.withColumn("key", F.lpad(F.bin("h"), BITS, "0")).withColumn("h", F.shiftright(F.xxhash64(F.monotonically_increasing_id()), 4).bitwiseAND(F.lit((1 << BITS) - 1))))
    alone = salted.where(F.col("n_bytes") > limit).select("doc_id", "n_bytes", F.lit(2 * BITS).alias("depth"), F.concat_ws(".", "key", F.lpad(F.bin("h"), BITS, "0")).alias("shard"))
    small, left = _leaves(salted.where(F.col("n_bytes") <= limit), limit)
    small = small.unionByName(left.withColumn("depth", F.lit(BITS)))
    return out.unionByName(alone).unionByName(small.select("doc_id", "n_bytes", (F.col("depth") + BITS).alias("depth"), F.concat_ws(".", "key", bits()).alias("shard")))


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes docs under path, a folder a shard; rows of a repeated id go with the first of its shards."""
    shards = shard_documents(docs, limit, id_col, text_col).groupBy(F.col("doc_id").alias("__id")).agg(F.min("shard").alias("shard"))
    out = docs.join(shards, docs[id_col].eqNullSafe(F.col("__id"))).drop("__id")
    out.repartition("shard").write.partitionBy("shard").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shard_documents() of documents; nulls, repeated rows and empty tables as there."""
    return shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_sql(limit: int = SHARD_BYTES) -> str:
    return f"""
WITH hashed AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes FROM documents),
buckets AS (
  SELECT depth, h >> ({BITS} - depth) AS prefix, sum(n_bytes) AS total FROM hashed, unnest(range(0, 31)) t(depth) GROUP BY ALL),
leaf AS (
  SELECT h.doc_id, h.h, h.n_bytes, min(b.depth)::INTEGER AS depth
  FROM hashed h, unnest(range(0, 31)) t(depth) JOIN buckets b ON b.depth = t.depth AND b.prefix = h.h >> ({BITS} - t.depth) AND b.total <= {limit}
  GROUP BY ALL)
SELECT doc_id, n_bytes, depth, CASE WHEN depth = 0 THEN '' ELSE right(format('{{:060b}}', h >> ({BITS} - depth)), depth) END AS shard FROM leaf"""
