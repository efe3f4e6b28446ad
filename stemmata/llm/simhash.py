"""SimHash near-duplicates: a byte-position inverted index with count filtering."""

from __future__ import annotations

from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemmata.llm.common import LOWER_ASCII, as_bytes, connected_components, in_arrow, numbered, table
from stemmata.runtime import cut

SHINGLE, SEED, MAX_BITS = 3, 42, 3
#: Bytes of a fingerprint. With at most MAX_BITS differing bits at least MIN_SHARED of them are equal, place by place.
BYTES = 8
MIN_SHARED = BYTES - MAX_BITS
#: The places fall into two halves; MIN_SHARED of eight places hold three of one half, so the triples of each half suffice as postings.
TRIPLES = tuple(t for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for t in ((half[0], half[1], half[2]), (half[0], half[1], half[3]), (half[0], half[2], half[3]), (half[1], half[2], half[3])))
#: Fingerprints of a posting that one group takes; larger postings are split into blocks, and pairs of blocks are compared apart.
BLOCK = 1024
#: Postings that a task takes, about.
TASK_POSTINGS = 250_000
_CHUNK = 65_536


def fingerprint(text: bytes) -> int:
    """64 bits, each 1 if set in over half of the shingles' XXH64; shingles count as often as they occur."""
    words = text.translate(LOWER_ASCII).split()
    if not words:
        return 0
    hashed = partial(xxhash.xxh64_intdigest, seed=SEED)
    if len(words) < SHINGLE:
        return hashed(b" ".join(words))
    grams = map(hashed, map(b" ".join, zip(*(islice(words, k, None) for k in range(SHINGLE)))))  # noqa: B905
    total, ones = len(words) - SHINGLE + 1, np.zeros(64, np.int64)
    for start in range(0, total, _CHUNK):
        h = np.fromiter(islice(grams, _CHUNK), np.uint64, min(_CHUNK, total - start))
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def _fingerprints(batch: pa.RecordBatch) -> pa.RecordBatch:
    prints = np.fromiter(map(fingerprint, batch.column(1).to_pylist()), np.uint64, batch.num_rows)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def roots(groups: np.ndarray, prints: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """For each print the first of its group that chains of prints differing in at most max_bits bits lead to.

    groups are sorted numbers. The tally of equal bytes comes first, then the bits. Prints at one distance in the order are compared
    together, and pairs that are connected already are left out; no list of pairs is made.
    """
    root = np.arange(len(prints))
    at, lag = np.arange(len(prints)), 1
    while True:
        at = at[at + lag < len(prints)]
        at = at[groups[at] == groups[at + lag]]
        if not len(at):
            return root
        near = at[root[at] != root[at + lag]]
        differ = prints[near] ^ prints[near + lag]
        shared = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1) >= BYTES - max_bits
        near, differ = near[shared], differ[shared]
        near = near[np.bitwise_count(differ) <= max_bits]
        for i in near.tolist():
            a, b = i, i + lag
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
        while len(near) and (root != (root := root[root])).any():
            pass
        lag += 1


def _forests(batches):
    """Links of the postings in a sorted partition; the last posting of a batch waits for the next batch."""
    held: tuple[np.ndarray, np.ndarray] | None = None

    def found(keys: np.ndarray, prints: np.ndarray):
        root = roots(np.cumsum(np.r_[0, (keys[1:] != keys[:-1]).any(axis=1)]), prints)
        tied = np.flatnonzero(root != np.arange(len(root)))
        if len(tied):
            yield pa.RecordBatch.from_arrays([pa.array(prints[root[tied]].view(np.int64)), pa.array(prints[tied].view(np.int64))], ["src", "dst"])

    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
        prints = batch.column(3).to_numpy().view(np.uint64)
        if held is not None:
            keys, prints = np.concatenate([held[0], keys]), np.concatenate([held[1], prints])
        if len(keys):
            last = int(np.argmax((keys == keys[-1]).all(axis=1)))
            yield from found(keys[:last], prints[:last]) if last else ()
            held = keys[last:], prints[last:]
    if held is not None:
        yield from found(*held)


def near_links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """(src, dst) links that connect the distinct prints (fp) as all pairs differing in at most MAX_BITS bits would: each posting
    ties its prints to the first of those that they reach in it.
    """
    byte = lambda p: F.shiftrightunsigned("fp", 8 * (BYTES - 1 - p)).bitwiseAND(F.lit(255))
    key = lambda k, t: F.lit(k << 24) + byte(t[0]) * 65536 + byte(t[1]) * 256 + byte(t[2])
    postings = prints.select("fp", F.explode(F.array(*[key(k, t) for k, t in enumerate(TRIPLES)])).alias("posting"))
    large = cut(postings.groupBy("posting").agg(F.count("*").alias("n")).where(F.col("n") > block))
    one = F.lit(0).cast("long")
    if large.isEmpty():
        dealt = postings.select("posting", one.alias("a"), one.alias("b"), "fp")
    else:
        parts = postings.join(large, "posting", "left").withColumn("parts", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("parts"))
        pairs = parts.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        dealt = pairs.select("posting", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    n = 1 + len(TRIPLES) * prints.count() // TASK_POSTINGS  # tasks and files by the postings
    dealt = dealt.repartition(n, "posting", "a", "b").sortWithinPartitions("posting", "a", "b", "fp")
    return dealt.mapInArrow(_forests, "src bigint, dst bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs: component_id is the smallest id that links of at most MAX_BITS bits reach.

    A null or empty text has fingerprint zero and is linked like any other. Repeated rows and copies share a fingerprint and so a
    component; null ids are never a component's id unless it has no other. An empty table gives an empty result; only id_col and
    text_col are read. Copies fold into one fingerprint before anything is linked.
    """
    prints = cut(in_arrow(docs.select(docs[id_col].cast("long").alias("doc_id"), as_bytes(docs[text_col])), _fingerprints, "doc_id bigint, fp bigint"))
    return prints.join(_components(prints), "fp").select("doc_id", "fp", "component_id")


def _components(prints: DataFrame) -> DataFrame:
    """(fp, component_id) for the fingerprints of prints (doc_id, fp)."""
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    members = connected_components(near_links(distinct.select("fp")))
    grouped = distinct.join(members, distinct["fp"] == members["node"], "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    least = cut(grouped.groupBy("component").agg(F.min("least_id").alias("component_id")))
    return cut(grouped.join(least, "component").select("fp", "component", "component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs of each component: of those with its smallest id (null ids come last) any one, by a number of the row."""
    rows = numbered(docs)
    texts = rows.select(F.col("row")[id_col].cast("long").alias("doc_id"), as_bytes(F.col("row")[text_col]).alias("text"), "nr")
    prints = cut(in_arrow(texts, lambda b: pa.RecordBatch.from_arrays([*_fingerprints(b).columns, b.column(2)], ["doc_id", "fp", "nr"]), "doc_id bigint, fp bigint, nr bigint"))
    named = prints.join(_components(prints), "fp")
    stay = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "nr"))["nr"].alias("nr")).select("nr")
    return rows.join(stay, "nr", "left_semi").select("row.*")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of documents, with the fingerprint as 16 hexadecimal digits; null and empty texts have fingerprint zero."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
