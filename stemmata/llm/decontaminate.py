"""Benchmark decontamination: a prefix-filtered containment join of document words with item windows."""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemmata.llm.common import LOWER, UPPER, as_bytes, in_arrow, table
from stemmata.runtime import cut

WINDOW = 13
#: Bytes of benchmark text that one pass sends to the executors, at most; a larger benchmark takes several passes.
BLOCK_BYTES = 4_000_000
#: A-Z lower-cased; what is neither a digit, a letter nor beyond ASCII parts words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class WindowIndex:
    """Item windows by their rarest word.

    A window of n words is contained exactly, so its necessary prefix in the order of rarity is one word. A document position of that
    word fixes where the window would start (positional bound); it must fit in the document (length bound) and is then verified.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], frequency: dict[bytes, int], window: int = WINDOW):
        self.items = items
        self.by_word: dict[bytes, list[tuple[int, int, list[bytes], list[int]]]] = {}
        same: dict[tuple[bytes, ...], list[int]] = {}
        for k, (_, item) in enumerate(items):
            for start in range(max(1, len(item) - window + 1) if item else 0):
                held = tuple(item[start : start + window])
                if held in same:
                    if same[held][-1] != k:
                        same[held].append(k)
                    continue
                same[held] = [k]
                at = min(range(len(held)), key=lambda i: (frequency.get(held[i], 0), held[i], i))
                self.by_word.setdefault(held[at], []).append((at, len(held), list(held), same[held]))

    def match(self, doc: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Maximal runs of hit words as (start, end), and the indexes of items with windows that occur."""
        spans, found, index, size = [], set(), self.by_word, len(doc)
        for pos in [i for i, w in enumerate(doc) if w in index]:
            for at, n, held, items in index[doc[pos]]:
                start = pos - at
                if start >= 0 and start + n <= size and doc[start : start + n] == held:
                    spans.append((start, start + n))
                    found.update(items)
        return merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int, window: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of bounded size; one that is larger than a block goes on in the next with its last window - 1 words again."""
    block, size = [], 0
    for item, text in benchmark.select(benchmark[item_col].cast("string"), as_bytes(benchmark[text_col])).toLocalIterator():
        left = words(bytes(text))
        while left:
            most = max(window, (block_bytes - size) // 8)
            block.append((item, left[:most]))
            size += sum(map(len, left[:most])) + 8 * len(left[:most])
            left = left[most - window + 1 :] if len(left) > most else []
            if size >= block_bytes:
                yield block
                block, size = [], 0
    if block:
        yield block


_indexes: dict[str, WindowIndex] = {}


def _index(key: str, items, frequency, window) -> WindowIndex:
    """Built once a worker."""
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = WindowIndex(items, frequency, window)
    return _indexes[key]


def _frequencies(docs: DataFrame, text_col: str, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How often all documents use each word of the block; counted on each partition first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update([w for w in words(text) if w in vocabulary])
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    rows = docs.select(as_bytes(docs[text_col])).mapInArrow(counted, "word binary, n bigint")
    return {bytes(r["word"]): r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None) -> DataFrame:
    """docs (its columns `carry`, or all) as a struct column `row`, with n_words, n_hit, n_items, items, items_sha256, contaminated, and
    spans, the runs of hit words.

    A window is `window` words of an item in a row, or a shorter item whole. A null or empty text has no words and is never
    contaminated; items without words, and a benchmark without rows, hit nothing; items that repeat an id count as one; a null item id
    is written as an empty string. Repeated rows are judged each; an empty table gives an empty result; columns may have any name.
    The benchmark goes out in blocks of at most block_bytes, one pass each; passes after the first read written rows.
    """
    out = docs.select(F.struct(*[docs[c] for c in carry or docs.columns]).alias("row"), as_bytes(docs[text_col]).alias("bytes"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<s:int,e:int>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes, window)
    items = next(blocks, [])
    while True:
        after = next(blocks, None)
        frequency = _frequencies(docs, text_col, frozenset(w for _, ws in items for w in ws)) if items else {}
        out = _pass(out, items, frequency, window, last=after is None)
        if after is None:
            break
        out, items = cut(out), after
    n_hit = F.aggregate(F.col("spans"), F.lit(0).cast("long"), lambda a, x: a + (x["e"] - x["s"]))
    out = out.select("row", "n_words", n_hit.alias("n_hit"), F.sort_array("items").alias("items"), "spans")
    return out.select("row", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "spans")


def _pass(rows: DataFrame, items, frequency, window: int, last: bool) -> DataFrame:
    """Adds the hits of a block; the last pass leaves the texts behind."""
    key = uuid.uuid4().hex
    names = ["row", *([] if last else ["bytes"]), "n_words", "spans", "items"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    span = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def matched(batch: pa.RecordBatch) -> pa.RecordBatch:
        index = _index(key, items, frequency, window)
        spans, found, sizes = [], [], []
        for text, old, had in zip(*(batch.column(c).to_pylist() for c in ("bytes", "spans", "items")), strict=True):
            doc = words(text)
            new, which = index.match(doc)
            spans.append([{"s": s, "e": e} for s, e in merged([*((x["s"], x["e"]) for x in old), *new])])
            found.append(sorted({*had, *(index.items[i][0] or "" for i in which)}))
            sizes.append(len(doc))
        kept = [batch.column(0), *([] if last else [batch.column("bytes")])]
        return pa.RecordBatch.from_arrays([*kept, pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(found, pa.list_(pa.string()))], names)

    return in_arrow(rows, matched, kinds)


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that aren't contaminated."""
    return decontaminate(docs, benchmark, **options).where(~F.col("contaminated")).select("row.*")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """decontaminate() of documents against benchmark: one row a document, nulls, ties, repeated rows and empty tables as there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=["doc_id"]).select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op1_sql(docs: str = "documents") -> str:
    words_of = lambda t: rf"regexp_extract_all(translate(coalesce({t}, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH item_words AS (SELECT item_id, {words_of("text")} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS held, least(len(w), {WINDOW}) AS n
  FROM item_words, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) t(i) WHERE len(w) > 0),
doc_words AS (SELECT doc_id, {words_of("text")} AS w FROM {docs}),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT d.doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS held
  FROM doc_words d, sizes, unnest(range(1, len(w) - n + 2)) t(i) WHERE len(w) >= n),
hits AS (SELECT p.doc_id, p.i, p.n, x.item_id FROM places p JOIN windows x ON p.held = x.held AND p.n = x.n),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + n)) t(j) GROUP BY doc_id),
held AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, coalesce(item_id::VARCHAR, '') AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM doc_words d LEFT JOIN covered USING (doc_id) LEFT JOIN held USING (doc_id)"""
