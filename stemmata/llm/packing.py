"""Best-fit packing of documents into sequences, with conflicts of source and of duplicate cluster."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemmata.llm.common import BLANKS, table

#: Words of a sequence.
CAPACITY = 2048
#: Documents that are packed together, about; the number of such parts grows with the table.
PART_ROWS = 2048


class Bins:
    """Open bins ordered by what they have left, each with one bitmap of the sources and clusters that it holds.

    An item goes to the tightest bin that it fits and does not conflict with: the search starts at the smallest sufficient residual
    and goes on to its successors, past bins that conflict, until one is found. Bins of one residual and bitmap lie together, so that
    a conflict is tested once for all of them.
    """

    def __init__(self, capacity: int):
        self.capacity, self.count = capacity, 0
        self.open: dict[int, dict[int, list[int]]] = {}
        self.residuals = 0  # bit r: some bin has r left

    def place(self, size: int, bits: int) -> int:
        """The number of the bin that takes an item."""
        rest, left = self.residuals >> size, size
        while rest:
            skip = (rest & -rest).bit_length()
            left += skip - 1
            held = self.open[left]
            for mask, bins in held.items():
                if not mask & bits:
                    found = bins.pop()
                    if not bins:
                        del held[mask]
                        if not held:
                            del self.open[left]
                            self.residuals &= ~(1 << left)
                    return self._put(found, left - size, mask | bits)
            rest >>= skip
            left += 1
        return self._put(self._new(), self.capacity - size, bits)

    def _new(self) -> int:
        self.count += 1
        return self.count - 1

    def _put(self, number: int, left: int, mask: int) -> int:
        self.open.setdefault(left, {}).setdefault(mask, []).append(number)
        self.residuals |= 1 << left
        return number


def pack(items: Iterable[tuple[int | None, int, object, object]], capacity: int = CAPACITY) -> list[list[tuple[int | None, int, int]]]:
    """Bins of (id, start, size) pieces for items (id, size, source, cluster).

    An item larger than a bin is cut into full bins and a remainder. Pieces are placed by falling size, ties by id. Pieces of one
    document, documents of one source, and documents of one cluster never share a bin; a null source or cluster conflicts with
    none. Empty items take part and fill nothing.
    """
    items = list(items)
    clusters = Counter(c for *_, c in items if c is not None)
    bit: dict[object, int] = {}
    full, pieces = [], []
    for key, size, source, cluster in items:
        start = 0
        while size - start > capacity:
            full.append([(key, start, capacity)])
            start += capacity
        pieces.append((size - start, key, start, source, cluster))
    pieces.sort(key=lambda p: (-p[0], p[1] is None, p[1] or 0, p[2], str(p[3]), str(p[4])))
    bins, out = Bins(capacity), []
    for size, key, start, source, cluster in pieces:
        labels = [("source", source)] * (source is not None) + [("cluster", cluster)] * (cluster is not None and clusters[cluster] > 1)
        number = bins.place(size, sum(1 << bit.setdefault(x, len(bit)) for x in labels))
        if number == len(out):
            out.append([])
        out[number].append((key, start, size))
    return full + out


def count_words(text: Column) -> Column:
    trimmed = F.coalesce(F.btrim(text, F.lit(BLANKS)), F.lit(""))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))).cast("long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, cluster: Column | None = None) -> DataFrame:
    """(bin_id, doc_ids, starts, sizes, used): one row a bin of at most `capacity` words; every document is in the bins whole.

    size: a document's length, by default its words; cluster: its duplicate cluster, by default the hash of its text, so that exact
    copies keep apart. Rows are dealt evenly to parts of about part_rows, whatever ids are null or repeat, and each part is packed by itself.
    Null or empty texts have size 0 and share bins as their source allows; null texts belong to no cluster; null ids pack like others.
    Repeated rows are packed each. An empty table gives an empty result; columns may have any name.
    """
    size = count_words(docs[text_col]) if size is None else size
    cluster = F.when(docs[text_col].isNotNull(), F.xxhash64(docs[text_col])) if cluster is None else cluster
    parts = max(1, -(-docs.count() // part_rows))
    rows = docs.select(F.pmod(F.xxhash64(docs[id_col], F.monotonically_increasing_id()), F.lit(parts)).alias("part"), docs[id_col].cast("long").alias("doc_id"), size.alias("size"), docs[source_col].cast("string").alias("source"), cluster.alias("cluster"))

    def packed(part: pa.Table) -> pa.Table:
        name = part.column("part")[0].as_py()
        bins = pack(zip(*(part.column(c).to_pylist() for c in ("doc_id", "size", "source", "cluster")), strict=True), capacity)
        ids, starts, sizes = ([[p[k] for p in b] for b in bins] for k in range(3))
        longs = pa.list_(pa.int64())
        return pa.table([pa.array([f"{name}-{k}" for k in range(len(bins))], pa.string()), pa.array(ids, longs), pa.array(starts, longs), pa.array(sizes, longs), pa.array(map(sum, sizes), pa.int64())], ["bin_id", "doc_ids", "starts", "sizes", "used"])

    return rows.groupBy("part").applyInArrow(packed, "bin_id string, doc_ids array<bigint>, starts array<bigint>, sizes array<bigint>, used bigint")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack_documents() of documents by words: one row a bin, with all pieces of every document in bins; odd rows as there."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
