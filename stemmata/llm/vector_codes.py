"""Product codes of vectors: each part of a vector by its nearest codebook entry, found in a vantage-point tree over the entries of that part position."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemmata.llm.common import table
from stemmata.runtime import cut

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Scaled components lie within it, so that squared distances of up to 512 components stay in 64 bits.
LARGEST = 1 << 27
#: Relative and absolute slack of radii and bounds, beyond any rounding of square roots of such integers.
SLACK = 1e-9


def scaled(df: DataFrame, vector: str, scale: int) -> DataFrame:
    """df's rows whose vector isn't null and has only finite components, with floor(scale * x) in place of the components.

    A row with a component beyond LARGEST after that takes no part either: its distances could leave 64 bits.
    """
    x = F.col(vector)
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(F.floor(scale * c.cast("double"))) <= LARGEST)
    return df.where(x.isNotNull() & F.forall(x, fits)).withColumn(vector, F.transform(x, lambda c: F.floor(scale * c.cast("double")).cast("int")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column without nulls, each filled up with zeros to the width."""
    lengths = column.value_lengths().to_numpy()
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy()
    return out


@dataclass
class Node:
    entry: int
    inner: Node | None = None
    outer: Node | None = None
    #: Distances from the entry to those of inner and of outer lie between these, rounded outwards.
    inner_radii: tuple[float, float] = (0.0, 0.0)
    outer_radii: tuple[float, float] = (0.0, 0.0)


class Tree:
    """Vantage-point tree over the entries of one part position. Ties go to the lower index."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.asarray(entries, np.int64)
        self.root = self._built(np.arange(len(entries)))

    def _built(self, which: np.ndarray) -> Node | None:
        if not len(which):
            return None
        node, rest = Node(int(which[0])), which[1:]
        if len(rest):
            d2 = ((self.entries[rest] - self.entries[node.entry]) ** 2).sum(1)
            order = np.argsort(d2, kind="stable")
            half = (len(rest) + 1) // 2
            for name, part in (("inner", order[:half]), ("outer", order[half:])):
                if len(part):
                    d = np.sqrt(d2[part].astype(float))
                    setattr(node, name, self._built(rest[np.sort(part)]))
                    setattr(node, f"{name}_radii", (float(d.min()) * (1 - SLACK) - SLACK, float(d.max()) * (1 + SLACK) + SLACK))
        return node

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry to each row of x, as integers."""
        self._x, self._best, self._at = x, np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
        if self.root is not None:
            self._visit(self.root, np.arange(len(x)))
        return self._at, self._best

    def _visit(self, node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        d2 = ((self._x[rows] - self.entries[node.entry]) ** 2).sum(1)
        best = self._best[rows]
        closer = (d2 < best) | (d2 == best) & (node.entry < self._at[rows])
        self._best[rows[closer]], self._at[rows[closer]] = d2[closer], node.entry
        d = np.sqrt(d2.astype(float))
        gaps = {}
        for name in ("inner", "outer"):
            low, high = getattr(node, f"{name}_radii")
            gaps[name] = np.maximum(0.0, np.maximum(d * (1 - SLACK) - high, low - d * (1 + SLACK)) - SLACK)
        first = gaps["inner"] <= gaps["outer"]  # the side that may lie nearer goes first
        for name, mine in (("inner", first), ("outer", ~first), ("outer", first), ("inner", ~first)):
            child = getattr(node, name)
            if child is not None:
                own, gap = rows[mine], gaps[name][mine]
                self._visit(child, own[gap * gap * (1 - SLACK) <= self._best[own]])  # a side as near as the best may hold a lower index


def _assigned(x: np.ndarray, codebooks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, squared distances) of each row's parts."""
    size = x.shape[1] // len(codebooks)
    found = [Tree(book).nearest(x[:, k * size : (k + 1) * size]) for k, book in enumerate(codebooks)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _means(rows: DataFrame, vector: str, width: int, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """The next codebooks. A task sends one sum for each entry's component; the driver gets as many numbers as the codebooks have."""
    parts, entries, size = len(codebooks), len(codebooks[0]), width // len(codebooks)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, size), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = matrix(batch.column(0), width)
            codes, _ = _assigned(x, codebooks)
            for k in range(parts):
                np.add.at(total[k], codes[:, k], x[:, k * size : (k + 1) * size])
                count[k] += np.bincount(codes[:, k], minlength=entries)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    partial = rows.select(vector).mapInArrow(sums, "part int, entry int, n bigint, total array<bigint>")
    sides = [F.sum(F.get("total", F.lit(k))).alias(f"t{k}") for k in range(size)]
    found = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sides).collect()
    out = [book.copy() for book in codebooks]
    for r in found:
        out[r["part"]][r["entry"]] = [r[f"t{k}"] // r["n"] for k in range(size)]
    return out


def train(rows: DataFrame, vector: str, width: int, first: np.ndarray, parts: int = PARTS, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks by part position, from the rows of `first`: in each round every part goes to its nearest entry, and entries become the rounded-down means of their parts."""
    size = width // parts
    books = [first[:, k * size : (k + 1) * size] for k in range(parts)]
    for _ in range(rounds if len(first) else 0):
        books = _means(rows, vector, width, books)
    return books


def compress(df: DataFrame, vector: str = "embedding", by: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(df's rows with code and error behind their own columns but the vector, the codebooks).

    Rows whose vector is null, or holds null, non-finite or too large components (scaled()), are left out. Codebooks start from the rows of the smallest `by`, nulls last; of equal ones the
    smaller vector counts first; fewer rows give fewer entries. Vectors of unequal lengths are filled up with zeros, to a multiple of `parts`. Repeated rows are coded each; an empty table gives
    no rows. Columns named code or error are replaced. The vectors are scaled once and read again in each round.
    """
    rows = cut(scaled(df.drop("code", "error"), vector, scale), "codes")
    width = -(-(rows.agg(F.max(F.size(vector))).first()[0] or 0) // parts) * parts
    head = rows.select(vector).orderBy(F.col(by).asc_nulls_last(), F.col(vector)).limit(entries).collect()
    first = np.zeros((len(head), width), np.int64)
    for k, r in enumerate(head):
        first[k, : len(r[0])] = r[0]
    books = train(rows, vector, width, first, parts, rounds)
    rest = [f for f in rows.schema if f.name != vector]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = _assigned(matrix(batch.column(batch.schema.get_field_index(vector)), width), books)
            text = codes.astype(np.uint8).tobytes().hex()
            step = 2 * parts
            out = [pa.array([text[k : k + step] for k in range(0, len(text), step)], pa.string()), pa.array(errors.sum(1), pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(f.name)) for f in rest], *out], [*[f.name for f in rest], "code", "error"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest)
    return rows.mapInArrow(coded, f"{kinds}code string, error bigint"), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row of embeddings. Errors of a label are summed before they are joined; null labels count as one."""
    coded, books = compress(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    coded = cut(coded, "codes")
    text = ",".join(str(x) for book in books for entry in book.tolist() for x in entry)
    # A table as small as this one is by its number of labels is sent to all tasks by its size; beyond that large labels are split by the skew join.
    sums = cut(coded.groupBy("label").agg(F.sum("error").alias("label_error")).coalesce(1), "labels").withColumnRenamed("label", "of")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


def op13_sql() -> str:
    """The same by brute force: every part against every entry. As many rounds of common table expressions as there are rounds."""
    near = lambda k: f"""
a{k} AS MATERIALIZED (
  SELECT vec_id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT x.vec_id, x.p, c.e, sum((x.x - c.x) * (x.x - c.x)) AS d FROM parts x JOIN c{k} c ON c.p = x.p AND c.i = x.i GROUP BY x.vec_id, x.p, c.e
  ) GROUP BY vec_id, p
)"""  # noqa: E731
    means = lambda k: f"""
c{k + 1} AS MATERIALIZED (
  SELECT c.p, c.e, c.i, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN (
    SELECT p, e, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (
      SELECT x.p, a.e, x.i, CAST(sum(x.x) AS BIGINT) AS s, count(*) AS n FROM parts x JOIN a{k} a ON a.vec_id = x.vec_id AND a.p = x.p GROUP BY x.p, a.e, x.i)
  ) m ON m.p = c.p AND m.e = c.e AND m.i = c.i
)"""  # noqa: E731
    rounds = ",".join(near(k) + "," + means(k) for k in range(ROUNDS))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, (k - 1) // (n // {PARTS}) AS p, (k - 1) % (n // {PARTS}) AS i, v[k] AS x FROM (SELECT vec_id, v, len(v) AS n, unnest(range(1, len(v) + 1)) AS k FROM kept)
), c0 AS MATERIALIZED (
  SELECT p, i, x, r - 1 AS e FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r FROM kept) USING (vec_id) WHERE r <= {ENTRIES}
),{rounds},{near(ROUNDS)}, coded AS MATERIALIZED (
  SELECT vec_id, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id
), books AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) AS digest FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM coded JOIN kept USING (vec_id), books
"""
