"""Neighbour joining over a symmetric matrix (i, j, d) with i < j."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemmata.operators.pairs import upper_pairs


def row_sums(matrix: DataFrame) -> DataFrame:
    """(i, r): the sum of each taxon's distances."""
    both = matrix.select("i", "d").unionByName(matrix.select(F.col("j").alias("i"), "d"))
    return both.groupBy("i").agg(F.sum("d").alias("r"))


def q_matrix(matrix: DataFrame) -> DataFrame:
    """(i, j, d, q) with q = (n - 2) d - r_i - r_j."""
    sums = row_sums(matrix)
    n = sums.agg(F.count("*").alias("n"))
    rows = matrix.join(sums.toDF("i", "ri"), "i").join(sums.toDF("j", "rj"), "j").crossJoin(F.broadcast(n))  # n: one row
    return rows.select("i", "j", "d", ((F.col("n") - 2) * F.col("d") - F.col("ri") - F.col("rj")).alias("q"), "ri", "rj", "n")


def first_join(matrix: DataFrame) -> DataFrame:
    """One row (i, j, q, di, dj): the pair that is joined first, ties by row and column, and the lengths of its branches."""
    best = q_matrix(matrix).agg(F.min(F.struct("q", "i", "j", "d", "ri", "rj", "n")).alias("x")).select("x.*")
    di = F.col("d") / 2 + (F.col("ri") - F.col("rj")) / (2 * (F.col("n") - 2))
    return best.select("i", "j", "q", di.alias("di"), (F.col("d") - di).alias("dj"))


def join_all(ids: np.ndarray, d: np.ndarray) -> list[tuple[int, int, float]]:
    """(parent, child, length) rows of the tree over ids with the full matrix d; new vertices are numbered from the largest id on."""
    ids, d, fresh, out = list(ids), d.astype(float).copy(), int(max(ids)) + 1, []
    while len(ids) > 2:
        n, r = len(ids), d.sum(axis=1)
        q = (n - 2) * d - r[:, None] - r[None, :]
        q[np.tril_indices(n)] = np.inf
        i, j = np.unravel_index(np.argmin(q), q.shape)
        di = d[i, j] / 2 + (r[i] - r[j]) / (2 * (n - 2))
        out += [(fresh, ids[i], float(di)), (fresh, ids[j], float(d[i, j] - di))]
        rest = [k for k in range(n) if k not in (i, j)]
        new = (d[i, rest] + d[j, rest] - d[i, j]) / 2
        d = np.block([[d[np.ix_(rest, rest)], new[:, None]], [new[None, :], np.zeros((1, 1))]])
        ids = [ids[k] for k in rest] + [fresh]
        fresh += 1
    if len(ids) == 2:
        out.append((ids[1], ids[0], float(d[0, 1])))
    return out


def neighbour_joining(matrix: DataFrame, group: str | None = None) -> DataFrame:
    """(group?, src, dst, length, w): the tree of a matrix, or of each group's; w is the length cut to an integer.

    Each join needs all sums of the step before, so a matrix is joined by one task: its n * n distances bound the task, and groups
    run side by side. Two taxa are linked by their distance.
    """
    kind = matrix.schema[group].dataType.simpleString() if group else "int"

    def joined(rows: pa.Table) -> pa.Table:
        i, j, d = (rows.column(c).to_numpy() for c in ("i", "j", "d"))
        ids, flat = np.unique(np.r_[i, j], return_inverse=True)
        full = np.zeros((len(ids), len(ids)))
        a, b = flat[: len(i)], flat[len(i) :]
        full[a, b] = full[b, a] = d
        tree = join_all(ids, full)
        src, dst, length = (np.array(x) for x in zip(*tree, strict=True)) if tree else (np.zeros(0),) * 3
        columns = [pa.array(np.full(len(tree), rows.column("g")[0].as_py()), rows.schema.field("g").type) if len(tree) else pa.array([], rows.schema.field("g").type)]
        columns += [pa.array(src.astype(np.int64)), pa.array(dst.astype(np.int64)), pa.array(length.astype(float)), pa.array(length.astype(np.int64))]
        return pa.table(columns, ["g", "src", "dst", "length", "w"])

    keyed = matrix.select((F.col(group) if group else F.lit(0)).alias("g"), F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.col("d").cast("double").alias("d"))
    out = keyed.groupBy("g").applyInArrow(joined, f"g {kind}, src bigint, dst bigint, length double, w bigint")
    return out.withColumnRenamed("g", group) if group else out.drop("g")


def profiles_tree(profiles: DataFrame) -> DataFrame:
    return neighbour_joining(upper_pairs(profiles).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").cast("double").alias("d")))
