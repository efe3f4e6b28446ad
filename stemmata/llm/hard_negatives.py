"""Hard negatives: rows of other labels whose inner product with an anchor lies in a window below a positive's, from vantage-point trees.

A vector gets one component more, so that all have the norm of the longest; an anchor gets a zero there. Then a row lies the nearer to an anchor the larger their product, and a
window of products is an annulus around the anchor. Blocks of rows hold a tree each; a search leaves out what lies wholly outside the annulus and meets the rest nearest first.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemmata.llm.common import batches_of, table
from stemmata.llm.vector_codes import matrix, scaled
from stemmata.runtime import cut

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: Percent of a positive's score that a negative's has at least and at most.
LOW, HIGH = 30, 90
#: Rows of a block and of a tree's leaf, anchors of a block.
BLOCK, LEAF, ANCHORS = 8192, 512, 512
#: Rows that the upper tree, which deals rows to blocks, is fitted on at most, and its leaves. Every row is dealt and indexed, and every block searched: the sample changes no result.
SAMPLE, LEAVES = 2048, 256
#: Pairs of blocks, of about two megabytes, in an Arrow batch.
PAIRS = 4


def augmented(x: np.ndarray, longest: int) -> np.ndarray:
    """x with one component more, so that each row's squared norm is `longest`."""
    return np.c_[x.astype(float), np.sqrt(np.maximum(0.0, float(longest) - (x.astype(float) ** 2).sum(1)))]


def _split(points: np.ndarray, which: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(vantage point, the others' distances, order by distance): the vantage point is the row farthest from the first."""
    start = np.linalg.norm(points[which] - points[which[0]], axis=1)
    vantage = int(which[int(np.argmax(start))])
    d = np.linalg.norm(points[which] - points[vantage], axis=1)
    return vantage, d, np.argsort(d, kind="stable")


class Router:
    """The upper tree: halves of a bounded sample by their distance from vantage points, down to `leaves` parts."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.nodes: list[tuple[np.ndarray, float, int, int] | int] = []
        self.leaves = 0
        self._built(points, np.arange(len(points)), leaves)

    def _built(self, points: np.ndarray, which: np.ndarray, leaves: int) -> int:
        at = len(self.nodes)
        self.nodes.append(self.leaves)
        if leaves < 2 or len(which) < 2:
            self.leaves += 1
            return at
        vantage, d, order = _split(points, which)
        half = len(which) // 2
        near, far = which[order[:half]], which[order[half:]]
        self.nodes[at] = (points[vantage], float(d[order[half - 1]]), self._built(points, near, leaves // 2), self._built(points, far, leaves - leaves // 2))
        return at

    def route(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        todo = [(0, np.arange(len(points)))]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            if isinstance(node, int):
                out[rows] = node
            elif len(rows):
                near = np.linalg.norm(points[rows] - node[0], axis=1) <= node[1]
                todo += [(node[2], rows[near]), (node[3], rows[~near])]
        return out


def grown(x: np.ndarray, longest: int) -> dict[str, np.ndarray]:
    """A tree over the rows of x. Nodes lie behind their parents: (parent, left, right, start, stop) with places in `order`; all rows of a node lie between two radii around `via`."""
    points = augmented(x, longest)
    nodes: list[list[int]] = []
    radii: list[tuple[float, float]] = []
    order = np.arange(len(x))
    todo = [(-1, 0, len(x), 0, np.linalg.norm(points - points[0], axis=1))]
    while todo:
        parent, start, stop, via, d = todo.pop(0)
        at = len(nodes)
        nodes.append([parent, -1, -1, start, stop, via])
        radii.append((float(d.min()), float(d.max())))
        if parent >= 0:
            nodes[parent][1 if nodes[parent][1] < 0 else 2] = at
        if stop - start > LEAF:
            vantage, d, by = _split(points, order[start:stop])
            order[start:stop], d = order[start:stop][by], d[by]
            half = (stop - start) // 2
            todo += [(at, start, start + half, vantage, d[:half]), (at, start + half, stop, vantage, d[half:])]
    return {"nodes": np.array(nodes, np.int32), "radii": np.array(radii), "order": order}


class Block:
    """Rows with their tree: nr, id, known (whether the id isn't null), label, x."""

    def __init__(self, held: dict[str, np.ndarray], longest: int):
        order = held["order"]
        self.nr, self.id, self.label, self.x = (held[k][order] for k in ("nr", "id", "label", "x"))
        # Sums of products stay below the longest norm, so doubles hold them exactly if it does.
        self.kind = np.float64 if longest < 1 << 53 else np.int64
        self.x = self.x.astype(self.kind)
        self.nodes, self.radii, self.longest = held["nodes"], held["radii"], longest
        self.via = held["x"][held["nodes"][:, 5]]
        self.kids = [(a, b, c, d) for _, a, b, c, d, _ in held["nodes"].tolist()]

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(most, least) score that a row of each node (column) can have with each anchor (row of q), rounded outwards."""
        whole = float(self.longest) + (q.astype(float) ** 2).sum(1)[:, None]
        d = np.sqrt(np.maximum(0.0, whole - 2.0 * (q.astype(float) @ self.via.astype(float).T)))
        low = np.maximum(0.0, np.maximum(d - self.radii[:, 1], self.radii[:, 0] - d))
        high = d + self.radii[:, 1]
        for k, parent in enumerate(self.nodes[:, 0].tolist()):
            if parent >= 0:
                np.maximum(low[:, k], low[:, parent], out=low[:, k])
                np.minimum(high[:, k], high[:, parent], out=high[:, k])
        slack = 1.0 + 1e-7 * whole
        return np.floor((whole - low * low) / 2 + slack), np.ceil((whole - high * high) / 2 - slack)

    def nearest(self, q: np.ndarray, most: list[float], least: list[float], low: float, high: float, wanted: np.ndarray) -> Iterator[tuple[int, int]]:
        """(score, place) of the wanted rows with a score in low..high, the highest first, ties by id.

        The queue holds nodes by their bound and the next row of each leaf that was met; at equal scores nodes go first, so that a row comes out only when no smaller id can follow.
        """
        q = q.astype(self.kind)
        queue: list[tuple] = [(-most[0], 0, 0)] if most[0] >= low and least[0] <= high else []
        while queue:
            first = heapq.heappop(queue)
            if first[1]:
                yield -first[0], first[4]
                if (following := next(first[5], None)) is not None:
                    heapq.heappush(queue, (*following, first[5]))
                continue
            left, right, start, stop = self.kids[first[2]]
            if left >= 0:
                for k in (left, right):
                    if most[k] >= low and least[k] <= high:
                        heapq.heappush(queue, (-most[k], 0, k))
                continue
            scores = (self.x[start:stop] @ q).astype(np.int64)
            at = np.flatnonzero((scores >= low) & (scores <= high) & wanted[start:stop])
            if len(at):
                at = at[np.lexsort((self.nr[start + at], self.id[start + at], -scores[at]))]
                rest = iter([(-s, 1, i, n, p) for s, i, n, p in zip(scores[at].tolist(), self.id[start + at].tolist(), self.nr[start + at].tolist(), (start + at).tolist(), strict=True)])
                heapq.heappush(queue, (*next(rest), rest))


def _packed(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


#: Stands for a null id: behind all others.
LAST = (1 << 63) - 1


def _rows(group: pa.Table, width: int) -> dict[str, np.ndarray]:
    column = lambda c: group.column(c).combine_chunks()
    return {
        "nr": column("nr").to_numpy(), "id": column("id").fill_null(LAST).to_numpy(), "label": column("label").to_numpy(zero_copy_only=False),
        "x": matrix(column("x"), width).astype(np.int32),
    }


def _blocks(rows: DataFrame, key: Column, width: int, longest: int, tree: bool, extra: tuple[str, ...] = ()) -> DataFrame:
    """(block, data): the rows of each key packed, with a tree or with further columns of numbers in lists of a fixed length."""

    def pack(group: pa.Table) -> pa.Table:
        held = _rows(group, width)
        held |= grown(held["x"], longest) if tree else {}
        held |= {c: np.array(group.column(c).to_pylist(), np.int64).reshape(len(held["nr"]), -1) for c in extra}
        return pa.table({"block": group.column("block").slice(0, 1), "data": pa.array([_packed(held)], pa.binary())})

    return cut(rows.withColumn("block", key).groupBy("block").applyInArrow(pack, "block int, data binary"), "blocks")


def _met(anchors: DataFrame, blocks: DataFrame, n_anchors: int, n_blocks: int) -> DataFrame:
    """(data, asked): every block of rows with every block of anchors. Rows go in `across` groups, anchors in `down`; a group meets each of the other side in a merged cell. The number of cells
    follows that of tasks, so that so many copies of a block are shuffled at most, however many there are, and none goes through the driver.
    """
    tasks = max(1, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    across = max(1, min(n_blocks, 2 * tasks))
    down = max(1, min(n_anchors, -(-2 * tasks // across)))
    side = lambda rows, own, n, other, m, name: rows.select(F.pmod("block", F.lit(n)).alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other), F.col("data").alias(name)).repartition(tasks, "i", "j")
    return side(blocks, "i", across, "j", down, "data").join(side(anchors, "j", down, "i", across, "asked").hint("merge"), ["i", "j"]).select("data", "asked")


def _searched(anchors: DataFrame, blocks: DataFrame, n_anchors: int, n_blocks: int, longest: int, fn, schema: str) -> DataFrame:
    """fn(anchors, block, most, least) -> columns, for every pair of a block of anchors and a block of rows."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, asked in zip(batch.column(0), batch.column(1), strict=True):
                block, wanted = Block(_unpacked(data.as_py()), longest), _unpacked(asked.as_py())
                yield fn(wanted, block, *block.bounds(wanted["x"]))

    with batches_of(anchors.sparkSession, PAIRS):
        return cut(_met(anchors, blocks, n_anchors, n_blocks).mapInArrow(search, schema), "found")


def _positives(k: int):
    def found(asked: dict[str, np.ndarray], block: Block, most: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
        out = []
        for a, (nr, label, q) in enumerate(zip(asked["nr"].tolist(), asked["label"].tolist(), asked["x"], strict=True)):
            wanted = (block.label == label) & (block.nr != nr)
            for n, (score, place) in enumerate(block.nearest(q, most[a].tolist(), least[a].tolist(), -np.inf, np.inf, wanted), 1):
                out.append((nr, int(block.id[place]), int(score)))
                if n == k:
                    break
        return _batch(out, ("nr", "positive_id", "positive_score"))

    return found


def _negatives(k: int, low: int, high: int):
    def found(asked: dict[str, np.ndarray], block: Block, most: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
        out = []
        for a, (nr, label, q) in enumerate(zip(asked["nr"].tolist(), asked["label"].tolist(), asked["x"], strict=True)):
            # One pass through the union of the anchor's windows; a window is closed when it is full, or when scores have fallen below it.
            windows = [[j, -(-low * p // 100), high * p // 100, 0] for j, p in enumerate(asked["scores"][a].tolist()) if p >= 0]
            windows = [w for w in windows if w[1] <= w[2]]
            if not windows:
                continue
            for score, place in block.nearest(q, most[a].tolist(), least[a].tolist(), min(w[1] for w in windows), max(w[2] for w in windows), block.label != label):
                windows = [w for w in windows if w[3] < k and score >= w[1]]
                if not windows:
                    break
                for w in windows:
                    if score <= w[2]:
                        w[3] += 1
                        out.append((nr, w[0], int(block.id[place]), int(score)))
        return _batch(out, ("nr", "n", "negative_id", "negative_score"))

    return found


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], list(names))


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of vectors (id, label, x) for which `anchor` holds.

    Rows with a null label or vector, or a component that is null, not finite or too large (vector_codes.scaled), take no part. Scores are inner products of floor(scale * x); shorter vectors
    count as filled up with zeros. Higher scores come first, then smaller ids, null ids last. An anchor's positives are its first other rows of its label; the negatives of each are the first
    rows of other labels with low * positive <= 100 * negative <= high * positive, of which there are none where the positive's score is negative. Repeated rows count each; those that repeat an anchor are its
    positives. An empty table, or one without anchors, gives no rows.

    Rows are dealt to blocks by an upper tree over a bounded sample; a leaf of more rows is dealt further by a hash, so that copies of one vector spread. Every block of anchors meets every
    block of rows, and each pair leaves at most `negatives` rows a positive.
    """
    spark = vectors.sparkSession
    kept = scaled(vectors.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "x").where("label IS NOT NULL"), "x", scale).withColumn("asks", F.coalesce(anchor, F.lit(False)))
    norm = F.aggregate("x", F.lit(0).cast("long"), lambda s, c: s + c.cast("long") * c.cast("long"))
    n, width, longest, asking = kept.agg(F.count("*"), F.max(F.size("x")), F.max(norm), F.sum(F.col("asks").cast("long"))).first()
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not n or not asking or not width:
        return spark.createDataFrame([], schema)
    sample = [r[0] for r in kept.select("x").orderBy(F.xxhash64("id", "x")).limit(SAMPLE).collect()]
    points = np.zeros((len(sample), width), np.int64)
    for k, x in enumerate(sample):
        points[k, : len(x)] = x
    router = Router(augmented(points, longest), min(LEAVES, -(-n // BLOCK)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = router.route(augmented(matrix(b.column(b.schema.get_field_index("x")), width), longest))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32())], [*b.schema.names, "leaf"])

    numbers = kept.withColumn("nr", F.monotonically_increasing_id())
    rows = cut(numbers.mapInArrow(route, "id bigint, label bigint, x array<int>, asks boolean, nr bigint, leaf int"), "rows")
    # Blocks of each leaf: at most LEAVES counts.
    sizes = {r["leaf"]: -(-r["count"] // BLOCK) for r in rows.groupBy("leaf").count().collect()}
    starts = np.cumsum([0, *[sizes.get(k, 0) for k in range(router.leaves)]]).tolist()
    pick = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("leaf") + 1)
    of = (pick(starts[:-1]) + F.pmod(F.xxhash64("nr"), pick([max(1, sizes.get(k, 1)) for k in range(router.leaves)]))).cast("int")
    blocks = _blocks(rows, of, width, longest, True)
    mine = rows.where("asks")
    groups = -(-asking // ANCHORS)
    deal = F.pmod(F.xxhash64("nr"), F.lit(groups)).cast("int")
    near = _searched(_blocks(mine, deal, width, longest, False), blocks, groups, starts[-1], longest, _positives(positives), "nr bigint, positive_id bigint, positive_score bigint")
    place = F.row_number().over(Window.partitionBy("nr").orderBy(F.desc("positive_score"), "positive_id"))
    near = cut(near.withColumn("n", place).where(F.col("n") <= positives), "positives")
    # Lists have one length: a score below zero has no negatives, and stands for a positive that an anchor lacks.
    held = near.groupBy("nr").agg(F.map_from_entries(F.collect_list(F.struct("n", "positive_score"))).alias("known"))
    scores = F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda k: F.coalesce(F.col("known")[k], F.lit(-1).cast("long")))
    asked = mine.join(held, "nr").withColumn("scores", scores)
    far = _searched(_blocks(asked, deal, width, longest, False, ("scores",)), blocks, groups, starts[-1], longest, _negatives(negatives, low, high), "nr bigint, n bigint, negative_id bigint, negative_score bigint")
    rank = F.row_number().over(Window.partitionBy("nr", "n").orderBy(F.desc("negative_score"), "negative_id"))
    best = far.withColumn("n", F.col("n") + 1).withColumn("rank", rank).where(F.col("rank") <= negatives)
    out = best.join(near, ["nr", "n"]).join(mine.select("nr", F.col("id").alias("anchor_id")), "nr")
    null = lambda c: F.nullif(F.col(c), F.lit(LAST)).alias(c)
    return out.select("anchor_id", null("positive_id"), F.col("rank").cast("int"), null("negative_id"), "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows of embeddings whose vec_id is divisible by 100, labels shifted by one where it is divisible by 7. What nulls, ties, repeated rows and empty tables give is said at hard_negatives()."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("x")), F.col("id") % 100 == 0)


def op12_sql() -> str:
    """The same by brute force: every anchor against every row."""
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor({SCALE} * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score FROM kept a JOIN kept r ON r.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id, score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank, n.vec_id AS negative_id,
  p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND {LOW} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.score
QUALIFY rank <= {NEGATIVES}
"""
