"""Near-duplicate passages by compact windows: Cartesian trees over hashes of runs of words, joined, then verified."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemmata.llm.common import LOWER_ASCII, among, as_bytes, batches_of, connected_components, in_arrow, table
from stemmata.llm.rolling import RowHash, SpanHash, mixed, sliding_min, smaller_before
from stemmata.llm.words import SHINGLE, shingles_of
from stemmata.runtime import cut

#: Words of a passage, at least; the similarity of passages, as Jaccard of their shingles, at least.
PASSAGE, SIMILARITY = 50, 0.8
WIDTH = PASSAGE - SHINGLE + 1
#: Words in a row, at least, that two passages at SIMILARITY hold both, if none of their shingles repeats: with WIDTH shingles a side, 41 or more are
#: common. Each gap between common ones costs 8 or more that are not, of a quarter of the common ones at most. So 41 to 63 fall into two runs at most,
#: 64 to 95 into three and so on: one run has 21 shingles.
RUN = 25
#: Words of a seed. The smallest hash of those in each RUN words is the same wherever the run stands, so that one hash function finds each such pair.
GRAM = 11
#: Shingles on both sides of a seed that are compared: a stretch of 92 or more that is alike holds a shorter one that is, in one of its halves.
REACH = 88
#: Shingles in a row that make a passage: padded to WIDTH on either side, they are SIMILARITY of it.
EXACT = int(np.ceil(2 * WIDTH * SIMILARITY / (1 + SIMILARITY) - 1e-9))
#: Places of a seed that are compared all with all by their texts; where a seed has more, their surroundings are compared in pairs of blocks of BLOCK.
GROUP, BLOCK = 32, 1024
#: Values that more pairs of rows than the square of this hold are counted by a product of matrices of SLAB columns, others pair by pair.
RARE, SLAB = 16, 4096
#: Shingles by which the places of a pair may shift within a passage.
DRIFT = 16
#: Parts that the requests for one text are dealt to.
SALTS = 32
#: Bytes whose words are hashed together, about.
TILE = 1_000_000
#: Texts, or surroundings of seeds, in an Arrow batch, at most.
BATCH = 2000


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the windows of `size` words of a text; A-Z lower-cased, words parted by blanks."""
    plain = b" ".join(text.translate(LOWER_ASCII).split())
    data = np.frombuffer(plain, np.uint8)
    gaps = np.flatnonzero(data == 32)
    starts, ends = np.r_[0, gaps + 1], np.r_[gaps, len(data)]
    n = len(starts) - size + 1
    if n <= 0 or not plain:
        return np.zeros(0, np.uint64)
    return SpanHash(data).spans(starts[:n], ends[size - 1 :])


def compact_windows(ranks: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, c, b) of the compact windows of at least `width` entries: all sequences from a..c to c..b have their smallest entry at c.

    They are the subtrees, of `width` entries or more, of the entries' Cartesian tree. The centres of these are the minima of the
    windows of `width`; the nearest smaller entry of a centre is a centre too, so that the tree need be built over centres only.
    Entries compare by their upper 32 bits; of equal ones the first is the smaller.
    """
    if len(ranks) < width:
        return (np.zeros(0, np.int64),) * 3
    values = ranks & np.uint64(0xFFFFFFFF00000000) | np.arange(len(ranks), dtype=np.uint64)
    c = np.unique((sliding_min(values, width) & np.uint64(0xFFFFFFFF)).astype(np.int64))
    values = values[c]
    before, after = smaller_before(values), len(c) - 1 - smaller_before(values[::-1])[::-1]
    a = np.where(before >= 0, c[before] + 1, 0)
    b = np.where(after < len(c), c[np.minimum(after, len(c) - 1)] - 1, len(ranks) - 1)
    return a, c, b


_ROWS = pa.schema([("key", pa.int64()), ("rk", pa.int64()), ("place", pa.int64())])
_ROW_SQL = "key bigint, rk bigint, place bigint"
_LINKS = pa.schema([(c, pa.int64()) for c in ("rk", "place", "rep", "at")])
_LINK_SQL = "rk bigint, place bigint, rep bigint, at bigint"


def seeds_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, text numbers, places) of the centres of the compact windows of RUN words or more, over the fresh shingles of each text."""
    size, width = GRAM - SHINGLE + 1, RUN - GRAM + 1
    hashes, own, place = shingles_of(texts, WIDTH)
    grams = RowHash(hashes).all(size)
    if len(grams) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    centres = compact_windows(grams, width)[1]
    packed = grams & np.uint64(0xFFFFFFFF00000000) | np.arange(len(grams), dtype=np.uint64)
    lowest = (sliding_min(packed, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    whole = np.arange(len(lowest))
    whole = own[whole] == own[whole + size + width - 2]  # windows cross no text
    centres = centres[np.isin(centres, lowest[whole])]
    return grams[centres], own[centres], place[centres]


def seeds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the seeds of one text."""
    hashes, _, places = seeds_of([text])
    return hashes, places


def _seeds(batch: pa.RecordBatch) -> pa.RecordBatch:
    rk, texts = batch.column(0).to_numpy(), batch.column(1)
    out, held, owner, total = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))], [], [], 0
    for k in range(batch.num_rows):
        held.append(texts[k].as_py())
        owner.append(k)
        total += len(held[-1])
        if total >= TILE or k == batch.num_rows - 1:
            hashes, number, places = seeds_of(held)
            out.append((hashes, rk[np.array(owner)[number]], places))
            held, owner, total = [], [], 0
    key, own, place = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own), pa.array(place)], schema=_ROWS)


def _pairs(batches):
    """Links of all rows of a key with each other, from sorted rows; the last key of a batch waits for the next batch."""
    held = [np.zeros(0, np.int64)] * 3

    def linked(key: np.ndarray, rk: np.ndarray, place: np.ndarray):
        at, lag = np.arange(len(key)), 1
        while len(at := at[at + lag < len(key)]) and len(at := at[key[at] == key[at + lag]]):
            one = at[rk[at] != rk[at + lag]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rk[one], place[one], rk[one + lag], place[one + lag])], schema=_LINKS)
            lag += 1

    for batch in batches:
        rows = [np.r_[h, batch.column(i).to_numpy()] for i, h in enumerate(held)]
        last = int(np.argmax(rows[0] == rows[0][-1])) if len(rows[0]) else 0
        yield from linked(*(x[:last] for x in rows))
        held = [x[last:] for x in rows]
    yield from linked(*held)


def _contexts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """For each asked place of a text the hashes of the shingles up to REACH around it; where the text ends, numbers of its own.

    core is a hash of EXACT shingles around the place, null if they aren't all there or aren't all different: places with one core are alike.
    """
    out: list[list] = [[], [], [], [], []]
    for rk, text, asked in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
        full = shingles(text)
        hashes = (full >> np.uint64(32)).astype(np.uint32)
        own = (mixed(np.arange(2 * REACH, dtype=np.uint64) ^ np.array([rk]).view(np.uint64)) >> np.uint64(32)).astype(np.uint32)
        whole = np.concatenate([own[:REACH], hashes, own[REACH:], own[:SHINGLE]])
        rows = RowHash(full)
        for x in asked:
            around = whole[x["place"] : x["place"] + 2 * REACH + 1]
            first = x["place"] - EXACT // 2
            core = None
            if len(full) >= WIDTH and first >= 0 and first + EXACT <= len(full) and len(np.unique(full[first : first + EXACT])) == EXACT:
                core = int(rows.spans(np.array([first]), np.array([first + EXACT])).view(np.int64)[0])
            for column, value in zip(out, (x["key"], rk, x["place"], core, around.tobytes()), strict=True):
                column.append(value)
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())], ["key", "rk", "place", "core", "around"])


def overlaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many different values each row of x shares with each row of y."""
    n, m = len(x), len(y)
    values, token = np.unique(x, return_inverse=True)
    at = np.minimum(np.searchsorted(values, y), len(values) - 1)
    other, known = at, values[at] == y
    mine = np.unique(token.reshape(x.shape).astype(np.int64) * n + np.arange(n)[:, None])
    theirs = np.unique((other.astype(np.int64) * m + np.arange(m)[:, None])[known])
    mine, own, theirs, row = mine // n, mine % n, theirs // m, theirs % m
    held = np.bincount(mine, minlength=len(values))
    often = held * np.bincount(theirs, minlength=len(values)) > RARE**2
    out = np.zeros((n, m), np.float32)
    some = np.flatnonzero(often)
    for low in range(0, len(some), SLAB):
        column = np.full(len(values), -1)
        column[some[low : low + SLAB]] = np.arange(len(some[low : low + SLAB]))
        a, b = column[mine] >= 0, column[theirs] >= 0
        one, two = np.zeros((n, len(some[low : low + SLAB])), np.float32), np.zeros((m, len(some[low : low + SLAB])), np.float32)
        one[own[a], column[mine[a]]] = 1
        two[row[b], column[theirs[b]]] = 1
        out += one @ two.T
    theirs, row = theirs[~often[theirs]], row[~often[theirs]]
    times = held[theirs]  # each entry of y meets all entries of x with its value, which stand together
    first = np.cumsum(held) - held
    entry = np.repeat(first[theirs] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    return out + np.bincount(own[entry] * m + np.repeat(row, times), minlength=n * m).reshape(n, m)


def may_be_alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of y the row x may be alike to: h links of n and m places, h / (n + m - h) at 0.8 or more, need h at 0.8 n, 0.8 m and, of one of the two, 8 / 9."""
    values, own = np.unique(x, return_inverse=True)
    at = np.minimum(np.searchsorted(values, y), len(values) - 1)
    in_x = values[at] == y
    held = np.zeros((len(y), len(values)), bool)
    row = np.nonzero(in_x)[0]
    held[row, at[in_x]] = True

    def dense(hit: np.ndarray, cost: int) -> np.ndarray:
        gain = np.cumsum(np.where(hit, 1, -cost), axis=1, dtype=np.int32)
        gain = np.concatenate([np.zeros((len(hit), 1), np.int32), gain], axis=1)
        return (gain[:, WIDTH:] >= np.minimum.accumulate(gain[:, : gain.shape[1] - WIDTH], axis=1)).any(axis=1)

    in_y = held[:, own]
    return dense(in_x, 4) & dense(in_y, 4) & (dense(in_x, 8) | dense(in_y, 8))


def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of x and y (shingle hashes around a common seed) hold passages that are alike, wherever words were changed, dropped or added."""
    gain = np.cumsum(np.where(x == y, 1, -8), axis=1, dtype=np.int32)  # h / (2 n - h) >= 0.8 where 9 h >= 8 n
    gain = np.concatenate([np.zeros((len(x), 1), np.int32), gain], axis=1)
    least = np.minimum.accumulate(gain[:, : gain.shape[1] - WIDTH], axis=1)
    out = (gain[:, WIDTH:] >= least).any(axis=1)
    for i in np.flatnonzero(~out).tolist():
        out[i] = bool(aligned(x[i], y[i], padded=True))
    return out


def _tied(rk: np.ndarray, place: np.ndarray, component: np.ndarray, side: np.ndarray, around: np.ndarray) -> list[list[int]]:
    """Links between the rows of side 0 and of side 1, or of side 0 if there is no other, of different components."""
    root = {c: c for c in component.tolist()}

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    mine, links = np.flatnonzero(side == 0), []
    theirs = np.flatnonzero(side == 1)
    theirs = theirs if len(theirs) else mine
    near = overlaps(around[mine], around[theirs]) if len(mine) else np.zeros((0, 0))
    for i, shared in zip(mine.tolist(), near, strict=True):
        others = theirs[np.argsort(-shared, kind="stable")][: int((shared >= EXACT).sum())]
        tops = np.array([top(c) for c in component[others].tolist()], np.int64)
        others = others[(tops != top(int(component[i]))) & (rk[others] != rk[i])]
        for j in others[may_be_alike(around[i], around[others])].tolist() if len(others) else ():
            a, b = top(int(component[i])), top(int(component[j]))
            if a != b and alike(around[i : i + 1], around[j : j + 1])[0]:
                root[max(a, b)] = min(a, b)
                links.append([int(rk[i]), int(place[i]), int(rk[j]), int(place[j])])
    return links


def _blocks(batches):
    """Links that tie the rows of each pair of blocks together as all pairs of them that are alike would; each link is such a pair itself.

    Rows of one component are tied already. Rows must share EXACT shingles to be alike: pairs that don't are passed over by their overlaps.
    """
    held = None

    def found(keys: np.ndarray, *rows: np.ndarray):
        cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True])
        links = [x for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) for x in _tied(*(r[low:high] for r in rows))]
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], schema=_LINKS)

    for batch in batches:
        if not batch.num_rows:
            continue
        around = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
        rows = [np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1), *(batch.column(i).to_numpy() for i in (3, 4, 5, 6)), around]
        rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
        last = int(np.argmax((rows[0] == rows[0][-1]).all(axis=1)))
        if last:
            yield from found(*(x[:last] for x in rows))
        held = [x[last:] for x in rows]
    if held is not None:
        yield from found(*held)


def _tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The different shingles around each place."""
    parts = [np.unique(np.frombuffer(x, np.uint32)).astype(np.int64) for x in batch.column(3).to_pylist()]
    times = [len(p) for p in parts]
    columns = [np.repeat(batch.column(i).to_numpy(), times) for i in range(3)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.concatenate(parts))], ["key", "rk", "place", "token"])


def _surroundings(rows: DataFrame, hot: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, rk, place, core, around) for the places of the seeds in hot (key)."""
    asked = rows.join(hot, "key").groupBy("rk").agg(F.collect_list(F.struct("key", "place")).alias("asked"))
    return cut(in_arrow(texts.join(asked, "rk").select("rk", "text", "asked"), _contexts, "key bigint, rk bigint, place bigint, core bigint, around binary"), "around")


def _same_core(around: DataFrame) -> DataFrame:
    """Links of places with one core to the first of them."""
    first = around.where("core is not null").groupBy("core").agg(F.min(F.struct("rk", "place")).alias("first"), F.count("*").alias("n")).where("n > 1")
    linked = around.join(first, "core").where("rk <> first.rk")
    return linked.select("rk", "place", F.col("first.rk").alias("rep"), F.col("first.place").alias("at"))


def _parted(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """rows of seeds by the shingles that they share beside the seed, so that places with nothing else in common don't meet.

    Two places need EXACT shingles in common, so both hold the rarest common one, by its number of places, among all but their own EXACT - 1 most frequent.
    """
    rows = rows.join(seeds.select("key"), "key")
    held = cut(in_arrow(rows.select("key", "rk", "place", "around"), _tokens, "key bigint, rk bigint, place bigint, token bigint"), "tokens")
    again = held.groupBy("key", "token").agg(F.count("*").alias("n")).where("n > 1")
    order = Window.partitionBy("key", "rk", "place").orderBy(F.desc("n"), "token")
    kept = held.join(again, ["key", "token"]).withColumn("nr", F.row_number().over(order)).where(F.col("nr") >= EXACT).select("key", "rk", "place", "token")
    parted = rows.join(kept, ["key", "rk", "place"]).withColumn("key", F.xxhash64("key", "token")).drop("token")
    return cut(parted, "parted")


def _main(rows: DataFrame, block: int) -> DataFrame:
    """(key, main, mains, others, rest): for seeds with places in several components the largest of these, its blocks, those of all others, and their rows."""
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    large = F.max(F.struct("n", F.col("component").alias("c"))).alias("large")
    seeds = sizes.groupBy("key").agg(large, F.sum("n").alias("n"), F.count("*").alias("components")).where("components > 1")
    rest = F.col("n") - F.col("large.n")
    return cut(seeds.select("key", F.col("large.c").alias("main"), F.ceil(F.col("large.n") / block).alias("mains"), F.ceil(rest / block).alias("others"), rest.alias("rest")), "mains")


def _dealt(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """rows once for each pair of blocks of its seed: (key, a, b, rk, place, component, side, around), b negative for blocks of the main component."""
    rows = rows.join(seeds, "key").withColumn("is_main", F.col("component") == F.col("main"))
    own = F.pmod(F.xxhash64("rk", "place"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).alias("own")
    rows = rows.select("key", "is_main", "mains", "others", own, "rk", "place", "component", "around")
    number = lambda upto: F.sequence(F.lit(0).cast("long"), upto - 1)
    at = lambda a, b, side: F.struct(a.alias("a"), b.alias("b"), side.cast("long").alias("side"))
    own = F.col("own")
    with_others = F.transform(number(F.col("others")), lambda x: F.when(F.col("is_main"), at(x, -1 - own, F.lit(1))).otherwise(at(F.least(own, x), F.greatest(own, x), own > x)))
    with_main = F.when(~F.col("is_main"), F.transform(number(F.col("mains")), lambda x: at(own, -1 - x, F.lit(0)))).otherwise(F.expr("array()"))
    return rows.withColumn("pair", F.explode(F.concat(with_others, with_main))).select("key", "pair.a", "pair.b", "rk", "place", "component", "pair.side", "around")


def _among_common(around: DataFrame, tied: DataFrame, n: int, block: int) -> DataFrame:
    """Links of places that no links tie yet; tied: (rk, component). A seed's largest component isn't compared with itself, but all others with it and each other."""
    rows = around.join(tied, "rk", "left").select("key", "rk", "place", F.coalesce("component", "rk").alias("component"), "around")
    seeds = _main(rows, block)
    dealt = _dealt(rows, seeds.where(F.col("rest") <= block // 2))
    wide = seeds.where(F.col("rest") > block // 2)
    if not wide.isEmpty():
        parted = _parted(rows, wide)
        dealt = dealt.unionByName(_dealt(parted, _main(parted, block)))
    return dealt.repartition(n, "key", "a", "b").sortWithinPartitions("key", "a", "b", "rk", "place").mapInArrow(_blocks, _LINK_SQL)


_PASSAGES = pa.schema([(c, pa.int64()) for c in ("rk", "a", "b", "rep", "c", "d")])


def _passages(batches):
    """Links of two texts that follow one another with little drift, merged: shingles a..b of rk go with c..d of rep, REACH around their seeds."""
    held: list[int] | None = None
    for batch in batches:
        out: list[list[int]] = []
        for rk, place, rep, at in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            p, q = place, at
            a, b, c, d = max(0, p - REACH), p + REACH, max(0, q - REACH), q + REACH
            if held and held[0] == rk and held[3] == rep and a <= held[2] and abs((p - q) - held[6]) <= DRIFT:
                held[1:3], held[4:] = [min(held[1], a), max(held[2], b)], [min(held[4], c), max(held[5], d), p - q]
            else:
                if held:
                    out.append(held[:6])
                held = [rk, a, b, rep, c, d, p - q]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], schema=_PASSAGES)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in held[:6]], schema=_PASSAGES)


def _asked(batch: pa.RecordBatch) -> pa.RecordBatch:
    pairs, out = [], []
    sides = []
    for text, asked, side in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
        hashes = (shingles(text) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        for x in asked:
            pairs.append(x["pair"])
            sides.append(side)
            out.append(hashes[x["a"] : x["b"] + 1])
    flat = pa.array(np.concatenate(out) if out else np.zeros(0, np.int32))
    offsets = pa.array(np.cumsum([0, *map(len, out)]), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(sides, pa.int32()), pa.ListArray.from_arrays(offsets, flat)], ["pair", "side", "hashes"])


def best_run(hit: np.ndarray, share: float = SIMILARITY) -> tuple[int, int]:
    """First and last place of the stretch in which hits most outweigh misses, so that each end of it has a share of hits of more than `share`."""
    if not hit.any():
        return 0, -1
    gain = np.cumsum(np.where(hit, 1 - share, -share))
    low = np.minimum.accumulate(np.r_[0.0, gain])
    end = int(np.argmax(gain - low[:-1]))
    return int(np.flatnonzero(np.r_[0.0, gain][: end + 1] == low[end])[-1]), end


def chain(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x and y that hold the same, rising in both: the longest chain of what occurs once in either, and what goes on evenly from it."""
    one, i = np.unique(x, return_index=True)
    i = i[np.bincount(np.searchsorted(one, x), minlength=len(one)) == 1]
    two, j, n = np.unique(y, return_index=True, return_counts=True)
    two, j = two[n == 1], j[n == 1]
    i = np.sort(i)
    at = np.minimum(np.searchsorted(two, x[i]), max(0, len(two) - 1))
    i = i[two[at] == x[i]] if len(two) else i[:0]
    j = j[np.searchsorted(two, x[i])] if len(i) else i
    if len(j) > 1 and (np.diff(j) < 0).any():
        tails, ends, before = [], [], []
        for k, v in enumerate(j.tolist()):
            at = bisect_left(tails, v)
            before.append(ends[at - 1] if at else -1)
            tails[at : at + 1], ends[at : at + 1] = [v], [k]
        k, kept = ends[-1], []
        while k >= 0:
            kept.append(k)
            k = before[k]
        i, j = i[kept[::-1]], j[kept[::-1]]
    cuts = np.flatnonzero(np.r_[True, (np.diff(i) != 1) | (np.diff(j) != 1), True]) if len(i) else np.zeros(1, np.int64)
    runs: list[list[int]] = []  # first place in x, in y, and length
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        p, q, n = int(i[s]), int(j[s]), e - s
        a, b = (runs[-1][0] + runs[-1][2], runs[-1][1] + runs[-1][2]) if runs else (0, 0)
        room = min(p - a, q - b)
        if runs and room:
            differs = np.flatnonzero(x[a : a + room] != y[b : b + room])
            goes_on = int(differs[0]) if len(differs) else room
            runs[-1][2] += goes_on
            room -= goes_on
        differs = np.flatnonzero(x[p - room : p] != y[q - room : q])
        back = room - 1 - int(differs[-1]) if len(differs) else room
        runs.append([p - back, q - back, n + back])
    if runs:
        a, b = runs[-1][0] + runs[-1][2], runs[-1][1] + runs[-1][2]
        room = min(len(x) - a, len(y) - b)
        differs = np.flatnonzero(x[a : a + room] != y[b : b + room])
        runs[-1][2] += int(differs[0]) if len(differs) else room
    steps = [np.arange(n) for _, _, n in runs]
    empty = np.zeros(0, np.int64)
    return np.concatenate([p + t for (p, _, _), t in zip(runs, steps, strict=True)] or [empty]), np.concatenate([q + t for (_, q, _), t in zip(runs, steps, strict=True)] or [empty])


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    one, two = np.unique(x), np.unique(y)
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both / (len(one) + len(two) - both)


def _padded(first: int, last: int, width: int, n: int) -> tuple[int, int]:
    """first..last made `width` long, to the right while there is room."""
    last = min(n - 1, max(last, first + width - 1))
    return min(first, last - width + 1), last


def aligned(x: np.ndarray, y: np.ndarray, least: float = SIMILARITY, width: int = WIDTH, padded: bool = False) -> list[tuple[int, int, int, int, float]]:
    """Passages as of similar() that follow the chain of x and y. Every stretch of the chain is tested: with h links, and n and m places of x and y, at
    `width` each or more, it is alike if h / (n + m - h) is `least` or more. From the left the longest is taken, then the search goes on behind it.
    """
    out: list[tuple[int, int, int, int, float]] = []
    if min(len(x), len(y)) < width:
        return out
    i, j = chain(x, y)
    start, n = 0, len(i)
    fewest = int(np.ceil(2 * width * least / (1 + least) - 1e-9))
    if n < fewest:
        return out
    # From s to e a stretch has (1 + least) * hits - least * (places of x and of y) = score[e] - score[s] + 1 - least, which has to be 0 or more.
    score = (1 + least) * np.arange(n) - least * (i + j)
    ahead = np.maximum.accumulate(score[::-1])[::-1][fewest - 1 :]
    begins = np.flatnonzero(ahead - score[: n - fewest + 1] + 1 - least >= -1e-9)
    while (k := int(np.searchsorted(begins, start))) < len(begins):
        s = int(begins[k])
        one, two = i[s + fewest - 1 :] - i[s] + 1, j[s + fewest - 1 :] - j[s] + 1
        ok = np.arange(fewest, n - s + 1) * (1 + least) >= least * (np.maximum(one, width) + np.maximum(two, width)) - 1e-9
        if not padded:
            ok &= (one >= width) & (two >= width)
        last = np.flatnonzero(ok)
        if not len(last):
            start = s + 1
            continue
        e = s + fewest - 1 + int(last[-1])
        (a, b), (c, d) = _padded(int(i[s]), int(i[e]), width, len(x)), _padded(int(j[s]), int(j[e]), width, len(y))
        jaccard = _jaccard(x[a : b + 1], y[c : d + 1])
        if jaccard >= least and (not out or a > out[-1][1]):
            out.append((a, b, c, d, jaccard))
            start = max(e + 1, int(np.searchsorted(i, b, side="right")))
        else:  # shingles that repeat count once; or the padding meets the passage before
            start = s + 1
    return out


def similar(x: np.ndarray, y: np.ndarray, least: float = SIMILARITY, width: int = WIDTH, padded: bool = False) -> list[tuple[int, int, int, int, float]]:
    """Passages of x and y (shingle hashes) that are alike: (first and last in x, first and last in y, Jaccard), in the order of x.

    First come those that keep their order, with every stretch tested. In what is left of x the best stretch is taken if it is alike, in whatever
    order; if it isn't, it is parted where it misses longest. padded: a passage may also begin and end with shingles that differ.
    """
    out, hits = aligned(x, y, least, width, padded), np.isin(x, y)
    ends = [-1, *(v for p in out for v in p[:2]), len(x)]
    todo = [(low + 1, high - 1) for low, high in zip(ends[::2], ends[1::2], strict=True)]
    while todo:
        low, high = todo.pop()
        if high - low + 1 < width:
            continue
        a, b = best_run(hits[low : high + 1])
        a, b = a + low, b + low
        if b - a + 1 < width:
            continue
        todo += [(low, a - 1), (b + 1, high)]
        part = x[a : b + 1]
        c, d = best_run(np.isin(y, part))
        jaccard = _jaccard(part, y[c : d + 1])
        if d - c + 1 >= width and jaccard >= least:
            out.append((a, b, c, d, jaccard))
            continue
        missed = np.flatnonzero(~hits[a : b + 1])
        if len(missed):
            cuts = np.flatnonzero(np.r_[True, np.diff(missed) > 1])
            lengths = np.diff(np.r_[cuts, len(missed)])
            k = int(np.argmax(lengths))
            first = a + int(missed[cuts[k]])
            todo += [(a, first - 1), (first + int(lengths[k]), b)]
        elif b - a + 1 > width:  # all of it occurs in y, but in another order
            todo += [(a, (a + b) // 2), ((a + b) // 2 + 1, b)]
    return sorted(out)


def _verified(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Verified passages of either text of a pair."""
    rows: list[list] = [[] for _ in range(6)]
    x, y = batch.column("x"), batch.column("y")
    names = ("rk", "a", "rep", "c")
    for k, (rk, a, rep, c) in enumerate(zip(*(batch.column(n).to_pylist() for n in names), strict=True)):
        for i, j, m, n, s in similar(x[k].values.to_numpy(), y[k].values.to_numpy(), padded=True):
            for column, value in zip(rows, (rk, a + i, a + j + SHINGLE, rep, c + m, s), strict=True):
                column.append(value)
            for column, value in zip(rows, (rep, c + m, c + n + SHINGLE, rk, a + i, s), strict=True):
                column.append(value)
    kinds = [pa.int64()] * 5 + [pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds, strict=True)], ["rk", "start", "end", "match", "match_start", "similarity"])


def _checked(links: DataFrame, single: DataFrame, n: int) -> DataFrame:
    """The passages of links (rk, place, rep, at), verified on the texts and listed for both of them; cut."""
    merged = links.repartition(n, "rk", "rep").sortWithinPartitions("rk", "rep", "place", "at").mapInArrow(_passages, "rk bigint, a bigint, b bigint, rep bigint, c bigint, d bigint")
    merged = cut(merged.withColumn("pair", F.xxhash64("rk", "a", "rep", "c")), "merged")
    asked = merged.select("rk", F.struct("pair", "a", "b").alias("x"), F.lit(0).alias("side")).unionByName(merged.select(F.col("rep").alias("rk"), F.struct("pair", F.col("c").alias("a"), F.col("d").alias("b")).alias("x"), F.lit(1).alias("side")))
    lists = asked.groupBy("rk", "side", F.pmod("x.pair", F.lit(SALTS)).alias("salt")).agg(F.collect_list("x").alias("asked"))
    # A copied text stands for its group, so texts may be asked for that occur under several names; each rk is one text.
    held = among(single.select("rk", "text"), asked.select("rk")).join(cut(lists), "rk")
    got = in_arrow(held.select("text", "asked", "side"), _asked, "pair bigint, side int, hashes array<int>")
    got = got.groupBy("pair").agg(*[F.first(F.when(F.col("side") == k, F.col("hashes")), ignorenulls=True).alias(x) for k, x in enumerate("xy")])
    both = merged.join(got, "pair").select("rk", "a", "rep", "c", "x", "y")
    return cut(in_arrow(both, _verified, "rk bigint, start bigint, end bigint, match bigint, match_start bigint, similarity double"), "passages")


def near_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(names, passages): passages are (rk, start, end, match, match_start, similarity), names (rk, doc_id).

    start and end count words. Passages of PASSAGE words or more that two texts share, at SIMILARITY or more, are listed for both texts: of all
    pairs of texts that share a seed of at most `group` places; of the others as many as tie them together. Copies of a text are listed as passages of the whole text, with a null end.
    Shingles that recur within a passage's width count once, so that a word or line said over and over makes no passage.
    """
    spark = docs.sparkSession
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), as_bytes(docs[text_col]).alias("text")).select(F.xxhash64("doc_id", "text").alias("rk"), "doc_id", "text")
    keys = cut(texts.select("rk", "doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")), "keys")
    first = cut(keys.groupBy("h1", "h2").agg(F.min("rk").alias("first"), F.max("rk").alias("last")).where("first <> last").select("h1", "h2", "first"))
    copies = cut(keys.join(first, ["h1", "h2"]).where("rk <> first").select("rk", "first"), "copies")
    single = texts.join(copies.select("rk"), "rk", "left_anti")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = cut(in_arrow(single.where(F.octet_length("text") >= 2 * PASSAGE - 1).select("rk", "text"), _seeds, _ROW_SQL), "seeds")
    common = cut(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "common")
    few, hot = common.where(F.col("n") <= group).select("key"), common.where(F.col("n") > group).select("key")
    links = found.join(few, "key").repartition(n, "key").sortWithinPartitions("key", "rk", "place").mapInArrow(_pairs, _LINK_SQL)
    if hot.isEmpty():
        passages = _checked(links, single, n)
    else:
        around = _surroundings(found, hot, single.select("rk", "text"))
        passages = _checked(links.unionByName(_same_core(around)), single, n)
        tied = connected_components(passages.where("rk < match").select(F.col("rk").alias("src"), F.col("match").alias("dst")).distinct()).withColumnRenamed("node", "rk")
        passages = passages.unionByName(_checked(_among_common(around, tied, n, block), single, n))
    words = F.lit(None).cast("long")
    whole = copies.select("rk", F.lit(0).cast("long").alias("start"), words.alias("end"), F.col("first").alias("match"), F.lit(0).cast("long").alias("match_start"), F.lit(1.0).alias("similarity"))
    mirrored = whole.select(F.col("match").alias("rk"), "start", "end", F.col("rk").alias("match"), "match_start", "similarity")
    return keys.select("rk", "doc_id").distinct(), passages.unionByName(whole).unionByName(mirrored)


def documents_with_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_passages, longest, first_start, match_id, similarity, class_id, n_docs, n_links) for each document that shares a passage with another, nearly or exactly.

    n_passages counts distinct places, longest and first_start are in words (longest is null for a document only copied whole),
    match_id is the smallest id among the n_links documents that it is linked to; class_id is the smallest id that links of whatever
    number reach, n_docs the number of documents that they reach. A null or short text shares nothing unless it is copied whole, and counts as an empty one then; rows that repeat id
    and text are one document. An empty table gives an empty result; only id_col and text_col are read.
    """
    with batches_of(docs.sparkSession, BATCH):
        names, passages = near_passages(docs, id_col, text_col)
    passages, names = cut(passages, "passages"), cut(names, "names")
    named = passages.join(names.select(F.col("rk").alias("match"), F.col("doc_id").alias("match_id")), "match")
    found = named.groupBy("rk").agg(F.countDistinct("start", F.coalesce("end", F.lit(-1))).alias("n_passages"), F.max(F.col("end") - F.col("start")).alias("longest"), F.min("match_id").alias("match_id"), F.min("start").alias("first_start"), F.max("similarity").alias("similarity"), F.countDistinct("match").alias("n_links"))
    members = connected_components(passages.where("rk < match").select(F.col("rk").alias("src"), F.col("match").alias("dst")).distinct())
    members = cut(members.select(F.col("node").alias("rk"), "component").join(names, "rk"), "members")
    least = members.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_docs"))
    classed = members.join(least, "component").select("rk", "doc_id", "class_id", "n_docs")
    return found.join(classed, "rk").select("doc_id", "n_passages", "longest", "first_start", "match_id", "similarity", "class_id", "n_docs", "n_links")


def op9_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, class_id, n_docs) for each document that shares a passage: its class and the number of documents in it.

    Which of a class's pairs are verified beside those that tie it together depends on GROUP and BLOCK; the classes don't, so only they are given. Null
    or short texts, repeated rows and empty tables: as of documents_with_passages().
    """
    return documents_with_passages(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_docs")
