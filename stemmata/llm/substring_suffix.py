"""Suffix-array deduplication of repeated byte strings by longest previous factors.

Strings of MIN_BYTES are grouped before any suffix is sorted: each is assigned the smallest hash among its byte grams, so that equal
strings meet under one seed. A seed's places that agree in all they cover are counted; only where they differ are their texts brought
together, and a suffix array over them tells which strings repeat. Groups of very many texts are parted by longer shared contents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemmata.llm.common import among, as_bytes, in_arrow, table
from stemmata.llm.rolling import RowHash, SpanHash, mixed, sliding_min, smaller_before
from stemmata.llm.words import SHINGLE, shingles_of
from stemmata.runtime import cut

MIN_BYTES = 400
#: Words in a row that make a passage, for those that are shorter in bytes.
PASSAGE = 51
#: Words of a gram that seeds a passage.
WORDS = 11
#: Bytes of a gram that seeds a group.
GRAM = 128
#: Bytes that are hashed together, about, and texts of a group that one suffix array takes.
TILE, GROUP = 1_000_000, 64
#: Starts that a part of a large group covers, from one round to the next; in the last a part is one string.
SLICES = (64, 16, 4, 1)


# Suffix arrays


def suffix_ranks(data: np.ndarray, ends: np.ndarray, limit: int) -> tuple[np.ndarray, list[np.ndarray], list[int]]:
    """(suffix array, ranks by depth, depths): suffixes in the order of their first `limit` bytes, equal ones by place.

    ends: for each place, where its text ends; a suffix goes no further. Prefix doubling, from 4 bytes at once.
    """
    n = len(data)
    padded = np.r_[data.astype(np.uint64) + np.uint64(1), np.zeros(4, np.uint64)]
    places = np.arange(n)
    key = np.zeros(n, np.uint64)
    for k in range(4):
        key = key << np.uint64(9) | np.where(places + k < ends, padded[k : n + k], np.uint64(0))
    ranks, depths, depth = [], [], 4
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]]) + 1
        ranks.append(rank)
        depths.append(depth)
        if depth >= limit:
            return order, ranks, depths
        step = min(depth, limit - depth)
        after = places + step
        tail = np.where(after < ends, rank[np.minimum(after, n - 1)], 0)
        key = rank.astype(np.uint64) << np.uint64(32) | tail.astype(np.uint64)
        depth += step


def common_prefix(a: np.ndarray, b: np.ndarray, ends: np.ndarray, ranks: list[np.ndarray], depths: list[int]) -> np.ndarray:
    """Bytes that the suffixes at a and b share, up to the greatest depth; exact in steps of the depths, else a lower bound below 4."""
    n, out = len(ends), np.zeros(len(a), np.int64)
    top = ranks[-1][a] == ranks[-1][b]
    for rank, depth in zip(reversed(ranks), reversed(depths), strict=True):
        x, y = a + out, b + out
        ok = ~top & (x + depth <= ends[a]) & (y + depth <= ends[b])
        ok[ok] = rank[np.minimum(x[ok], n - 1)] == rank[np.minimum(y[ok], n - 1)]
        out[ok] += depth
    out[top] = depths[-1]
    return np.minimum(out, np.minimum(ends[a] - a, ends[b] - b))


def previous_factors(data: np.ndarray, ends: np.ndarray, limit: int, only_limit: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(LPF, LNF): for each place the longest string there, `limit` bytes at most, that also starts at an earlier place, and at a later one.

    In suffix order the best earlier place is the previous or the next one of smaller position; the best later place the previous or
    the next one of larger position. only_limit: factors shorter than limit are given as 0, which saves measuring them.
    """
    n = len(data)
    order, ranks, depths = suffix_ranks(data, ends, limit)
    out = []
    for sign in (1, -1):
        values, best = sign * order, np.zeros(n, np.int64)
        before = smaller_before(values)
        after = n - 1 - smaller_before(values[::-1])[::-1]
        for other in (before, np.where(after < n, after, -1)):
            held = other >= 0
            a, b = order[held], order[other[held]]
            best[a] = np.maximum(best[a], limit * (ranks[-1][a] == ranks[-1][b]) * (a + limit <= ends[a]) if only_limit else common_prefix(a, b, ends, ranks, depths))
        out.append(best)
    return out[0], out[1]


# Seeds


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of runs of equal entries."""
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return first, np.r_[first[1:], len(x)] - 1


def seeds(texts: list[bytes], size: int = MIN_BYTES, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text number, first start, last start, seed hash, content hash) of the runs of starts that share a seed.

    A seed is the gram of smallest hash in a string, the first of equals; it depends on the string alone.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < size:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    first_hash, second_hash = SpanHash(data), SpanHash(data, 1)
    grams = first_hash.all(gram)
    packed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    seed = (sliding_min(packed, size - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    bounds = np.cumsum(lengths)
    text = np.searchsorted(bounds, np.arange(len(seed)), side="right")
    first, last = _runs(seed + len(data) * text)  # a run ends with its text
    # Starts whose string would cross the end of their text are no strings.
    end = bounds[text[first]]
    last = np.minimum(last, end - size)
    keep = first <= last
    first, last = first[keep], last[keep]
    at = seed[first]
    number = text[first]
    base = bounds[number] - lengths[number]
    return number, first - base, last - base, grams[at], second_hash.spans(first, last + size)


def _places(size: int):
    schema = pa.schema([("rk", pa.int64()), ("id", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("f", pa.int64()), ("g", pa.int64())])

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        rk, ids, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        parts, held, owner, shift, total = [], [], [], [], 0

        def flush():
            if held:
                number, a, b, f, g = seeds(held, size)
                own, off = np.array(owner)[number], np.array(shift)[number]
                parts.append((rk[own], ids[own], (a + off).astype(np.int32), (b + off).astype(np.int32), f.view(np.int64), g.view(np.int64)))
                held.clear(), owner.clear(), shift.clear()

        for k in range(batch.num_rows):
            text = texts[k].as_py()
            for start in range(0, max(1, len(text)), TILE):  # tiles of a long text share size - 1 bytes: each start is in one
                tile = text[start : start + TILE + size - 1]
                if len(tile) >= size:
                    held.append(tile)
                    owner.append(k)
                    shift.append(start)
                    total += len(tile)
                if total >= TILE:
                    flush()
                    total = 0
        flush()
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, f.type.to_pandas_dtype()) for f in schema]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return found


# Texts that share a seed but not all around it


def _cut_out(size: int):
    schema = pa.schema([("f", pa.int64()), ("whole", pa.bool_()), ("rk", pa.int64()), ("id", pa.int64()), ("a", pa.int32()), ("text", pa.binary())])

    def cut_out(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [[] for _ in schema]
        for rk, key, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("rk", "id", "text", "wanted")), strict=True):
            for w in wanted:
                for column, value in zip(rows, (w["f"], w["whole"], rk, key, w["a"], text[w["a"] : w["b"] + size]), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return cut_out


def _sliced(size: int, width: int):
    """Parts of each text: starts in slices that lie alike towards the seed, so that equal strings stay together under what a slice shares."""
    schema = pa.schema([("f", pa.int64()), ("g", pa.int64()), ("whole", pa.bool_()), ("rk", pa.int64()), ("id", pa.int64()), ("a", pa.int32()), ("text", pa.binary())])

    def sliced(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [[] for _ in schema]
        for f, whole, rk, key, a, text in zip(*(batch.column(c).to_pylist() for c in ("f", "whole", "rk", "id", "a", "text")), strict=True):
            data = np.frombuffer(text, np.uint8)
            one, two = SpanHash(data), SpanHash(data, 1)
            starts = len(text) - size + 1
            if width == 1:
                cuts = np.arange(starts)
            else:  # slices start where the smallest hash of short grams lies, so that they fall alike in equal strings
                grams = one.all(size - width + 1)
                seed = (sliding_min((grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64), width) & np.uint64(0xFFFFFFFF)).astype(np.int64)[:starts]
                cuts, lasts = _runs(seed)
                shared = one.spans(seed[cuts], seed[cuts] + size - width + 1)
            if width == 1:
                lasts, shared = cuts, one.spans(cuts, cuts + size)
            content = two.spans(cuts, lasts + size)
            for s, e, h, g in zip(cuts.tolist(), lasts.tolist(), shared.view(np.int64).tolist(), content.view(np.int64).tolist(), strict=True):
                for column, value in zip(rows, (h, g, whole, rk, key, a + s, text[s : e + size]), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return sliced


def shared_parts(rows: list[tuple], size: int) -> list[tuple]:
    """The parts of rows (f, whole, rk, id, a, text) whose strings of `size` bytes may repeat: strings with a hash of their own can't, and
    no suffix of theirs need be sorted.
    """
    lengths = np.array([len(r[5]) for r in rows], np.int64)
    bounds = np.cumsum(lengths)
    hashes = SpanHash(np.frombuffer(b"".join(r[5] for r in rows), np.uint8)).all(size)
    starts = np.flatnonzero(np.arange(len(hashes)) + size <= np.repeat(bounds, lengths)[: len(hashes)])
    order = starts[np.argsort(hashes[starts])]
    same = hashes[order[1:]] == hashes[order[:-1]]
    some = np.sort(order[np.r_[False, same] | np.r_[same, False]]) if len(order) else order
    text = np.searchsorted(bounds, some, side="right")
    cuts = np.flatnonzero(np.r_[True, (some[1:] != some[:-1] + 1) | (text[1:] != text[:-1])][: len(some)])
    out = []
    for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(some)], strict=False):
        f, whole, rk, key, a, held = rows[text[i]]
        at = int(some[i] - (bounds[text[i]] - lengths[text[i]]))
        out.append((f, whole, rk, key, a + at, held[at : at + j - i - 1 + size]))
    return out


def _repeated(size: int, first_stays: bool):
    """Strings that repeat among the texts of sorted groups: (rk, id, a, b) runs of starts; groups are never parted."""
    schema = pa.schema([("rk", pa.int64()), ("id", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])

    def solved(rows: list[tuple]) -> pa.RecordBatch:
        rows = shared_parts(rows, size)
        rows.sort(key=lambda r: (r[3], r[4], r[2]))  # (f, whole, rk, id, a, text): earlier documents and places first
        lengths = np.array([len(r[5]) for r in rows], np.int64)
        bounds = np.cumsum(lengths)
        data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
        lpf, lnf = previous_factors(data, np.repeat(bounds, lengths), size, only_limit=True) if rows else (np.zeros(0, np.int64),) * 2
        again = lpf >= size if first_stays else (lpf >= size) | (lnf >= size)
        hit = np.flatnonzero(again)
        text = np.searchsorted(bounds, hit, side="right")
        first = np.flatnonzero(np.r_[True, (hit[1:] != hit[:-1] + 1) | (text[1:] != text[:-1])][: len(hit)])
        last = np.r_[first[1:], len(hit)][: len(first)] - 1
        out = [(rows[t][2], rows[t][3], rows[t][4] + int(hit[i] - (bounds[t] - lengths[t])), rows[t][4] + int(hit[j] - (bounds[t] - lengths[t]))) for i, j, t in zip(first.tolist(), last.tolist(), text[first].tolist(), strict=True) if first_stays or not rows[t][1]]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    def each(batches):
        held: list[tuple] = []
        total = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("f", "whole", "rk", "id", "a", "text")), strict=True):
                if total >= TILE and row[0] != held[-1][0]:
                    yield solved(held)
                    held, total = [], 0
                held.append(row)
                total += len(row[5])
        if held:
            yield solved(held)

    return each


def repeated_strings(docs: DataFrame, size: int = MIN_BYTES, first_stays: bool = False, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(texts, runs): texts are (rk, id, text) of docs (id long, text binary), runs (rk, id, a, b) the starts of strings of `size`
    bytes that also start elsewhere; with first_stays only those that also start earlier, in the order of ids and places.
    """
    spark = docs.sparkSession
    texts = docs.select(F.xxhash64("id", "text").alias("rk"), F.coalesce("id", F.lit(-1 << 63)).alias("id"), "text")
    long = texts.where(F.octet_length("text") >= size)
    places = cut(in_arrow(long, _places(size), "rk bigint, id bigint, a int, b int, f bigint, g bigint"), "places")
    order = F.struct("id", "a", "rk", "b")
    alike = cut(places.groupBy("f", "g").agg(F.count("*").alias("n"), F.min(order).alias("least")))
    seeded = cut(alike.groupBy("f").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total > 1"))
    alike = cut(alike.join(seeded, "f").select("f", "g", "n", "kinds", "least"))
    copies = places.join(alike.where("n > 1").select("f", "g", "least"), ["f", "g"])
    if first_stays:
        copies = copies.where(F.struct("id", "a", "rk", "b") != F.col("least"))
    runs = [copies.select("rk", "id", "a", "b")]
    wanted = alike.where("kinds > 1").select("f", (F.col("n") > 1).alias("whole"), "least.*").groupBy("rk", "id").agg(F.collect_list(F.struct("f", "whole", "a", "b")).alias("wanted"))
    columns = "f bigint, whole boolean, rk bigint, id bigint, a int, text binary"
    rows = cut(in_arrow(long.join(wanted, ["rk", "id"]).select("rk", "id", "text", "wanted"), _cut_out(size), columns), "rows")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for width in (*SLICES, 0):
        large = cut(rows.groupBy("f").agg(F.count("*").alias("n")).where(F.col("n") > group)) if width else None
        few = rows.join(large, "f", "left_anti") if width else rows
        runs.append(few.repartition(n, "f").sortWithinPartitions("f").mapInArrow(_repeated(size, first_stays), "rk bigint, id bigint, a int, b int"))
        if not width or large.isEmpty():
            break
        sliced = cut(in_arrow(rows.join(large.select("f"), "f"), _sliced(size, width), "f bigint, g bigint, whole boolean, rk bigint, id bigint, a int, text binary"), "sliced")
        counted = cut(sliced.groupBy("f", "g").agg(F.count("*").alias("n"), F.min(F.struct("id", "a", "rk")).alias("least")))
        again = sliced.join(counted.where("n > 1").select("f", "g", "least"), ["f", "g"])
        again = again.where(F.struct("id", "a", "rk") != F.col("least")) if first_stays else again.where("NOT whole")
        runs.append(again.select("rk", "id", "a", (F.col("a") + F.octet_length("text") - size).cast("int").alias("b")))
        seeded = cut(counted.groupBy("f").agg(F.count("*").alias("kinds")).where("kinds > 1").select("f"))
        least = counted.join(seeded, "f").select("f", "g", "n", F.col("least.id").alias("id"), F.col("least.a").alias("a"), F.col("least.rk").alias("rk"))
        rows = cut(sliced.join(cut(least), ["f", "g", "id", "a", "rk"]).select("f", (F.col("whole") | (F.col("n") > 1)).alias("whole"), "rk", "id", "a", "text").dropDuplicates(["f", "rk", "id", "a"]), "rows")
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return texts, out


# Passages by words


def passages(texts: list[bytes], length: int = PASSAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text numbers, seeds, hashes, last shingles) of the strings of `length` words of all texts; shingles that recur within a string count once.

    A seed is the gram of smallest hash in a string, so that equal strings have one seed.
    """
    hashes, own, _ = shingles_of(texts, length - SHINGLE)
    size, rows = length - SHINGLE + 1, RowHash(hashes)
    whole = rows.all(size)
    if not len(whole):
        return np.zeros(0, np.int64), whole, whole, whole
    grams = rows.all(WORDS - SHINGLE + 1)
    packed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    seed = grams[(sliding_min(packed, length - WORDS + 1)[: len(whole)] & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    at = np.flatnonzero(own[: len(whole)] == own[size - 1 :])
    return own[at], seed[at], whole[at], mixed(hashes)[at + size - 1]


def _tiles(lengths: list[int]):
    """First and last + 1 of the texts that are taken together."""
    first, total = 0, 0
    for k, n in enumerate(lengths):
        total += n
        if total >= TILE or k == len(lengths) - 1:
            yield first, k + 1
            first, total = k + 1, 0


def _passage_seeds(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(seed, content, rk) of the runs of strings with one seed; content: a hash of all that they cover."""
    texts, rk, parts = batch.column(1).to_pylist(), batch.column(0).to_numpy(), []
    for low, high in _tiles([len(t) for t in texts]):
        number, seed, whole, last = passages(texts[low:high])
        first = np.flatnonzero(np.r_[True, (seed[1:] != seed[:-1]) | (number[1:] != number[:-1])][: len(seed)])
        content = RowHash(last).spans(first, np.r_[first[1:], len(seed)][: len(first)]) ^ whole[first]
        parts.append((seed[first].view(np.int64), content.view(np.int64), rk[low:high][number[first]]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["seed", "content", "rk"])


def _passage_hashes(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The strings of each text with one of its seeds asked for."""
    texts, rk, asked, parts = batch.column(1).to_pylist(), batch.column(0).to_numpy(), batch.column(2), []
    for low, high in _tiles([len(t) for t in texts]):
        number, seed, whole, _ = passages(texts[low:high])
        wanted = asked.slice(low, high - low)
        own = np.repeat(np.arange(high - low, dtype=np.uint64), [len(x) for x in wanted])
        mixed_in = lambda s, k: s ^ (k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        hit = np.isin(mixed_in(seed, number), mixed_in(wanted.flatten().to_numpy().view(np.uint64), own))
        parts.append((whole[hit].view(np.int64), rk[low:high][number[hit]]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["whole", "rk"])


def sharing_passages(texts: DataFrame) -> DataFrame:
    """(rk) of the texts (rk, text) that hold PASSAGE words in a row which a text of another rk holds too."""
    texts = texts.select("rk", "text").where(F.octet_length("text") >= 2 * PASSAGE - 1)
    ends = (F.min("rk").alias("low"), F.max("rk").alias("high"))
    seeded = cut(in_arrow(texts, _passage_seeds, "seed bigint, content bigint, rk bigint"), "passages")
    alike = seeded.groupBy("seed", "content").agg(*ends).where("low <> high").select("seed", "content")
    sure = cut(seeded.join(alike, ["seed", "content"]).select("rk").distinct(), "passages")
    # What is left: runs that agree in part, at seeds of a text that isn't known to share anything.
    told = seeded.select("seed", "rk").join(sure.withColumn("known", F.lit(True)), "rk", "left")
    open_seeds = told.groupBy("seed").agg(*ends, F.count("known").alias("known"), F.count("*").alias("n")).where("low <> high AND known < n").select("seed")
    asked = cut(seeded.select("seed", "rk").join(open_seeds, "seed").groupBy("rk").agg(F.collect_set("seed").alias("asked")))
    found = cut(in_arrow(among(texts, asked).join(asked, "rk"), _passage_hashes, "whole bigint, rk bigint"), "passages")
    same = found.groupBy("whole").agg(*ends).where("low <> high").select("whole")
    return sure.unionByName(found.join(same, "whole").select("rk")).distinct()


def _kept(size: int):
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("shares_passage", pa.bool_())])

    def kept(with_text: bool):
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [[] for _ in schema]
            for key, text, runs, shares in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "runs", "shares")), strict=True):
                spans: list[list[int]] = []
                for a, b in sorted((r["a"], r["b"] + size) for r in runs or ()):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(b, spans[-1][1])
                    else:
                        spans.append([a, b])
                at, parts = 0, []
                for a, b in spans:
                    parts.append(text[at:a])
                    at = b
                stays = b"".join([*parts, text[at:]])
                for column, value in zip(rows, (key, len(text), len(text) - len(stays), len(spans), hashlib.sha256(stays).hexdigest(), stays if with_text else None, bool(shares)), strict=True):
                    column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

        return each

    return kept


def dedup_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = MIN_BYTES, first_stays: bool = True, with_text: bool = True, group: int = GROUP, by_words: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of docs: kept are the bytes that no repeated string of `size` bytes covers.

    With first_stays the first copy of a string, by id and place, stays, and those after it go; without it all copies go. Strings never
    cross texts and are judged on the input. by_words: a column shares_passage tells, beside, whether PASSAGE words in a row are held by a row of other id or
    text too, which may be fewer than `size` bytes; nothing is removed for that. A null text is empty; texts shorter than size lose nothing. A repeated row is one more
    document. A null id comes first in the order of ids; first_stays keeps the string in each of several equal rows with the first
    id. An empty table gives an empty result; only id_col and text_col are read.
    """
    texts, runs = repeated_strings(docs.select(docs[id_col].cast("long").alias("id"), as_bytes(docs[text_col]).alias("text")), size, first_stays, group)
    runs = runs.select("rk", F.struct("a", "b").alias("run"), F.lit(False).alias("shares"))
    if by_words:
        runs = runs.unionByName(sharing_passages(texts).select("rk", F.lit(None).cast("struct<a:int,b:int>").alias("run"), F.lit(True).alias("shares")))
    runs = runs.groupBy("rk").agg(F.collect_set("run").alias("runs"), F.max("shares").alias("shares"))
    columns = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, shares_passage boolean"
    out = in_arrow(texts.join(runs, "rk", "left").select("id", "text", "runs", "shares"), _kept(size)(with_text), columns)
    out = out.withColumn("id", F.when(F.col("id") != -1 << 63, F.col("id"))).withColumnRenamed("id", "doc_id")
    return out if by_words else out.drop("shares_passage")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup_strings() of documents with all copies removed, without the kept bytes, and with shares_passage behind the contract's columns."""
    return dedup_strings(table(spark, sf_dir, "documents"), first_stays=False, with_text=False, by_words=True).drop("kept")
