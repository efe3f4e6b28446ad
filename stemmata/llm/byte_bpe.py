"""Byte-level BPE encoding and decoding: DuckDB recursive queries over the distinct words of a block of texts, in each partition."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemmata.llm.common import as_bytes, table

#: Bytes of text that are encoded at once; a text is never cut, so a longer one is a block of its own.
BLOCK_BYTES = 8 << 20
#: Words, chunks and runs of ids that a Python worker remembers from block to block, each; past twice that the half goes that wasn't met lately, to be made again when met.
REMEMBERED = 300_000
#: Words of over so many bytes contract all places of a rank in a round, shorter ones one place.
LONG_WORD = 64
#: Above every rank.
NONE = 1 << 30

#: A round of words of a few bytes. Rows are tokens (l) at dense positions with their right neighbour (r, -1 at the end) and the rank k of both together.
#: Each word's least (rank, position) is contracted: the pair's first row goes, the rows beside it hear of the new token. A word without a pair is emitted once more, as done.
SHORT = f"""
WITH RECURSIVE t(w, p, l, r, k, done) AS (
  SELECT b.w, b.p, b.l, b.r, coalesce(m.id, {NONE}), false FROM bytes b LEFT JOIN merges m ON m.pair = (b.l::BIGINT << 32) + b.r
  UNION ALL
  SELECT x.w, x.p, x.l, x.r, CASE WHEN x.new THEN coalesce(m.id, {NONE}) ELSE x.k END, x.done FROM (
    SELECT t.w, t.p - CAST(low.id < {NONE} AND t.p > low.p AS INTEGER) AS p,
           CASE WHEN low.id < {NONE} AND t.p = low.p + 1 THEN low.id ELSE t.l END AS l,
           CASE WHEN low.id < {NONE} AND t.p = low.p - 1 THEN low.id ELSE t.r END AS r,
           t.k, low.id < {NONE} AND abs(t.p - low.p) = 1 AS new, low.id = {NONE} AS done
    FROM t JOIN (
      SELECT w, CAST(x >> 20 AS INTEGER) AS id, CAST(x & 1048575 AS INTEGER) AS p FROM (SELECT w, min((k::BIGINT << 20) + p) AS x FROM t WHERE NOT done GROUP BY w)
    ) low ON t.w = low.w
    WHERE low.id = {NONE} OR t.p <> low.p
  ) x LEFT JOIN merges m ON m.pair = CASE WHEN x.new THEN (x.l::BIGINT << 32) + x.r END
)
SELECT w, l FROM t WHERE done ORDER BY w, p
"""

#: A round of long words: every place of the word's least rank, from the left and without overlaps, up to the first whose contraction makes a pair of lower rank, which
#: the next round takes first. That is what contracting the leftmost least pair again and again comes to, in as many rounds as ranks instead of places.
LONG = f"""
WITH RECURSIVE t(w, p, l, r, k, done) AS (
  SELECT b.w, b.p, b.l, b.r, coalesce(m.id, {NONE}), false FROM bytes b LEFT JOIN merges m ON m.pair = (b.l::BIGINT << 32) + b.r
  UNION ALL
  SELECT z.w, z.p, z.l, z.r, coalesce(m.id, {NONE}), z.done FROM (
    WITH a AS (
      SELECT w, p, l, r, k, min(k) OVER (PARTITION BY w) AS low, lag(l) OVER (PARTITION BY w ORDER BY p) AS l0, lead(r) OVER (PARTITION BY w ORDER BY p) AS r2 FROM t WHERE NOT done
    ), places AS (
      SELECT w, p, l0, r2, low, p - row_number() OVER (PARTITION BY w ORDER BY p) AS run FROM a WHERE k = low AND low < {NONE}
    ), apart AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY p) AS n FROM places) WHERE n % 2 = 1
    ), made AS (
      SELECT w, p, low, r2, CASE WHEN lag(p) OVER (PARTITION BY w ORDER BY p) = p - 2 THEN low ELSE l0 END AS left FROM apart
    ), judged AS (
      SELECT made.w, made.p, made.low, least(coalesce(m1.id, {NONE}), coalesce(m2.id, {NONE})) < made.low AS lower FROM made
      LEFT JOIN merges m1 ON m1.pair = (made.left::BIGINT << 32) + made.low LEFT JOIN merges m2 ON m2.pair = (made.low::BIGINT << 32) + made.r2
    ), taken AS (
      SELECT w, p, low FROM (SELECT *, min(CASE WHEN lower THEN p END) OVER (PARTITION BY w) AS stop FROM judged) WHERE stop IS NULL OR p <= stop
    ), kept AS (
      SELECT * FROM (SELECT a.w, a.p, coalesce(s.low, a.l) AS l, a.low = {NONE} AS done, lag(s.low) OVER (PARTITION BY a.w ORDER BY a.p) AS before FROM a LEFT JOIN taken s ON s.w = a.w AND s.p = a.p) WHERE before IS NULL
    )
    SELECT w, CAST(row_number() OVER (PARTITION BY w ORDER BY p) - 1 AS INTEGER) AS p, l, coalesce(lead(l) OVER (PARTITION BY w ORDER BY p), -1) AS r, done FROM kept
  ) z LEFT JOIN merges m ON m.pair = (z.l::BIGINT << 32) + z.r
)
SELECT w, l FROM t WHERE done ORDER BY w, p
"""

#: The tokens of all runs in turn, as one hexadecimal string, and the bytes of each token.
DECODED = "SELECT string_agg(v.hex, '' ORDER BY i.p) AS hex, list(length(v.hex) // 2 ORDER BY i.p) AS n FROM ids i JOIN vocabulary v ON v.id = i.id"


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks, from lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _bytes_and_bounds(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array without nulls, and its n + 1 bounds in them."""
    values = values.cast(pa.large_binary())
    bounds = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def _pieces(values: pa.Array) -> list[bytes]:
    data, bounds = _bytes_and_bounds(values)
    whole, at = data.tobytes(), bounds.tolist()
    return [whole[a:b] for a, b in zip(at, at[1:], strict=False)]


def _cut(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def _chunk_bounds(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bounds of chunks that the pattern may split one by one: each begins with a text, or with an ASCII blank behind a character that is none.

    No match goes over such a place, and none looks behind itself; a chunk ends with its text or with no blank, so nothing looks ahead of it either.
    """
    blank = (data == 32) | ((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 31))
    at = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    high = data[at - 1] >= 128
    if high.any():  # the character before may be a blank of more bytes
        own = at[high]
        a, b, c = data[own - 1], data[own - 2], data[np.maximum(own - 3, 0)]
        wide = (b == 0xC2) & ((a == 0x85) | (a == 0xA0)) | (c == 0xE1) & (b == 0x9A) & (a == 0x80) | (c == 0xE2) & ((b == 0x80) | (b == 0x81)) | (c == 0xE3) & (b == 0x80) & (a == 0x80)
        at = np.r_[at[~high], own[~wide]]
    return _marked(len(data), at, bounds)


def _marked(n: int, *places: np.ndarray) -> np.ndarray:
    """The distinct places among 0..n, in order."""
    marks = np.zeros(n + 1, bool)
    for p in places:
        marks[p] = True
    return np.flatnonzero(marks)


class Memory:
    """A bounded dictionary: what was met since the last turn, and what was met in the turn before."""

    def __init__(self):
        self.now, self.before = {}, {}

    def missing(self, keys) -> list[bytes]:
        """The keys that aren't known; the others are in `now` from here on."""
        if len(self.now) > REMEMBERED:
            self.now, self.before = {}, self.now
        now, before, out = self.now, self.before, []
        for k in keys:
            if k not in now:
                if (v := before.get(k)) is None:
                    out.append(k)
                else:
                    now[k] = v
        return out


class Codec:
    """Encodes and decodes arrays of texts by a rank table. A worker keeps one for each table."""

    _held: dict[str, Codec] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.words, self.chunks, self.runs = Memory(), Memory(), Memory()
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"no token for the bytes {missing}")
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        # Two tokens may be contracted if they are a token together, whose id is the rank.
        pairs = [(ranks[t[:k]] << 32 | ranks[t[k:]], n) for t, n in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self._put("merges", pair=pa.array([p for p, _ in pairs], pa.int64()), id=pa.array([n for _, n in pairs], pa.int32()))
        self._put("vocabulary", id=pa.array(list(ranks.values()), pa.int32()), hex=pa.array([t.hex() for t in ranks]))
        opens = np.zeros(max(ranks.values()) + 1, bool)
        opens[[n for t, n in ranks.items() if t[:1].isspace()]] = True
        self.opens = opens

    @classmethod
    def held(cls, ranks: dict[bytes, int], pattern: str, key: str) -> Codec:
        if key not in cls._held:
            cls._held = {key: cls(ranks, pattern)}
        return cls._held[key]

    def _put(self, name: str, **columns: pa.Array) -> None:
        rows = pa.table(columns)
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _contracted(self, words: list[bytes], query: str) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit integers; words have two bytes or more."""
        lengths = np.array([len(w) for w in words])
        ends = np.cumsum(lengths)
        left = self.single[np.frombuffer(b"".join(words), np.uint8)]
        right = np.r_[left[1:], -1].astype(np.int32)
        right[ends - 1] = -1
        place = np.arange(len(left)) - np.repeat(ends - lengths, lengths)
        rows = pa.table({"w": pa.array(np.repeat(np.arange(len(words)), lengths), pa.int32()), "p": pa.array(place, pa.int32()), "l": pa.array(left), "r": pa.array(right)})
        self.db.register("bytes", rows)
        found = self.db.sql(query).to_arrow_table()
        self.db.unregister("bytes")
        data = found.column("l").to_numpy().astype("<i4").tobytes()
        bounds = np.r_[0, np.cumsum(np.bincount(found.column("w").to_numpy(), minlength=len(words)))] * 4
        return [data[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of words. A word that is a token is encoded as that; others by contraction."""
        new = self.words.missing(words)
        self.words.now.update((w, self.ranks[w].to_bytes(4, "little")) for w in new if w in self.ranks)
        new = [w for w in new if w not in self.ranks]
        for query, part in ((SHORT, [w for w in new if len(w) <= LONG_WORD]), (LONG, [w for w in new if len(w) > LONG_WORD])):
            if part:
                self.words.now.update(zip(part, self._contracted(part, query), strict=True))
        return self.words.now

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text (no nulls), as binary of little-endian 32-bit integers."""
        data, bounds = _bytes_and_bounds(texts)
        cuts = _chunk_bounds(data, bounds)
        coded = _cut(data, cuts).dictionary_encode()
        chunks = _pieces(coded.dictionary)
        new = self.chunks.missing(chunks)
        split = [[w.encode() for w in self.pattern.findall(c.decode())] for c in new]
        known = self._learn({w for words in split for w in words})
        self.chunks.now.update((c, known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words])) for c, words in zip(new, split, strict=True))
        return self._gathered([self.chunks.now[c] for c in chunks], coded.indices, cuts, bounds)

    def decode(self, ids: pa.Array) -> pa.Array:
        """The bytes of each list of ids (binary of little-endian 32-bit integers): distinct runs of ids from one that begins with a blank to the next are joined with the vocabulary."""
        data, bounds = _bytes_and_bounds(ids)
        flat = np.ascontiguousarray(data).view("<i4")
        cuts = _marked(len(flat), np.flatnonzero(self.opens[flat]), bounds // 4) * 4
        coded = _cut(data, cuts).dictionary_encode()
        runs = _pieces(coded.dictionary)
        new = self.runs.missing(runs)
        if new:
            lengths = np.array([len(r) // 4 for r in new])
            rows = pa.table({"w": pa.array(np.repeat(np.arange(len(new)), lengths), pa.int32()), "p": pa.array(np.arange(lengths.sum()), pa.int64()), "id": pa.array(np.frombuffer(b"".join(new), "<i4"))})
            self.db.register("ids", rows)
            found = self.db.sql(DECODED).to_arrow_table()
            self.db.unregister("ids")
            sizes = np.r_[0, np.cumsum(found.column("n").combine_chunks().values.to_numpy())]
            if len(sizes) != len(rows) + 1:
                raise ValueError("ids that the vocabulary lacks")
            self.runs.now.update(zip(new, _pieces(_cut(np.frombuffer(bytes.fromhex(found.column("hex")[0].as_py()), np.uint8), sizes[np.r_[0, np.cumsum(lengths)]])), strict=True))
        return self._gathered([self.runs.now[r] for r in runs], coded.indices, cuts, bounds)

    @staticmethod
    def _gathered(values: list[bytes], indices: pa.Array, cuts: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """values of the chunks in turn, joined for each text: chunks between cuts, texts between bounds."""
        data, ends = _bytes_and_bounds(pa.array(values, pa.large_binary()).take(indices))
        return _cut(data, ends[np.searchsorted(cuts, bounds)])


def _blocks(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of BLOCK_BYTES of text, or one row."""
    start, held = 0, 0
    for k, n in enumerate(lengths.tolist()):
        if held and held + n > BLOCK_BYTES:
            yield start, k
            start, held = k, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def _mapped(df: DataFrame, ranks: dict[bytes, int], pattern: str, given: str, schema: str, fn) -> DataFrame:
    """df with fn(codec, values of `given`) -> columns in place of that column, block by block. The rank table goes out as a broadcast variable: its size is the vocabulary's."""
    held = df.sparkSession.sparkContext.broadcast((ranks, pattern))
    key = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(given)
            _, bounds = _bytes_and_bounds(batch.column(at))
            for a, b in _blocks(np.diff(bounds)):
                part = batch.slice(a, b - a)
                made = fn(Codec.held(*held.value, key), part.column(at))
                names = [n for n in batch.schema.names if n != given]
                yield pa.RecordBatch.from_arrays([*[part.column(batch.schema.get_field_index(n)) for n in names], *made.values()], [*names, *made])

    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != given)
    return df.mapInArrow(each, f"{rest}, {schema}" if rest else schema)


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the column `ids` (binary, little-endian 32-bit integers) behind its own: the text's tokens.

    The pattern splits a text into words, each of which is encoded by itself; special tokens don't exist. Null and empty texts have no ids; rows stay as they are, however often they repeat;
    a text is encoded whole, however long. A column named like `ids` is replaced.
    """
    inner = df.drop(ids).withColumn("__text", as_bytes(F.col(f"`{text}`")))
    return _mapped(inner, ranks, pattern, "__text", f"`{ids}` binary", lambda codec, texts: {ids: codec.encode(texts).cast(pa.binary())})


def decode(df: DataFrame, ranks: dict[bytes, int], pattern: str, ids: str = "ids", data: str = "data") -> DataFrame:
    """df with the column `data` (binary) behind its own: the bytes of its ids. Null and empty ids give no bytes; an id that the vocabulary lacks is an error."""
    inner = df.drop(data).withColumn("__ids", F.coalesce(F.col(f"`{ids}`"), F.lit(b"")))
    return _mapped(inner, ranks, pattern, "__ids", f"`{data}` binary", lambda codec, values: {data: codec.decode(values).cast(pa.binary())})


def _digests(values: pa.Array) -> pa.Array:
    data, bounds = _bytes_and_bounds(values)
    view = memoryview(np.ascontiguousarray(data))
    return pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)])


def round_trip(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """df's columns but the text, and n_tokens, ids_sha256 and decoded_sha256: encoded and decoded in one pass, so that ids don't leave the worker."""

    def both(codec: Codec, texts: pa.Array) -> dict[str, pa.Array]:
        ids = codec.encode(texts)
        _, bounds = _bytes_and_bounds(ids)
        return {"n_tokens": pa.array(np.diff(bounds) // 4, pa.int64()), "ids_sha256": _digests(ids), "decoded_sha256": _digests(codec.decode(ids))}

    return _mapped(df.withColumn(text, as_bytes(F.col(f"`{text}`"))), ranks, pattern, text, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", both)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document. A null text counts as empty; repeated rows are encoded each; an empty table gives no rows."""
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
