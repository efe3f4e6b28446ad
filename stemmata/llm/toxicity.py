"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals give document scores and spans."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemmata.llm.common import as_bytes, in_arrow, table

#: Labelled documents of each label that the model is fitted on, and bytes of their texts, at most; the smallest hashes of ids come first.
SAMPLE_DOCS, SAMPLE_BYTES = 1_500, 12_000_000
#: Words of a row of the table that a text's chain is laid out in; messages pass from row to row.
CHAIN = 64
#: A feature marks words of toxic documents as toxic if, weighing both labels alike, this share of its documents is toxic, with a
#: log-likelihood ratio against chance of this much, so that none of the very many features is taken by accident.
LEAST_SHARE, LEAST_GAIN = 0.9, 7.0
_CACHE = 300_000
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_PLACES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def features(word: bytes) -> list[bytes]:
    """The word, and its first 3, 4 and 5 letters, of words longer than those."""
    s = word.decode("utf-8", "replace")
    return [b"=" + word, *(f"{k}{s[:k]}".encode() for k in (3, 4, 5) if len(s) > k)]


class _Scores(dict):
    """A word's log-odds of being toxic apart from its neighbours; computed on first use."""

    def __init__(self, weights: dict[bytes, float], bias: float):
        super().__init__()
        self.weights, self.bias = weights, bias

    def __missing__(self, word: bytes) -> float:
        if len(self) >= _CACHE:
            self.clear()
        out = self[word] = min(30.0, max(-30.0, self.bias + sum(self.weights.get(f, 0.0) for f in features(word))))
        return out


def _rows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of words in a (rows, CHAIN) table, which of its cells hold words, and each text's number of rows."""
    per = -(-sizes // CHAIN)
    first = np.repeat(np.cumsum(per) - per, sizes)
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    places = first * CHAIN + within
    held = np.zeros(int(per.sum()) * CHAIN, bool)
    held[places] = True
    return places, held.reshape(-1, CHAIN), per


def _messages(emit: np.ndarray, held: np.ndarray, per: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Odds that reach each row from the rows before it, and from those behind it: a row is a 2 x 2 matrix, and matrices are passed through row by row."""
    n, starts = len(emit), np.cumsum(per) - per
    ahead, back = np.ones(n), np.ones(n)
    if not len(per) or per.max() < 2:
        return ahead, back
    first = np.zeros(n, bool)
    first[starts[per > 0]] = True
    # The product of moves and emissions of a row; where a text begins there is no move, and cells without words change nothing.
    p00, p01, p10, p11 = np.ones(n), np.zeros(n), np.zeros(n), np.ones(n)
    for t in range(CHAIN - 1, -1, -1):
        m00, m01, m10, m11 = (np.where(first, f, m) for f, m in zip((1.0, 1.0, 0.0, 0.0), moves.ravel(), strict=True)) if t == 0 else moves.ravel()
        e, on = emit[:, t], held[:, t]
        q00, q01, q10, q11 = m00 * p00 + m01 * e * p10, m00 * p01 + m01 * e * p11, m10 * p00 + m11 * e * p10, m10 * p01 + m11 * e * p11
        total = q00 + q01 + q10 + q11
        p00, p01, p10, p11 = (np.where(on, q / total, p) for q, p in zip((q00, q01, q10, q11), (p00, p01, p10, p11), strict=True))
    order = np.argsort(-per, kind="stable")
    texts = np.searchsorted(-per[order], np.arange(0, -int(per.max()), -1))  # how many texts have more rows than k
    for k in range(1, int(per.max())):
        row = starts[order[: texts[k]]] + k
        r = ahead[row - 1]
        ahead[row] = (p01[row - 1] + r * p11[row - 1]) / (p00[row - 1] + r * p10[row - 1])
        row = starts[order[: texts[k]]] + per[order[: texts[k]]] - k
        b = back[row]
        back[row - 1] = (p10[row] + p11[row] * b) / (p00[row] + p01[row] * b)
    return ahead, back


def marginals(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over every text's chain at once: (log-odds of each word's being toxic, expected share of moves between states).

    moves: a 2 x 2 table of factors, from state to state. Only the odds of the two states are kept, which can't underflow.
    """
    places, held, per = _rows(sizes)
    if not len(held):
        return np.zeros(0), np.zeros((2, 2))
    table = np.zeros(held.size)
    table[places] = np.exp(scores)
    emit = table.reshape(held.shape)
    before, behind = _messages(emit, held, per, moves)
    first, last = np.zeros(len(emit), bool), np.zeros(len(emit), bool)
    first[(np.cumsum(per) - per)[per > 0]] = last[np.cumsum(per)[per > 0] - 1] = True
    ahead, back = np.empty_like(emit), np.ones_like(emit)
    ahead[:, 0] = np.where(first, emit[:, 0], emit[:, 0] * (moves[0, 1] + before * moves[1, 1]) / (moves[0, 0] + before * moves[1, 0]))
    for t in range(1, CHAIN):
        r = ahead[:, t - 1]
        ahead[:, t] = np.where(held[:, t], emit[:, t] * (moves[0, 1] + r * moves[1, 1]) / (moves[0, 0] + r * moves[1, 0]), 0.0)
    back[:, -1] = np.where(last, 1.0, behind)
    for t in range(CHAIN - 2, -1, -1):
        x = emit[:, t + 1] * back[:, t + 1]
        back[:, t] = np.where(held[:, t + 1], (moves[1, 0] + x * moves[1, 1]) / (moves[0, 0] + x * moves[0, 1]), 1.0)
    odds = ahead * back
    pairs, on = held[:, 1:], np.flatnonzero(~last)
    a = np.r_[ahead[:, :-1][pairs], ahead[on, -1]]
    x = np.r_[(emit[:, 1:] * back[:, 1:])[pairs], emit[on + 1, 0] * back[on + 1, 0]]
    joint = np.stack([np.full_like(a, moves[0, 0]), moves[0, 1] * x, a * moves[1, 0], a * moves[1, 1] * x])
    share = (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2) if len(a) else np.zeros((2, 2))
    return np.log(np.maximum(odds.reshape(-1)[places], 1e-30)), share


def _summary(logits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each document: 1, the highest log-odds of a word, the logarithm of the expected number of toxic words."""
    out = np.full((len(sizes), 3), (1.0, -20.0, -20.0))
    full = sizes > 0
    if full.any():
        starts = (np.cumsum(sizes) - sizes)[full]
        out[full, 1] = np.clip(np.maximum.reduceat(logits, starts), -20, 20)
        out[full, 2] = np.log(np.maximum(np.add.reduceat(1 / (1 + np.exp(-logits)), starts), 1e-9))
    return out


@dataclass
class Tagger:
    """A fitted model: feature weights, a bias, factors of moves and weights of the document summary."""

    weights: dict[bytes, float]
    bias: float
    moves: np.ndarray
    top: np.ndarray

    def scores(self) -> _Scores:
        return _Scores(self.weights, self.bias)

    def tag(self, docs: list[list[bytes]], cache: _Scores) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score of each document, log-odds of each word, words of each document)."""
        sizes = np.array([len(d) for d in docs], np.int64)
        score = np.fromiter((cache[w] for d in docs for w in d), float, int(sizes.sum()))
        logits, _ = marginals(score, sizes, self.moves)
        return 1 / (1 + np.exp(-np.clip(_summary(logits, sizes) @ self.top, -30, 30))), logits, sizes


def token_labels(docs: list[list[bytes]], toxic: list[int]) -> set[bytes]:
    """Features that tell toxic documents: words with one of them are labelled toxic in toxic documents, all other words clean.

    The best feature is taken and its documents count half as much from then on, then the next best, and so on: what merely goes
    along with toxic words, as the other words of copied documents do, soon explains too little and is left out.
    """
    held = [{f for w in set(d) for f in features(w)} for d in docs]
    clean = Counter(f for h, label in zip(held, toxic, strict=True) if not label for f in h)
    where: dict[bytes, set[int]] = {}
    for k, (h, label) in enumerate(zip(held, toxic, strict=True)):
        for f in h if label else ():
            where.setdefault(f, set()).add(k)
    bad_docs = max(1, sum(toxic))
    share, clean_docs = bad_docs / (len(toxic) + 1), max(1, len(toxic) - bad_docs)

    def gain(n: int, m: int) -> float:
        """n toxic and m clean documents against chance."""
        if not n or n / bad_docs < LEAST_SHARE / (1 - LEAST_SHARE) * m / clean_docs:
            return 0.0
        return n * math.log(n / (n + m) / share) + (m * math.log(m / (n + m) / (1 - share)) if m else 0.0)

    weight = [1.0] * len(docs)
    left = {f: ks for f, ks in where.items() if gain(len(ks), clean[f]) >= LEAST_GAIN}
    out: set[bytes] = set()
    while left:
        worth = {f: gain(sum(weight[k] for k in ks), clean[f]) for f, ks in left.items()}
        best = max(worth, key=lambda f: (worth[f], f))
        if worth[best] < LEAST_GAIN:
            break
        out.add(best)
        for k in left.pop(best):
            weight[k] /= 2
        left = {f: ks for f, ks in left.items() if worth[f] >= LEAST_GAIN}
    return out


def fit(rows: Iterable[tuple[bytes, int]], rounds: int = 60, rate: float = 0.5, ridge: float = 1e-4) -> Tagger:
    """Fits the field by gradient ascent on the likelihood of the token labels, then the summary on the document labels."""
    texts, toxic = [], []
    for text, label in rows:
        texts.append(words(text))
        toxic.append(int(label))
    marks = token_labels(texts, toxic)
    if not marks:
        share = (sum(toxic) + 0.5) / (len(toxic) + 2)  # without rows nothing speaks for toxic
        return Tagger({}, -10.0, np.ones((2, 2)), np.array([math.log(share / (1 - share)), 0.0, 0.0]))
    vocabulary: dict[bytes, int] = {}
    sizes = np.array([len(d) for d in texts], np.int64)
    ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for d in texts for w in d), np.int64, int(sizes.sum()))
    known: dict[bytes, int] = {}
    held = [[known.setdefault(f, len(known)) for f in features(w)] for w in vocabulary]
    of_word = np.repeat(np.arange(len(held)), [len(h) for h in held])
    of_feature = np.fromiter((f for h in held for f in h), np.int64)
    marked = np.array([any(f in marks for f in features(w)) for w in vocabulary])
    gold = (marked[ids] & np.repeat(np.array(toxic, bool), sizes)).astype(float)
    within = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    follows = within > 0
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (gold[:-1].astype(int)[follows[1:]], gold[1:].astype(int)[follows[1:]]), 1)
    theta, bias, log_moves = np.zeros(len(known)), math.log((gold.sum() + 1) / (len(gold) + 2)), np.zeros((2, 2))
    seen_theta, seen_bias, seen_moves = np.full(len(known), 1e-8), 1e-8, np.full((2, 2), 1e-8)
    for _ in range(rounds):
        of = np.clip(bias + np.bincount(of_word, theta[of_feature], len(held)), -30, 30)
        logits, share = marginals(of[ids], sizes, np.exp(log_moves))
        off = np.bincount(ids, gold - 1 / (1 + np.exp(-logits)), len(held))
        up = np.bincount(of_feature, off[of_word], len(known)) - ridge * len(gold) ** 0.5 * theta
        seen_theta += up**2
        theta += rate * up / np.sqrt(seen_theta)
        seen_bias += off.sum() ** 2
        bias += rate * off.sum() / math.sqrt(seen_bias)
        turn = pairs - share - 0.1 * log_moves
        seen_moves += turn**2
        log_moves = np.clip(log_moves + 0.3 * rate * turn / np.sqrt(seen_moves), -4, 4)
    weights = {f: float(theta[k]) for f, k in known.items() if abs(theta[k]) > 0.02}
    out = Tagger(weights, bias, np.exp(log_moves), np.zeros(3))
    logits, _ = marginals(np.clip(bias + np.bincount(of_word, theta[of_feature], len(held)), -30, 30)[ids], sizes, out.moves)
    x, y, top = _summary(logits, sizes), np.array(toxic, float), np.zeros(3)
    for _ in range(25):  # Newton's method, with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ top, -30, 30)))
        top = top + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3), x.T @ (y - p) - 0.05 * top)
    out.top = top
    return out


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Iterable[tuple[bytes, int]]:
    """Texts and labels for fit(), within SAMPLE_DOCS of each label and SAMPLE_BYTES, longer texts being passed over; ids with two labels or none are left out."""
    known = labels.where(labels[id_col].isNotNull() & labels[label_col].isin(0, 1)).groupBy(labels[id_col].alias("__id")).agg(F.min(label_col).alias("lo"), F.max(label_col).alias("hi")).where("lo = hi")
    ids = None
    for label in (0, 1):
        part = known.where(F.col("lo") == label).select("__id", F.col("lo").alias("__label")).orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE_DOCS)
        ids = part if ids is None else ids.unionByName(part)
    rows = docs.join(F.broadcast(ids), docs[id_col] == F.col("__id")).select(F.xxhash64("__id").alias("h"), as_bytes(docs[text_col]).alias("text"), "__label")
    left = SAMPLE_BYTES
    for r in rows.orderBy("h", "text").limit(2 * SAMPLE_DOCS).toLocalIterator():
        if len(r["text"]) > left:
            continue
        left -= len(r["text"])
        yield bytes(r["text"]), r["__label"]


def _offsets(text: bytes, logits: np.ndarray) -> list[dict]:
    """Runs of words likelier toxic than not, as code point offsets."""
    out: list[dict] = []
    for k, place in enumerate(_PLACES.finditer(text)):
        if logits[k] >= 0:
            p = float(1 / (1 + np.exp(-logits[k])))
            if out and out[-1]["word"] == k - 1:
                out[-1] |= {"word": k, "end": place.end(), "p": max(p, out[-1]["p"])}
            else:
                out.append({"word": k, "start": place.start(), "end": place.end(), "p": p})
    code = lambda at: len(text[:at].decode("utf-8", "replace"))
    return [{"start": code(s["start"]), "end": code(s["end"]), "p": s["p"]} for s in out]


def score_toxicity(docs: DataFrame, model: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, spans) for each row of docs; spans: (start, end, p) in code points of whole text.

    A null or empty text has no words, no spans and the score of a text without evidence. Repeated rows are scored each; an empty
    table gives an empty result; only id_col and text_col are read, and only the text makes the score.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
    caches: list[_Scores] = []

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not caches:
            caches.append(model.scores())
        texts = batch.column(1).to_pylist()
        scores, spans, at = [], [], 0
        while at < len(texts):  # a few megabytes at a time
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= 2_000_000):
                size += len(texts[end])
                end += 1
            score, logits, sizes = model.tag([words(t) for t in texts[at:end]], caches[0])
            scores.append(score)
            bounds = np.cumsum(sizes)
            for t, n, e in zip(texts[at:end], sizes.tolist(), bounds.tolist(), strict=True):
                own = logits[e - n : e]
                spans.append(_offsets(t, own) if n and own.max() >= 0 else [])
            at = end
        score = np.concatenate(scores)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, span)], ["doc_id", "score", "predicted", "spans"])

    return in_arrow(docs.select(docs[id_col], as_bytes(docs[text_col])), scored, f"doc_id {kind}, score double, predicted int, spans array<struct<start:int,end:int,p:double>>")


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of documents by a model learned from rows outside the fold that is held out; null or empty texts score low, rows with a null id are judged too and never learned from."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fit(sample(docs, labels.where(~held_out(F.col("doc_id"))), "doc_id", "text", "toxic"))
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
