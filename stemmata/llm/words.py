"""Shingles of words over many texts at once."""

from __future__ import annotations

import numpy as np

from stemmata.llm.common import LOWER_ASCII
from stemmata.llm.rolling import SpanHash

#: Words of a shingle.
SHINGLE = 5


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, text number) of the words of all texts, A-Z lower-cased, words parted by blanks."""
    plain = [b" ".join(text.translate(LOWER_ASCII).split()) for text in texts]
    data = np.frombuffer(b" ".join(t for t in plain if t), np.uint8)
    gaps = np.flatnonzero(data == 32)
    text = np.repeat(np.arange(len(plain)), [t.count(b" ") + 1 if t else 0 for t in plain])
    return data, np.r_[0, gaps + 1][: len(text)], np.r_[gaps, len(data)][: len(text)], text


def fresh(hashes: np.ndarray, text: np.ndarray, within: int) -> np.ndarray:
    """Places of the shingles that none of the `within` before them in their text equals: words that repeat count once."""
    order = np.argsort(hashes, kind="stable")
    a, b = order[:-1], order[1:]
    again = (hashes[a] == hashes[b]) & (b - a <= within) & (text[a] == text[b])
    keep = np.ones(len(hashes), bool)
    keep[b[again]] = False
    return np.flatnonzero(keep)


def shingles_of(texts: list[bytes], within: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, text numbers, first words) of the shingles of all texts that are fresh."""
    data, starts, ends, text = word_spans(texts)
    n = max(0, len(text) - SHINGLE + 1)
    at = np.flatnonzero(text[:n] == text[len(text) - n :])
    hashes = SpanHash(data).spans(starts[at], ends[at + SHINGLE - 1])
    kept = fresh(hashes, text[at], within)
    own = text[at[kept]]
    return hashes[kept], own, at[kept] - np.searchsorted(text, own)
