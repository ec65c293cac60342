"""Near matches of keywords (scanned text), as an Arrow UDF with vectorised windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions import fixed_values as fv


_SLICE = 1 << 16  # characters whose windows are compared at once


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _subsequence_similarity(char_mask: list[np.ndarray], starts: np.ndarray, size: int) -> np.ndarray:
    """Indel similarity (0-100) of a keyword with the windows of its length that begin at ``starts``.

    The longest common subsequence of all windows is found at once, one bit per keyword character, in as
    many 64-bit words as the keyword takes; sums carry from word to word.
    """
    n_words = len(char_mask)
    full = [np.uint64(((1 << size) - 1) >> (64 * w) & 0xFFFFFFFFFFFFFFFF) for w in range(n_words)]
    state = [np.full(starts.size, f, dtype=np.uint64) for f in full]
    for j in range(size):
        carry = np.zeros(starts.size, dtype=np.uint64)
        for w in range(n_words):
            old, hit = state[w], state[w] & char_mask[w][starts + j]
            part = old + hit
            total = part + carry
            state[w] = (total | (old & ~hit)) & full[w]
            carry = ((part < old) | (total < part)).astype(np.uint64)
    missed = sum(np.bitwise_count(x).astype(np.int64) for x in state)
    return 100.0 * (size - missed) / size


def _places(alphabet: np.ndarray, keyword: str) -> list[int]:
    """For each character of the alphabet, one bit per place of the keyword where it stands."""
    masks: dict[int, int] = {}
    for i, ch in enumerate(keyword):
        masks[ord(ch)] = masks.get(ord(ch), 0) | (1 << i)
    return [masks.get(int(c), 0) for c in alphabet]


def _char_mask(bits: list[int], ids: np.ndarray, size: int) -> list[np.ndarray]:
    return [
        np.array([b >> (64 * w) & 0xFFFFFFFFFFFFFFFF for b in bits], dtype=np.uint64)[ids]
        for w in range((size + 63) // 64)
    ]


def _window_similarity(codes: np.ndarray, keyword: str) -> np.ndarray:
    """Similarity of the keyword with every window of one text."""
    size = len(keyword)
    starts = np.arange(0, len(codes) - size + 1, max(1, size // 2))
    if starts.size == 0 or not size:
        return np.empty(0)
    alphabet, ids = np.unique(codes, return_inverse=True)
    return _subsequence_similarity(_char_mask(_places(alphabet, keyword), ids, size), starts, size)


def _near_windows(
    alphabet: np.ndarray, ids: np.ndarray, begins: np.ndarray, lengths: np.ndarray, keyword: str
) -> tuple[np.ndarray, np.ndarray]:
    """(text, similarity) of the windows near to the keyword, in order; windows stay inside their text.

    A window with too few characters of the keyword cannot be near, so most are ruled out by a count.
    """
    size = len(keyword)
    step = max(1, size // 2)
    n_windows = np.maximum(0, (lengths - size) // step + 1) if size else np.zeros_like(lengths)
    owner = np.repeat(np.arange(len(begins)), n_windows)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    starts = begins[owner] + step * place
    bits = _places(alphabet, keyword)
    known = np.concatenate([[0], np.cumsum(np.array([b > 0 for b in bits], dtype=bool)[ids])])
    possible = 100.0 * (known[starts + size] - known[starts]) / max(1, size) >= fv.FUZZY_THRESHOLD
    owner, starts = owner[possible], starts[possible]
    if not starts.size:
        return owner, np.empty(0)
    similarity = _subsequence_similarity(_char_mask(bits, ids, size), starts, size)
    near = similarity >= fv.FUZZY_THRESHOLD
    return owner[near], similarity[near]


def _slice_totals(texts: list[str], keywords: list[str]) -> np.ndarray:
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.cumsum(lengths) - lengths
    alphabet, ids = np.unique(_codes("".join(texts)), return_inverse=True)
    totals = np.zeros(len(texts))
    for keyword in keywords:
        owner, similarity = _near_windows(alphabet, ids, begins, lengths, keyword)
        first = np.ones(len(owner), dtype=bool)
        first[1:] = owner[1:] != owner[:-1]
        totals[owner[first]] += similarity[first] / 100.0 * 0.3
    return totals


def fuzzy_totals(texts: list[str], keywords: list[str]) -> np.ndarray:
    """Near-match score of each text, the first near window of each keyword counting. Texts are compared in slices."""
    totals, at = np.zeros(len(texts)), 0
    while at < len(texts):
        end, room = at + 1, _SLICE - len(texts[at])
        while end < len(texts) and len(texts[end]) <= room:
            room -= len(texts[end])
            end += 1
        totals[at:end] = _slice_totals(texts[at:end], keywords)
        at = end
    return totals


def fuzzy_total(text: str, keywords: list[str]) -> float:
    return float(fuzzy_totals([text], keywords)[0])


def fuzzy_udf(vocabulary: dict[str, list[str]]):
    """Text and the labels that already have an exact hit, to one score per label."""
    labels = list(vocabulary)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, hits in batches:
            plain, found = [text or "" for text in texts], [set(hit) if hit is not None else () for hit in hits]
            out = np.zeros((len(plain), len(labels)))
            for column, name in enumerate(labels):
                rows = [i for i, hit in enumerate(found) if name in hit]
                out[rows, column] = fuzzy_totals([plain[i] for i in rows], vocabulary[name])
            yield pd.Series(list(out))

    return scores
