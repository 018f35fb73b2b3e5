"""Weighted word shingles, their ProbMinHash sketches and their probability Jaccard similarity.

A document is the multiset of its runs of five words (a shorter text is one run). The probability Jaccard
similarity of two documents with weights x and y is the sum over common shingles i of
``1 / sum_j max(x_j / x_i, y_j / y_i)``; for weights that are all one it is the Jaccard similarity.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

SHINGLE = 5
#: A prime, so that any start and step walk through all registers.
REGISTERS = 163
WORD = re.compile(r"\w+")
#: Words whose hashes a worker remembers, about 25 MB. A frequent word is soon known again after they are forgotten.
MAX_REMEMBERED = 100_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_ROLL = np.uint64(0x100000001B3)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value for each (splitmix64)."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; remembers a bounded number."""

    def __missing__(self, word: str) -> int:
        if len(self) > MAX_REMEMBERED:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


_HASHES = WordHashes()


def forget_words() -> None:
    _HASHES.clear()


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in ascending order, and how often each occurs."""
    hashes = np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))
    size = min(SHINGLE, len(tokens))
    rolled = np.zeros(max(0, len(tokens) - SHINGLE + 1) if len(tokens) >= SHINGLE else min(1, len(tokens)), np.uint64)
    for i in range(size):
        rolled = rolled * _ROLL + hashes[i : i + len(rolled)]
    found, times = np.unique(mixed(rolled), return_counts=True)
    return found, times.astype(np.float64)


def prob_minhash(docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The sketch of each document: for each register, the shingle that arrives there first (0 without shingles).

    Each shingle is a Poisson process with its weight as rate that meets every register once, in an order
    of its own. All shingles of all documents make their k-th arrival together; a shingle stops once its next arrival
    is later than every register's first, so after a few rounds hardly any is left.
    """
    m = REGISTERS
    first = np.full(len(docs) * m, np.inf)
    who = np.zeros(len(docs) * m, np.uint64)
    doc = np.repeat(np.arange(len(docs)), [len(h) for h, _ in docs])
    shingle = np.concatenate([h for h, _ in docs]) if docs else np.zeros(0, np.uint64)
    weight = np.concatenate([w for _, w in docs]) if docs else np.zeros(0)
    place = (mixed(shingle ^ np.uint64(1)) % np.uint64(m)).astype(np.int64)
    step = 1 + (mixed(shingle ^ np.uint64(2)) % np.uint64(m - 1)).astype(np.int64)
    time = np.zeros(len(shingle))
    for k in range(m):
        if not len(shingle):
            break
        uniform = ((mixed(shingle + np.uint64(k) * _ROLL) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
        time = time - np.log(uniform) / (weight * (m - k))
        at = doc * m + place
        np.minimum.at(first, at, time)
        won = first[at] == time
        who[at[won]] = shingle[won]
        last = first.reshape(-1, m).max(1)
        going = time < last[doc]
        doc, shingle, weight, step, time = doc[going], shingle[going], weight[going], step[going], time[going]
        place = (place[going] + step) % m
    return who.reshape(-1, m)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard, exactly: with the union sorted by weight ratio each inner sum is two partial sums."""
    union = np.union1d(a[0], b[0])
    x, y = np.zeros(len(union)), np.zeros(len(union))
    x[np.searchsorted(union, a[0])] = a[1]
    y[np.searchsorted(union, b[0])] = b[1]
    with np.errstate(divide="ignore"):
        ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    ends = np.searchsorted(ratio, ratio, side="right")  # equal ratios count on the left
    left, right = np.cumsum(x)[ends - 1], y.sum() - np.cumsum(y)[ends - 1]
    both = (x > 0) & (y > 0)
    return float((1.0 / (left[both] / x[both] + right[both] / y[both])).sum())
