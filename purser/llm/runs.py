"""Periodic runs of words: stretches that repeat a block of words, found from the Lyndon words they are made of.

The words of a text are numbered, and every suffix is put in a group by the first phase of Baier's suffix sorter: groups are
taken from the largest down; the members of one are cut out of the text, and what then stands left of a member is a smaller
suffix, whose group is split and whose context grows by the member's. The context with which a suffix's group is taken is the
longest Lyndon word that starts there, so the phase yields the Lyndon array directly, without any sorting of suffixes. It is done
for the order of the numbers and for the opposite one: every run holds a Lyndon word of one of the two as long as its period (Bannai
et al., 2017), which is extended to both sides by comparing stretches of words (longest common extensions) to the whole run.

Only parts of a text can hold runs: in a run of at least 24 words and three periods, each stretch of nine words
is found twice. Stretches are compared by hashes here, so that parts without such a repetition, most of natural text, are left out
before the grouping; a hash that two stretches share only adds work. Nothing else is left out.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MIN_LENGTH = 24
MIN_PERIODS = 3
#: Each stretch of so many words of a run occurs twice: 2 q + GRAM - 1 <= max(24, 3 q) for every period q.
GRAM = 9
#: Texts are compared in batches of about so many words.
BATCH_WORDS = 1 << 20
RUNS = "array<struct<start: long, length: long, period: long>>"
FOUND = f"doc_id long, n_words long, runs {RUNS}, collapsed string"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def lyndon_array(order: list[int]) -> list[int]:
    """The length of the longest Lyndon word that starts at each place of a sequence of numbers, by grouping."""
    n = len(order)
    places = defaultdict(list)
    for at, x in enumerate(order):
        places[x].append(at)
    # Of each group: its members in order of their places, its context's length, and its neighbours among the groups.
    members = [places[x] for x in sorted(places)]
    size = [1] * len(members)
    smaller, larger = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    group = [0] * n
    for g, mine in enumerate(members):
        for at in mine:
            group[at] = g
    # Places of groups not yet taken are linked; left of a member is the nearest place with a smaller suffix.
    left, right = list(range(-1, n)), list(range(1, n + 1))
    out = [0] * n
    now = len(members) - 1
    while now >= 0:
        width, followed = size[now], {}
        for at in members[now]:
            if group[at] != now:
                continue  # its context has grown since, and it was taken with a larger group
            out[at] = width
            before, after = left[at], right[at]
            left[after] = before
            if before >= 0:
                right[before] = after
                followed[before] = followed.get(before, 0) + 1
        members[now] = []
        moved = defaultdict(list)
        for at, times in followed.items():
            moved[group[at], times].append(at)
        # Right above its old group; of those from one group the more often followed are the larger.
        for old, times in sorted(moved, reverse=True):
            new, next_one = len(size), larger[old]
            members.append(moved[old, times])
            size.append(size[old] + times * width)
            smaller.append(old)
            larger.append(next_one)
            smaller[next_one], larger[old] = new, new
            for at in moved[old, times]:
                group[at] = new
        now = smaller[now]
    return out


def _common(x: list[int], values: np.ndarray, i: int, j: int) -> int:
    """How many numbers from i on (i < j) equal those from j on."""
    n, k = len(x), 0
    while k < 16:
        if j + k >= n or x[i + k] != x[j + k]:
            return k
        k += 1
    step = 32
    while j + k < n:
        here = min(step, n - j - k)
        differ = values[i + k : i + k + here] != values[j + k : j + k + here]
        if differ.any():
            return k + int(differ.argmax())
        k += here
        step *= 2
    return k


def periodic_runs(x: list[int], min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers that are long enough, by start, then period; two periods at least."""
    n, found = len(x), set()
    back = x[::-1]
    values, backward = np.array(x, np.int64), np.array(back, np.int64)
    for order in (x, [-v for v in x]):
        reached: dict[int, int] = {}  # by period: the end of the last stretch with it
        for at, period in enumerate(lyndon_array(order)):
            end = at + period
            if min_periods * period > n or end <= reached.get(period, 0):
                continue
            after = _common(x, values, at, end)
            before = _common(back, backward, n - end, n - at)
            if after or before:
                reached[period] = end + after
                start, length = at - before, period + before + after
                if length >= max(min_length, min_periods * period):
                    found.add((start, length, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _repeated(numbers: np.ndarray, text_of: np.ndarray) -> list[tuple[int, int]]:
    """Maximal stretches (start, end), of at least ``MIN_LENGTH`` words of one text, whose every stretch of ``GRAM`` words is there twice."""
    n = len(numbers) - GRAM + 1
    if n < MIN_LENGTH - GRAM + 1:
        return []
    mixed = (numbers.astype(np.uint64) + np.uint64(1)) * _MIX
    mixed ^= mixed >> np.uint64(29)
    gram = np.zeros(n, np.uint64)
    for k in range(GRAM):
        gram = gram * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + n]
    gram = (gram ^ (text_of[:n].astype(np.uint64) * np.uint64(0x94D049BB133111EB))) * _MIX
    inside = text_of[:n] == text_of[GRAM - 1 :]
    cell = (gram >> np.uint64(64 - max(10, int(8 * n).bit_length()))).astype(np.int64)
    twice = inside & (np.bincount(cell[inside], minlength=int(cell.max()) + 1)[cell] > 1)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], twice, [False]])))
    return [(int(a), int(b) + GRAM - 1) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a > MIN_LENGTH - GRAM]


def runs_of_texts(texts: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as its words."""
    known: dict[str, int] = {}
    numbers = np.array([known.setdefault(w, len(known)) for words in texts for w in words], np.int64)
    sizes = [len(words) for words in texts]
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    text_of = np.repeat(np.arange(len(texts)), sizes)
    for a, b in _repeated(numbers, text_of):
        text = int(text_of[a])
        shift = a - int(first[text])
        out[text] += [(start + shift, length, period) for start, length, period in periodic_runs(numbers[a:b].tolist())]
    return out


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words but for the later periods of each run, joined by blanks."""
    if not runs:
        return " ".join(words)
    drop = np.zeros(len(words), bool)
    for start, length, period in runs:
        drop[start + period : start + length] = True
    return " ".join(w for w, d in zip(words, drop.tolist(), strict=True) if not d)


def find_runs(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rewrite: Callable[[int | None, list[str]], list[str]] | None = None,
) -> DataFrame:
    """Per row: doc_id, n_words, its runs by start, then period, and the text without what runs repeat.

    ``rewrite`` may change the words of a row, given its id, before they are searched. Rows are independent of each other: repeated
    rows, and rows without an id, are each searched. A null or empty text has no words and no runs; a text of any length is
    searched whole by one task. An empty table gives an empty one; other columns are not looked at.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

        def found(names: list, texts: list[list[str]]) -> pa.RecordBatch:
            runs = runs_of_texts(texts)
            cells = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in runs]
            return pa.record_batch(
                [pa.array(names, pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array(cells, kind),
                 pa.array(map(collapsed, texts, runs), pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

        for batch in batches:
            names, texts, size = [], [], 0
            for name, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                words = WORD.findall(text.as_py() or "")
                names.append(name)
                texts.append(rewrite(name, words) if rewrite else words)
                size += len(texts[-1])
                if size >= BATCH_WORDS:
                    yield found(names, texts)
                    names, texts, size = [], [], 0
            if names:
                yield found(names, texts)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(search, FOUND)


def with_repeats(doc_id: int | None, words: list[str]) -> list[str]:
    """For a tenth of the ids, by their crc32: from some place on, the words repeat a number of them. Without an id none do."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * (-(-(n - a) // p)))[: n - a]


def digests(found: DataFrame) -> DataFrame:
    """Per row of ``find_runs``: the number of runs, the one with the most periods, and digests of all of them and of the collapsed text."""
    # Exact fractions are compared by cross products; of equal ones the first in order stays.
    best = F.aggregate(
        "runs", F.get("runs", F.lit(0)),
        lambda held, r: F.when(r["length"] * held["period"] > held["length"] * r["period"], r).otherwise(held))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"),
                       F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
