"""Toxicity of a text from its nearest labelled examples.

Terms are all words, and beginnings of words, of a bounded sample of labelled rows; a beginning ("abcd*") stands for all
inflections of a stem, also unseen ones. Examples and texts are TF-IDF vectors over these terms: one plus the logarithm of the
occurrences, times a power of the inverse document frequency over the whole corpus, times a weight that is the larger the more the term goes
with the label in the sample (chi-square); none weighs nothing.

The examples are held in an inverted index of arrays, in an order that puts like ones side by side and cuts them into blocks. Lists of
terms of few examples are read whole. Those of frequent terms are not: an example can gain from them no more than the product of
both sides' lengths over these terms, nor more than its block's largest weights, so the other examples are never looked at. What can
still be among the k nearest is scored in full, the most promising first, so the k nearest are exact.

The examples vote with their squared cosines. Both classes are sampled alike, so votes are weighted back to the shares
the labels have, pulled toward the share among texts without any term, and calibrated by a logistic curve
fitted to each example's vote without itself, in a Spark job over the examples.
"""

from __future__ import annotations

import hashlib
import io
import math
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from purser.llm.ball_tree import BallTree
from purser.llm.common import held_out, id_and_text, remembering
from purser.llm.shingles import mixed
from purser.session import written

WORD = re.compile(r"[^\W\d_]+")
#: The sample of labelled rows that is fitted on: so many of each class at most, lowest id hashes first, with so many characters
#: in all and in each. This bounds the model.
SAMPLE_PER_CLASS = 4_096
SAMPLE_CHARS = 1 << 24
LONGEST = 1 << 19
#: Lengths of the beginnings of words that are terms.
BEGINNINGS = (4, 5)
MAX_SCORES = 4_000
STRETCH = 1 << 19
#: Texts whose words are looked up at once.
SLICE = 128
#: A term of this chi-square has half the weight that the label can give; none has less than the least.
HALF_CHI_SQUARE = 30.0
LEAST_WEIGHT = 0.1
#: Power of the inverse document frequency; the higher, the less of a vector is frequent terms.
IDF_POWER = 2.5
BLOCK = 32
#: Terms of more than this share of the examples have lists that are not read whole.
FREQUENT = 0.08
NEIGHBOURS = 16
#: A cosine in single precision is right but for less than this.
SINGLE = 1e-5
#: Weight, in labelled rows, of leaving the votes as they are.
PULL = 2.0
#: Weight of the share among texts without any term, in votes of cosine 1.
PRIOR_VOTES = 0.5
THRESHOLD = 0.3
#: Document frequencies are added up in chunks of so many terms, by so many groups of tasks first.
CHUNK = 4_096
GROUPS = 1_024


#: A multiplier of hashes, and its inverse modulo 2^64.
FACTOR = 0x9E3779B97F4A7C15
BACK = pow(FACTOR, -1, 1 << 64)
#: What tells the hash of a beginning from that of a word.
CUT = np.uint64(0xD1B54A32D192ED03)


@lru_cache(maxsize=1)
def characters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: whether words are made of it, and a well-mixed number."""
    letter = np.zeros(sys.maxunicode + 1, bool)
    for found in WORD.finditer("".join(map(chr, range(sys.maxunicode + 1)))):
        letter[found.start() : found.end()] = True
    return letter, mixed(np.arange(sys.maxunicode + 1, dtype=np.uint64))


def _powers(base: int, size: int) -> np.ndarray:
    """1, base, base^2 and so on, modulo 2^64."""
    if size <= STRETCH:
        return _known_powers(base)[:size]
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))


@lru_cache(maxsize=2)
def _known_powers(base: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(STRETCH - 1, base, np.uint64)]))


class Words:
    """The words of some texts: ``text_of`` and ``row`` of each, and ``hashes``, a row for each distinct one.

    A word's hash is the sum of its characters' numbers, each times a power for its place, modulo 2^64, so the hashes of all words
    are differences of running sums. The columns are the word and its beginnings ("abcd*"); the word itself stands for
    a beginning that it hasn't.
    """

    def __init__(self, texts: list[str]):
        lowered = [t.lower() for t in texts]
        joined = "\n".join(lowered)
        raw = joined.encode("ascii") if joined.isascii() else joined.encode("utf-32-le", errors="surrogatepass")
        chars = np.frombuffer(raw, np.uint8 if joined.isascii() else np.uint32)
        letter, number = characters()
        edges = np.flatnonzero(np.diff(letter[chars], prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        self.text_of = np.searchsorted(np.cumsum([len(t) + 1 for t in lowered]), starts, side="right")
        hashes, at = np.empty(len(starts), np.uint64), 0
        while at < len(starts):  # in stretches, which a longer word has to itself
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + STRETCH, side="right")))
            low, high = int(starts[at]), int(ends[to - 1])
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(number[chars[low:high]] * _powers(FACTOR, high - low), out=sums[1:])
            first, last = starts[at:to] - low, ends[at:to] - low
            hashes[at:to] = (sums[last] - sums[first]) * _powers(BACK, high - low)[first]
            at = to
        order = np.argsort(hashes.view(np.int64))
        new = np.ones(len(order), bool)
        new[1:] = hashes[order[1:]] != hashes[order[:-1]]
        self.row = np.empty(len(order), np.int64)
        self.row[order] = np.cumsum(new) - 1
        each = order[new]
        columns = [hashes[each]]
        for n in BEGINNINGS:
            begun = number[chars[np.minimum(starts[each, None] + np.arange(n), max(len(chars) - 1, 0))]] * _powers(FACTOR, n)
            columns.append(np.where(ends[each] - starts[each] > n, begun.sum(1, dtype=np.uint64) ^ CUT, columns[0]))
        self.hashes = np.stack(columns, 1).view(np.int64)


def term_hashes(word: str) -> list[int]:
    """64-bit hashes of a word and its beginnings, as signed numbers."""
    return Words([word]).hashes[0].tolist()


class Terms:
    """The terms of texts, as places in a sorted array of hashes, or as hashes where none is given."""

    def __init__(self, known: np.ndarray | None = None):
        self.known = known

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, term) of each occurrence of a term."""
        words = Words(texts)
        terms, real = words.hashes, np.ones(words.hashes.shape, bool)
        real[:, 1:] = terms[:, 1:] != terms[:, :1]
        if self.known is not None:
            at = np.minimum(np.searchsorted(self.known, terms), max(len(self.known) - 1, 0))
            real &= self.known[at] == terms if len(self.known) else False
            terms = at
        found = np.flatnonzero(real[words.row])
        return words.text_of[found // real.shape[1]], terms[words.row].reshape(-1)[found]

    def _cells(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text times the number of terms plus term, occurrences), in order."""
        text_of, terms = self._each(texts)
        cells = np.sort(text_of * len(self.known) + terms)
        new = np.flatnonzero(np.diff(cells, prepend=-1))
        return cells[new], np.diff(new, append=len(cells))

    def present(self, texts: list[str]) -> np.ndarray:
        """The terms of some texts, one for each text that has it, by place."""
        return self._cells(texts)[0] % max(len(self.known), 1)

    def of(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(terms in order, times) of each text; some texts are worked on at once."""
        for part in slices(texts):
            if self.known is None:
                text_of, terms = self._each(part)
                for own in np.split(terms, np.searchsorted(text_of, np.arange(1, len(part)))):
                    yield np.unique(own, return_counts=True)
                continue
            cells, times = self._cells(part)
            ends = np.searchsorted(cells, np.arange(len(part) + 1) * len(self.known))
            for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
                yield cells[a:b] - i * len(self.known), times[a:b]


def slices(texts: list[str]) -> Iterator[list[str]]:
    """``SLICE`` texts at once, fewer where they are long."""
    part, chars = [], 0
    for text in texts:
        if part and (len(part) == SLICE or chars + len(text) > STRETCH):
            yield part
            part, chars = [], 0
        part.append(text)
        chars += len(text)
    if part:
        yield part


def weighted(times: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vector, given the gain of each term that is there."""
    raw = (1 + np.log(times)) * gain
    norm = math.sqrt(raw @ raw)
    return raw / norm if norm else raw


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th largest; 0 where there are fewer."""
    return float(np.partition(values, len(values) - k)[-k]) if len(values) >= k else 0.0


class BlockMaxIndex:
    """The inverted index of the examples. ``read`` and ``posted`` count the postings read and those there were for the texts asked;
    ``looked`` and ``offered`` the examples that were scored in full, and all."""

    FIELDS = ("ids", "labels", "gain", "first", "places", "times")

    def __init__(self, ids: np.ndarray, labels: np.ndarray, gain: np.ndarray, first: np.ndarray, places: np.ndarray, times: np.ndarray):
        self.ids, self.labels, self.gain, self.first, self.times = ids, labels, gain, first, times
        # In stretches, so that a worker holds one wide copy of the postings at most.
        raw, norm = np.repeat(gain, np.diff(first)), np.zeros(len(ids))
        stretches = [slice(a, a + STRETCH) for a in range(0, len(raw), STRETCH)]
        for x in stretches:
            raw[x] *= 1 + np.log(times[x].astype(np.float64))
            norm += np.bincount(places[x], raw[x] * raw[x], len(ids))
        norm = np.sqrt(norm)
        self.postings = np.empty(len(places), [("place", np.int32), ("value", np.float32)])
        self.postings["place"] = places
        for x in stretches:
            self.postings["value"][x] = raw[x] / norm[places[x]]
        del raw
        self._packed = self.postings.view(np.uint64)  # whole numbers are copied faster than records
        values = self.postings["value"]
        n = len(ids)
        sizes = np.diff(first)
        self.row = np.full(len(gain), -1, np.int64)  # of a frequent term, in the tables below
        frequent = np.flatnonzero(sizes > FREQUENT * n) if n > 2 * BLOCK else np.zeros(0, np.int64)
        self.row[frequent] = np.arange(len(frequent))
        blocks = -(-n // BLOCK)
        self.weight = np.zeros((blocks * BLOCK, len(frequent)), np.float32)
        for i, t in enumerate(frequent.tolist()):
            here = slice(first[t], first[t + 1])
            self.weight[places[here], i] = values[here]
        self.highest = self.weight.reshape(blocks, BLOCK, -1).max(1).astype(np.float64) if len(frequent) else np.zeros((blocks, 0))
        self.length = np.sqrt(np.square(self.weight, dtype=np.float64).sum(1))[:n]
        self.sizes = sizes
        self.read = self.posted = self.looked = self.offered = 0

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, starts: np.ndarray, terms: np.ndarray, times: np.ndarray, gain: np.ndarray) -> BlockMaxIndex:
        """Of examples in order of their ids, with their terms (places in ``gain``) and times from ``starts``."""
        row = np.repeat(np.arange(len(ids)), np.diff(starts))
        values = (1 + np.log(times)) * gain[terms]
        values /= np.sqrt(np.bincount(row, values * values, len(ids)))[row]
        order = np.arange(len(ids))
        if len(ids):
            order = BallTree.build(order, np.ones(len(ids), bool), starts, terms, values, range(len(gain))).ids
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        by_term = np.lexsort((place[row], terms))
        first = np.searchsorted(terms[by_term], np.arange(len(gain) + 1))
        return cls(ids[order], labels[order], gain, first, place[row][by_term].astype(np.int32), times[by_term])

    @property
    def places(self) -> np.ndarray:
        return self.postings["place"]

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        small = {f: getattr(self, f).astype(np.min_scalar_type(int(getattr(self, f).max(initial=0)))) for f in ("first", "places", "times")}
        np.savez_compressed(out, ids=self.ids, labels=self.labels, gain=self.gain, **small)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> BlockMaxIndex:
        with np.load(io.BytesIO(raw)) as held:
            wide = {"first": np.int64, "places": np.int32}
            return cls(*(held[f].astype(wide.get(f, held[f].dtype)) for f in cls.FIELDS))

    def nearest(self, terms: np.ndarray, times: np.ndarray, k: int = NEIGHBOURS, but: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k largest positive cosines, largest first, and the places of their examples; of equal ones the smallest ids. ``but``: an id left out."""
        return next(self.nearest_of([(terms, times)], k, [but]))

    def nearest_of(
        self, texts: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, but: list[int | None] | None = None,
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of some texts; the bounds of all blocks are one product."""
        vectors = [weighted(times, self.gain[terms]) for terms, times in texts]
        often = np.zeros((len(texts), self.weight.shape[1]))
        for i, ((terms, _), vector) in enumerate(zip(texts, vectors, strict=True)):
            row = self.row[terms]
            often[i, row[row >= 0]] = vector[row >= 0]
        bounds = often @ self.highest.T
        for i, (terms, _) in enumerate(texts):
            yield self._nearest(terms, vectors[i], often[i], bounds[i], k, but[i] if but else None)

    def _nearest(
        self, terms: np.ndarray, vector: np.ndarray, often: np.ndarray, in_block: np.ndarray, k: int, but: int | None,
    ) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.ids)
        if not len(vector) or not n:
            return np.zeros(0), np.zeros(0, np.int64)
        rare = self.row[terms] < 0
        few = terms[rare]
        ends, part = np.cumsum(self.sizes[few]), np.zeros(n)
        spans, at = int(ends[-1]) if len(few) else 0, 0
        while at < len(few):  # all lists at once, in stretches; a list is no longer than a share of the examples
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + STRETCH, side="right")))
            sizes = self.sizes[few[at:to]]
            read = np.repeat(self.first[few[at:to]] - (ends[at:to] - sizes), sizes)
            read += np.arange(before, before + len(read))
            read = self._packed[read].view(self.postings.dtype)
            part += np.bincount(read["place"], read["value"] * np.repeat(vector[rare][at:to], sizes), n)
            at = to
        in_block = np.repeat(in_block, BLOCK)[:n]
        # Rounding may lift a cosine over its bound by a few units in the last place.
        bound = part + np.minimum(in_block, math.sqrt(often @ often) * self.length) + 1e-9
        if but is not None:
            bound[self.ids == but] = -1.0
        first = np.argpartition(bound, max(n - 4 * k, 0))[-4 * k :]
        # Single precision is enough to tell who may be among the nearest; these are then scored in double precision.
        single = often.astype(np.float32)
        close = np.where(bound[first] > 0, part[first] + self.weight[first] @ single, -1.0)
        least = max(_kth(close, k) - SINGLE, 1e-9)
        rest = bound >= least
        rest[first] = False
        rest = np.flatnonzero(rest)
        places = np.concatenate([first, rest])
        close = np.concatenate([close, part[rest] + self.weight[rest] @ single])
        near = places[close >= max(_kth(close, k) - SINGLE, 0.0)]
        cosines = part[near] + self.weight[near] @ often
        listed = self.sizes[terms].sum()
        self.looked, self.offered = self.looked + len(places), self.offered + n
        self.posted += int(listed)
        self.read += int(spans + (listed - spans) * len(places) / n)
        good = (cosines > 0) & (bound[near] > 0)
        places, cosines = near[good], cosines[good]
        top = np.lexsort((self.ids[places], -cosines))[:k]
        return cosines[top], places[top]


@dataclass(frozen=True, eq=False)
class ToxicityModel:
    """Hashes of the terms in order, the indexed examples as bytes, and what makes scores of their votes."""

    terms: np.ndarray
    index: bytes
    class_weight: tuple[float, float]
    share_without: float
    curve: tuple[float, float] = (1.0, 0.0)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, ToxicityModel) and np.array_equal(self.terms, other.terms) and self.index == other.index and (
            (self.class_weight, self.share_without, self.curve) == (other.class_weight, other.share_without, other.curve))

    def votes(self, cosines: np.ndarray, labels: np.ndarray) -> float:
        each = cosines * cosines * np.array(self.class_weight)[labels]
        return float((PRIOR_VOTES * self.share_without + each[labels == 1].sum()) / (PRIOR_VOTES + each.sum()))

    def column(self, text: str | Column) -> Column:
        """struct<score, evidence> of a text column; evidence are the nearest examples' ids and cosines, nearest first."""
        shared = SparkSession.active().sparkContext.broadcast(self)

        @F.arrow_udf("score double, evidence array<struct<doc_id: long, label: int, cosine: double>>")
        def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            scorer = Scorer.of(shared.value)
            for batch in batches:
                found = [f for at in range(0, len(batch), SLICE) for f in scorer([t or "" for t in batch.slice(at, SLICE).to_pylist()])]
                ends = np.cumsum([0, *(len(ids) for _, ids, _, _ in found)])
                flat = [np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in (1, 2, 3)]
                near = pa.StructArray.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(flat, (pa.int64(), pa.int32(), pa.float64()), strict=True)], names=["doc_id", "label", "cosine"])
                yield pa.StructArray.from_arrays(
                    [pa.array([f[0] for f in found], pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), near)],
                    names=["score", "evidence"])

        return predict.asNondeterministic()(text)  # evaluated once, not again in a filter below


class Scorer:
    """Scores texts by a model; one for each worker process. The scores of the last texts are remembered."""

    _last = None

    def __init__(self, model: ToxicityModel):
        self.model, self.index, self.terms = model, BlockMaxIndex.from_bytes(model.index), Terms(model.terms)
        self._scores: dict[bytes, tuple] = {}

    @classmethod
    def of(cls, model: ToxicityModel) -> Scorer:
        remembering("toxicity", _forget)
        if cls._last is None or cls._last.model is not model:
            cls._last = None  # let go of the one before first
            cls._last = cls(model)
        return cls._last

    def __call__(self, texts: list[str]) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
        """(score, ids, labels and cosines of the nearest examples) of each text."""
        keys = [hashlib.blake2b(t.encode(errors="surrogatepass"), digest_size=16).digest() for t in texts]
        if len(self._scores) > MAX_SCORES:
            self._scores.clear()
        fresh = {k: t for k, t in zip(keys, texts, strict=True) if k not in self._scores}
        found = self.index.nearest_of(list(self.terms.of(list(fresh.values()))))
        for key, (cosines, places) in zip(fresh, found, strict=True):
            labels = self.index.labels[places]
            score = calibrated(self.model.votes(cosines, labels), self.model.curve)
            self._scores[key] = (score, self.index.ids[places], labels, cosines)
        return [self._scores[k] for k in keys]


def _forget() -> None:
    Scorer._last = None
    characters.cache_clear()
    _known_powers.cache_clear()


def calibrated(votes: float, curve: tuple[float, float]) -> float:
    return 1 / (1 + math.exp(-(curve[0] * _odds(votes) + curve[1])))


def _odds(share: float) -> float:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return math.log(share / (1 - share))


def logistic_curve(points: list[tuple[float, int, float]]) -> tuple[float, float]:
    """Slope and shift of the votes' log odds that suit (votes, label, weight) best, held near (1, 0) as if by ``PULL`` rows.

    So without points, or with few, the votes are their own calibration.
    """
    x = np.array([[_odds(v), 1.0] for v, _, _ in points]).reshape(-1, 2)
    y, w = (np.array([p[i] for p in points], float) for i in (1, 2))
    start = np.array([1.0, 0.0])
    curve = start.copy()
    for _ in range(50):  # Newton steps, shortened so that none overshoots far
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        slope = x.T @ (w * (y - p)) - PULL * (curve - start)
        bend = (x * (w * p * (1 - p))[:, None]).T @ x + PULL * np.eye(2)
        move = np.clip(np.linalg.solve(bend, slope), -1, 1)
        curve += move
        curve[0] = max(curve[0], 0.05)  # more toxic votes never lower the score
        if np.abs(move).max() < 1e-9:
            break
    return float(curve[0]), float(curve[1])


def _example_terms(rows: DataFrame) -> DataFrame:
    """(doc_id, label, terms, times) of each labelled row's whole text; terms are hashes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembering("toxicity", _forget)
        terms_of = Terms()
        for batch in batches:
            found = list(terms_of.of(batch["text"].to_pylist()))
            yield pa.record_batch(
                [batch["doc_id"], batch["label"], pa.array([t for t, _ in found], pa.list_(pa.int64())),
                 pa.array([n for _, n in found], pa.list_(pa.int32()))], names=["doc_id", "label", "terms", "times"])

    return rows.select("doc_id", "label", "text").mapInArrow(count, "doc_id long, label int, terms array<long>, times array<int>")


def document_frequencies(texts: DataFrame, terms: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of rows, and of those whose text has each of the sorted terms: a count for each term and task, added up by chunks."""
    shared = texts.sparkSession.sparkContext.broadcast(terms)
    kind = pa.list_(pa.int64())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembering("toxicity", _forget)
        known, n, part = shared.value, 0, TaskContext.get().partitionId() % GROUPS
        terms_of, seen = Terms(known), np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            for some in slices(batch["text"].to_pylist()):
                seen[:-1] += np.bincount(terms_of.present(some), minlength=len(known))
            n += batch.num_rows
        seen[-1] = n  # the last cell has the number of rows
        chunks = [c for c in range(0, len(seen), CHUNK) if seen[c : c + CHUNK].any()]
        yield pa.record_batch(
            [pa.array([part] * len(chunks), pa.int32()), pa.array(chunks, pa.int64()), pa.array([seen[c : c + CHUNK] for c in chunks], kind)],
            names=["part", "chunk", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        counts = rows["counts"].combine_chunks()
        total = counts.flatten().to_numpy().reshape(len(counts), -1).sum(0)
        return pa.table([rows["part"][:1], rows["chunk"][:1], pa.array([total], kind)], names=["part", "chunk", "counts"])

    schema = "part int, chunk long, counts array<long>"
    sums = texts.select("text").mapInArrow(count, schema).groupBy("part", "chunk").applyInArrow(add, schema)
    sums = sums.groupBy("chunk").applyInArrow(add, schema).toArrow()  # a number for each term of the bounded sample
    seen = np.zeros(len(terms) + 1, np.int64)
    shared.destroy()
    for chunk, counts in zip(sums["chunk"].to_pylist(), sums["counts"], strict=True):
        seen[chunk : chunk + len(counts)] = counts.values.to_numpy()
    return int(seen[-1]), seen[:-1]


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
) -> ToxicityModel:
    """Learn from labelled rows outside the held-out fold; at most ``SAMPLE_PER_CLASS`` of each class are examples.

    A document with several labels counts as toxic if one says so; one with several rows, by its first text. Labels without
    a document or a value teach nothing; nor do drawn rows with more than ``LONGEST`` characters, or after ``SAMPLE_CHARS`` of their
    class. Without any label every text scores 0.
    """
    texts = id_and_text(docs, doc_id, text)
    known = (
        labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    known = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    share = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_known = sum(share.values())
    if not n_known:
        return ToxicityModel(np.zeros(0, np.int64), _index_of([], np.zeros(0)).to_bytes(), (1.0, 1.0), 0.0)
    drawn = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_CLASS) for y in (0, 1)]
    sample = drawn[0].unionByName(drawn[1])
    drawn_texts = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    # Of equal texts one example says as much as many; it is toxic if one of them is.
    rows = drawn_texts.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label"))
    rows = written(rows.where(F.length("text") <= LONGEST), "examples")
    so_far = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    within = rows.select("doc_id", F.sum(F.length("text")).over(so_far).alias("chars"), "label").where(F.col("chars") <= SAMPLE_CHARS)
    rows = rows.join(F.broadcast(within.select("doc_id")), "doc_id")
    found = written(_example_terms(rows), "example-terms")
    size = {0: 0, 1: 0} | {r["label"]: r["n"] for r in found.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    terms, strength = _term_weights(found, size)
    n_docs, seen = document_frequencies(texts, terms)
    gain = strength * np.maximum(np.log((1 + n_docs) / (1 + seen)), 1e-3) ** IDF_POWER
    index = _built_index(found.where(F.size("terms") > 0), terms, gain)
    # A drawn row stands for so many labelled ones.
    each = tuple(share.get(y, 0) / size[y] if size[y] else 0.0 for y in (0, 1))
    without = [found.where((F.size("terms") == 0) & (F.col("label") == y)).count() for y in (0, 1)]
    n_without = sum(n * w for n, w in zip(without, each, strict=True))
    share_without = (without[1] * each[1] + share.get(1, 0) / n_known) / (n_without + 1)
    highest = max(each) or 1.0
    model = ToxicityModel(terms, index, tuple(w / highest for w in each), share_without)
    curve = _calibration(model, found.where(F.size("terms") > 0), without, each)
    return ToxicityModel(terms, index, model.class_weight, share_without, curve)


def _term_weights(found: DataFrame, size: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """All terms of the examples in order, each with a weight that rises with the dependence of its presence and the label."""
    counts = found.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("a"))
    counts = counts.toArrow().sort_by("term")  # a row for each term of the bounded sample
    n, positive = float(size[0] + size[1]), float(size[1])
    have, toxic = (counts[c].to_numpy().astype(np.float64) for c in ("n", "a"))
    # With Yates's correction, or a term of one row would seem to go with the rarer label.
    off = np.maximum(np.abs(toxic * n - have * positive) - n / 2, 0.0)
    spread = have * (n - have) * positive * (n - positive)
    chi = np.divide(off * off * n, spread, out=np.zeros_like(off), where=spread > 0)
    return counts["term"].to_numpy(), np.maximum(chi / (chi + HALF_CHI_SQUARE), LEAST_WEIGHT)


def _index_of(tables: list[pa.Table], gain: np.ndarray, terms: np.ndarray | None = None) -> BlockMaxIndex:
    if not tables:
        return BlockMaxIndex.build(*(np.zeros(0, np.int64) for _ in range(2)), np.zeros(1, np.int64), *(np.zeros(0, np.int64) for _ in range(2)), gain)
    rows = tables[0].sort_by("doc_id").combine_chunks()
    lists, times = (rows[c].combine_chunks() for c in ("terms", "times"))
    starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
    return BlockMaxIndex.build(
        rows["doc_id"].to_numpy(), rows["label"].to_numpy(), starts, np.searchsorted(terms, lists.flatten().to_numpy()),
        times.flatten().to_numpy().astype(np.float64), gain)


def _built_index(found: DataFrame, terms: np.ndarray, gain: np.ndarray) -> bytes:
    """The index of the bounded sample, built by one task and kept in the shared folder."""
    shared = found.sparkSession.sparkContext.broadcast((terms, gain))

    def build(rows: pa.Table) -> pa.Table:
        known, gain = shared.value
        return pa.table([pa.array([_index_of([rows], gain, known).to_bytes()], pa.binary())], names=["index"])

    built = written(found.groupBy(F.lit("all").alias("all")).applyInArrow(build, "index binary"), "toxicity-index").first()
    shared.destroy()
    return bytes(built["index"]) if built else _index_of([], np.zeros(0)).to_bytes()


def _calibration(model: ToxicityModel, found: DataFrame, without: list[int], each: tuple[float, ...]) -> tuple[float, float]:
    """The curve from each example's votes, left to its neighbours, to the share of toxic ones."""
    shared = found.sparkSession.sparkContext.broadcast(model)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer.of(shared.value)
        for batch in batches:
            votes, known = [], scorer.model.terms
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                texts = [(np.searchsorted(known, t.values.to_numpy()), n.values.to_numpy()) for t, n in zip(part["terms"], part["times"], strict=True)]
                for cosines, places in scorer.index.nearest_of(texts, but=part["doc_id"].to_pylist()):
                    votes.append(scorer.model.votes(cosines, scorer.index.labels[places]))
            yield pa.record_batch([batch["doc_id"], batch["label"], pa.array(votes, pa.float64())], names=["doc_id", "label", "votes"])

    # A row of three numbers for each example of the bounded sample.
    spread = found.select("doc_id", "label", "terms", "times").repartition(4 * found.sparkSession.sparkContext.defaultParallelism, "doc_id")
    rows = spread.mapInArrow(vote, "doc_id long, label int, votes double").collect()
    shared.destroy()
    points = [(r["votes"], r["label"], each[r["label"]]) for r in sorted(rows, key=lambda r: r["doc_id"])]
    points += [(model.share_without, y, without[y] * each[y]) for y in (0, 1) if without[y]]
    return logistic_curve(points)


def score(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, fold, score, prediction and evidence. Rows are independent; a null text is empty; a null id stays null."""
    found = docs.select(F.col(doc_id).cast("long").alias("doc_id"), model.column(F.col(text)).alias("found"))
    return found.select(
        "doc_id", held_out().alias("held_out"), F.col("found.score").alias("score"),
        (F.col("found.score") >= THRESHOLD).cast("int").alias("predicted"), F.col("found.evidence").alias("evidence"))
