"""Trees with a cap on their leaves, grown best first: boosted, or as a forest.

Columns are cut into bins once. The open leaf whose best split gains most is split next, until there are as many leaves as
allowed. A leaf's gains come from a table of sums for each (leaf, column, bin), which tasks tally from the binned rows; of two
new leaves only the smaller is summed, the other is the difference to their parent. Whether a leaf is split at all depends on
the gains of leaves still to come, so one job sums all leaves that are needed as far as is known, and the order is gone through
again with what it found: a tree takes about as many jobs as it is deep, and is the one that splitting leaf by leaf gives.
The trees of a forest are grown side by side, so these jobs are those of its deepest tree.

The binned rows are held as blocks of bytes (flags share one, as in ``boosting``), with a margin for boosted trees and the draws of each
tree for a forest. Sums are of whole numbers (gradients times 2^24), so a tree does not depend on how the rows are spread. What reaches
the driver is bounded by trees x leaves x columns x bins, never by rows.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from purser.operators.blocks import summed
from purser.operators.boosting import CODES, WRITTEN_EVERY, Layout, layout_of
from purser.session import written

BINS = 64
UNIT = 1 << 24
LEAST_WEIGHT = 1e-3
FLAT = 1e-9


@dataclass(frozen=True)
class Growth:
    """How far one tree grows. ``columns`` of all are looked at for each split (all of them where it is None), picked by ``seed``."""

    leaves: int
    depth: int
    least_rows: int
    least_split: int = 2
    columns: int | None = None
    seed: int = 0


@dataclass
class Leaf:
    """A node of a growing tree: its sums by (column, bin) of gradients, weights and rows, and its best split."""

    name: int
    depth: int
    sums: np.ndarray
    gain: float = 0.0
    column: int = -1
    bin: int = -1
    children: tuple[int, int] | None = None
    total: np.ndarray = field(init=False)

    def __post_init__(self):
        self.total = self.sums[0].sum(0)

    def value(self) -> float:
        return -self.total[0] / max(self.total[1], FLAT)

    def find_split(self, growth: Growth) -> None:
        if self.depth >= growth.depth or self.total[2] < growth.least_split:
            return
        left = self.sums.cumsum(1)
        right = self.total - left
        score = (left[..., 0] ** 2 / np.maximum(left[..., 1], FLAT) + right[..., 0] ** 2 / np.maximum(right[..., 1], FLAT)
                 - self.total[0] ** 2 / max(self.total[1], FLAT))
        bad = (np.minimum(left[..., 2], right[..., 2]) < growth.least_rows) | (np.minimum(left[..., 1], right[..., 1]) < LEAST_WEIGHT * UNIT)
        if growth.columns is not None and growth.columns < len(score):
            picked = np.random.default_rng([growth.seed, self.name]).choice(len(score), growth.columns, replace=False)
            bad[np.setdiff1d(np.arange(len(score)), picked)] = True
        score[bad] = 0
        at = int(np.argmax(score))  # of equal gains the first column, then the first bin
        if score.flat[at] > 1e-6 * UNIT:
            self.gain, (self.column, self.bin) = float(score.flat[at]), map(int, np.unravel_index(at, score.shape))

    def left_rows(self) -> float:
        return self.sums[self.column, : self.bin + 1, 2].sum()


#: Of a block and the number of a tree: the rows that it sees (None: all), and their gradients and weights.
Weigh = Callable[[tuple, int], tuple[np.ndarray | None, np.ndarray, np.ndarray]]


def grow(rows: DataFrame, columns: int, growth: Growth) -> dict:
    """One tree over ``rows`` (bins array, g long, h long), as nested splits {column, bin, left, right} and leaves {value}."""
    layout = layout_of([BINS] * columns)
    blocks = _given(rows, layout).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return grow_all(blocks, layout, [growth], _as_given)[0]
    finally:
        blocks.unpersist()


def grow_all(blocks: RDD, layout: Layout, growths: list[Growth], weigh: Weigh) -> list[dict]:
    """A tree for each growth; what the next splits of all of them need is summed in one job."""
    roots = _tallied(blocks, layout, [(i, {1}, {}) for i in range(len(growths))], weigh)
    nodes = [{1: Leaf(1, 0, root[1])} for root in roots]
    for mine, growth in zip(nodes, growths, strict=True):
        mine[1].find_split(growth)
    trees: dict[int, dict] = {}
    while len(trees) < len(growths):
        plans, needs = [], []
        for i, growth in enumerate(growths):
            if i in trees:
                continue
            split, needed = _best_first(nodes[i], growth.leaves)
            if not needed:
                trees[i] = _nested(nodes[i], 1, split)
                continue
            wanted = {2 * n + (nodes[i][n].left_rows() * 2 > nodes[i][n].total[2]) for n in needed}  # the smaller child
            plans.append((i, wanted, {n: nodes[i][n] for n in {*split, *needed}}))
            needs.append(needed)
        found = _tallied(blocks, layout, plans, weigh) if plans else []
        for (i, wanted, _), needed, sums in zip(plans, needs, found, strict=True):
            for n in needed:
                small = 2 * n if 2 * n in wanted else 2 * n + 1
                for name, mine in ((small, sums[small]), (small ^ 1, nodes[i][n].sums - sums[small])):
                    nodes[i][name] = Leaf(name, nodes[i][n].depth + 1, mine)
                    nodes[i][name].find_split(growths[i])
                nodes[i][n].children = (2 * n, 2 * n + 1)
    return [trees[i] for i in range(len(growths))]


def _best_first(nodes: dict[int, Leaf], leaves: int) -> tuple[set[int], set[int]]:
    """The nodes split in order of their gains, and those among them whose children are not known yet."""
    split: set[int] = set()
    needed: set[int] = set()
    waiting = [(-nodes[1].gain, 1)]
    while waiting and len(split) + 1 < leaves:
        gain, n = heapq.heappop(waiting)
        if gain >= 0:
            break
        split.add(n)
        if nodes[n].children is None:
            needed.add(n)
        else:
            for c in nodes[n].children:
                heapq.heappush(waiting, (-nodes[c].gain, c))
    return split, needed


def _nested(nodes: dict[int, Leaf], n: int, split: set[int]) -> dict:
    if n not in split:
        return {"value": nodes[n].value()}
    return {"column": nodes[n].column, "bin": nodes[n].bin, "left": _nested(nodes, 2 * n, split), "right": _nested(nodes, 2 * n + 1, split)}


def _sums(rows: DataFrame, wanted: set[int], inner: dict[int, Leaf], shape: tuple[int, int, int]) -> dict[int, np.ndarray]:
    """Sums by (column, bin) of the rows (as in ``grow``) in each wanted node of one tree."""
    layout = layout_of([shape[1]] * shape[0])
    return _tallied(_given(rows, layout), layout, [(0, wanted, inner)], _as_given)[0]


def _tallied(blocks: RDD, layout: Layout, plans: list[tuple[int, set[int], dict[int, Leaf]]], weigh: Weigh) -> list[dict[int, np.ndarray]]:
    """For each (tree, wanted nodes, nodes split so far) the sums by (column, bin) of the rows in each wanted node."""
    sent = []
    for tree, wanted, inner in plans:
        place, steps = {1: 0}, []
        for n in sorted(inner):  # parents come before their children
            steps.append((place[n], inner[n].column, inner[n].bin, len(place)))
            place[2 * n], place[2 * n + 1] = len(place), len(place) + 1
        slots = np.full(len(place), -1)
        slots[[place[n] for n in sorted(wanted)]] = np.arange(len(wanted))
        sent.append((tree, steps, slots, len(wanted)))
    found = layout.by_column(summed(blocks, sent, lambda part, held: _tally(part, held, layout, weigh))[0])
    sums = np.zeros((len(found), len(layout.code), BINS, 3))
    sums[:, :, : found.shape[-1]] = np.moveaxis(found, 1, -1)
    rest = iter(sums)
    return [{n: next(rest) for n in sorted(wanted)} for _, wanted, _ in plans]


def _tally(blocks: Iterable[tuple], plans: list[tuple], layout: Layout, weigh: Weigh) -> tuple[np.ndarray]:
    """Sums of gradients, weights and rows by (code, value) for the wanted nodes of every tree."""
    size = layout.codes * CODES
    total = np.zeros((sum(n for *_, n in plans), 3, size), np.int64)
    cell = np.arange(layout.codes) * CODES
    walks = [(tree, [(at, layout.code[c], layout.bin_of(c) > cut, left) for at, c, cut, left in steps], slots, n) for tree, steps, slots, n in plans]
    for block in blocks:
        done = 0
        for tree, steps, slots, n in walks:
            seen, g, h = weigh(block, tree)
            codes = block[0] if seen is None else block[0][seen]
            node = np.zeros(len(codes), np.int32)
            for at, code, right, left in steps:
                here = np.flatnonzero(node == at)
                node[here] = left + right[codes[here, code]]
            slot = slots[node]
            here = np.flatnonzero(slot >= 0)
            where = ((slot[here] * size)[:, None] + cell + codes[here]).ravel()
            for k, values in enumerate((g, h)):  # whole numbers: a block's sums are exact in doubles
                total[done : done + n, k] += np.bincount(where, np.repeat(values[here], layout.codes), n * size).astype(np.int64).reshape(n, size)
            total[done : done + n, 2] += np.bincount(where, minlength=n * size).reshape(n, size)
            done += n
    return (total.reshape(-1, 3, layout.codes, CODES),)


def _blocks(table: DataFrame, layout: Layout, width: int) -> RDD:
    """Blocks of (codes, ``width`` rows of numbers) from a table of (bins, values array of ``width`` numbers)."""

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = batch.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(layout.code))
            codes = np.zeros((batch.num_rows, layout.codes), np.uint8)
            for c in range(len(layout.code)):
                codes[:, layout.code[c]] += (bins[:, c] * layout.unit[c]).astype(np.uint8)
            values = batch.column("values").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width).T
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in (codes, values)], ["codes", "values"])

    def read(r) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(r["codes"], np.uint8).reshape(-1, layout.codes), np.frombuffer(r["values"]).reshape(width, -1)

    return table.select("bins", "values").mapInArrow(coded, "codes binary, values binary").rdd.map(read)


def _given(rows: DataFrame, layout: Layout) -> RDD:
    return _blocks(rows.select("bins", F.array(*[F.coalesce(c, F.lit(0)).cast("double") for c in "gh"]).alias("values")), layout, 2)


def _as_given(block: tuple, tree: int) -> tuple[None, np.ndarray, np.ndarray]:
    return None, block[1][0], block[1][1]


def _log_loss(block: tuple, tree: int) -> tuple[None, np.ndarray, np.ndarray]:
    """Of (codes, label, margin). A row without a label pulls nowhere."""
    _, label, margin = block
    p = 1 / (1 + np.exp(-margin))
    return None, np.where(np.isnan(label), 0, np.rint((p - label) * UNIT)), np.rint(p * (1 - p) * UNIT)


def _drawn(block: tuple, tree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (codes, label, how often each tree draws a row)."""
    _, label, times = block
    seen = np.flatnonzero(times[tree])
    w = times[tree][seen].astype(float) * UNIT
    return seen, np.where(np.isnan(label[seen]), 0, np.rint(-label[seen] * w)), w


def _values(tree: dict, codes: np.ndarray, layout: Layout) -> np.ndarray:
    """The tree's value for each row."""
    out = np.empty(len(codes))
    open_nodes = [(tree, np.arange(len(codes)))]
    while open_nodes:
        node, rows = open_nodes.pop()
        if "value" in node:
            out[rows] = node["value"]
            continue
        right = (layout.bin_of(node["column"]) > node["bin"])[codes[rows, layout.code[node["column"]]]]
        open_nodes += [(node["left"], rows[~right]), (node["right"], rows[right])]
    return out


def tree_value(tree: dict, column) -> Column:
    """A tree's value as an expression; ``column(split)`` tells whether a row goes left."""
    if "value" in tree:
        return F.lit(float(tree["value"]))
    return F.when(column(tree), tree_value(tree["left"], column)).otherwise(tree_value(tree["right"], column))


def bin_edges(df: DataFrame, bins: int = BINS) -> list[list[float]]:
    """At most ``bins`` - 1 edges of each column of ``features``, at even ranks."""
    x = vector_to_array("features")
    width = df.select(F.size(x).alias("n")).first()
    if width is None:
        raise ValueError("no rows to fit on")
    probs = [i / bins for i in range(1, bins)]
    row = df.select(x.alias("x")).agg(*[F.percentile_approx(F.get("x", F.lit(i)), probs, 10_000).alias(f"e{i}") for i in range(width["n"])]).first()
    return [sorted(set(e)) for e in row]


def binned(df: DataFrame, edges: list[list[float]]) -> DataFrame:
    """``df``'s label, and the bin of each column of its array ``x``: the number of edges below the value."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(edges))
            bins = np.stack([np.searchsorted(e, x[:, c]) for c, e in enumerate(edges)], 1).astype(np.int32)
            starts = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(edges))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.ListArray.from_arrays(starts, pa.array(bins.ravel()))], ["label", "bins"])

    return df.select("label", "x").mapInArrow(cut, "label double, bins array<int>")


def with_thresholds(tree: dict, edges: list[list[float]]) -> dict:
    """The tree with values in place of bins."""
    if "value" in tree:
        return tree
    return {"column": tree["column"], "below": edges[tree["column"]][tree["bin"]],
            "left": with_thresholds(tree["left"], edges), "right": with_thresholds(tree["right"], edges)}


class LeafwiseTrees(Estimator):
    """``kind`` is 'boosted' (log loss, each tree on what those before left over) or 'forest' (means of resampled rows)."""

    @keyword_only
    def __init__(self, *, kind: str = "boosted", rounds: int = 30, step: float = 0.15, leaves: int = 35, depth: int = 15, least_rows: int = 20,
                 least_split: int = 2, columns: int | None = None, seed: int = 13, threads: int = 2):
        super().__init__()
        if kind not in ("boosted", "forest"):
            raise ValueError(f"kind is boosted or forest, not {kind}")
        self.kind, self.rounds, self.step, self.threads, self.seed = kind, rounds, step, threads, seed
        self.growth = Growth(leaves, depth, least_rows, least_split, columns, seed)

    def _fit(self, df: DataFrame) -> LeafwiseModel:
        edges = bin_edges(df)
        x = df.select(F.col("label").cast("double").alias("label"), vector_to_array("features").alias("x"))
        rows = written(binned(x, edges), "binned")
        share = rows.agg(F.avg("label")).first()[0]
        layout = layout_of([len(e) + 1 for e in edges])
        trees, base = self._boosted(rows, layout, share) if self.kind == "boosted" else self._forest(rows, layout)
        return LeafwiseModel([with_thresholds(t, edges) for t in trees], base, self.step if self.kind == "boosted" else None)

    def _boosted(self, rows: DataFrame, layout: Layout, share: float) -> tuple[list[dict], float]:
        share = min(max(share, 1e-6), 1 - 1e-6)
        base, step = math.log(share / (1 - share)), self.step
        labels = _blocks(rows.select("bins", F.array("label").alias("values")), layout, 1)
        blocks = labels.map(lambda b: (b[0], b[1][0], np.full(len(b[0]), base))).persist(StorageLevel.MEMORY_AND_DISK)
        trees, held = [], [blocks]
        try:
            for done in range(1, self.rounds + 1):
                tree = grow_all(blocks, layout, [self.growth], _log_loss)[0]
                trees.append(tree)
                while len(held) > 1:  # the blocks made of them are held by now
                    held.pop(0).unpersist()
                blocks = blocks.map(lambda b, tree=tree: (b[0], b[1], b[2] + step * _values(tree, b[0], layout))).persist(StorageLevel.MEMORY_AND_DISK)
                if done % WRITTEN_EVERY == 0 and done < self.rounds and blocks.context.getCheckpointDir():
                    blocks.checkpoint()
                held.append(blocks)
        finally:
            for part in held:
                part.unpersist()
        return trees, base

    def _forest(self, rows: DataFrame, layout: Layout) -> tuple[list[dict], float]:
        # How often a row is drawn is Poisson; the draws are held, so all jobs see the same rows.
        below = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
        draws = F.array(F.col("label"), *[F.rand(self.seed + i) for i in range(self.rounds)])
        table = _blocks(rows.select("bins", draws.alias("values")), layout, 1 + self.rounds)
        blocks = table.map(lambda b: (b[0], b[1][0].copy(), np.searchsorted(below, b[1][1:]).astype(np.uint8))).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return grow_all(blocks, layout, [replace(self.growth, seed=self.seed + i) for i in range(self.rounds)], _drawn), 0.0
        finally:
            blocks.unpersist()


class LeafwiseModel(Model, MLWritable, MLReadable):
    """Without ``step`` the trees' values are averaged to a probability; with it they add up to log odds, from ``base``."""

    def __init__(self, trees: list[dict] | None = None, base: float = 0.0, step: float | None = None):
        super().__init__()
        self.trees, self.base, self.step = trees or [], base, step

    def _transform(self, df: DataFrame) -> DataFrame:
        def left(split: dict) -> Column:
            return F.get("_x", F.lit(split["column"])) <= split["below"]

        # One column for each tree: a sum of all of them would be one expression too long to compile.
        values = [tree_value(t, left).alias(f"_t{i}") for i, t in enumerate(self.trees)]
        out = df.withColumn("_x", vector_to_array("features")).select(*[F.col(f"`{c}`") for c in df.columns], F.array(*values).alias("_v"))
        total = F.aggregate("_v", F.lit(0.0), lambda a, v: a + v)
        p = 1 / (1 + F.exp(-(total * self.step + self.base))) if self.step is not None else total / max(len(self.trees), 1)
        out = out.withColumn("_p", p)
        return out.withColumns({
            "probability": array_to_vector(F.array(1 - F.col("_p"), F.col("_p"))), "prediction": (F.col("_p") > 0.5).cast("double"),
        }).drop("_v", "_p")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: LeafwiseModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        held = {"trees": json.dumps(self.model.trees), "base": self.model.base, "step": self.model.step}
        DefaultParamsWriter.saveMetadata(self.model, path, SparkSession.active(), extraMetadata=held)


class _Reader(MLReader):
    def load(self, path: str) -> LeafwiseModel:
        held = DefaultParamsReader.loadMetadata(path, SparkSession.active())
        model = LeafwiseModel(json.loads(held["trees"]), held["base"], held["step"])
        model._resetUid(held["uid"])
        return model
