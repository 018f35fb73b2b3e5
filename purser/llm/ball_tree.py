"""Ranked lexical search: exact inner products with sparse document vectors, pruned by ball trees.

A document's vector has, for each of its terms, the whole number div(10^9 tf, 1000 tf + 8 m), m being 25 + div(75 n N, L) for its n
terms with repeats; an item's vector has floor(1000 ln((2 N + 2) / (2 df + 1))) times the term's occurrences. The score is
their inner product, in whole numbers.

Documents are indexed where they lie: every few thousand of a partition make a ball tree, split again and again toward two
distant documents. For a block of items, a tree is projected onto the terms of the block, which changes no inner product: each
node gets the centroid c of its documents and its radius r there, so that no document below scores over q·c + |q| r. Lengths are
measured with every coordinate stretched by a number s of its term (and q shrunk by it), and |q| takes only terms
that occur below the node; both leave the bound valid and make it tighter. Bounds are rounded up. Nodes are
opened best first until none can reach the tenth score so far, which is carried from tree to tree within a task.
Leaves are scored in whole numbers. Tasks return at most ten documents for each item.
"""

from __future__ import annotations

import heapq
import io
import re
import string
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from purser.session import written

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
TOP = 10
#: A tree closes at so many documents or, with long ones, so many distinct terms of documents.
TREE_DOCS = 8_192
TREE_ENTRIES = 1 << 20
#: So many texts are counted at once.
SLICE = 256
#: A task that counts terms holds so many at most.
MAX_COUNTED = 1 << 18
LEAF = 32
#: A block of items holds about so many (item, term) entries; a longer item is a block of its own.
BLOCK_ENTRIES = 16_384
#: Cells of the node by term matrix of a projected tree; with more terms the tree is used to a smaller depth.
CELLS = 1 << 21
VECTORS = "doc_id long, n long, terms array<string>, tf array<int>"
TREES = "docs int, tree binary"
HITS = "item_id long, doc_id long, score long"


def terms_of(text: str | None) -> list[str]:
    """The terms of a text, with repeats; only A-Z are made lower case."""
    text = text or ""
    return TERM.findall(text.lower() if text.isascii() else text.translate(_LOWER))


def term_vectors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, tf) of every row's whole text; a null text has no terms. For the items, whose terms Spark joins with the counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = [Counter(terms_of(text.as_py())) for text in part["text"]]
                yield pa.record_batch(
                    [part["doc_id"], pa.array([f.total() for f in found], pa.int64()), pa.array([list(f) for f in found], pa.list_(pa.string())),
                     pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "tf"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(count, VECTORS)


def _spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    size = end - start
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


class BallTree:
    """``ids`` and ``known`` of documents in the order of the tree; their entries (place in ``terms``, value) from ``starts``;
    nodes in breadth-first order as ranges (low, high) of documents, with the first of two children (-1 at a leaf). Where values come
    of occurrences ``tf`` and each document's ``m``, only these are written."""

    def __init__(self, ids, known, starts, cols, vals, terms, low, high, child, tf=None, m=None):
        self.ids, self.known, self.starts, self.cols, self.vals = ids, known, starts, cols, vals
        self.terms, self.low, self.high, self.child, self.tf, self.m = terms, low, high, child, tf, m

    @classmethod
    def build(
        cls, ids: np.ndarray, known: np.ndarray, starts: np.ndarray, cols: np.ndarray, vals: np.ndarray, terms: pa.Array,
        tf: np.ndarray | None = None, m: np.ndarray | None = None,
    ) -> BallTree:
        n = len(ids)
        stretched = vals * stretch(cols, n, len(terms))[cols]
        square = _row_sums(stretched * stretched, starts)
        order = np.arange(n)
        low, high, child = [0], [n], [-1]
        dense = np.zeros(len(terms))
        at = 0
        while at < len(low):
            a, b = low[at], high[at]
            if b - a > LEAF:
                rows = order[a:b]
                left = _halves(rows, starts, cols, stretched, square, dense)
                order[a:b] = np.concatenate([rows[left], rows[~left]])
                child[at] = len(low)
                cut = a + int(left.sum())
                low += [a, cut]
                high += [cut, b]
                child += [-1, -1]
            at += 1
        spans = _spans(starts[order], starts[order + 1])
        sizes = np.diff(starts)[order]
        return cls(ids[order], known[order], np.concatenate([[0], np.cumsum(sizes)]), cols[spans], vals[spans], terms,
                   np.array(low), np.array(high), np.array(child), None if tf is None else tf[spans], None if m is None else m[order])

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        names = np.frombuffer("\n".join(self.terms.to_pylist()).encode(errors="surrogatepass"), np.uint8)  # a term holds no control character
        entries = {"vals": self.vals} if self.tf is None else {"tf": self.tf, "m": self.m}
        small = {c: x.astype(np.min_scalar_type(int(x.max(initial=0)))) for c, x in (("cols", self.cols), *entries.items())}
        np.savez(out, ids=self.ids, known=self.known, starts=self.starts, names=names, low=self.low, high=self.high, child=self.child, **small)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> BallTree:
        with np.load(io.BytesIO(raw)) as held:
            names = held["names"].tobytes().decode(errors="surrogatepass")
            tf, m = (held[c].astype(np.int64) if c in held else None for c in ("tf", "m"))
            vals = held["vals"].astype(np.int64) if tf is None else term_values(tf, np.repeat(m, np.diff(held["starts"])))
            return cls(held["ids"], held["known"], held["starts"], held["cols"].astype(np.int32), vals,
                       pa.array(names.split("\n") if names else [], pa.string()), held["low"], held["high"], held["child"], tf, m)


def term_values(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a document's term is worth, by its occurrences and the document's length."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def stretch(cols: np.ndarray, n: int, n_terms: int) -> np.ndarray:
    """A number for each term of a tree, the larger the fewer documents have it: about the root of what the term weighs in items."""
    return np.sqrt(np.log((2 * n + 2) / (2 * np.bincount(cols, minlength=n_terms) + 1)) + 0.1)


def _row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def _halves(rows: np.ndarray, starts: np.ndarray, cols: np.ndarray, vals: np.ndarray, square: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Which rows go left: those nearer to the centroid of what is nearer to one of two distant rows; half of them if that is lopsided."""
    entry = _spans(starts[rows], starts[rows + 1])
    c, v = cols[entry], vals[entry]
    first = np.concatenate([[0], np.cumsum(starts[rows + 1] - starts[rows])])

    def nearness(c_of: np.ndarray, v_of: np.ndarray) -> np.ndarray:
        """Twice the inner product with a vector, less its square."""
        dense[c_of] = v_of
        out = 2 * _row_sums(v * dense[c], first) - v_of @ v_of
        dense[c_of] = 0
        return out

    def of_row(i: int) -> np.ndarray:
        return nearness(c[first[i] : first[i + 1]], v[first[i] : first[i + 1]])

    one = int(np.argmax(square[rows] - of_row(0)))
    to_one = of_row(one)
    two = int(np.argmax(square[rows] - to_one))
    gap = to_one - of_row(two)
    side = gap > 0
    if side.any() and not side.all():
        by_entry, means = np.repeat(side, np.diff(first)), []
        for s, mine in ((side, by_entry), (~side, ~by_entry)):
            sums = np.bincount(c[mine], v[mine], len(dense))
            there = np.flatnonzero(sums)
            means.append(nearness(there, sums[there] / s.sum()))
        gap = means[0] - means[1]
        side = gap > 0
    if 8 * min(side.sum(), (~side).sum()) < len(rows):
        side = np.zeros(len(rows), bool)
        side[np.argsort(-gap, kind="stable")[: len(rows) // 2]] = True
    return side


class Items:
    """A block of items: their ids, and the terms and weights of each as entries from ``starts``."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        self.ids = rows["item_id"].to_pylist()
        flat = [list(t) for t in rows["terms"].to_pylist()]
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in flat])]).astype(np.int64)
        names = pa.array([t for ts in flat for t in ts], pa.string())
        encoded = names.dictionary_encode()
        self.terms, self.term = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.weight = np.array([w for ws in rows["weights"].to_pylist() for w in ws], np.int64)


class Search:
    """The best documents of each item of a block so far; ``opened`` and ``leaves`` count the leaves scored, and all there were."""

    def __init__(self, items: Items, top: int = TOP):
        self.items, self.top = items, top
        self.best: list[list[tuple[int, int, bool]]] = [[] for _ in items.ids]  # (-score, id, unknown), sorted
        self.opened = self.leaves = 0

    def add(self, tree: BallTree) -> None:
        """Take the documents of a tree into account."""
        items = self.items
        place = pc.index_in(tree.terms, value_set=items.terms)  # of each of the tree's terms, among the block's
        place = pc.fill_null(place, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(tree.ids)), np.diff(tree.starts))
        kept = place[tree.cols] >= 0
        doc, cols, vals = doc[kept], place[tree.cols[kept]], tree.vals[kept]
        starts = np.searchsorted(doc, np.arange(len(tree.ids) + 1))
        width = len(items.terms)
        nodes = max(1, min(len(tree.low), CELLS // max(width, 1)))
        inner = (tree.child[:nodes] >= 0) & (tree.child[:nodes] + 1 < nodes)
        scale = np.ones(width)
        scale[place[place >= 0]] = stretch(tree.cols, len(tree.ids), len(tree.terms))[place >= 0]
        bound = self._bounds(tree, nodes, doc, cols, vals, starts, scale)
        whole = np.zeros(width, np.int64)
        self.leaves += int((~inner).sum()) * len(items.ids)
        for i in range(len(items.ids)):
            mine = slice(items.starts[i], items.starts[i + 1])
            whole[items.term[mine]] = items.weight[mine]
            self._best_first(i, tree, bound[i], inner, whole, cols, vals, starts)
            whole[items.term[mine]] = 0

    def _bounds(self, tree, nodes, doc, cols, vals, starts, scale) -> np.ndarray:
        """For each item and node, a number that no document below the node exceeds; minus one where no term is shared."""
        items, width = self.items, len(scale)
        centre = np.zeros((nodes, width))
        radius = np.zeros(nodes)
        stretched = vals * scale[cols]
        square = _row_sums(stretched * stretched, starts)
        for node in range(nodes):
            low, high = tree.low[node], tree.high[node]
            here = slice(starts[low], starts[high])
            c = np.bincount(cols[here], vals[here], width) / max(high - low, 1)
            centre[node] = c
            s = c * scale * scale
            across = _row_sums(vals[here] * s[cols[here]], starts[low : high + 1] - starts[low])
            own = float(c @ s)
            # Rounding in these sums is far below a trillionth of the squares.
            apart = square[low:high] + own - 2 * across + 1e-12 * (square[low:high] + own)
            radius[node] = np.sqrt(max(float(apart.max(initial=0.0)), 0.0)) * (1 + 1e-12)
        query = np.zeros((len(items.ids), width))
        query[np.repeat(np.arange(len(items.ids)), np.diff(items.starts)), items.term] = items.weight
        along = query @ centre.T
        reach = (query / scale) ** 2 @ (centre > 0).T.astype(float)
        return np.where(reach > 0, np.floor((along + np.sqrt(reach) * radius) * (1 + 1e-9)) + 1, -1)

    def _best_first(self, i, tree, bound, inner, whole, cols, vals, starts) -> None:
        best = self.best[i]
        waiting = [(-bound[0], 0)]
        while waiting:
            highest, node = heapq.heappop(waiting)
            least = -best[-1][0] if len(best) == self.top else 1
            if -highest < least:
                break
            if inner[node]:
                for child in (int(tree.child[node]), int(tree.child[node]) + 1):
                    if bound[child] >= least:
                        heapq.heappush(waiting, (-bound[child], child))
                continue
            self.opened += 1
            low, high = tree.low[node], tree.high[node]
            here = slice(starts[low], starts[high])
            scores = _row_sums(whole[cols[here]] * vals[here], starts[low : high + 1] - starts[low])
            for at in np.flatnonzero(scores >= least).tolist():
                best.append((-int(scores[at]), int(tree.ids[low + at]), not tree.known[low + at]))
            best.sort(key=lambda b: (b[0], b[2], b[1]))
            del best[self.top :]

    def hits(self) -> pa.RecordBatch:
        rows = [(item, None if unknown else doc, -score) for item, best in zip(self.items.ids, self.best, strict=True) for score, doc, unknown in best]
        return pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["item_id", "doc_id", "score"])


def term_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, df, n): the documents that hold each term; in the row without a term, those with any term and all their terms.

    A task counts its documents and sends the counts on whenever it holds many terms, so its memory is bounded.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counts(seen: Counter, docs: int, terms: int) -> pa.RecordBatch:
            return pa.record_batch(
                [pa.array([None, *seen], pa.string()), pa.array([docs, *seen.values()], pa.int64()), pa.array([terms, *[0] * len(seen)], pa.int64())],
                names=["term", "df", "n"])

        seen, docs, terms = Counter(), 0, 0
        for batch in batches:
            for text in batch["text"]:
                found = terms_of(text.as_py())
                docs, terms = docs + bool(found), terms + len(found)
                seen.update(set(found))
                if len(seen) > MAX_COUNTED:
                    yield counts(seen, docs, terms)
                    seen, docs, terms = Counter(), 0, 0
        yield counts(seen, docs, terms)

    schema = "term string, df long, n long"
    return docs.select(F.col(text).alias("text")).mapInArrow(count, schema).groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))


def build_trees(docs: DataFrame, n_docs: int, n_terms: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Ball trees over the documents with terms; ``n_docs`` such documents hold ``n_terms`` terms with repeats."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[str, int] = {}
        names: list = []
        cols: list[np.ndarray] = []
        times: list[np.ndarray] = []
        entries = 0

        def row() -> pa.RecordBatch:
            tf = np.concatenate(times)
            sizes = [len(c) for c in cols]
            n = np.array([t.sum() for t in times])
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            vals = term_values(tf, np.repeat(m, sizes))
            tree = BallTree.build(
                np.array([d or 0 for d in names], np.int64), np.array([d is not None for d in names]), np.concatenate([[0], np.cumsum(sizes)]),
                np.concatenate(cols), vals, pa.array(list(place), pa.string()), tf, m)
            return pa.record_batch([pa.array([len(names)], pa.int32()), pa.array([tree.to_bytes()], pa.binary())], names=["docs", "tree"])

        for batch in batches:
            for name, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                found = Counter(terms_of(text.as_py()))
                if not found:
                    continue
                names.append(name)
                cols.append(np.fromiter((place.setdefault(t, len(place)) for t in found), np.int64, len(found)))
                times.append(np.fromiter(found.values(), np.int64, len(found)))
                entries += len(found)
                if len(names) >= TREE_DOCS or entries >= TREE_ENTRIES:
                    yield row()
                    place, names, cols, times, entries = {}, [], [], [], 0
        if names:
            yield row()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(trees, TREES)


def weigh(asked: DataFrame, counts: DataFrame, n_docs: int) -> DataFrame:
    """(item_id, terms, weights) of the items' terms that documents have: the term's weight times its occurrences in the item."""
    entries = asked.select("item_id", F.explode(F.arrays_zip("terms", "tf")).alias("e")).select(
        "item_id", F.col("e.terms").alias("term"), F.col("e.tf").cast("long").alias("times"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))) * F.col("times")
    found = entries.join(counts, "term").select("item_id", "term", weight.cast("long").alias("weight"))
    return found.groupBy("item_id").agg(F.collect_list(F.struct("term", "weight")).alias("e")).select(
        "item_id", F.col("e.term").alias("terms"), F.col("e.weight").alias("weights"))


def search_trees(trees: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, doc_id, score): the best documents of each item, of each task. Items are sent out block by block, each of bounded size."""
    spark = trees.sparkSession
    items = written(items, "weighed-items")
    entries = items.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-entries // BLOCK_ENTRIES)
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(blocks, 1))))

    def one(block: int) -> DataFrame:
        shared = spark.sparkContext.broadcast(numbered.where(F.col("block") == block).drop("block").toArrow())

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Search(Items(shared.value), top)
            for batch in batches:
                for tree in batch["tree"]:
                    found.add(BallTree.from_bytes(tree.as_py()))
            yield found.hits()

        return trees.select("tree").mapInArrow(search, HITS)

    if blocks <= 1:
        return one(0)
    return reduce(DataFrame.unionByName, [written(one(b), "hits") for b in range(blocks)])


def ranked_search(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP,
) -> DataFrame:
    """The ``top`` highest-scoring documents of each item with a score above 0: item_id, rank from 1, doc_id, score.

    Equal scores are ranked by document id, those without an id last. Every row of ``docs`` is a document of its own, also one that
    repeats another. Rows of an item that are equal count once; texts of several rows of an item are taken together, and an
    item without an id is one item. Null and empty texts have no terms; without documents or items nothing is returned. Other
    columns are not looked at.
    """
    counts = written(term_statistics(docs, doc_id, text), "term-counts")
    totals = counts.where("term is null").select("df", "n").first() or (0, 0)
    asked = items.select(F.col(item_id).cast("long").alias("doc_id"), F.col(item_text).alias("text")).distinct()
    asked = term_vectors(asked).select(F.col("doc_id").alias("item_id"), "terms", "tf").withColumns({
        "terms": F.coalesce("terms", F.array()), "tf": F.coalesce("tf", F.array())})
    trees = written(build_trees(docs, totals[0], totals[1] or 1, doc_id, text), "ball-trees")
    hits = search_trees(trees, weigh(asked, counts, totals[0]), top)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


_TERMS_SQL = (f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), "
              r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

#: DuckDB SQL for ``ranked_search`` of ``benchmark`` in ``documents``.
SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS_SQL} AS terms FROM documents),
totals AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM docs WHERE len(terms) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest({_TERMS_SQL}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
weighed AS (
  SELECT item_id, term, times * CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS weight
  FROM asked JOIN df USING (term), totals),
lengths AS (SELECT r, doc_id, 100 - 75 + (75 * len(terms) * n_docs) // n_terms AS m FROM docs, totals WHERE len(terms) > 0),
scores AS (
  SELECT item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM weighed JOIN tf USING (term) JOIN lengths USING (r) GROUP BY ALL),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {TOP}"""
