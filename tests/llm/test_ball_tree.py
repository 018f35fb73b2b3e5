"""Operator 12: bounds and pruning against all inner products; the query against plain Python (and SQL, in test_oracle)."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import AWKWARD

from purser.llm import ball_tree
from purser.llm.common import table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute(docs, items, top=10):
    cut = [(d, Counter(TERM.findall((t or "").translate(UPPER)))) for d, t in docs]
    cut = [(d, c, c.total()) for d, c in cut if c]
    n_docs, n_terms = len(cut), sum(n for _, _, n in cut)
    df = Counter(t for _, c, _ in cut for t in c)
    asked = defaultdict(Counter)
    for item, text in set(items):
        asked[item].update(TERM.findall((text or "").translate(UPPER)))
    out = []
    for item, terms in asked.items():
        scores = []
        for d, c, n in cut:
            m = 100 - 75 + 75 * n * n_docs // n_terms
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                    for t, k in terms.items() if t in c)
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def random_tree(pick, n, groups=6):
    """Documents of some languages that share few terms, with copies."""
    names = [f"t{i}" for i in range(60 * groups)]
    docs = []
    for i in range(n):
        if docs and pick.random() < 0.2:
            docs.append(docs[int(pick.integers(len(docs)))])
            continue
        g = int(pick.integers(groups))
        terms = np.unique(np.concatenate([pick.integers(60 * g, 60 * (g + 1), 12), pick.integers(0, 5, 1)]))
        docs.append((terms, pick.integers(1, 1_000_000, len(terms))))
    starts = np.concatenate([[0], np.cumsum([len(t) for t, _ in docs])]).astype(np.int64)
    cols, vals = np.concatenate([t for t, _ in docs]), np.concatenate([v for _, v in docs])
    tree = ball_tree.BallTree.build(np.arange(n) * 3, np.ones(n, bool), starts, cols, vals, pa.array(names))
    return docs, names, tree


def random_items(pick, names, n, groups=6):
    items = []
    for i in range(n):
        g = int(pick.integers(groups))
        terms = sorted(set((pick.integers(60 * g, 60 * (g + 1), 8)).tolist()))
        items.append((i, [names[t] for t in terms], pick.integers(1, 20_000, len(terms)).tolist()))
    return pa.table({"item_id": [i[0] for i in items], "terms": [i[1] for i in items], "weights": [i[2] for i in items]}), items


@pytest.mark.parametrize("n", [1, 31, 700, 3000])
@pytest.mark.parametrize("cells", [1 << 23, 3_000])
def test_search_is_exact_and_prunes(monkeypatch, n, cells):
    monkeypatch.setattr(ball_tree, "CELLS", cells)
    pick = np.random.default_rng(n)
    docs, names, tree = random_tree(pick, n)
    raw, items = random_items(pick, names, 40)
    again = ball_tree.BallTree.from_bytes(tree.to_bytes())
    search = ball_tree.Search(ball_tree.Items(raw))
    search.add(again)
    for (_, terms, weights), best in zip(items, search.best, strict=True):
        q = dict(zip((names.index(t) for t in terms), weights, strict=True))
        every = sorted((-sum(q.get(int(t), 0) * int(v) for t, v in zip(*d, strict=True)), 3 * i) for i, d in enumerate(docs))
        assert [(s, d) for s, d, _ in best] == [e for e in every if e[0] < 0][:10]
    if n == 3000 and cells > 3_000:
        assert search.opened < search.leaves / 3  # the other languages' subtrees


def test_bounds_hold_below_every_node():
    pick = np.random.default_rng(5)
    docs, names, tree = random_tree(pick, 900)
    raw, items = random_items(pick, names, 20)
    held = ball_tree.Items(raw)
    seen = []

    class Looking(ball_tree.Search):
        def _best_first(self, i, tree, bound, inner, whole, cols, vals, starts):
            scores = ball_tree._row_sums(whole[cols] * vals, starts)
            for node, b in enumerate(bound):
                highest = scores[tree.low[node] : tree.high[node]].max()
                assert highest <= b or highest == 0
                seen.append(b)

    Looking(held).add(tree)
    assert len(seen) == 20 * len(tree.low)


def test_results_are_carried_from_tree_to_tree():
    pick = np.random.default_rng(9)
    first, second = random_tree(pick, 500), random_tree(pick, 500)
    raw, _ = random_items(pick, first[1], 30)
    both, apart = ball_tree.Search(ball_tree.Items(raw)), [ball_tree.Search(ball_tree.Items(raw)) for _ in range(2)]
    for t, alone in zip((first[2], second[2]), apart, strict=True):
        both.add(t)
        alone.add(t)
    assert both.opened < sum(a.opened for a in apart)
    for b, x, y in zip(both.best, apart[0].best, apart[1].best, strict=True):
        assert [s for s, _, _ in b] == sorted([s for s, _, _ in x + y])[:10]


def test_search_of_the_corpus(spark, docs, texts, sf_dir, monkeypatch):
    """With small trees and several blocks of items."""
    monkeypatch.setattr(ball_tree, "BLOCK_ENTRIES", 300)
    monkeypatch.setattr(ball_tree, "TREE_DOCS", 50)
    monkeypatch.setattr(ball_tree, "MAX_COUNTED", 400)
    bench = table(spark, sf_dir, "benchmark")
    assert rows_of(ball_tree.ranked_search(docs, bench)) == brute(texts.items(), [tuple(r) for r in bench.select("item_id", "text").collect()])


def test_awkward_rows(spark, awkward, nothing):
    items = [(1, "Same text as nine"), (1, "a id"), (2, None), (3, ""), (4, "word WORD É"), (5, "Same text as nine"), (5, "Same text as nine"), (None, "no id")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(ball_tree.ranked_search(awkward, asked)) == brute([r[:2] for r in AWKWARD], items)
    assert ball_tree.ranked_search(nothing, asked).collect() == []
    assert ball_tree.ranked_search(awkward, asked.limit(0)).collect() == []
    assert ball_tree.ranked_search(awkward.where("doc_id = 2"), asked).collect() == []
