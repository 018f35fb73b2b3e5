"""Operator 1: sketches against the exact similarity, classes against brute force over all pairs."""

import random

import numpy as np
import pytest
from cases import DOC

from purser.llm import graph, minhash
from purser.llm.shingles import mixed, prob_minhash, shingles, similarity, words


def brute_similarity(a, b):
    x, y = dict(zip(*a)), dict(zip(*b))
    every = x.keys() | y.keys()
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in x.keys() & y.keys())


def weighted(pick, n):
    hashes = np.unique(mixed(pick.integers(0, 80, n).astype(np.uint64)))
    return hashes, pick.integers(1, 6, len(hashes)).astype(float)


def test_similarity_and_its_estimate():
    pick = np.random.default_rng(0)
    for _ in range(5):
        a, b = weighted(pick, 50), weighted(pick, 60)
        exact = brute_similarity(a, b)
        assert similarity(a, b) == pytest.approx(exact)
        agree = []
        for salt in range(60):
            docs = [(mixed(h ^ np.uint64(salt * 7919 + 1)), w) for h, w in (a, b)]
            first, second = prob_minhash(docs)
            agree.append((first == second).mean())
        assert np.mean(agree) == pytest.approx(exact, abs=0.03)


def test_sketch_does_not_depend_on_the_batch():
    docs = [shingles(words(t)) for t in ("a b c d e f g", "one", "", "a b c d e f g h", "x " * 400)]
    together = prob_minhash(docs)
    for i, doc in enumerate(docs):
        assert (prob_minhash([doc])[0] == together[i]).all()
    assert (together[2] == 0).all() and len(set(together[1].tolist())) == 1


def brute_classes(rows):
    rows = [r for r in rows if r[0] is not None]
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    cut = [(d, words(t or ""), t, shingles(words(t or ""))) for d, t in rows]
    for i, (a, wa, ta, sa) in enumerate(cut):
        for b, wb, tb, sb in cut[:i]:
            if ta is None or tb is None:
                linked = False
            elif not wa or not wb:
                linked = ta == tb
            else:
                linked = similarity(sa, sb) >= minhash.THRESHOLD
            if linked:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d, _ in rows}


def check(frame, rows):
    got = minhash.near_duplicates(frame).collect()
    wanted = brute_classes(rows)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == wanted
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got if r["doc_id"] is not None)
    assert all(r["kept"] and r["class_id"] is None for r in got if r["doc_id"] is None)


def test_documents(docs, texts):
    check(docs, list(texts.items()))


def test_awkward_and_empty(spark, awkward, nothing):
    from cases import AWKWARD

    check(awkward, [r[:2] for r in AWKWARD])
    assert minhash.near_duplicates(nothing).collect() == []


def test_one_large_group(spark):
    """Copies, near copies of one text with pairs on either side of the threshold, and texts that share a passage."""
    pick = random.Random(4)
    word = lambda: "".join(pick.choice("abcdefghij") for _ in range(6))
    base, passage = [word() for _ in range(60)], " ".join(word() for _ in range(30))
    rows = [(i, " ".join(base)) for i in range(100)]
    for i in range(100, 250):
        text = list(base)
        for _ in range(pick.randint(0, 2)):
            text[pick.randrange(60)] = word()
        rows.append((i, " ".join(text)))
    rows += [(i, passage + " " + " ".join(word() for _ in range(pick.randint(3, 30)))) for i in range(250, 330)]
    pick.shuffle(rows)
    check(spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DOC), rows)


def test_components(spark):
    pick = random.Random(5)
    edges = [(pick.randrange(400), pick.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {x: root(x) for x in list(parent)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_registers_that_collide_in_16_bits_hide_no_pair(spark):
    """Two texts that share a later band only, with an earlier one alike in 16 bits of each register but not in its hash."""
    text = " ".join(f"w{i}" for i in range(60))
    other = text + " end"
    rows = [(1, text, 1), (2, other, 2)]
    sketch = np.arange(minhash.REGISTERS, dtype="<u2").tobytes()
    bands = {1: [100 + i for i in range(minhash.BANDS)], 2: [200 + i for i in range(minhash.BANDS)]}
    bands[2][7] = bands[1][7] = 7
    members = spark.createDataFrame(
        [(7, 7, d, d, 0, 0, 2, bands[d], bytearray(sketch), t) for d, t, _ in rows],
        "bucket long, band int, doc_id long, component long, low int, high int, side int, bands array<long>, sketch binary, text string")
    assert [tuple(r) for r in minhash._forest(members).collect()] == [(1, 2)]
