"""Operator 7: links and components against brute force in double precision, with small shards."""

import time

import numpy as np
import pytest

from purser.llm import embeddings
from purser.llm.hnsw import Graph

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows):
    good = [(i, np.array(v, np.float64), lab) for i, v, lab in rows
            if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    n, parent = {}, {i: i for i, _, _ in good}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x, lx) in enumerate(good):
        for j, y, ly in good[:a]:
            if i != j and lx == ly and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= embeddings.THRESHOLD:
                n[i], n[j] = n.get(i, 0) + 1, n.get(j, 0) + 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: (n.get(i, 0), root(i) if i in parent else i) for i, _, _ in rows}


def clustered(pick, n, dims, spread):
    centres = pick.standard_normal((12, dims))
    out = []
    for i in range(n):
        if i % 3 == 0:
            v = pick.standard_normal(dims)
        else:
            c = centres[0 if i % 3 == 1 else pick.integers(12)]
            v = c + spread * pick.standard_normal(dims)
        out.append((i, [float(np.float32(x)) for x in v], int(pick.integers(2))))
    return out


@pytest.mark.parametrize("shard", [8192, 60])
def test_against_brute_force(spark, shard):
    rows = clustered(np.random.default_rng(1), 420, 16, 0.12)
    rows += [(1000 + i, rows[1][1], rows[1][2]) for i in range(40)]  # copies
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in
           embeddings.link_embeddings(spark.createDataFrame(rows, ROWS), shard=shard).collect()}
    assert got == brute(rows)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, nan], 1), (5, [inf, 1.0], 1), (6, [1.0, None], 1), (7, [1.0, 0.0], None),
            (8, [1.0, 0.0], 1), (9, [2.0, 0.0], 1), (9, [2.0, 0.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [0.0, 1.0], 1), (12, [-0.0, 1.0], 1),
            (13, [1e-30, 0.0], 1), (14, [1e30, 0.0], 2), (None, [1.0, 0.0], 1)]
    frame = spark.createDataFrame(rows, ROWS)
    got = embeddings.link_embeddings(frame).collect()
    assert len(got) == len(rows)
    wanted = brute([r for i, r in enumerate(rows) if i != 9])
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got if r["vec_id"] is not None} == {k: v for k, v in wanted.items() if k is not None}
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)
    assert embeddings.link_embeddings(frame.limit(0)).collect() == []


def test_table(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in frame.collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.link_embeddings(frame).collect()}
    assert got == brute(rows)


def test_graph_recall_and_bytes():
    pick = np.random.default_rng(3)
    vectors = embeddings.units(pick.standard_normal((1500, 24)))
    graph = Graph.from_bytes(Graph.build(vectors).to_bytes())
    near = np.argsort(-(vectors @ vectors.T), axis=1)[:, :10]
    found, sims = graph.search(vectors, 64)
    recall = np.mean([len(set(f[:10]) & set(n)) / 10 for f, n in zip(found, near, strict=True)])
    assert recall > 0.9 and (np.diff(sims, axis=1) <= 0).all()


def test_beam_widens_until_the_audit_passes():
    """A graph without links between its nodes finds nothing until the beam takes in all of them."""
    pick = np.random.default_rng(4)
    vectors = embeddings.units(np.repeat(pick.standard_normal((1, 8)), 300, 0) + 0.001 * pick.standard_normal((300, 8)))
    assert embeddings.audited_beam(Graph.build(vectors), vectors, vectors) < 300
    broken = Graph(vectors.astype(np.float32), [np.full((300, 4), -1, np.int32)], np.arange(300))
    assert embeddings.audited_beam(broken, vectors, vectors) >= 300


def with_unreachable(pick, near=6):
    """256 far nodes, and links of the first few that no list of the graph leads to."""
    far = embeddings.units(pick.standard_normal((256, 32)))
    graph = Graph.build(far)
    vectors = np.vstack([far, embeddings.units(far[:near] + 0.01 * pick.standard_normal((near, 32)))])
    bottom = np.vstack([graph.layers[0], np.full((near, graph.layers[0].shape[1]), -1, np.int32)])
    order = np.concatenate([graph.order, np.arange(256, 256 + near)])
    return vectors, Graph(vectors[order].astype(np.float32), [bottom, *graph.layers[1:]], order)


def test_the_audit_does_not_count_what_finds_itself():
    """One link among 257 nodes, found by neither end, while every query finds its nearest node."""
    vectors, _ = with_unreachable(np.random.default_rng(5), 1)
    assert (np.triu(vectors @ vectors.T, 1) >= embeddings.THRESHOLD).sum() == 1

    class Nearest:
        def search(self, queries, beam):
            sims = queries @ vectors.T
            nodes = np.where(np.arange(beam) == 0, sims.argmax(1)[:, None], -1)
            return nodes, np.where(nodes >= 0, sims.max(1)[:, None], -np.inf)

    assert embeddings.audited_beam(Nearest(), vectors, vectors) > len(vectors)


def test_a_graph_is_audited_where_the_queries_have_no_links():
    pick = np.random.default_rng(6)
    vectors, graph = with_unreachable(pick)
    others = embeddings.units(pick.standard_normal((256, 32)))
    assert (others @ vectors.T).max() < embeddings.THRESHOLD
    assert embeddings.audited_beam(graph, vectors, others) > len(vectors)
    good = Graph.build(vectors)
    assert embeddings.audited_beam(good, vectors, others) < len(vectors)


@pytest.mark.parametrize("own", [True, False])
def test_links_of_unreachable_nodes_are_counted(own):
    pick = np.random.default_rng(7)
    vectors, graph = with_unreachable(pick)
    queries = vectors if own else embeddings.units(vectors + 0.005 * pick.standard_normal(vectors.shape))
    first = 0 if own else 1000
    raw = {"shard": 0, "q_shard": int(not own), "size": 32, "vectors": vectors.tobytes(), "graph": graph.to_bytes(),
           "q_vectors": queries.tobytes(), "ids": list(range(len(vectors))), "copies": [1] * len(vectors),
           "q_ids": list(range(first, first + len(queries))), "q_copies": [1] * len(queries)}
    links = queries @ vectors.T >= embeddings.THRESHOLD
    if own:
        np.fill_diagonal(links, False)
    wanted = {first + i: int(n) for i, n in enumerate(links.sum(1)) if n}
    if not own:
        wanted |= {i: int(n) for i, n in enumerate(links.sum(0)) if n}
    counts, forest = embeddings._links(raw)
    assert counts == wanted and forest


def near_copies(pick, groups, n, dims=32):
    """Groups of n vectors each that all link to each other, and as many far ones."""
    vectors = [embeddings.units(c + 0.01 * pick.standard_normal((n, dims))) for c in pick.standard_normal((groups, dims))]
    return np.vstack([*vectors, embeddings.units(pick.standard_normal((n, dims)))])


def pair_of_shards(vectors, others=None):
    held = {"label": 1, "size": vectors.shape[1], "shard": 0, "q_shard": 0, "ids": list(range(len(vectors))), "copies": [1] * len(vectors),
            "vectors": vectors.tobytes(), "graph": Graph.build(vectors).to_bytes(), "q_ids": None, "q_copies": None, "q_vectors": None}
    if others is not None:
        held |= {"q_shard": 1, "q_ids": list(range(100_000, 100_000 + len(others))), "q_copies": [1] * len(others), "q_vectors": others.tobytes()}
    return held


def test_a_dense_shard_takes_no_long_search():
    """4,096 near copies, 16 million links, in one shard."""
    vectors = near_copies(np.random.default_rng(11), 1, 4_096)
    start = time.process_time()
    counts, forest = embeddings._links(pair_of_shards(vectors))
    assert time.process_time() - start < 60
    links = vectors @ vectors.T >= embeddings.THRESHOLD
    assert counts == {i: int(k) - 1 for i, k in enumerate(links.sum(1)) if k > 1}
    assert len(forest) == 4_095 + (len(counts) - 4_096) // 2


def test_two_dense_shards():
    pick = np.random.default_rng(12)
    both = near_copies(pick, 3, 400)
    both = both[pick.permutation(len(both))]
    first, second = both[:800], both[800:]
    counts, forest = embeddings._links(pair_of_shards(first, second))
    links = first @ second.T >= embeddings.THRESHOLD
    assert counts == {i: int(k) for i, k in enumerate(links.sum(1)) if k} | {100_000 + i: int(k) for i, k in enumerate(links.sum(0)) if k}
    linked = sum(1 for k in links.any(1) if k) + sum(1 for k in links.any(0) if k)
    assert len(forest) == linked - 3  # a spanning tree for each group


def test_forest_spans_components():
    pick = np.random.default_rng(13)
    for n, m in ((50, 30), (300, 280), (300, 2000)):
        forest, a, b = embeddings.Forest(n), pick.integers(0, n, m), pick.integers(0, n, m)
        for at in range(0, m, 100):
            forest.add(a[at : at + 100], b[at : at + 100])
        group = np.arange(n)
        for _ in range(n):
            low = np.minimum(group[a], group[b])
            np.minimum.at(group, a, low)
            np.minimum.at(group, b, low)
        assert (forest.group == group).all() and len(forest.links) == n - len(set(group.tolist()))
