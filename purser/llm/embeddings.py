"""Near-duplicate embeddings: graphs for shards of vectors, queried by every vector of the same label.

Equal vectors of a label are one node. The nodes of a label are dealt into shards of bounded size, and a hierarchical
small-world graph is built for each. Each pair of shards of a label is a key of its own: the nodes of the one query the graph of the
other (within a shard, all query their own). A query whose beam is full of links, as in a dense group, is compared with all
nodes of the shard instead, in blocks. All beams of a task are widened until audits of sampled queries against brute force find what they must: the graph's own nodes, the same slightly
moved, which have links there for certain, and the querying shard's nodes. No audit counts a node's finding itself or what
it was moved from among the other links. If no beam that is cheaper does, the task compares all pairs. Every hit is verified
in double precision, so no reported link is below the threshold.

Tasks return the number of links of each node and a spanning forest of the links, never the pairs; the forests' components
name the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from purser.llm.common import partitions
from purser.llm.graph import components
from purser.llm.hnsw import Graph
from purser.session import written

THRESHOLD = 0.98
SHARD = 8_192
BEAM = 64
QUERIES = 256
AUDIT = 256
RECALL = 0.99
#: Single precision may put a cosine this much off in the search; candidates are taken so much earlier.
SLACK = 1e-5
#: A product of blocks in double precision is right but for this; what is nearer to the threshold is verified one by one.
SURE = 1e-12
GRAPH = "label int, size int, shard int, ids array<long>, copies array<long>, vectors binary, graph binary"
FOUND = "a long, b long, n long"


def linkable(label: Column, embedding: Column) -> Column:
    """Whether a vector can have links: a label, and finite components that are not all zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(label.isNotNull() & ~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def units(vectors: np.ndarray) -> np.ndarray:
    """Unit rows in double precision; scaled first, so that no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _build(key: tuple, rows: pa.Table) -> pa.Table:
    ids = rows["vec_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    vectors = np.array(rows["embedding"].to_pylist(), np.float64)[order]
    graph = Graph.build(units(vectors))
    cells = (key[0].as_py(), key[1].as_py(), key[2].as_py(), ids[order].tolist(), rows["copies"].to_numpy()[order].tolist(),
             vectors.tobytes(), graph.to_bytes())
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
    return pa.table([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)],
                    names=["label", "size", "shard", "ids", "copies", "vectors", "graph"])


def _hits(graph: Graph, indexed: np.ndarray, queries: np.ndarray, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(queries, indexed) places of verified links, batch by batch. A beam wider than all nodes stands for comparing all pairs."""
    for start in range(0, len(queries), QUERIES):
        waiting = np.arange(start, min(start + QUERIES, len(queries)))
        if beam <= len(indexed):
            nodes, sims = graph.search(queries[waiting], beam)
            # A search that filled its beam with links may have missed some; one that met all nodes has not.
            full = (sims[:, -1] >= THRESHOLD - SLACK) & (beam < len(indexed))
            row, place = np.nonzero((sims >= THRESHOLD - SLACK) & (nodes >= 0) & ~full[:, None])
            yield _verified(indexed, queries, waiting[row], nodes[row, place])
            waiting = waiting[full]
        if len(waiting):
            cosines = queries[waiting] @ indexed.T
            sure, near = cosines >= THRESHOLD + SURE, np.abs(cosines - THRESHOLD) < SURE
            row, place = np.nonzero(sure)
            yield waiting[row], place
            row, place = np.nonzero(near)
            yield _verified(indexed, queries, waiting[row], place)


def _verified(indexed: np.ndarray, queries: np.ndarray, q: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    true = np.einsum("ld,ld->l", queries[q], indexed[i]) >= THRESHOLD
    return q[true], i[true]


def _spaced(n: int) -> np.ndarray:
    return np.unique(np.linspace(0, n - 1, min(AUDIT, n)).astype(int))


def _moved(vectors: np.ndarray, seed: int = 11) -> np.ndarray:
    """Unit vectors half way to the threshold from the given ones, in random directions."""
    aside = np.random.default_rng(seed).standard_normal(vectors.shape)
    aside -= np.einsum("nd,nd->n", aside, vectors)[:, None] * vectors
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    aside = np.divide(aside, length, out=np.zeros_like(aside), where=length > 1e-6)  # one dimension has no other direction
    cosine = (1 + THRESHOLD) / 2
    return units(cosine * vectors + np.sqrt(1 - cosine * cosine) * aside)


def audited_beam(graph: Graph, indexed: np.ndarray, queries: np.ndarray, beam: int = BEAM, least: float = RECALL) -> int:
    """A beam with which each audit finds, of the links that brute force finds, at least the given share; one more than the
    nodes, which stands for comparing all pairs, if none of up to a quarter of the nodes does."""
    places = _spaced(len(indexed))
    own = indexed[places]
    audits = [(own, places), (_moved(own), places)]
    if queries is not indexed:
        audits.append((queries[_spaced(len(queries))], None))
    there = [sample @ indexed.T >= THRESHOLD for sample, _ in audits]
    beam = min(beam, len(indexed))
    while not all(_passes(graph, indexed, *audit, links, beam, least) for audit, links in zip(audits, there, strict=True)):
        if 8 * beam > len(indexed):  # comparing all pairs costs no more from here on
            return len(indexed) + 1
        beam *= 2
    return beam


def _passes(
    graph: Graph, indexed: np.ndarray, sample: np.ndarray, origin: np.ndarray | None, there: np.ndarray, beam: int, least: float,
) -> bool:
    """Whether the share is found, of the sample's origins and of all other links each."""
    found = np.zeros_like(there)
    for q, i in _hits(graph, indexed, sample, beam):
        found[q, i] = True
    found &= there  # rounding may put a cosine on either side
    groups = [np.ones_like(there)]
    if origin is not None:
        first = np.zeros_like(there)
        first[np.arange(len(sample)), origin] = True
        groups = [first, ~first]
    return all((found & g).sum() >= least * (there & g).sum() for g in groups)


class Forest:
    """Components of the nodes of one task, and links that span them."""

    def __init__(self, n: int):
        self.group = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the ends of links, a batch at a time: one link of each end in b that still leads elsewhere, until none does."""
        while True:
            apart = self.group[a] != self.group[b]
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            first = np.unique(b, return_index=True)[1]
            up: dict[int, int] = {}
            for x, y in zip(a[first].tolist(), b[first].tolist(), strict=True):
                low, high = sorted((_root(up, int(self.group[x])), _root(up, int(self.group[y]))))
                if low != high:
                    up[high] = low
                    self.links.append((x, y))
            new = np.arange(len(self.group))
            new[list(up)] = [_root(up, x) for x in up]
            self.group = new[self.group]


def _root(up: dict[int, int], x: int) -> int:
    while x in up:
        up[x] = up.get(up[x], up[x])
        x = up[x]
    return x


def _links(raw: dict) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Links of each node, counting copies, and a spanning forest, of one pair of shards."""
    own = raw["shard"] == raw["q_shard"]
    width = raw["size"]
    indexed = units(np.frombuffer(raw["vectors"], np.float64).reshape(-1, width))
    queries = indexed if own else units(np.frombuffer(raw["q_vectors"], np.float64).reshape(-1, width))
    graph = Graph.from_bytes(raw["graph"])
    ids, copies = np.array(raw["ids"]), np.array(raw["copies"])
    q_ids, q_copies = (ids, copies) if own else (np.array(raw["q_ids"]), np.array(raw["q_copies"]))
    n, n_q = np.zeros(len(ids), np.int64), np.zeros(len(q_ids), np.int64)
    first_q = 0 if own else len(ids)
    names = ids if own else np.concatenate([ids, q_ids])  # of the indexed, then the querying nodes
    forest = Forest(len(names))
    for q, i in _hits(graph, indexed, queries, audited_beam(graph, indexed, queries)):
        if own:
            q, i = q[q != i], i[q != i]
        n_q += np.bincount(q, copies[i], len(q_ids)).astype(np.int64)
        if not own:
            n += np.bincount(i, q_copies[q], len(ids)).astype(np.int64)
        forest.add(first_q + q, i)
    counts = dict(zip(q_ids.tolist(), n_q.tolist(), strict=True))
    if not own:
        counts |= dict(zip(ids.tolist(), n.tolist(), strict=True))
    return {k: v for k, v in counts.items() if v}, [(int(names[x]), int(names[y])) for x, y in forest.links]


def link_embeddings(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", shard: int = SHARD,
) -> DataFrame:
    """Per row: vec_id, n_links (other vectors linked directly), component_id (smallest id reached) and kept.

    Rows without an id, with a null label or with a vector that is null, empty, zero or not finite link with nothing and are
    their own component. Vectors of different lengths don't link. Rows that repeat an id and a vector are one vector. An
    empty table gives an empty one; other columns are not looked at.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("int").alias("label"),
                          F.col(embedding).cast("array<double>").alias("embedding"))
    usable = linkable(F.col("label"), F.col("embedding")) & F.col("vec_id").isNotNull()
    # Equal arrays, whatever the sign of a zero, are one node, named by its smallest id.
    rows = rows.select("vec_id", "label", F.transform("embedding", lambda x: x + F.lit(0.0)).alias("embedding"), usable.alias("usable"))
    named = rows.where("usable").select("vec_id", "label", "embedding").distinct()
    nodes = named.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    nodes = written(nodes.withColumn("size", F.size("embedding")), "nodes")
    shards = nodes.groupBy("label", "size").agg(F.ceil(F.count(F.lit(1)) / shard).alias("shards"))
    dealt = nodes.join(shards, ["label", "size"]).select(
        "label", "size", F.pmod(F.xxhash64("rep"), "shards").cast("int").alias("shard"), F.col("rep").alias("vec_id"), "copies", "embedding")
    graphs = written(dealt.groupBy("label", "size", "shard").applyInArrow(_build, GRAPH), "graphs")

    # Each pair of shards is a key, so no task holds more than pairs; a shard's graph goes to each pair that it is queried in.
    asked = graphs.join(shards, ["label", "size"]).withColumn("q_shard", F.explode(F.expr("sequence(shard, cast(shards as int) - 1)")))
    asking = graphs.where("shard > 0").select(
        "label", "size", F.col("shard").alias("q_shard"), F.explode(F.expr("sequence(0, shard - 1)")).alias("shard"),
        *[F.col(c).alias(f"q_{c}") for c in ("ids", "copies", "vectors")])
    lean = asked.join(asking, ["label", "size", "shard", "q_shard"], "left")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                counts, forest = _links(batch.slice(at, 1).to_pylist()[0])
                a = [*counts, *(x for x, _ in forest)]
                b = [None] * len(counts) + [y for _, y in forest]
                n = [*counts.values(), *[None] * len(forest)]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in (a, b, n)], names=["a", "b", "n"])

    lean = lean.repartition(partitions(vectors.sparkSession), "label", "size", "shard", "q_shard")
    found = written(lean.mapInArrow(search, FOUND), "found")
    links = found.where("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    groups = components(found.where("b is not null").select("a", "b"), "vector-components").withColumnRenamed("node", "rep")
    known = nodes.select("label", "embedding", "rep", "copies").join(links, "rep", "left").join(groups, "rep", "left")
    known = known.select("label", "embedding", "copies", "others", F.coalesce("component", "rep").alias("component"), F.lit(True).alias("usable"))
    out = rows.join(known, ["label", "embedding", "usable"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce(F.col("copies") - 1 + F.coalesce("others", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
