"""A hierarchical navigable small-world graph over the unit vectors of one shard, in numpy.

Nodes are inserted in batches, those of the highest level first, so a layer's entry points always exist. Searches run for
many queries at once: each step opens the few best unopened nodes of every query's beam.
"""

from __future__ import annotations

import io

import numpy as np

LINKS = 16
BUILD_BEAM = 64
BATCH = 256
OPENED = 4


class Graph:
    """``vectors`` are unit rows; ``layers`` hold neighbour lists (-1 where empty), the widest layer first."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray], order: np.ndarray):
        self.vectors, self.layers, self.order = vectors, layers, order

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 7) -> Graph:
        n = len(vectors)
        pick = np.random.default_rng(seed)
        levels = np.floor(-np.log(1.0 - pick.random(n)) / np.log(LINKS)).astype(int)
        order = np.lexsort((pick.permutation(n), -levels))  # node at each place of the insertion order
        graph = cls(np.ascontiguousarray(vectors[order], np.float32), [], order)
        sizes = [int((levels >= level).sum()) for level in range(levels.max(initial=0) + 1)]
        for size in reversed(sizes):
            graph.layers.insert(0, graph._layer(size))
        return graph

    def _layer(self, size: int) -> np.ndarray:
        x, width = self.vectors[:size], 2 * LINKS
        links = np.full((size, width), -1, np.int32)
        used = np.zeros(size, np.int64)
        done = 0
        while done < size:
            batch = np.arange(done, min(size, done + min(BATCH, max(64, done))))
            # The batch's nodes see each other, and what is in the graph by a search.
            among = x[batch] @ x[batch].T
            np.fill_diagonal(among, -np.inf)
            near = np.argsort(-among, axis=1)[:, :BUILD_BEAM]
            nodes, sims = batch[near], np.take_along_axis(among, near, 1)
            nodes = np.where(np.isfinite(sims), nodes, -1)
            if done:
                entry = self._entries(x[batch])
                entry[entry >= done] = 0
                found, close = beam_search(x, links, x[batch], entry, min(BUILD_BEAM, done))
                nodes, sims = np.hstack([nodes, found]), np.hstack([sims, close])
            chosen = spread_out(x, nodes, sims, LINKS)
            links[batch, :LINKS] = chosen
            used[batch] = (chosen >= 0).sum(1)
            links_from, places = np.nonzero(chosen >= 0)
            add_links(x, links, used, chosen[links_from, places], batch[links_from])
            done = int(batch[-1]) + 1
        return links

    def _entries(self, queries: np.ndarray) -> np.ndarray:
        """The nearest node found in the layers above those still to come."""
        entry = np.zeros(len(queries), np.int64)
        for layer in reversed(self.layers):
            entry = beam_search(self.vectors[: len(layer)], layer, queries, entry, 1)[0][:, 0]
        return entry

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, cosines) of each query's beam, nearest first; -1 where the beam isn't full. Nodes as given to ``build``."""
        queries = np.ascontiguousarray(queries, np.float32)
        entry = np.zeros(len(queries), np.int64)
        for layer in reversed(self.layers[1:]):
            entry = beam_search(self.vectors[: len(layer)], layer, queries, entry, 1)[0][:, 0]
        nodes, sims = beam_search(self.vectors, self.layers[0], queries, entry, min(beam, len(self.vectors)))
        return np.where(nodes >= 0, self.order[nodes], -1), sims

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vectors=self.vectors, order=self.order, **{f"layer{i}": layer for i, layer in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Graph:
        with np.load(io.BytesIO(raw)) as held:
            layers = [held[f"layer{i}"] for i in range(len(held.files) - 2)]
            return cls(held["vectors"], layers, held["order"])


def beam_search(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries over one layer."""
    n_queries, opened = len(queries), min(OPENED, beam)
    every = np.arange(n_queries)
    nodes, sims = np.full((n_queries, beam), -1, np.int64), np.full((n_queries, beam), -np.inf, np.float32)
    closed = np.ones((n_queries, beam), bool)
    seen = np.zeros((n_queries, len(x)), bool)
    nodes[:, 0], closed[:, 0] = entry, False
    sims[:, 0] = np.einsum("qd,qd->q", queries, x[entry])
    seen[every, entry] = True
    active = every
    while True:
        still = np.where(closed[active], -np.inf, sims[active])
        best = np.argpartition(-still, opened - 1, axis=1)[:, :opened]
        usable = np.isfinite(np.take_along_axis(still, best, 1))
        going = usable.any(1)
        if not going.any():
            break
        active, best, usable = active[going], best[going], usable[going]
        row = active[:, None]
        closed[row, best] |= usable
        met = links[np.where(usable, nodes[row, best], 0)]
        met[~usable] = -1
        met = np.sort(met.reshape(len(active), -1), axis=1)
        met[:, 1:][met[:, 1:] == met[:, :-1]] = -1
        fresh = (met >= 0) & ~seen[row, met]
        at, places = np.nonzero(fresh)
        seen[active[at], met[at, places]] = True
        new = np.matmul(x[np.where(fresh, met, 0)], queries[active][:, :, None])[:, :, 0]
        new[~fresh] = -np.inf
        all_nodes = np.hstack([nodes[active], np.where(fresh, met, -1)])
        all_sims = np.hstack([sims[active], new])
        all_closed = np.hstack([closed[active], ~fresh])
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        nodes[active], sims[active] = np.take_along_axis(all_nodes, top, 1), np.take_along_axis(all_sims, top, 1)
        closed[active] = np.take_along_axis(all_closed, top, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1)


def spread_out(x: np.ndarray, nodes: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates at most so many: first those nearer to the row's node than to any taken before, then the nearest."""
    order = np.argsort(-sims, axis=1, kind="stable")
    nodes, sims = np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1)
    real = (nodes >= 0) & np.isfinite(sims)
    own = x[np.where(real, nodes, 0)]
    between = np.matmul(own, own.transpose(0, 2, 1))
    taken, count = np.zeros(nodes.shape, bool), np.zeros(len(nodes), int)
    for c in range(nodes.shape[1]):
        hidden = ((between[:, c, :] > sims[:, c, None]) & taken).any(1)
        good = real[:, c] & ~hidden & (count < most)
        taken[:, c] = good
        count += good
    rank = np.where(taken, 0, np.where(real, 1, 2))
    first = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.where(np.take_along_axis(rank, first, 1) < 2, np.take_along_axis(nodes, first, 1), -1)
    if out.shape[1] < most:
        out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
    return out.astype(np.int32)


def add_links(x: np.ndarray, links: np.ndarray, used: np.ndarray, to: np.ndarray, source: np.ndarray) -> None:
    """Add links back to their sources; full lists are thinned out."""
    fresh = ~(links[to] == source[:, None]).any(1)
    to, source = to[fresh], source[fresh]
    order = np.argsort(to, kind="stable")
    to, source = to[order], source[order]
    targets, first, counts = np.unique(to, return_index=True, return_counts=True)
    rank = np.arange(len(to)) - np.repeat(first, counts)
    width = links.shape[1]
    full = used[targets] + counts > width
    simple = ~np.repeat(full, counts)
    links[to[simple], used[to[simple]] + rank[simple]] = source[simple]
    used[targets[~full]] += counts[~full]
    if full.any():
        crowded = targets[full]
        place = np.repeat(np.arange(full.sum()), counts[full])
        more = np.full((len(crowded), int(counts[full].max())), -1, np.int64)
        more[place, rank[~simple]] = source[~simple]
        nodes = np.hstack([links[crowded], more])
        sims = np.einsum("td,tkd->tk", x[crowded], x[np.where(nodes >= 0, nodes, 0)])
        sims[nodes < 0] = -np.inf
        links[crowded] = spread_out(x, nodes, sims, width)
        used[crowded] = (links[crowded] >= 0).sum(1)
