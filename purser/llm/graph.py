"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from purser.session import written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node of ``edges`` (a long, b long); a component is named by its smallest node.

    Each partition first shrinks its edges to a spanning forest of stars. Then large-star and small-star steps alternate
    (Kiveris et al., 2014): each node's larger neighbours are moved to its smallest one, then its smaller ones, until the
    edges are stars around the smallest nodes. Every round is written to the shared folder, which keeps plans
    short. Null ends and loops say nothing; an empty list has no components.
    """
    now = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select("a", "b")
    now = written(now.mapInArrow(_stars, "u long, v long").distinct(), name)
    while not _are_stars(now):
        now = written(_small_star(_large_star(now)), name)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of one partition's edges, as edges from each node to the smallest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    found = [(x, root(x)) for x in list(parent)]
    found = [f for f in found if f[0] != f[1]]
    yield pa.record_batch([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["u", "v"])


def _are_stars(edges: DataFrame) -> bool:
    """Every larger end has one edge and is nobody's smaller end."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct()
