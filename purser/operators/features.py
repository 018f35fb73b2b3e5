"""Group features, bins, scaling and one-hot columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from purser.functions.scalars import SPEND, key_hash, label_if
from purser.operators.groups import group_aggregates, lookup_join
from purser.operators.profile import MAX_COLUMNS
from purser.operators.quantiles import exact_quantiles

SCALED = (*SPEND, "TotalExpenses")


def _size_and_single(largest: Column) -> dict[str, Column]:
    return {"GroupSize": largest, "Is_Single": label_if(largest == 1, "Single", "Not-Single")}


def group_table(df: DataFrame, key: str = "GroupNumber", member: str = "InGroupNumber") -> DataFrame:
    """GroupSize (largest member number, not a head count) and Is_Single per group."""
    largest = df.groupBy(key).agg(F.max(F.col(member).cast("int")).alias("GroupSize"))
    return largest.withColumns(_size_and_single(F.col("GroupSize")))


def group_features(df: DataFrame, key: str = "GroupNumber", member: str = "InGroupNumber") -> DataFrame:
    """GroupSize and Is_Single on every row; rows without a group have neither."""
    sized = group_aggregates(df, key, {"GroupSize": F.max(F.col(member).cast("int"))})
    return sized.withColumns(_size_and_single(F.col("GroupSize")))


def join_group_features(df: DataFrame, key: str = "GroupNumber") -> DataFrame:
    """The same two columns on the rows that have a group."""
    return lookup_join(df, group_table(df, key), key, how="inner")


@dataclass(frozen=True)
class Bins:
    """Right-closed bins; values beyond the outer edges fall in the outer bins."""

    col: str
    edges: tuple[float, ...]
    labels: tuple[str, ...]

    def expr(self) -> Column:
        x, out = F.col(self.col), F
        for edge, label in zip(self.edges[1:-1], self.labels):
            out = out.when(x <= edge, label)
        return out.when(x.isNotNull(), self.labels[-1])

    def transform(self, df: DataFrame, to: str | None = None) -> DataFrame:
        return df.withColumn(to or self.col, self.expr())


def cut_edges(low: float, high: float, k: int) -> tuple[float, ...]:
    """``k`` bins of equal width; a constant column gets a band around its value."""
    if low == high:
        reach = 0.001 * abs(low) if low else 0.001
        low, high = low - reach, high + reach
    return tuple(low + i * (high - low) / k for i in range(k + 1))


def fit_cut(df: DataFrame, col: str, k: int, labels: Sequence[str]) -> Bins:
    row = df.agg(F.min(col).cast("double").alias("low"), F.max(col).cast("double").alias("high")).first()
    if row["low"] is None:
        raise ValueError(f"{col} has no known value to bin")
    return Bins(col, cut_edges(row["low"], row["high"], k), tuple(labels))


def fit_qcut(df: DataFrame, col: str, k: int, labels: Sequence[str], duplicates: str = "raise") -> Bins:
    """Bins between exact, linearly interpolated quantiles.

    Equal edges are an error, or are merged (with fewer labels) under ``duplicates='drop'``.
    """
    quantiles = exact_quantiles(df, col, [i / k for i in range(k + 1)])
    if not quantiles:
        raise ValueError(f"{col} has no known value to bin")
    edges = quantiles[1]
    if len(set(edges)) < len(edges):
        if duplicates != "drop":
            raise ValueError(f"bin edges of {col} are not unique: {edges}")
        edges = sorted(set(edges))
    if len(edges) < 2:
        raise ValueError(f"{col} has one value only: {edges}")
    return Bins(col, tuple(edges), tuple(labels[: len(edges) - 1]))


@dataclass(frozen=True)
class Scaler:
    stats: tuple[tuple[str, float, float], ...]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(mean)) / F.lit(deviation) for c, mean, deviation in self.stats})


def fit_scale(df: DataFrame, cols: Sequence[str] = SCALED) -> Scaler:
    """Mean and population deviation of every column in one aggregate; a constant column is only centred."""
    aggs = [f(c).alias(f"{n}_{c}") for c in cols for n, f in (("mean", F.avg), ("dev", F.stddev_pop))]
    row = df.agg(*aggs).first()
    return Scaler(tuple((c, row[f"mean_{c}"] or 0.0, row[f"dev_{c}"] or 1.0) for c in cols))


@dataclass(frozen=True)
class OneHot:
    levels: tuple[tuple[str, tuple[str, ...]], ...]

    def columns(self) -> list[str]:
        return [f"{c}_{v}" for c, vs in self.levels for v in vs]

    def transform(self, df: DataFrame) -> DataFrame:
        """Untouched columns, then one boolean per fitted level; a missing or new value is false in all."""
        encoded = {c for c, _ in self.levels}
        flags = [
            F.coalesce(F.col(c) == v, F.lit(False)).alias(f"{c}_{v}") for c, vs in self.levels for v in vs
        ]
        return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in encoded], *flags)

    def flags(self) -> list[Column]:
        """The same booleans in the order of ``columns``, for plans where a level is no column name."""
        return [F.coalesce(F.col(c) == v, F.lit(False)) for c, vs in self.levels for v in vs]


def fit_onehot(df: DataFrame, cols: Sequence[str] | None = None, known: dict[str, Sequence[str]] | None = None) -> OneHot:
    """Sorted levels of each column (every string column when none are given), in one pass.

    ``known`` gives the levels of a binned column, observed or not, in their own order.
    """
    known = known or {}
    if cols is None:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    open_cols = [c for c in cols if c not in known]
    seen: dict[str, list[str]] = {c: [] for c in open_cols}
    if open_cols:
        pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("level")) for c in open_cols])
        # Each level becomes a column, so the driver has to know them all; more than there can be columns are an error.
        levels = df.select(F.inline(pairs)).where(F.col("level").isNotNull()).distinct().limit(MAX_COLUMNS + 1).collect()
        if len(levels) > MAX_COLUMNS:
            raise ValueError(f"the levels of {open_cols} are more than {MAX_COLUMNS}, too many for columns")
        for row in levels:
            seen[row["name"]].append(row["level"])
    return OneHot(tuple((c, tuple(known[c]) if c in known else tuple(sorted(seen[c]))) for c in cols))


def holdout(df: DataFrame, key: str = "PassengerId", fraction: float = 0.15, seed: int = 13) -> DataFrame:
    """Mark each row 'train' or 'val' by a hash of its key: no shuffle, same split every time."""
    cut = round(fraction * 10_000)
    return df.withColumn("split", label_if(key_hash(key, seed, 10_000) < cut, "val", "train"))


def with_fold(df: DataFrame, folds: int, key: str = "PassengerId", seed: int = 13, name: str = "fold") -> DataFrame:
    return df.withColumn(name, key_hash(key, seed, folds))
