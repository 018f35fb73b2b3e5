"""Missing-value repair. What is learned from data is fitted first and then applied.

A ``fit_*`` function reads the table once and returns a small, serialisable
object; its ``transform`` starts no job and works row by row, so that it
applies to another table, or to a stream, unchanged.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from purser.functions.scalars import SPEND, ceil_double
from purser.operators.groups import group_aggregates, lookup_join
from purser.operators.profile import groups_single_valued, mean_by
from purser.session import written

# Planet by deck, and the most frequent deck of a planet.
PLANET_BY_DECK = {
    "A": "Europa", "B": "Europa", "C": "Europa", "T": "Europa",
    "E": "Earth", "F": "Earth", "G": "Earth",
    "D": "Mars",
}
DECK_BY_PLANET = {"Earth": "G", "Europa": "B", "Mars": "F"}
# Destination of a scoring row by planet, and its constants.
DESTINATION_BY_PLANET = {"Earth": "TRAPPIST-1e", "Europa": "TRAPPIST-1e", "Mars": "TRAPPIST-1e"}
SCORING_CONSTANTS = {"HomePlanet": "Europa", "Side": "P", "CryoSleep": False, "VIP": False}


def drop_missing(df: DataFrame, cols: Sequence[str], how: str = "any") -> DataFrame:
    return df.dropna(how=how, subset=list(cols))


def fill_constant(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.na.fill(dict(values))


def fill_by_rules(df: DataFrame, target: str, source: str, rules: Mapping[str, str]) -> DataFrame:
    """Fill a missing target by the value of another column."""
    by_value: dict[str, list[str]] = {}
    for given, value in rules.items():
        by_value.setdefault(value, []).append(given)
    rule = reduce(lambda acc, item: acc.when(F.col(source).isin(item[1]), item[0]), by_value.items(), F)
    return df.withColumn(target, F.coalesce(target, rule))


def propagate_group_value(df: DataFrame, key: str, cols: Sequence[str], order: str | Column) -> DataFrame:
    """Write one value per group to all its rows, over known values too.

    Of a group's distinct values it is the one that first occurs last along
    ``order``, which must be unique in the group. A group without a known value gives null.
    """
    seen = _first_seen(df, key, {c: F.col(c) for c in cols}, order)
    return lookup_join(df.drop(*cols), seen.groupBy(key).agg(*map(_latest, cols)), key).select(*df.columns)


def propagate_with_only(df: DataFrame, key: str, cols: Sequence[str], order: str | Column, value: Column, only: str) -> DataFrame:
    """``propagate_group_value``, and as ``only`` the value of each row's group that knows exactly one: one aggregate and one join for both."""
    seen = _first_seen(df, key, {**{c: F.col(c) for c in cols}, only: value}, order)
    known = F.when(F.col("name") == only, F.col("value"))
    one = F.when(F.min(known) == F.max(known), F.min(known)).alias(only)
    return lookup_join(df.drop(*cols), seen.groupBy(key).agg(*map(_latest, cols), one), key).select(*df.columns, only)


def _first_seen(df: DataFrame, key: str, values: Mapping[str, Column], order: str | Column) -> DataFrame:
    """(key, name, value, first): the distinct known values of each group and where they first occur."""
    pairs = F.array(*[F.struct(F.lit(name).alias("name"), value.alias("value")) for name, value in values.items()])
    order = F.col(order) if isinstance(order, str) else order
    return (
        df.where(F.col(key).isNotNull()).select(key, order.alias("_at"), F.inline(pairs))
        .where(F.col("value").isNotNull())
        .groupBy(key, "name", "value")
        .agg(F.min("_at").alias("first"))
    )


def _latest(c: str) -> Column:
    return F.max_by(F.when(F.col("name") == c, F.col("value")), F.when(F.col("name") == c, F.col("first"))).alias(c)


def lookup_overwrite(df: DataFrame, key: str, col: str, order: str | Column) -> DataFrame:
    """``propagate_group_value`` of one column."""
    return propagate_group_value(df, key, (col,), order)


def fill_if_unique(df: DataFrame, key: str, col: str) -> DataFrame:
    """Fill a missing value where its group knows exactly one."""
    ends = group_aggregates(df, key, {"_low": F.min(col), "_high": F.max(col)})
    only = F.when(F.col("_low") == F.col("_high"), F.col("_low"))
    return ends.withColumn(col, F.coalesce(col, only)).drop("_low", "_high")


def semi_single_valued(df: DataFrame, key: str, col: str) -> DataFrame:
    """Rows of the groups that have exactly one known value of ``col``."""
    groups = groups_single_valued(df, key, col).select(key, F.lit(True).alias("_one"))
    return lookup_join(df, groups, key, how="inner").drop("_one")


@dataclass(frozen=True)
class GroupMeans:
    """Fitted means per key combination: a written table, joined as its size asks for."""

    keys: tuple[str, ...]
    cols: tuple[str, ...]
    table: DataFrame
    ceil_all: bool = False

    def transform(self, df: DataFrame) -> DataFrame:
        """Fill missing values by the mean of the row's key combination."""
        means = {c: f"_mean_{c}" for c in self.cols}
        joined = df.join(self.table.withColumnsRenamed(means), list(self.keys), "left")
        known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in self.keys])

        def filled(c: str) -> Column:
            value = F.coalesce(c, means[c])
            return F.when(known, ceil_double(value)) if self.ceil_all else value

        return joined.withColumns({c: filled(c) for c in self.cols}).select(*df.columns)


def fit_group_means(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str] = SPEND,
    ceil: bool = True,
    zero_is_missing: bool = True,
    ceil_all: bool = False,
) -> GroupMeans:
    """Means per key combination, in one aggregate that is written.

    ``ceil_all`` also rounds up observed values, and clears the rows whose key is missing.
    """
    means = written(mean_by(df, keys, cols, ceil and not ceil_all, zero_is_missing), "group-means")
    return GroupMeans(tuple(keys), tuple(cols), means, ceil_all)


@dataclass(frozen=True)
class GlobalMeans:
    means: tuple[tuple[str, float | None], ...]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(c, F.lit(m).cast("double")) for c, m in self.means})


def fit_global_means(df: DataFrame, cols: Sequence[str] = SPEND) -> GlobalMeans:
    row = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return GlobalMeans(tuple((c, row[c]) for c in cols))


def zero_fill_where(df: DataFrame, cond: Column, cols: Sequence[str] = SPEND) -> DataFrame:
    """Missing values become 0 in the rows where ``cond`` holds."""
    return df.withColumns({c: F.when(cond & F.col(c).isNull(), F.lit(0.0)).otherwise(F.col(c)) for c in cols})
