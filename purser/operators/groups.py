"""Values shared by the rows of a group, in one form for groups of any size.

Per-group values are aggregates, combined before their shuffle, and joined back onto the rows. A group that holds much of
the table is no window task of its own: adaptive execution splits its side of the join, and the aggregate has
one row for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from purser.session import written

SLOT = "_slot"
LARGE = 1 << 16


def lookup_join(df: DataFrame, lookup: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join ``lookup`` (one row per key, as large as it likes) onto the rows of ``df``."""
    if how not in ("left", "inner"):
        raise ValueError(f"lookup_join does left and inner joins, not {how}")
    values = [c for c in lookup.columns if c != key]
    return df.join(lookup, key, how).select(*df.columns, *values)


def group_aggregates(df: DataFrame, key: str, aggs: dict[str, Column]) -> DataFrame:
    """Per-group aggregates on every row: ``{name: F.max('x'), ...}``. Without a key there is no value."""
    known = df.where(F.col(key).isNotNull())
    return lookup_join(df, known.groupBy(key).agg(*[agg.alias(name) for name, agg in aggs.items()]), key)


def number_rows(df: DataFrame, key: str, order: Sequence[str], slot: Column, name: str = "member") -> DataFrame:
    """Row number within each group, along ``order``.

    A group of at most ``LARGE`` rows is ordered by one task, and what is joined by ``key`` next needs no other shuffle. Larger ones, found
    by a count of the keys alone, are cut into consecutive parts by ``slot``, a number that never decreases along ``order``: a row's number is
    its number within its part plus the rows of the parts before, so no task needs such a group. Rows without a key or slot are left out.
    """
    df = df.where(F.col(key).isNotNull())
    slotted = df.withColumn(SLOT, slot)
    large = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LARGE).select(key)
    large = written(large, "large-groups")
    some = not large.isEmpty()
    whole = slotted.join(F.broadcast(large), key, "left_anti") if some else slotted
    whole = whole.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(SLOT, *order)))
    whole = whole.where(F.col(SLOT).isNotNull()).select(*df.columns, name)
    return whole.unionByName(_number_parts(slotted.join(F.broadcast(large), key, "left_semi"), key, order, name)) if some else whole


def _number_parts(slotted: DataFrame, key: str, order: Sequence[str], name: str) -> DataFrame:
    counts = slotted.groupBy(key, SLOT).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, SLOT, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy(key, SLOT).orderBy(*order))
    numbered = slotted.withColumn("_local", local).join(starts, [key, SLOT])
    return numbered.select(*[c for c in slotted.columns if c != SLOT], (F.col("_local") + F.col("_start")).cast("int").alias(name))
