"""Exact quantiles by repeated narrowing.

``percentile`` keeps every distinct value of a group in one buffer, which a
continuous column fills without bound. Here each pass is one aggregate
whose result has a fixed size: it counts the rows of each of ``BINS`` slices of every
interval still open, and the slice that holds the wanted rank is the next interval.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window, functions as F

from purser.session import small_table, written

BINS = 1_024


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float]) -> tuple[int, list[float]] | None:
    """(rows, quantile values) with linear interpolation between neighbours; nothing when no value is known."""
    data = df.select(F.col(col).cast("double").alias("_x")).where("_x is not null").groupBy("_x").agg(F.count(F.lit(1)).alias("_n"))
    # Every pass reads the counts of the column, not the plan behind it.
    data = written(data, "column-counts").select(F.lit("all").alias("_g"), "_x", "_n")
    s = data.agg(F.sum("_n").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi")).first()
    if not s["n"]:
        return None
    found: dict[tuple[object, int], float] = {}
    open_ranks: dict[tuple[object, float, float, int], set[int]] = {}
    ranks = {r for p in probs for r in (floor((s["n"] - 1) * p), ceil((s["n"] - 1) * p))}
    _settle(found, open_ranks, "all", s["lo"], s["hi"], 0, s["n"], ranks)
    while open_ranks:
        open_ranks = _narrow(data, open_ranks, found)
    values = []
    for p in probs:
        h = (s["n"] - 1) * p
        low, high = found["all", floor(h)], found["all", ceil(h)]
        values.append(low + (high - low) * (h - floor(h)))
    return s["n"], values


def group_quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The counts of distinct values (by, col, n), and the quantiles of each group (by, n, quantiles), linearly interpolated.

    Open intervals and ranks are tables like the data, so neither the groups nor their sizes are bounded: a pass counts
    the slices of every open interval and keeps those that hold a wanted rank. Nulls are left out.
    """
    by = list(by)
    for c in (*by, col):
        df = df.where(F.col(c).isNotNull())
    values = written(df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("n")), "distinct-values")
    sizes = values.groupBy(*by).agg(F.sum("n").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi"))
    place = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    ranks = F.array_distinct(F.array(*[f(h).cast("bigint") for h in place for f in (F.floor, F.ceil)]))
    spans = written(sizes.withColumn("below", F.lit(0).cast("bigint")).withColumn("r", F.explode(ranks)), "open-ranks")
    at_low = (F.col("r") == F.col("below")) | (F.col("lo") == F.col("hi"))
    at_high = F.col("r") == F.col("below") + F.col("n") - 1
    settled = spans.where(at_low | at_high).select(*by, "r", F.when(at_low, F.col("lo")).otherwise(F.col("hi")).alias("v"))
    still = spans.where(~(at_low | at_high))
    interval = [*by, "lo", "hi", "below"]
    while not still.isEmpty():
        share = (F.col(col) / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        inside = values.withColumnRenamed("n", "_n").join(still.select(*interval).distinct(), by).where(F.col(col).between(F.col("lo"), F.col("hi")))
        slices = inside.groupBy(*interval, F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("b")).agg(
            F.sum("_n").alias("_n"), F.min(col).alias("_lo"), F.max(col).alias("_hi"))
        earlier = Window.partitionBy(*interval).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        slices = slices.withColumn("_below", F.col("below") + F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        holds = (F.col("r") >= F.col("_below")) & (F.col("r") < F.col("_below") + F.col("_n"))
        narrowed = still.select(*interval, "r").join(slices, interval).where(holds).select(
            *by, F.col("_n").alias("n"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_below").alias("below"), "r")
        narrowed = written(narrowed, "open-ranks")
        settled = settled.unionByName(
            narrowed.where(at_low | at_high).select(*by, "r", F.when(at_low, F.col("lo")).otherwise(F.col("hi")).alias("v")))
        still = narrowed.where(~(at_low | at_high))
    found = settled.groupBy(*by).agg(F.map_from_entries(F.collect_set(F.struct("r", "v"))).alias("_found"))

    def value(h: Column) -> Column:
        low, high = (F.element_at("_found", f(h).cast("bigint")) for f in (F.floor, F.ceil))
        return low + (high - low) * (h - F.floor(h))

    quantiles = sizes.join(found, by).select(*by, "n", F.array(*map(value, place)).alias("quantiles"))
    return values, quantiles


def _settle(found, open_ranks, group, lo, hi, below, n, ranks) -> None:
    """Ranks at the ends of a span are its ends; the rest stay open."""
    for r in ranks:
        if r == below or lo == hi:
            found[group, r] = lo
        elif r == below + n - 1:
            found[group, r] = hi
        else:
            open_ranks.setdefault((group, lo, hi, below), set()).add(r)


def _narrow(data, open_ranks, found):
    """One pass: slice every open interval and keep the slices that hold a rank."""
    spark = data.sparkSession
    group_type = data.schema["_g"].dataType.simpleString()
    intervals = list(open_ranks)
    rows = [(g, i, lo, hi) for i, (g, lo, hi, _) in enumerate(intervals)]
    table = small_table(spark, rows, f"_g {group_type}, i int, lo double, hi double")
    inside = data.join(F.broadcast(table), "_g").where(F.col("_x").between(F.col("lo"), F.col("hi")))
    share = (F.col("_x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
    slices = (
        inside.groupBy("i", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("b"))
        .agg(F.sum("_n").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
        .collect()
    )
    below = [interval[3] for interval in intervals]
    still_open: dict[tuple[object, float, float, int], set[int]] = {}
    for s in sorted(slices, key=lambda s: s["lo"]):
        i = s["i"]
        here = {r for r in open_ranks[intervals[i]] if below[i] <= r < below[i] + s["n"]}
        _settle(found, still_open, intervals[i][0], s["lo"], s["hi"], below[i], s["n"], here)
        below[i] += s["n"]
    return still_open
