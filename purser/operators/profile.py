"""Tables that describe a manifest: counts, shares, rates, distributions, correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from purser.functions.scalars import ceil_double
from purser.operators.quantiles import group_quantiles
from purser.session import small_table, written

#: So many values of a column can become columns of a result.
MAX_COLUMNS = 10_000


def long_form(df: DataFrame, cols: Sequence[str], *keep: str, name: str = "dim", value: str = "value") -> DataFrame:
    """One row per listed column, its value as a string."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("string").alias(value)) for c in cols])
    return df.select(*keep, F.inline(pairs))


def null_profile(df: DataFrame) -> DataFrame:
    """Missing values per column, in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "n_missing")


class Watch:
    """Missing values of columns at the steps of a plan, counted from the tables that the plan writes anyway.

    ``watch(df, step)`` notes a step, which should be a written table or a row-local view of one; ``table`` counts each by one aggregate.
    Nothing is observed: a session that has observed a table can't serialise Spark's models with a training summary any more.
    """

    def __init__(self, cols: Sequence[str]):
        self.cols = tuple(cols)
        self.steps: list[tuple[str, DataFrame]] = []

    def __call__(self, df: DataFrame, step: str) -> DataFrame:
        self.steps.append((step, df))
        return df

    def table(self, spark: SparkSession) -> DataFrame:
        """(place, step, column_name, n_missing, n_rows)."""
        counts = [F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in self.cols]]
        rows = [(i, step, c, found[c], found["n_rows"]) for i, (step, df) in enumerate(self.steps) for found in [df.agg(*counts).first()] for c in self.cols]
        return small_table(spark, rows, "place int, step string, column_name string, n_missing long, n_rows long")


def crosstab(
    df: DataFrame,
    row: str,
    col: str,
    count_of: str | None = None,
    values: Sequence[str] | None = None,
) -> DataFrame:
    """Rows (or non-null ``count_of``) per pair of values, one column per value of ``col``.

    The columns are ``values``, or those that the data hold; more than ``MAX_COLUMNS`` of these are an error: then
    ``crosstab_counts`` has the same numbers as rows. Rows where either side is missing are left out, and with them groups that
    hold nothing else. The data are read once: the counts of the pairs are written, and the columns are made of them.
    """
    counts = written(crosstab_counts(df, row, col, count_of), "crosstab")
    if values is None:
        values = bounded_values(counts.select(col).distinct(), f"the values of {col}")
    return counts.groupBy(row).pivot(col, list(values)).agg(F.sum("n")).na.fill(0)


def crosstab_counts(df: DataFrame, row: str, col: str, count_of: str | None = None) -> DataFrame:
    """(row, col, n) of every pair of known values, however many there are."""
    known = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    return known.groupBy(row, col).agg((F.count(count_of) if count_of else F.count(F.lit(1))).alias("n"))


def bounded_values(values: DataFrame, what: str) -> list:
    """The sorted values of a one-column table that are to become columns; more than ``MAX_COLUMNS`` are an error."""
    found = [r[0] for r in values.limit(MAX_COLUMNS + 1).collect()]
    if len(found) > MAX_COLUMNS:
        raise ValueError(f"{what} are more than {MAX_COLUMNS}, too many for columns")
    return sorted(found)


def distinct_per_group(df: DataFrame, key: str, col: str, name: str = "n_distinct") -> DataFrame:
    """Distinct known values of ``col`` per group; groups without any are absent."""
    known = df.where(F.col(key).isNotNull() & F.col(col).isNotNull())
    return known.groupBy(key).agg(F.count_distinct(col).alias(name))


def groups_single_valued(df: DataFrame, key: str, col: str) -> DataFrame:
    """Groups with exactly one known value of ``col``, and that value."""
    known = df.where(F.col(key).isNotNull() & F.col(col).isNotNull())
    ends = known.groupBy(key).agg(F.min(col).alias(col), F.max(col).alias("_max"))
    return ends.where(F.col(col) == F.col("_max")).drop("_max")


def fd_check(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """How many groups have 1, 2, ... distinct values of each column.

    ``key`` determines a column when its only row says 1.
    """
    values = long_form(df, cols, key, name="dependent").where(F.col(key).isNotNull() & F.col("value").isNotNull())
    per_group = values.distinct().groupBy(key, "dependent").agg(F.count(F.lit(1)).alias("n_values"))
    return per_group.groupBy("dependent", "n_values").agg(F.count(F.lit(1)).alias("n_groups"))


def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """Rows per known value, most frequent first."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))
    return counts.orderBy(F.desc(name), col)


def value_share(df: DataFrame, col: str) -> DataFrame:
    """Rows and percentage per known value."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / total, 6))


def distinct_pairs(df: DataFrame, key: str, col: str) -> DataFrame:
    return df.select(key, col).dropna().dropDuplicates()


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many distinct values of ``key`` two tables share: one row."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    shared = left.join(right, key, "left_semi")
    return shared.agg(F.lit(key).alias("key"), F.count(F.lit(1)).alias("n_common"))


def mean_by(df: DataFrame, keys: Sequence[str], cols: Sequence[str], ceil: bool = True,
            zero_is_missing: bool = True) -> DataFrame:
    """Mean of each column per known key combination, all columns in one aggregate."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df.groupBy(*keys).agg(*[_mean(c, ceil, zero_is_missing).alias(c) for c in cols])


def _mean(col: str, ceil: bool, zero_is_missing: bool) -> Column:
    mean = F.avg(col)
    if zero_is_missing:
        mean = F.nullif(mean, F.lit(0.0))
    return ceil_double(mean) if ceil else mean


def mean_pivot(df: DataFrame, row: str, flag: str, cols: Sequence[str], ceil: bool = True) -> DataFrame:
    """``mean_by`` with one column per spend and flag value."""
    known = df.where(F.col(row).isNotNull())
    cells = {
        f"{c}_{str(v).lower()}": F.nullif(F.avg(F.when(F.col(flag) == v, F.col(c))), F.lit(0.0))
        for c in cols
        for v in (False, True)
    }
    known = known.where(F.col(flag).isNotNull())
    return known.groupBy(row).agg(*[(ceil_double(x) if ceil else x).alias(n) for n, x in cells.items()])


def group_mode(df: DataFrame, key: str, col: str) -> DataFrame:
    """Most frequent known value per key; of equally frequent ones the largest."""
    known = df.where(F.col(key).isNotNull() & F.col(col).isNotNull())
    counts = known.groupBy(key, col).agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct("n", col)).alias("best")
    return counts.groupBy(key).agg(best).select(key, F.col(f"best.{col}").alias(col), F.col("best.n").alias("n"))


def rate_table(df: DataFrame, dims: Sequence[str], label: str) -> DataFrame:
    """Share of each label within each value of each dimension, one pass for all dimensions."""
    values = long_form(df, dims, label).where(F.col("value").isNotNull() & F.col(label).isNotNull())
    counts = values.groupBy("dim", "value", label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("dim", "value"))
    return counts.withColumn("rate", F.round(F.col("n") / total, 6))


def hierarchy_counts(df: DataFrame, path: Sequence[str]) -> DataFrame:
    """Rows at every node of a hierarchy, with the percentage of the parent node."""
    for c in path:
        df = df.where(F.col(c).isNotNull())
    nodes = df.rollup(*path).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_gid"))
    depth = F.lit(len(path)) - F.bit_count("_gid")
    nodes = nodes.select(*path, "n", depth.cast("int").alias("depth"))
    parents = nodes.select(
        *[F.col(c).alias(f"_{c}") for c in path], F.col("n").alias("_n"), (F.col("depth") + 1).alias("depth")
    )
    same = F.col("c.depth") == F.col("p.depth")
    for i, c in enumerate(path):
        here = F.when(F.col("c.depth") > i + 1, F.col(f"c.{c}"))
        same = same & here.eqNullSafe(F.col(f"p._{c}"))
    joined = nodes.alias("c").join(parents.alias("p"), same, "left")
    return joined.select(
        *[F.col(f"c.{c}") for c in path],
        F.col("c.depth"),
        F.col("c.n"),
        F.round(F.col("c.n") * 100.0 / F.col("_n"), 6).alias("pct_parent"),
    )


def histogram(df: DataFrame, x: str, by: Sequence[str], width: float) -> DataFrame:
    """Rows per bin of fixed width, split by each of several columns; the bin is named by its lower end."""
    values = long_form(df, by, x, name="by").where(F.col(x).isNotNull() & F.col("value").isNotNull())
    bin_start = (F.floor(F.col(x) / width) * width).cast("double")
    return values.groupBy("by", "value", bin_start.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_table(df: DataFrame, boxes: Sequence[tuple[str, str]]) -> DataFrame:
    """(measure, by, value, n, five numbers, lower, upper, n_outliers) of each box, for any number of groups.

    All boxes go through the same few passes, over the counts of their distinct values.
    """
    cells = [
        F.struct(F.lit(x).alias("measure"), F.lit(by).alias("by"), F.col(by).cast("string").alias("value"), F.col(x).cast("double").alias("x"))
        for x, by in boxes
    ]
    box = ["measure", "by", "value"]
    values, quartiles = group_quantiles(df.select(F.inline(F.array(*cells))), "x", (0, 0.25, 0.5, 0.75, 1), box)
    low, q1, mid, q3, high = (F.col("quantiles")[i] for i in range(5))
    reach = 1.5 * (q3 - q1)
    stats = quartiles.select(
        *box, "n", low.alias("min_value"), q1.alias("q1_value"), mid.alias("median_value"), q3.alias("q3_value"),
        high.alias("max_value"), (q1 - reach).alias("lower_value"), (q3 + reach).alias("upper_value"))
    outside = (F.col("x") < F.col("lower_value")) | (F.col("x") > F.col("upper_value"))
    counts = values.join(stats.select(*box, "lower_value", "upper_value"), box).groupBy(*box).agg(
        F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("n_outliers"))
    return stats.join(counts, box, "left")


def outlier_cells(df: DataFrame, cols: Sequence[str], by: str, *keep: str) -> DataFrame:
    """``keep``, measure and value of every cell of ``cols`` beyond the fences of its row's group; the rows are scanned once."""
    stats = box_table(df, [(x, by) for x in cols])
    fences = stats.groupBy(F.col("value").alias("_group")).agg(*[
        F.max(F.when(F.col("measure") == x, F.col(f"{end}_value"))).alias(f"_{end}_{i}")
        for i, x in enumerate(cols) for end in ("lower", "upper")
    ])
    cells = F.array(*[
        F.struct(F.lit(x).alias("measure"), F.col(x).alias("value"), (~F.col(x).between(F.col(f"_lower_{i}"), F.col(f"_upper_{i}"))).alias("_out"))
        for i, x in enumerate(cols)
    ])
    joined = df.join(fences, F.col(by).cast("string") == F.col("_group"))
    return joined.select(*keep, F.inline(cells)).where("_out").drop("_out")


def outlier_rows(df: DataFrame, x: str, by: str) -> DataFrame:
    """Rows beyond the fences of their group."""
    fences = box_table(df, [(x, by)]).select(F.col("value").alias("_group"), "lower_value", "upper_value")
    joined = df.join(fences, F.col(by).cast("string") == F.col("_group"))
    return joined.where(~F.col(x).between(F.col("lower_value"), F.col("upper_value"))).select(*df.columns)


def box_stats(df: DataFrame, boxes: Sequence[tuple[str, str]]) -> DataFrame:
    """Box-plot numbers for each (measure, by): five-number summary, fences, rows outside them."""
    stats = box_table(df, boxes)
    numbers = [c for c in stats.columns if c.endswith("_value")]
    return stats.select("measure", "by", "value", "n", *[F.round(c, 6).alias(c) for c in numbers], "n_outliers")


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair, each over the rows where both are known, in one aggregate.

    A row is dealt out to all pairs and the pairs are grouped, so the aggregate stays narrow; it is combined before its
    shuffle of one row for each pair and task. A constant column has no correlation: null.
    """
    x = {c: F.col(f"`{c}`").cast("int" if t == "boolean" else "double").cast("double") for c, t in df.select(*cols).dtypes}
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), x[cols[i]].alias("x"), x[cols[j]].alias("y")) for i, j in pairs]
    known = df.select(F.inline(F.array(*cells))).where("x is not null and y is not null")
    sums = known.groupBy("i", "j").agg(F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"))
    found = F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy"))
    corr = F.round(F.when(F.col("i") == F.col("j"), F.when(F.col("xx") > 0, 1.0)).otherwise(found), 6)
    # Pairs that no row knows both columns of are there, too.
    every = small_table(df.sparkSession, pairs, "i int, j int")
    names = F.array(*map(F.lit, cols))
    both = every.join(sums, ["i", "j"], "left").select("i", "j", corr.alias("corr"))
    both = both.unionByName(both.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "corr"))
    return both.select(F.get(names, F.col("i")).alias("col_a"), F.get(names, F.col("j")).alias("col_b"), "corr")


def sorted_group_profile(df: DataFrame, key: str, col: str) -> DataFrame:
    """Crosstab by group with the number of distinct values, in group order."""
    table = crosstab(df, key, col)
    kinds = sum((F.when(F.col(f"`{v}`") > 0, 1).otherwise(0) for v in table.columns[1:]), F.lit(0))
    return table.withColumn(f"Unique{col}s", kinds).orderBy(key)
