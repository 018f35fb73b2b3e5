"""Row-local column expressions. None of them causes a shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

SPEND = ("RoomService", "FoodCourt", "ShoppingMall", "Spa", "VRDeck")


def part(col: str | Column, sep: str, i: int) -> Column:
    """Part ``i`` of a split string, null when there are fewer parts."""
    return F.get(F.split(col, sep), i)


def split_cabin(df: DataFrame, cabin: str = "Cabin", with_num: bool = True) -> DataFrame:
    """Replace Cabin (deck/num/side) by Deck, Num and Side."""
    cols = {"Deck": part(cabin, "/", 0)}
    if with_num:
        cols["Num"] = part(cabin, "/", 1)
    cols["Side"] = part(cabin, "/", 2)
    return df.withColumns(cols).drop(cabin)


def split_passenger_id(df: DataFrame, member: bool = True) -> DataFrame:
    """GroupNumber and InGroupNumber from PassengerId (group_member)."""
    cols = {"GroupNumber": part("PassengerId", "_", 0)}
    if member:
        cols["InGroupNumber"] = part("PassengerId", "_", 1)
    return df.withColumns(cols)


def journey_route() -> Column:
    """'planet to destination'; null when either is missing."""
    return F.concat("HomePlanet", F.lit(" to "), "Destination")


def total_expenses(cols: Sequence[str] = SPEND) -> Column:
    """Sum of the spends; null when any of them is missing."""
    total = F.col(cols[0])
    for c in cols[1:]:
        total = total + F.col(c)
    return total


def ratio(part_col: str | Column, whole: str | Column) -> Column:
    """part / whole, with a missing or undefined quotient as 0."""
    return F.coalesce(F.try_divide(part_col, whole), F.lit(0.0))


def spend_ratios(df: DataFrame, cols: Sequence[str] = SPEND, total: str = "TotalExpenses") -> DataFrame:
    return df.withColumns({f"Ratio{c}": ratio(F.col(c), F.col(total)) for c in cols})


def label_if(cond: Column, yes: str, no: str) -> Column:
    """``yes`` where ``cond`` holds; ``no`` where it is false or unknown."""
    return F.when(cond, yes).otherwise(no)


def is_spend(total: str = "TotalExpenses") -> Column:
    return label_if(F.col(total) > 0, "Spent", "Not-Spent")


# The display label of a true and of a false or missing flag.
DISPLAY = {
    "VIP": ("VIP", "Not-VIP"),
    "Transported": ("Transported", "Not-Transported"),
    "CryoSleep": ("Cryo Sleeping", "Not-Cryo Sleeping"),
}


def display_labels(df: DataFrame, labels: Mapping[str, tuple[str, str]] = DISPLAY) -> DataFrame:
    return df.withColumns({c: label_if(F.col(c), yes, no) for c, (yes, no) in labels.items() if c in df.columns})


def ceil_double(x: Column) -> Column:
    return F.ceil(x).cast("double")


def key_hash(key: str | Column, seed: int, buckets: int) -> Column:
    """Bucket of a key in [0, buckets): the same for every layout of the data."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")
