"""The whole cleaning of a training and of a scoring manifest, and the model features.

Both start with the group repairs: aggregates over a written table, joined back onto its rows. What
follows is fitted on a few columns of the repaired table, which is written too, and applied row by row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from purser.functions.scalars import (
    SPEND,
    is_spend,
    journey_route,
    part,
    spend_ratios,
    split_cabin,
    split_passenger_id,
    total_expenses,
)
from purser.operators import repair
from purser.operators.features import Bins, OneHot, Scaler, fit_cut, fit_onehot, fit_qcut, fit_scale, group_features, group_table
from purser.operators.profile import Watch
from purser.session import written

KEY = "PassengerId"
GROUP = "GroupNumber"
SIZE_LABELS = ("Small", "Medium", "Large")
AGE_LABELS = ("A", "B", "C", "D", "E")
RATIOS = tuple(f"Ratio{c}" for c in SPEND)
# The model's input columns in order; the label follows VRDeck in training.
MODEL_COLUMNS = (
    "HomePlanet", "CryoSleep", "Destination", "Age", "VIP", "RoomService", "FoodCourt", "ShoppingMall",
    "Spa", "VRDeck", "Deck", "Side", "TotalExpenses", "Is_Spend", "GroupSize",
)


def by_group(df: DataFrame) -> DataFrame:
    """Name the group of each row."""
    return split_passenger_id(df, member=False)


def member_number() -> Column:
    """The place of a passenger in the group: a number, so that 100 comes after 99."""
    return part(KEY, "_", 1).try_cast("bigint")


@dataclass(frozen=True)
class ScoringMeans:
    """What the scoring table's missing numbers are filled with."""

    ages: repair.GroupMeans
    routes: repair.GroupMeans
    overall: repair.GlobalMeans


def _zero_filled(df: DataFrame) -> DataFrame:
    return repair.zero_fill_where(df, total_expenses().isNull() & F.col("CryoSleep"))


def _named(df: DataFrame) -> DataFrame:
    return repair.fill_constant(df, {"Name": "Unknown"}) if "Name" in df.columns else df


def _as_it_is(df: DataFrame, step: str) -> DataFrame:
    return df


def _clean_train(
    df: DataFrame, watch: Callable[[DataFrame, str], DataFrame] = _as_it_is,
) -> tuple[DataFrame, repair.GroupMeans, repair.GroupMeans, DataFrame]:
    # Written before the group step: its aggregate and its rows read the table, not the source.
    df = watch(written(by_group(split_cabin(_named(df))), "clean-train-keyed"), "source")
    # A cabin is missing where its deck is.
    df = watch(repair.drop_missing(df, ("HomePlanet", "Deck"), "all"), "with a planet or a cabin")
    # One step for the planet, the side and the only destination of a group. The rows that stay are those with a number in a group with
    # a side, so the destinations that count are those of rows with a number.
    known = F.when(F.col("Num").isNotNull(), F.col("Destination"))
    df = repair.propagate_with_only(df, GROUP, ("HomePlanet", "Side"), member_number(), known, "_only")
    df = repair.fill_by_rules(df, "HomePlanet", "Deck", repair.PLANET_BY_DECK)
    df = repair.fill_by_rules(df, "Deck", "HomePlanet", repair.DECK_BY_PLANET)
    df = watch(written(repair.drop_missing(df, ("Side", "Num")), "clean-train"), "planets and cabins filled")
    df = df.withColumn("Destination", F.coalesce("Destination", "_only")).drop("_only")
    df = watch(repair.drop_missing(df, ("Destination",)).withColumn("JourneyRoute", journey_route()), "destinations filled")

    routes = repair.fit_group_means(df, ("JourneyRoute", "VIP"))
    filled = _zero_filled(routes.transform(df))
    df = repair.drop_missing(filled.withColumn("TotalExpenses", total_expenses()), SPEND)
    ages = repair.fit_group_means(df, ("HomePlanet",), ("Age",), zero_is_missing=False, ceil_all=True)
    return repair.drop_missing(ages.transform(df), ("CryoSleep", "VIP")), ages, routes, filled


def clean_train(df: DataFrame) -> DataFrame:
    """Training rows with every needed value known; rows that cannot be repaired are dropped."""
    return _clean_train(df)[0]


def watched_clean_train(df: DataFrame, cols: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """``clean_train``, written, and the missing values of ``cols`` after each of its steps, counted from the written tables."""
    watch = Watch(cols)
    clean = watch(written(_clean_train(df, watch)[0], "cleaned"), "clean")
    return clean, watch.table(df.sparkSession)


def fit_clean_train(df: DataFrame) -> tuple[DataFrame, ScoringMeans]:
    """``clean_train``, and the means it learned, for scoring tables."""
    clean, ages, routes, filled = _clean_train(df)
    return clean, ScoringMeans(ages, routes, repair.fit_global_means(filled))


def clean_score(df: DataFrame, means: ScoringMeans | None = None) -> DataFrame:
    """Scoring rows with every needed value known; no row is dropped.

    ``means`` are those of the training table. Without them they are fitted again, on the scoring rows.
    """
    df = written(by_group(split_cabin(_named(df), with_num=False)), "clean-score-keyed")
    df = repair.propagate_with_only(df, GROUP, ("HomePlanet", "Side"), member_number(), F.col("Destination"), "_only")
    df = repair.fill_by_rules(df, "HomePlanet", "Deck", repair.PLANET_BY_DECK)
    df = repair.fill_constant(df, {k: repair.SCORING_CONSTANTS[k] for k in ("HomePlanet", "Side")})
    df = repair.fill_by_rules(df, "Deck", "HomePlanet", repair.DECK_BY_PLANET)
    df = df.withColumn("Destination", F.coalesce("Destination", "_only")).drop("_only")
    df = repair.fill_by_rules(df, "Destination", "HomePlanet", repair.DESTINATION_BY_PLANET)
    df = written(df.withColumn("JourneyRoute", journey_route()), "clean-score")

    def fit_ages() -> repair.GroupMeans:
        return repair.fit_group_means(df, ("HomePlanet",), ("Age",), zero_is_missing=False, ceil_all=True)

    ages = means.ages if means else fit_ages()
    routes = means.routes if means else repair.fit_group_means(df, ("JourneyRoute", "VIP"))
    # A sleeper whose flag is itself missing is not zero-filled: the flag is filled afterwards.
    filled = _zero_filled(routes.transform(ages.transform(df)))
    overall = means.overall if means else repair.fit_global_means(filled)
    out = overall.transform(filled).withColumn("TotalExpenses", total_expenses())
    return repair.fill_constant(out, {k: repair.SCORING_CONSTANTS[k] for k in ("CryoSleep", "VIP")})


@dataclass(frozen=True)
class FeatureParams:
    """Bin edges and scales learned on one table; applied to any other without a job of their own."""

    size: Bins
    age: Bins
    scale: Scaler
    ratio_after_scale: bool = False

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` is a cleaned table; one aggregate joined back, for the group features."""
        df = group_features(df.withColumn("InGroupNumber", part(KEY, "_", 1))).drop("InGroupNumber")
        if not self.ratio_after_scale:
            df = spend_ratios(df)
        df = self.age.transform(self.size.transform(df.withColumn("Is_Spend", is_spend())))
        df = self.scale.transform(df)
        return spend_ratios(df) if self.ratio_after_scale else df


def fit_features(df: DataFrame, ratio_after_scale: bool = False) -> FeatureParams:
    """Learn the feature parameters of a cleaned table.

    Fit on the training table and transform both; fitting each table on its own, as a
    refit, is the caller's choice.
    """
    sizes = group_table(df.select(GROUP, part(KEY, "_", 1).alias("InGroupNumber")))
    return FeatureParams(
        fit_cut(sizes, "GroupSize", 3, SIZE_LABELS),
        fit_qcut(df, "Age", 5, AGE_LABELS),
        fit_scale(df),
        ratio_after_scale,
    )


def model_columns(df: DataFrame, *keep: str, ratios: bool = False) -> DataFrame:
    return df.select(*keep, *MODEL_COLUMNS, *(RATIOS if ratios else ()))


def fit_encoding(df: DataFrame) -> OneHot:
    """One-hot levels of the model's text columns; binned columns keep all their labels."""
    cols = ("HomePlanet", "Destination", "Age", "Deck", "Side", "Is_Spend", "GroupSize")
    return fit_onehot(df, cols, known={"Age": AGE_LABELS, "GroupSize": SIZE_LABELS})
