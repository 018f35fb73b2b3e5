"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from purser.functions.scalars import (
    SPEND,
    display_labels as with_display_labels,
    is_spend as spend_label,
    journey_route as route,
    split_cabin as with_cabin_parts,
    split_passenger_id as with_group,
    spend_ratios as with_ratios,
    total_expenses as total,
)
from purser.operators import evaluate, features, profile, repair
from purser.plans import cleaning
from purser.session import new_path
from purser.sources.derived import manifest
from purser.sources.manifest import read_manifest, submission as as_submission, write_submission

KEY, GROUP = cleaning.KEY, cleaning.GROUP
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# Sources and sinks


@query
def scan_manifest(spark, sf_dir):
    path = new_path(spark, "manifest")
    manifest(spark, sf_dir).write.csv(path, header=True)
    return read_manifest(spark, path)


@query
def submission(spark, sf_dir):
    asleep = F.coalesce("CryoSleep", F.lit(False))
    path = new_path(spark, "submission")
    write_submission(as_submission(manifest(spark, sf_dir, "CryoSleep"), asleep), path)
    return spark.read.schema("PassengerId string, Transported boolean").csv(path, header=True, mode="FAILFAST")


# Projections, filters, predicates


@query
def select_model_columns(spark, sf_dir):
    df = manifest(spark, sf_dir)
    df = features.group_features(cleaning.by_group(with_group(with_cabin_parts(df))))
    df = df.withColumn("TotalExpenses", total()).withColumn("Is_Spend", spend_label())
    return cleaning.model_columns(df, KEY, "Transported")


@query
def drop_missing_all(spark, sf_dir):
    return repair.drop_missing(manifest(spark, sf_dir, "HomePlanet", "Cabin"), ("HomePlanet", "Cabin"), "all")


@query
def drop_missing_any(spark, sf_dir):
    df = manifest(spark, sf_dir, "CryoSleep", "VIP", *SPEND)
    return repair.drop_missing(repair.drop_missing(df, SPEND), ("CryoSleep", "VIP"))


@query
def filter_null_and_in(spark, sf_dir):
    df = with_cabin_parts(manifest(spark, sf_dir, "HomePlanet", "Cabin"))
    return df.where(F.col("HomePlanet").isNull() & F.col("Deck").isin("A", "B", "C", "T")).select(KEY, "Deck")


@query
def filter_null_and_eq(spark, sf_dir):
    df = manifest(spark, sf_dir, "HomePlanet", "VIP", "RoomService")
    wanted = F.col("RoomService").isNull() & (F.col("HomePlanet") == "Earth") & (F.col("VIP") == F.lit(True))
    return df.where(wanted).select(KEY, "HomePlanet", "VIP")


@query
def groups_single_valued(spark, sf_dir):
    return profile.groups_single_valued(manifest(spark, sf_dir, "Destination", key="group"), GROUP, "Destination")


@query
def filter_cryo_missing_total(spark, sf_dir):
    df = manifest(spark, sf_dir, "CryoSleep", *SPEND)
    return df.where(total().isNull() & F.col("CryoSleep"))


# Joins


@query
def join_group_features(spark, sf_dir):
    df = manifest(spark, sf_dir, "VIP")
    return features.join_group_features(with_group(df))


@query
def key_overlap(spark, sf_dir):
    parts = [manifest(spark, sf_dir, "Name", split=s, key="group") for s in ("train", "score")]
    return profile.key_overlap(*parts, GROUP).unionByName(profile.key_overlap(*parts, "Name"))


@query
def lookup_overwrite(spark, sf_dir):
    df = manifest(spark, sf_dir, "Destination")
    return repair.lookup_overwrite(cleaning.by_group(df), GROUP, "Destination", cleaning.member_number())


@query
def semi_single_valued(spark, sf_dir):
    df = manifest(spark, sf_dir, "Destination")
    return repair.semi_single_valued(cleaning.by_group(df), GROUP, "Destination")


@query
def impute_unique_in_group(spark, sf_dir):
    df = manifest(spark, sf_dir, "Destination").transform(cleaning.by_group)
    return repair.fill_if_unique(df, GROUP, "Destination").select(KEY, GROUP, "Destination")


# Aggregations


@query
def null_profile(spark, sf_dir):
    return profile.null_profile(manifest(spark, sf_dir))


@query
def crosstab_size(spark, sf_dir):
    df = with_cabin_parts(manifest(spark, sf_dir, "HomePlanet", "Cabin", key=False))
    return profile.crosstab(df, "HomePlanet", "Deck")


@query
def crosstab_count(spark, sf_dir):
    df = with_cabin_parts(manifest(spark, sf_dir, "HomePlanet", "Cabin", key=False))
    return profile.crosstab(df, "HomePlanet", "Deck", count_of="Deck")


@query
def distinct_per_group(spark, sf_dir):
    df = manifest(spark, sf_dir, "Destination", key="group")
    return profile.distinct_per_group(df, GROUP, "Destination", "UniqueDestinations")


@query
def fd_check(spark, sf_dir):
    df = with_cabin_parts(manifest(spark, sf_dir, "HomePlanet", "Cabin", "Destination", key="group"))
    return profile.fd_check(df, GROUP, ("HomePlanet", "Side", "Destination"))


@query
def value_share(spark, sf_dir):
    df = manifest(spark, sf_dir, "Destination", "CryoSleep", key="group")
    kinds = profile.distinct_per_group(df, GROUP, "Destination", "UniqueDestinations")
    shares = [(profile.value_share(d, c), c) for d, c in ((kinds, "UniqueDestinations"), (df, "CryoSleep"))]
    named = [
        s.select(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"), "n", "pct") for s, c in shares
    ]
    return named[0].unionByName(named[1])


@query
def distinct_pairs(spark, sf_dir):
    return profile.distinct_pairs(manifest(spark, sf_dir, "Destination", key="group"), GROUP, "Destination")


def with_route(spark, sf_dir, *columns, **kwargs):
    columns = dict.fromkeys(("HomePlanet", "Destination", *columns))
    return manifest(spark, sf_dir, *columns, **kwargs).withColumn("JourneyRoute", route())


@query
def mean_spend_by_route_vip(spark, sf_dir):
    return profile.mean_by(with_route(spark, sf_dir, "VIP", *SPEND, key=False), ("JourneyRoute", "VIP"), SPEND)


@query
def mean_spend_pivot(spark, sf_dir):
    return profile.mean_pivot(with_route(spark, sf_dir, "VIP", *SPEND, key=False), "JourneyRoute", "VIP", SPEND)


@query
def group_size(spark, sf_dir):
    return features.group_table(with_group(manifest(spark, sf_dir, "VIP"))).select(GROUP, "GroupSize")


@query
def group_is_single(spark, sf_dir):
    return features.group_table(with_group(manifest(spark, sf_dir, "VIP"))).select(GROUP, "Is_Single")


@query
def group_mode(spark, sf_dir):
    df = with_cabin_parts(manifest(spark, sf_dir, "HomePlanet", "Cabin", key=False))
    return profile.group_mode(df, "HomePlanet", "Deck")


@query
def transport_rate_by_dim(spark, sf_dir):
    df = with_cabin_parts(with_route(spark, sf_dir, "CryoSleep", "Cabin", "Transported", key=False))
    return profile.rate_table(with_display_labels(df), ("JourneyRoute", "CryoSleep", "Deck"), "Transported")


@query
def mean_total_by_route_vip(spark, sf_dir):
    df = with_route(spark, sf_dir, "VIP", *SPEND, key=False).withColumn("TotalExpenses", total())
    return rounded(profile.mean_by(df, ("JourneyRoute", "VIP"), ("TotalExpenses",), ceil=False), "TotalExpenses")


@query
def hierarchy_counts(spark, sf_dir):
    df = with_display_labels(with_route(spark, sf_dir, "VIP", "Transported", key=False))
    return profile.hierarchy_counts(df, ("JourneyRoute", "VIP", "Transported"))


@query
def value_counts(spark, sf_dir):
    return profile.value_counts(with_route(spark, sf_dir, key=False), "JourneyRoute")


@query
def age_histogram_by(spark, sf_dir):
    df = with_display_labels(manifest(spark, sf_dir, "Age", "VIP", "CryoSleep", "Transported", key=False))
    return profile.histogram(df, "Age", ("Transported", "VIP", "CryoSleep"), 5)


@query
def box_stats(spark, sf_dir):
    df = with_total(spark, sf_dir, "Age", "VIP", "CryoSleep", "Transported", key=False)
    df = with_ratios(with_display_labels(df))
    boxes = [("TotalExpenses", "VIP"), ("RatioRoomService", "VIP"),
             ("Age", "Transported"), ("Age", "VIP"), ("Age", "CryoSleep")]
    return profile.box_stats(df, boxes)


@query
def outlier_rows(spark, sf_dir):
    df = with_ratios(with_display_labels(with_total(spark, sf_dir, "VIP")))
    return profile.outlier_cells(df, ("TotalExpenses", "RatioRoomService"), "VIP", KEY, "VIP")


@query
def corr_matrix(spark, sf_dir):
    df = manifest(spark, sf_dir, "CryoSleep", "Age", "VIP", *SPEND, "Transported", key=False)
    df = df.withColumn("TotalExpenses", total())
    return profile.corr_matrix(df, ("CryoSleep", "Age", "VIP", *SPEND, "Transported", "TotalExpenses"))


@query
def sorted_group_profile(spark, sf_dir):
    df = manifest(spark, sf_dir, "Destination", key="group")
    return profile.sorted_group_profile(df, GROUP, "Destination")


# Missing-value repair


@query
def fill_constant(spark, sf_dir):
    df = with_cabin_parts(manifest(spark, sf_dir, "HomePlanet", "CryoSleep", "Cabin", "VIP", "Name"))
    filled = repair.fill_constant(df, {"Name": "Unknown", **repair.SCORING_CONSTANTS})
    return filled.select(KEY, "HomePlanet", "CryoSleep", "VIP", "Name", "Side")


def planet_and_deck(spark, sf_dir):
    return with_cabin_parts(manifest(spark, sf_dir, "HomePlanet", "Cabin")).select(KEY, "HomePlanet", "Deck")


@query
def fill_planet_from_deck(spark, sf_dir):
    return repair.fill_by_rules(planet_and_deck(spark, sf_dir), "HomePlanet", "Deck", repair.PLANET_BY_DECK)


@query
def fill_deck_from_planet(spark, sf_dir):
    return repair.fill_by_rules(planet_and_deck(spark, sf_dir), "Deck", "HomePlanet", repair.DECK_BY_PLANET)


@query
def fill_destination_test(spark, sf_dir):
    df = manifest(spark, sf_dir, "HomePlanet", "Destination")
    return repair.fill_by_rules(df, "Destination", "HomePlanet", repair.DESTINATION_BY_PLANET)


@query
def propagate_group_value(spark, sf_dir):
    df = manifest(spark, sf_dir, "HomePlanet", "Cabin", "Destination")
    cols = ("HomePlanet", "Side", "Destination")
    df = cleaning.by_group(with_cabin_parts(df))
    return repair.propagate_group_value(df, GROUP, cols, cleaning.member_number()).select(KEY, GROUP, *cols)


@query
def impute_mean_route_vip(spark, sf_dir):
    df = with_route(spark, sf_dir, "VIP", *SPEND)
    means = repair.fit_group_means(with_route(spark, sf_dir, "VIP", *SPEND, key=False), ("JourneyRoute", "VIP"))
    return means.transform(df).select(KEY, "JourneyRoute", "VIP", *SPEND)


@query
def impute_mean_transform(spark, sf_dir):
    df = with_route(spark, sf_dir, "VIP", *SPEND)
    means = repair.fit_group_means(
        with_route(spark, sf_dir, "VIP", *SPEND, key=False), ("JourneyRoute", "VIP"), zero_is_missing=False, ceil_all=True)
    return means.transform(df).select(KEY, "JourneyRoute", "VIP", *SPEND)


@query
def impute_age_by_planet(spark, sf_dir):
    # No mean depends on the passengers' numbers, so the fit doesn't number them.
    known = manifest(spark, sf_dir, "HomePlanet", "Age", key=False)
    means = repair.fit_group_means(known, ("HomePlanet",), ("Age",), zero_is_missing=False, ceil_all=True)
    return means.transform(manifest(spark, sf_dir, "HomePlanet", "Age"))


@query
def zero_fill_cryo(spark, sf_dir):
    df = manifest(spark, sf_dir, "CryoSleep", *SPEND)
    return repair.zero_fill_where(df, total().isNull() & F.col("CryoSleep"))


@query
def impute_global_mean(spark, sf_dir):
    means = repair.fit_global_means(manifest(spark, sf_dir, *SPEND, key=False))
    return rounded(means.transform(manifest(spark, sf_dir, *SPEND)), *SPEND)


# Scalar functions


@query
def split_cabin(spark, sf_dir):
    return with_cabin_parts(manifest(spark, sf_dir, "Cabin"))


@query
def split_passenger_id(spark, sf_dir):
    return with_group(manifest(spark, sf_dir, "VIP")).select(KEY, GROUP, "InGroupNumber")


@query
def journey_route(spark, sf_dir):
    return with_route(spark, sf_dir).select(KEY, "JourneyRoute")


def with_total(spark, sf_dir, *columns, **kwargs):
    return manifest(spark, sf_dir, *columns, *SPEND, **kwargs).withColumn("TotalExpenses", total())


@query
def total_expenses(spark, sf_dir):
    return with_total(spark, sf_dir).select(KEY, "TotalExpenses")


@query
def spend_ratios(spark, sf_dir):
    return with_ratios(with_total(spark, sf_dir)).select(KEY, *cleaning.RATIOS)


@query
def display_labels(spark, sf_dir):
    return with_display_labels(manifest(spark, sf_dir, "VIP", "Transported", "CryoSleep"))


@query
def is_spend(spark, sf_dir):
    return with_total(spark, sf_dir).select(KEY, spend_label().alias("Is_Spend"))


# Feature engineering


@query
def cut_group_size(spark, sf_dir):
    df = manifest(spark, sf_dir, "VIP")
    df = with_group(df)
    bins = features.fit_cut(features.group_table(df), "GroupSize", 3, cleaning.SIZE_LABELS)
    sized = features.group_features(cleaning.by_group(df))
    return bins.transform(sized, to="SizeClass").select(KEY, "GroupSize", "SizeClass")


@query
def qcut_age(spark, sf_dir):
    bins = features.fit_qcut(manifest(spark, sf_dir, "Age", key=False), "Age", 5, cleaning.AGE_LABELS)
    return bins.transform(manifest(spark, sf_dir, "Age"), to="AgeClass")


@query
def standardize_spend(spark, sf_dir):
    scale = features.fit_scale(with_total(spark, sf_dir, key=False))
    return rounded(scale.transform(with_total(spark, sf_dir)), *features.SCALED)


ENCODED = ("HomePlanet", "Destination", "Deck", "Side")


def to_encode(spark, sf_dir, key=True):
    df = with_cabin_parts(manifest(spark, sf_dir, "HomePlanet", "Cabin", "Destination", "VIP", key=key))
    return df.select(*([KEY] if key else []), "VIP", *ENCODED)


@query
def one_hot(spark, sf_dir):
    return features.fit_onehot(to_encode(spark, sf_dir, key=False), ENCODED).transform(to_encode(spark, sf_dir))


@query
def one_hot_aligned(spark, sf_dir):
    """Levels fitted on passengers of two planets, applied to all: the third planet is new to them."""
    some = to_encode(spark, sf_dir, key=False).where(F.col("HomePlanet").isin("Earth", "Europa"))
    return features.fit_onehot(some, ENCODED).transform(to_encode(spark, sf_dir))


@query
def holdout_split(spark, sf_dir):
    return features.holdout(manifest(spark, sf_dir, "Transported"))


@query
def clean_train(spark, sf_dir):
    return cleaning.clean_train(manifest(spark, sf_dir))


@query
def cleaning_profile(spark, sf_dir):
    """Missing values between the steps of cleaning, by the writes of the steps."""
    return cleaning.watched_clean_train(manifest(spark, sf_dir), ("HomePlanet", "CryoSleep", "Destination", "Age", "VIP", *SPEND))[1]


@query
def clean_test(spark, sf_dir):
    df = manifest(spark, sf_dir)
    return rounded(cleaning.clean_score(df.drop("Transported")), *SPEND, "TotalExpenses")


@query
def train_features(spark, sf_dir):
    df = manifest(spark, sf_dir)
    df = cleaning.clean_train(df)
    df = cleaning.fit_features(df).transform(df)
    return rounded(cleaning.model_columns(df, KEY, "Transported", "Is_Single", ratios=True), *features.SCALED)


# Evaluation, over a rule in place of a model


def rule_scored(spark, sf_dir, *columns):
    """Score of a rule: half a point for sleeping, a quarter each for not being VIP and being under 18."""
    df = manifest(spark, sf_dir, "CryoSleep", "VIP", "Age", "Transported", *columns)
    points = {0.5: F.col("CryoSleep"), 0.25: ~F.col("VIP"), 0.125: F.col("Age") < 18}
    score = sum((F.when(cond, p).otherwise(0.0) for p, cond in points.items()), F.lit(0.0))
    df = df.withColumn("score", score).withColumn("label", F.col("Transported").cast("int"))
    df = df.withColumn("prediction", evaluate.threshold_score("score").cast("int"))
    return features.with_fold(features.holdout(df), 5)


@query
def threshold_score(spark, sf_dir):
    df = rule_scored(spark, sf_dir)
    return as_submission(df, evaluate.threshold_score("score"))


@query
def accuracy_by_split(spark, sf_dir):
    return evaluate.accuracy_by_split(rule_scored(spark, sf_dir))


@query
def binary_accuracy(spark, sf_dir):
    return evaluate.binary_accuracy(rule_scored(spark, sf_dir))


@query
def classification_report(spark, sf_dir):
    return evaluate.classification_report(rule_scored(spark, sf_dir))


@query
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(rule_scored(spark, sf_dir))


@query
def cv_summary(spark, sf_dir):
    return evaluate.cv_summary(evaluate.fold_scores(rule_scored(spark, sf_dir)))


@query
def oof_fold_assignment(spark, sf_dir):
    return features.with_fold(manifest(spark, sf_dir, "Transported"), 3).select(KEY, "fold")


@query
def gnb_parameters(spark, sf_dir):
    df = with_total(spark, sf_dir, "Age", "Transported", key=False).withColumn("label", F.col("Transported").cast("int"))
    return evaluate.gnb_parameters(df, ["Age", *SPEND, "TotalExpenses"])
