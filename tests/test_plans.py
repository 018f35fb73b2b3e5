"""The plans are the ones meant: no Python workers, no single-task row work, one exchange for group steps."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from purser.operators import features, profile, repair
from purser.plans import cleaning
from purser.sources.derived import manifest

ROW_LOCAL = ("split_cabin", "journey_route", "total_expenses", "spend_ratios", "display_labels", "is_spend",
             "fill_constant", "fill_planet_from_deck", "fill_deck_from_planet", "zero_fill_cryo", "drop_missing_all",
             "filter_null_and_in", "holdout_split", "oof_fold_assignment")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> list[str]:
    return re.findall(r"\bExchange (\w+)", plan(df))


@pytest.fixture(scope="module")
def csv(spark, sf_dir, tmp_path_factory):
    """The manifest as a file: what the engine reads in practice."""
    from purser.sources.manifest import read_manifest

    path = str(tmp_path_factory.mktemp("csv") / "manifest")
    manifest(spark, sf_dir).write.csv(path, header=True)
    return read_manifest(spark, path)


@pytest.mark.parametrize("name", sorted(k for k in contract.oracle_sql() if not k.startswith("op")))
def test_no_python_worker(spark, sf_dir, name):
    text = plan(contract.queries()[name](spark, sf_dir))
    assert not re.search(r"Python|MapInPandas|ArrowEval|CartesianProduct|BroadcastNestedLoopJoin", text)


def test_row_local_steps_do_not_shuffle(csv):
    df = features.with_fold(features.holdout(cleaning.split_cabin(csv)), 3)
    df = repair.fill_by_rules(df, "HomePlanet", "Deck", repair.PLANET_BY_DECK)
    df = repair.zero_fill_where(df, F.col("CryoSleep"))
    assert exchanges(df) == []


def test_group_steps_have_no_window(csv):
    """Aggregates combined before their shuffle and joined back: the same plan for groups of any size."""
    df = cleaning.by_group(cleaning.split_cabin(csv))
    df = repair.propagate_group_value(df, "GroupNumber", ("HomePlanet", "Side"), cleaning.member_number())
    df = repair.fill_if_unique(df, "GroupNumber", "Destination")
    text = plan(features.group_features(df.withColumn("InGroupNumber", F.lit("01"))))
    assert "Window" not in text and "partial_min" in text and "partial_max" in text


@pytest.mark.parametrize("clean", [cleaning.clean_train, lambda df: cleaning.clean_score(df.drop("Transported"))])
def test_cleaning_reads_a_written_table(csv, clean):
    """What is left to run reads the last table and the fitted means: nothing of the source is left in the plan."""
    text = plan(clean(csv))
    scans = re.findall(r"FileScan (\w+)", text)
    assert scans.count("csv") == 0 and scans.count("parquet") == 3


def test_transform_starts_no_job(spark, csv):
    df = cleaning.clean_train(csv)
    params = cleaning.fit_features(df)
    spark.sparkContext.setJobGroup("transform", "transform")
    try:
        params.transform(df)
        repaired = csv.withColumn("JourneyRoute", cleaning.journey_route())
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("transform")
        assert repaired.columns
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_mean_table_combines_before_its_only_exchange(spark, sf_dir):
    df = contract.queries()["mean_spend_by_route_vip"](spark, sf_dir)
    text = plan(df)
    assert "partial_avg" in text
    # line items are not shuffled for this: no members are numbered
    assert "Window" not in text and len(exchanges(df)) == 1


def test_scans_read_only_their_columns(spark, sf_dir):
    text = plan(contract.queries()["value_counts"](spark, sf_dir))
    item = next(s for s in re.findall(r"ReadSchema: struct<([^>]*)>", text) if "l_orderkey" in s)
    assert {c.split(":")[0] for c in item.split(",")} == {"l_orderkey", "l_partkey", "l_returnflag"}
    assert "customer" not in text and "part.parquet" not in text


def test_split_filter_reaches_the_scan(spark, sf_dir):
    text = plan(manifest(spark, sf_dir, "VIP", split="train"))
    assert re.search(r"Filter .*l_orderkey#\d+L % 5", text)
    assert text.rindex("% 5") > text.index("Window")


def test_group_key_needs_no_numbers(spark, sf_dir):
    assert exchanges(manifest(spark, sf_dir, "Destination", key="group")) == []


def test_profile_of_groups_uses_partial_aggregates(csv):
    text = plan(profile.fd_check(cleaning.by_group(cleaning.split_cabin(csv)), "GroupNumber", ("Side", "Destination")))
    assert "partial_count" in text and "SinglePartition" not in text
