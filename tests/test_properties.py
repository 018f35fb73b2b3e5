"""What must hold whatever the data: repairs, row counts, folds, layout."""

import pytest
from pyspark.sql import functions as F

from purser.functions.scalars import SPEND
from purser.operators import features, repair
from purser.plans import cleaning
from purser.sources.derived import manifest


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in cols)) for r in df.collect()),
                  key=repr)


@pytest.fixture(scope="module")
def full(spark, sf_dir):
    return manifest(spark, sf_dir).cache()


@pytest.fixture(scope="module")
def clean(full):
    return cleaning.clean_train(full).cache()


def test_repairs_keep_known_values(full):
    df = cleaning.split_cabin(full)
    repaired = {
        "HomePlanet": repair.fill_by_rules(df, "HomePlanet", "Deck", repair.PLANET_BY_DECK),
        "Destination": repair.fill_if_unique(cleaning.by_group(df), "GroupNumber", "Destination"),
        "Spa": repair.fit_global_means(df).transform(df),
    }
    for c, out in repaired.items():
        pairs = df.select("PassengerId", F.col(c).alias("old")).join(out.select("PassengerId", c), "PassengerId")
        assert pairs.count() == df.count()
        assert pairs.where(f"old IS NOT NULL AND NOT old <=> {c}").count() == 0
        assert pairs.where(f"old IS NULL AND {c} IS NOT NULL").count() > 0


def test_clean_train_leaves_nothing_missing(clean):
    needed = ("HomePlanet", "CryoSleep", "Destination", "Age", "VIP", *SPEND, "TotalExpenses", "Deck", "Side", "Num", "Name")
    assert clean.dropna(subset=list(needed)).count() == clean.count() > 0


def test_clean_score_keeps_every_row(full):
    out = cleaning.clean_score(full.drop("Transported"))
    assert out.count() == full.count() == out.select("PassengerId").distinct().count()
    assert out.dropna().count() == out.count()


def test_fitted_parameters_do_not_depend_on_the_scoring_rows(full, clean):
    params = cleaning.fit_features(clean)
    score = cleaning.clean_score(full.drop("Transported").where("PassengerId < '0000500'"))
    out = params.transform(score)
    assert out.count() == score.count()
    sizes = {r["GroupSize"] for r in out.select("GroupSize").distinct().collect()}
    assert sizes <= set(cleaning.SIZE_LABELS)


def test_ratio_after_scale_uses_scaled_values(clean):
    late = cleaning.fit_features(clean, ratio_after_scale=True).transform(clean)
    row = late.where("TotalExpenses <> 0").first()
    assert row["RatioSpa"] == pytest.approx(row["Spa"] / row["TotalExpenses"])


def test_one_hot_blocks_and_bins(clean):
    binned = cleaning.fit_features(clean).transform(clean)
    encoding = cleaning.fit_encoding(binned)
    out = encoding.transform(cleaning.model_columns(binned))
    for c, levels in encoding.levels:
        total = sum((F.col(f"`{c}_{v}`").cast("int") for v in levels), F.lit(0))
        assert out.where(total != 1).count() == 0


def test_folds_and_split_are_stable(full):
    df = features.with_fold(features.holdout(full.select("PassengerId")), 3)
    expected = rows(df)
    for n in (1, 7, 64):
        assert rows(features.with_fold(features.holdout(full.select("PassengerId").repartition(n)), 3)) == expected
    share = df.where("split = 'val'").count() / df.count()
    assert 0.13 < share < 0.17


@pytest.mark.parametrize("n", [1, 7, 64])
def test_layout_does_not_matter(full, clean, n):
    again = cleaning.clean_train(full.repartition(n))
    assert rows(again) == rows(clean)
