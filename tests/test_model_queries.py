"""Each registered model query itself: rows, ids, labels and scores."""

import pytest

import __spark_entry__ as contract

FITS = ("model_rf", "model_gbt", "model_svc", "model_lr", "model_gnb", "model_tree", "model_ridge", "stacked_ensemble")


def run(spark, sf_dir, name):
    return contract.queries()[name](spark, sf_dir)


@pytest.mark.parametrize("name", FITS)
def test_fit_reports_accuracy(spark, sf_dir, name):
    (row,) = run(spark, sf_dir, name).collect()
    assert 40 < row["val_accuracy"] <= 100 and row["difference"] == pytest.approx(row["train_accuracy"] - row["val_accuracy"], abs=1e-2)


def test_encode_features(spark, sf_dir):
    rows = run(spark, sf_dir, "encode_features").collect()
    cleaned = run(spark, sf_dir, "clean_train").count()
    assert len(rows) == len({r["PassengerId"] for r in rows}) == cleaned
    assert len({len(r["features"]) for r in rows}) == 1
    assert {r["label"] for r in rows} == {0.0, 1.0} and {r["split"] for r in rows} == {"train", "val"} and {r["fold"] for r in rows} == {0, 1, 2}


def test_score_holdout(spark, sf_dir):
    rows = run(spark, sf_dir, "score_holdout").collect()
    assert len(rows) == len({r["PassengerId"] for r in rows}) > 0
    assert all(0 <= r["score"] <= 1 and r["prediction"] == (r["score"] > 0.5) for r in rows if abs(r["score"] - 0.5) > 1e-5)


def test_feature_importance(spark, sf_dir):
    rows = run(spark, sf_dir, "feature_importance").collect()
    assert abs(sum(r["Importance"] for r in rows) - 1) < 1e-6


def test_permutation_importance(spark, sf_dir):
    rows = run(spark, sf_dir, "permutation_importance").collect()
    names = {r["Features"] for r in run(spark, sf_dir, "feature_importance").collect()}
    assert {r["Features"] for r in rows} == names and all(-100 <= r["Importance"] <= 100 and r["Deviation"] >= 0 for r in rows)


def test_scores_by_a_saved_stack(spark, sf_dir):
    rows = run(spark, sf_dir, "score_saved").collect()
    ids = {r["PassengerId"] for r in run(spark, sf_dir, "score_manifest").collect()}
    assert {r["PassengerId"] for r in rows} == ids and len(rows) == len(ids) and {type(r["Transported"]) for r in rows} == {bool}


@pytest.mark.parametrize("name", ["model_svc_curved", "model_rf_leafwise"])
def test_new_fits_report_accuracy(spark, sf_dir, name):
    (row,) = run(spark, sf_dir, name).collect()
    assert 40 < row["val_accuracy"] <= 100
