"""Registered queries that fit models: on the training rows of the whole manifest, checked on its holdout."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, functions as F

from purser.operators import evaluate, importance, models, stacking
from purser.operators.features import with_fold
from purser.plans import cleaning, training
from purser.plans.catalog import query
from purser.session import new_path, small_table
from purser.sources.derived import manifest


def training_set(spark, sf_dir, ratios: bool = False, split: str | None = None) -> training.TrainingSet:
    """All cleaned rows, encoded and written; the spend ratios are input of the network alone."""
    return training.training_set(manifest(spark, sf_dir, split=split), ratios=ratios)


def quality(name: str, model, data: training.TrainingSet) -> DataFrame:
    report = evaluate.accuracy_by_split(models.scored(model, data.rows))
    return report.select(F.lit(name).alias("model"), *report.columns)


def fit_and_check(name: str, estimator, data: training.TrainingSet) -> DataFrame:
    return quality(name, estimator.fit(data.train), data)


@query
def encode_features(spark, sf_dir):
    """The model input as one row per passenger: its vector, rounded, with label, split and fold."""
    rows = training_set(spark, sf_dir, ratios=True).rows
    return rows.select(cleaning.KEY, "label", "split", "fold", F.transform(vector_to_array("features"), lambda x: F.round(x, 6)).alias("features"))


@query
def model_rf(spark, sf_dir):
    return fit_and_check("RF", models.random_forest(), training_set(spark, sf_dir))


@query
def model_gbt(spark, sf_dir):
    return fit_and_check("GBT", models.boosted_trees(), training_set(spark, sf_dir))


@query
def model_gbt_leafwise(spark, sf_dir):
    return fit_and_check("GBT, 35 leaves", models.leafwise_boosted(), training_set(spark, sf_dir))


@query
def model_rf_leafwise(spark, sf_dir):
    return fit_and_check("RF, 30 leaves", models.leafwise_forest(), training_set(spark, sf_dir))


@query
def model_svc(spark, sf_dir):
    data = training_set(spark, sf_dir)
    return fit_and_check("SVC", models.max_margin(data.n_train), data)


@query
def model_svc_curved(spark, sf_dir):
    data = training_set(spark, sf_dir)
    return fit_and_check("SVC, radial kernel", models.curved_margin(data.n_train), data)


@query
def model_lr(spark, sf_dir):
    data = training_set(spark, sf_dir)
    return fit_and_check("LR", models.logistic(data.n_train), data)


@query
def model_gnb(spark, sf_dir):
    return fit_and_check("GaussianNB", models.gaussian_bayes(), training_set(spark, sf_dir))


@query
def model_tree(spark, sf_dir):
    return fit_and_check("cart", models.decision_tree(), training_set(spark, sf_dir))


@query
def model_ridge(spark, sf_dir):
    data = training_set(spark, sf_dir)
    return fit_and_check("Ridge", models.ridge(data.n_train), data)


@query
def model_mlp(spark, sf_dir):
    data = training_set(spark, sf_dir, ratios=True)
    return fit_and_check("MLP", models.feed_forward(len(data.encoder.names())), data)


@query
def stacked_ensemble(spark, sf_dir):
    data = training_set(spark, sf_dir)
    return fit_and_check("Stacked", training.stacked(data.n_train), data)


@query
def score_holdout(spark, sf_dir):
    """The holdout, scored by the stack."""
    data = training_set(spark, sf_dir)
    rows = models.scored(training.stacked(data.n_train).fit(data.train), data.val)
    return rows.select(cleaning.KEY, "label", F.round("score", 6).alias("score"), "prediction")


@query
def score_manifest(spark, sf_dir):
    """The scoring manifest's submission by the network, with the means learned in training."""
    data = training_set(spark, sf_dir, ratios=True, split="train")
    unlabelled = manifest(spark, sf_dir, split="score").drop("Transported")
    model = models.feed_forward(len(data.encoder.names())).fit(data.train)
    return training.score_manifest(unlabelled, data.encoder, model, data.means)


@query
def score_saved(spark, sf_dir):
    """As ``score_manifest``, by a stack that was saved to the shared folder and loaded again, with its encoder and means."""
    data = training_set(spark, sf_dir, split="train")
    n = data.n_train
    stack = stacking.Stacking({"RF": models.random_forest(), "LR": models.logistic(n)}, models.gaussian_bayes(stacking.META), folds=training.FOLDS)
    folder = new_path(spark, "saved-model")
    training.save_fitted(folder, data.encoder, stack.fit(data.train), data.means)
    encoder, model, means = training.load_fitted(spark, folder)
    return training.score_manifest(manifest(spark, sf_dir, split="score").drop("Transported"), encoder, model, means)


@query
def cross_validate(spark, sf_dir):
    """The stack on the holdout rows, in five folds."""
    data = training_set(spark, sf_dir)
    rows = with_fold(data.val, 5, seed=5, name="cv_fold")
    scores = models.held_out_scores(rows, training.stacked(data.n_train), "cv_fold", folds=5)
    return evaluate.cv_summary(evaluate.fold_scores(scores, fold="cv_fold"))


# The settings that were searched, as far as Spark has them (there is no split minimum).
GRID = {"stepSize": [0.1, 0.15, 0.2], "maxIter": [100, 120, 130], "minInstancesPerNode": [1, 2, 3], "maxDepth": [3, 5, 7]}


def full_grid(trees) -> list[dict]:
    """All 81 settings."""
    grid = ParamGridBuilder()
    for name, values in GRID.items():
        grid = grid.addGrid(trees.getParam(name), values)
    return grid.build()


@query
def grid_search(spark, sf_dir):
    """Four of the settings with few rounds; ``full_grid`` has all 81, which are 243 fits of over 100 rounds."""
    trees = models.boosted_trees(rounds=5)
    grid = ParamGridBuilder().addGrid(trees.stepSize, [0.1, 0.2]).addGrid(trees.maxDepth, [3, 5]).build()
    return models.grid_search(training_set(spark, sf_dir).train, trees, grid)[0]


@query
def feature_importance(spark, sf_dir):
    data = training_set(spark, sf_dir)
    return models.feature_importance(spark, models.random_forest().fit(data.train), data.encoder.names())


@query
def permutation_importance(spark, sf_dir):
    """Of the stack, which has no weights of its own: the accuracy lost on the holdout by permuting each column."""
    data = training_set(spark, sf_dir)
    table = importance.permutation_importance(training.stacked(data.n_train).fit(data.train), data.val, data.encoder.names())
    return table.select("Features", *[F.round(c, 6).alias(c) for c in ("Importance", "Deviation")])


# The base sets and second levels that were compared.
LEADERBOARD = (
    (("RF", "LGBM", "bayes", "SVM", "LR"), "SVM"),
    (("RF", "LR"), "GaussianNB"),
    (("RF", "LGBM", "SVM", "LR"), "GaussianNB"),
    (("RF", "LGBM"), "GaussianNB"),
    (("RF", "LGBM", "XGBoost", "cart"), "GaussianNB"),
    (("RF", "LGBM", "XGBoost", "cart", "LR"), "GaussianNB"),
    (("RF", "XGBoost", "LR"), "GaussianNB"),
    (("XGBoost", "LR"), "GaussianNB"),
    (("RF", "XGBoost", "LR"), "LR"),
    (("RF", "LGBM", "SVM", "LR"), "LR"),
)


@query
def model_leaderboard(spark, sf_dir):
    """Every base is fitted once per fold and once on all rows; each line then refits the second level only."""
    data = training_set(spark, sf_dir)
    n = data.n_train
    bases = {
        "RF": models.random_forest(), "LGBM": models.boosted_trees(), "XGBoost": models.boosted_trees(rounds=100, seed=0),
        "SVM": models.max_margin(n), "LR": models.logistic(n), "cart": models.decision_tree(), "bayes": models.gaussian_bayes(),
    }
    oof, fitted = stacking.out_of_fold_and_whole(data.train, bases, training.FOLDS, threads=training.side_by_side(n))
    metas = {
        "GaussianNB": models.gaussian_bayes(),
        "LR": models.logistic(n),
        "SVM": models.max_margin(n),
    }
    lines = []
    for names, meta in LEADERBOARD:
        second = stacking.fit_meta(oof, list(names), metas[meta].setFeaturesCol(stacking.META))
        model = stacking.StackingModel({b: fitted[b] for b in names}, second)
        lines.append(quality(f"[{', '.join(names)}], [{meta}]", model, data))
    table = lines[0]
    for line in lines[1:]:
        table = table.unionByName(line)
    return table.orderBy(F.desc("val_accuracy"), "model")


@query
def training_curve(spark, sf_dir):
    """Loss by step on training and holdout rows: of the network, in stages of ten iterations, and of the boosted trees."""
    data = training_set(spark, sf_dir, ratios=True)
    trees = models.boosted_trees().fit(data.train)
    curves = {
        ("GBT", "loss"): trees.evaluateEachIteration(data.train),
        ("GBT", "val_loss"): trees.evaluateEachIteration(data.val),
        **{("MLP", name): values for name, values in models.network_curve(data.train, data.val, len(data.encoder.names())).items()},
    }
    rows = [(m, c, i, float(v)) for (m, c), values in curves.items() for i, v in enumerate(values, 1)]
    return small_table(spark, rows, "model string, curve string, step int, value double")
