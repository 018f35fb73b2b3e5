"""Classifiers, their scores, and what is read off a fitted one.

Each function returns an unfitted Spark ML estimator with the reference settings carried
over as far as Spark has them. What Spark lacks is named in the docstring.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import Future
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Binarizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from purser.session import small_table


def random_forest(trees: int = 15, depth: int = 5, features: int = 8, seed: int = 17) -> Estimator:
    """15 trees on 8 columns each. Spark has no leaf cap or split minimum: depth 5 stands in for 30 leaves."""
    return RandomForestClassifier(
        numTrees=trees, maxDepth=depth, featureSubsetStrategy=str(features), minInstancesPerNode=6, seed=seed
    )


def boosted_trees(step: float = 0.15, rounds: int = 30, depth: int = 5, leaf: int = 1, seed: int = 13) -> Estimator:
    """30 rounds at step 0.15. Depth 5 stands in for the cap of 35 leaves."""
    from purser.operators.boosting import BoostedTrees

    return BoostedTrees(stepSize=step, maxIter=rounds, maxDepth=depth, minInstancesPerNode=leaf, seed=seed)


def leafwise_boosted(step: float = 0.15, rounds: int = 30, leaves: int = 35, depth: int = 15, least_rows: int = 20) -> Estimator:
    """30 rounds at step 0.15 of trees with at most 35 leaves, grown best first."""
    from purser.operators.leafwise import LeafwiseTrees

    return LeafwiseTrees(kind="boosted", step=step, rounds=rounds, leaves=leaves, depth=depth, least_rows=least_rows)


def leafwise_forest(trees: int = 15, leaves: int = 30, columns: int = 8, seed: int = 17) -> Estimator:
    """15 trees of at most 30 leaves, each split on the best of 8 columns, of 6 rows at least; what has under 5 is not split."""
    from purser.operators.leafwise import LeafwiseTrees

    return LeafwiseTrees(kind="forest", rounds=trees, leaves=leaves, depth=40, least_rows=6, least_split=5, columns=columns, seed=seed)


def max_margin(rows: int, c: float = 3.0) -> Estimator:
    """Linear machine at cost ``c``: the kernel machine needs all pairs of rows, this one needs sums over them."""
    from purser.operators.margin import MarginMachine

    return MarginMachine(regParam=1.0 / (c * max(rows, 1)))


def curved_margin(rows: int, c: float = 3.0, size: int = 512, seed: int = 13) -> Estimator:
    """The machine of ``max_margin`` over random cosines that stand for a radial kernel: its boundary is curved."""
    from purser.operators.curved import CurvedMargin

    return CurvedMargin(outputCol="curved", size=size, seed=seed, regParam=1.0 / (c * max(rows, 1)))


def logistic(rows: int, iterations: int = 2000) -> Estimator:
    """Unit cost; the loss here is a mean, hence 1/rows. The intercept is not penalised."""
    return LogisticRegression(regParam=1.0 / max(rows, 1), elasticNetParam=0.0, standardization=False, maxIter=iterations)


def gaussian_bayes(features: str = "features") -> Estimator:
    return NaiveBayes(modelType="gaussian", featuresCol=features)


def decision_tree(depth: int = 5, features: int = 9, seed: int = 13) -> Estimator:
    """One tree over all rows on 9 columns at each node. Depth 5 stands in for the cap of 30 leaves."""
    return RandomForestClassifier(
        numTrees=1, bootstrap=False, maxDepth=depth, featureSubsetStrategy=str(features), minInstancesPerNode=3, seed=seed
    )


def ridge(rows: int, alpha: float = 1.0) -> Estimator:
    """Penalised least squares on 0/1, cut at one half: the same boundary as on -1/1, cut at zero."""
    line = LinearRegression(regParam=alpha / max(rows, 1), elasticNetParam=0.0, standardization=False, predictionCol="score")
    return Pipeline(stages=[line, Binarizer(threshold=0.5, inputCol="score", outputCol="prediction")])


def feed_forward(width: int, iterations: int = 100, seed: int = 13) -> Estimator:
    """Hidden layers 64, 512 and 32. Spark's perceptron has no dropout, batch norm or early stop; its fit is done in NumPy."""
    from purser.operators.network import BatchedPerceptron

    return BatchedPerceptron(layers=[width, 64, 512, 32, 2], maxIter=iterations, seed=seed)


def network_curve(
    train: DataFrame, val: DataFrame, width: int, stages: int = 5, iterations: int = 10,
) -> dict[str, list[float]]:
    """Log loss on both tables after each stage; a stage goes on from the weights of the one before. Both are packed once."""
    from purser.operators.network import log_loss

    curve: dict[str, list[float]] = {"loss": [], "val_loss": []}
    network, spark = feed_forward(width, iterations), train.sparkSession
    blocks = {name: network.blocks(rows) for name, rows in (("loss", train), ("val_loss", val))}
    try:
        for _ in range(stages):
            weights = network.descend(spark, blocks["loss"])
            network = network.copy({network.initialWeights: DenseVector(weights)})
            for name, rows in blocks.items():
                curve[name].append(log_loss(rows, weights, list(network.getLayers())))
    finally:
        for rows in blocks.values():
            rows.unpersist()
    return curve


def scored(model: Model, df: DataFrame, name: str = "score", keep_prediction: bool = True) -> DataFrame:
    """``df`` with the model's score: P(class 1), the margin of a margin machine, or the fitted line."""
    out = model.transform(df)
    if "probability" in out.columns:
        score = vector_to_array("probability")[1]
    elif "rawPrediction" in out.columns:
        score = vector_to_array("rawPrediction")[1]
    else:
        score = F.col("score")
    cols = [F.col(c) for c in df.columns] + [score.alias(name)]
    return out.select(*cols, *([F.col("prediction").cast("int").alias("prediction")] if keep_prediction else []))


def in_parallel(spark: SparkSession, jobs: Iterable[Callable[[], object]], threads: int) -> list:
    """Run independent fits side by side, results in order; each keeps a copy of the caller's job properties.

    A copy of its own: a query sets and clears its number there while it runs.
    """
    jobs = [inheritable_thread_target(spark)(job) for job in jobs]
    with ThreadPool(max(1, min(threads, len(jobs)))) as pool:
        return pool.map(lambda job: job(), jobs, chunksize=1)


def fit_parts(df: DataFrame, estimators: Mapping[str, Estimator], parts: Sequence[Column], threads: int, run: Callable = in_parallel) -> list[dict[str, Model]]:
    """The estimators fitted on each part (a condition) of the rows; no fit waits for another.

    Those that can fit all parts side by side (``fit_parts``) begin first, and what waits for one of them comes last.
    """
    together = {name: Future() for name, e in estimators.items() if hasattr(e, "fit_parts")}

    def lead(name: str) -> Model:
        try:
            together[name].set_result(estimators[name].fit_parts(df, parts))
        except BaseException as failed:
            together[name].set_exception(failed)
        return together[name].result()[0]

    jobs = {(name, 0): lambda name=name: lead(name) for name in together}
    jobs |= {(name, i): lambda part=part, e=e: e.fit(df.where(part)) for i, part in enumerate(parts) for name, e in estimators.items() if name not in together}
    jobs |= {(name, i): lambda name=name, i=i: together[name].result()[i] for name in together for i in range(1, len(parts))}
    fitted = dict(zip(jobs, run(df.sparkSession, list(jobs.values()), threads), strict=True))
    return [{name: fitted[name, i] for name in estimators} for i in range(len(parts))]


def held_out_scores(df: DataFrame, estimator: Estimator, fold: str = "fold", folds: int = 5, threads: int = 2) -> DataFrame:
    """Every row scored by the model fitted on the other folds."""
    models = fit_parts(df, {"model": estimator}, [F.col(fold) != i for i in range(folds)], threads)
    first, *rest = [scored(m["model"], df.where(F.col(fold) == i)) for i, m in enumerate(models)]
    for part in rest:
        first = first.unionByName(part)
    return first


#: What the side by side search of boosted trees knows, and what else may be set without a change to its trees.
BOOSTING = {"stepSize", "maxIter", "maxDepth", "minInstancesPerNode"}
BESIDE = {"seed", "featuresCol", "labelCol"}


def grid_search(
    df: DataFrame, estimator: Estimator, grid: list[dict], fold: str = "fold", folds: int = 3, threads: int = 2
) -> tuple[DataFrame, Model]:
    """Mean held-out accuracy of every setting, best first, and the best model refitted on all rows.

    Settings of boosted trees are fitted side by side over rows that are read together (``boosting``).
    """
    scores = _boosted_scores(df, estimator, grid, fold, folds)
    if scores is not None:
        mean, deviation = scores.mean(0), scores.std(0)
        best = estimator.fit(df, grid[int(mean.argmax())])
    else:
        accuracy = MulticlassClassificationEvaluator(metricName="accuracy")
        search = CrossValidator(
            estimator=estimator, estimatorParamMaps=grid, evaluator=accuracy, numFolds=folds, foldCol=fold, parallelism=threads
        ).fit(df)
        mean, deviation, best = search.avgMetrics, search.stdMetrics, search.bestModel
    rows = [
        (", ".join(f"{p.name}={v}" for p, v in sorted(params.items(), key=lambda kv: kv[0].name)), float(m), float(s))
        for params, m, s in zip(grid, mean, deviation)
    ]
    table = small_table(df.sparkSession, rows, "params string, mean_score double, std_score double")
    return table.orderBy(F.desc("mean_score"), "params"), best


def _boosted_scores(df: DataFrame, estimator: Estimator, grid: list[dict], fold: str, folds: int) -> np.ndarray | None:
    """Accuracies by (fold, setting), or None where the search holds more than boosted trees' plain settings over numbers."""
    if not isinstance(estimator, GBTClassifier) or not grid:
        return None
    from purser.operators.boosting import Setting, held_out_accuracy, plain

    each = [estimator.copy(params) for params in grid]
    if not all(plain(df, e) for e in each):
        return None
    settings = [Setting(e.getStepSize(), e.getMaxIter(), e.getMaxDepth(), e.getMinInstancesPerNode()) for e in each]
    return held_out_accuracy(df, settings, fold, folds, estimator.getFeaturesCol(), estimator.getLabelCol(), estimator.getSeed())


def feature_importance(spark: SparkSession, model: Model, names: Sequence[str]) -> DataFrame:
    """Importance per input column, largest first; of a linear model its absolute coefficients."""
    weights = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    rows = [(n, abs(float(w))) for n, w in zip(names, weights.toArray(), strict=True)]
    table = small_table(spark, rows, "Features string, Importance double")
    return table.orderBy(F.desc("Importance"), "Features")
