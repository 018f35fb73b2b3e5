"""The search of boosted trees side by side against Spark's own trees and cross-validation."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from purser.operators import boosting, features, models


@pytest.fixture(scope="module")
def rows(spark):
    """Numbers, flags, a column of one value and one of more values than bins."""
    x = spark.range(1500).select(
        F.concat(F.lpad(F.col("id").cast("string"), 4, "0"), F.lit("_01")).alias("PassengerId"), F.randn(1).alias("a"), F.randn(2).alias("b"),
        (F.rand(3) > 0.7).cast("double").alias("c"), F.floor(F.rand(4) * 5).cast("double").alias("d"), F.lit(0.0).alias("e"),
        F.floor(F.rand(5) * 40).cast("double").alias("f"))
    x = x.withColumn("label", (F.col("a") * F.col("a") + F.col("b") * F.col("d") + F.col("c") + F.randn(6) > 1.4).cast("double"))
    return features.with_fold(VectorAssembler(inputCols=list("abcdef"), outputCol="features").transform(x), 3, seed=17).cache()


def test_scores_are_those_of_spark(rows):
    """Before, every setting was fitted for itself: more jobs with each of them."""
    trees = models.boosted_trees(rounds=3)
    grid = (ParamGridBuilder().addGrid(trees.stepSize, [0.1, 0.3]).addGrid(trees.maxDepth, [0, 2, 4])
            .addGrid(trees.minInstancesPerNode, [1, 20]).addGrid(trees.maxIter, [1, 3]).build())
    scores = models._boosted_scores(rows, trees, grid, "fold", 3)
    assert scores.shape == (3, len(grid)) and len(set(scores.ravel().tolist())) > 10
    some = [i for i, p in enumerate(grid) if p[trees.stepSize] == 0.3 and p[trees.maxIter] == 3]
    search = CrossValidator(estimator=trees, estimatorParamMaps=[grid[i] for i in some], numFolds=3, foldCol="fold",
                            evaluator=MulticlassClassificationEvaluator(metricName="accuracy")).fit(rows)
    assert scores[:, some].mean(0).tolist() == pytest.approx(search.avgMetrics, abs=1e-12)
    assert scores[:, some].std(0).tolist() == pytest.approx(search.stdMetrics, abs=1e-12)


def test_search_reads_the_rows_together(spark, rows):
    """Six fits take as many jobs as one, but for those that count their hits."""
    trees = models.boosted_trees(rounds=2, depth=2)
    jobs = {}
    for steps in ([0.1], [0.1, 0.2]):
        group = f"search-{len(steps)}"
        spark.sparkContext.setJobGroup(group, group)
        models._boosted_scores(rows, trees, ParamGridBuilder().addGrid(trees.stepSize, steps).build(), "fold", 3)
        jobs[len(steps)] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] == jobs[2]


def test_other_searches_are_left_to_spark(rows):
    trees = models.boosted_trees(rounds=1)
    assert models._boosted_scores(rows, trees, [{trees.maxBins: 16}], "fold", 3) is None
    assert models._boosted_scores(rows, models.boosted_trees().setSubsamplingRate(0.5), [{}], "fold", 3) is None
    line = models.logistic(1000)
    assert models._boosted_scores(rows, line, [{line.regParam: 0.1}], "fold", 3) is None


def test_thresholds_lie_between_values_or_at_even_ranks():
    values = np.arange(1.0, 11.0)
    assert boosting.thresholds(values, np.ones(10), 10, 9) == (values[:-1] + 0.5).tolist()
    assert boosting.thresholds(values, np.ones(10), 10, 4) == [2.5, 4.5, 6.5, 8.5]
    assert boosting.thresholds(np.array([-1.0, 1.0, 2.0]), np.array([1.0, 1.0, 1.0]), 100, 2) == [-0.5, 0.5]  # 97 zeros
    assert boosting.thresholds(np.array([1.0]), np.array([5.0]), 12, 31) == [0.5]
    assert boosting.thresholds(np.array([]), np.array([]), 12, 31) == boosting.thresholds(np.array([3.0]), np.array([5.0]), 5, 31) == []


def test_scores_are_those_of_spark_where_thresholds_are_drawn(rows):
    """More rows than thresholds are taken from: the same rows are drawn."""
    many = rows.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(12)))).withColumn("noise", F.rand(8)).drop("features")
    many = VectorAssembler(inputCols=["a", "b", "d", "noise"], outputCol="features").transform(many).cache()
    trees = models.boosted_trees(rounds=2)
    search = CrossValidator(estimator=trees, estimatorParamMaps=[{trees.maxDepth: 4}], numFolds=3, foldCol="fold",
                            evaluator=MulticlassClassificationEvaluator(metricName="accuracy")).fit(many)
    assert models._boosted_scores(many, trees, [{trees.maxDepth: 4}], "fold", 3).mean(0).tolist() == pytest.approx(search.avgMetrics, abs=1e-12)
    many.unpersist()


def test_columns_that_share_a_code_are_told_apart():
    bins = [2, 32, 2, 7, 1, 32, 2, 2]
    layout = boosting.layout_of(bins)
    assert layout.codes < len(bins)
    rng = np.random.default_rng(1)
    rows = np.stack([rng.integers(0, n, 500) for n in bins], 1)
    sums = np.zeros((layout.codes, boosting.CODES), np.int64)
    codes = np.zeros((500, layout.codes), np.int64)
    for c in range(len(bins)):
        codes[:, layout.code[c]] += rows[:, c] * layout.unit[c]
    assert codes.max() < boosting.CODES
    for c in range(layout.codes):
        sums[c] = np.bincount(codes[:, c], minlength=boosting.CODES)
    for c, mine in enumerate(layout.by_column(sums)):
        assert mine.tolist() == np.bincount(rows[:, c], minlength=max(bins)).tolist()


@pytest.mark.parametrize(("column", "value", "what"), [("label", "2", "labels"), ("label", "null", "labels"), ("fold", "3", "not in"), ("fold", "null", "not in")])
def test_rows_that_cannot_be_fitted_are_an_error(rows, column, value, what):
    trees = models.boosted_trees(rounds=1)
    bad = rows.withColumn(column, F.when(F.col("a") > 2, F.expr(value)).otherwise(F.col(column)))
    with pytest.raises(Exception, match=what):
        models._boosted_scores(bad, trees, [{trees.maxDepth: 1}], "fold", 3)


def test_models_are_those_of_spark(rows, tmp_path):
    """Fits of several parts give Spark's own models; in leaves of many rows no two columns gain the same."""
    ours = models.boosted_trees(rounds=4, depth=3, leaf=40)
    theirs = GBTClassifier(stepSize=0.15, maxIter=4, maxDepth=3, minInstancesPerNode=40, seed=13)
    parts = [F.col("fold") != 0, F.col("fold") == 1, F.lit(True)]
    for part, model in zip(parts, ours.fit_parts(rows, parts), strict=True):
        plain = theirs.fit(rows.where(part))
        assert type(model) is type(plain) and model.treeWeights == plain.treeWeights and model.getMaxDepth() == 3
        assert [t.numNodes for t in model.trees] == [t.numNodes for t in plain.trees]
        assert model.featureImportances.toArray() == pytest.approx(plain.featureImportances.toArray(), abs=1e-6)
        assert model.evaluateEachIteration(rows) == pytest.approx(plain.evaluateEachIteration(rows), abs=1e-6)
        scores = [[r["score"] for r in models.scored(m, rows).orderBy("PassengerId").collect()] for m in (model, plain)]
        assert scores[0] == pytest.approx(scores[1], abs=1e-6)
    model.write().save(str(tmp_path / "model"))
    again = type(model).load(str(tmp_path / "model"))
    assert [r["score"] for r in models.scored(again, rows).orderBy("PassengerId").collect()] == scores[0]


def test_parts_take_no_jobs_of_their_own(spark, rows):
    """Before, each part's trees were grown for themselves."""
    trees = models.boosted_trees(rounds=3, depth=2)
    jobs = {}
    for parts in ([0], [0, 1, 2]):
        group = f"parts-{len(parts)}"
        spark.sparkContext.setJobGroup(group, group)
        trees.fit_parts(rows, [F.col("fold") != i for i in parts])
        jobs[len(parts)] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] == jobs[3]
