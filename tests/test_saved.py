"""Fitted models, encoders and means that are written and loaded again; the curved margin and its kernel."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from purser.main import run, score_saved
from purser.operators import curved, evaluate, features, models, stacking
from purser.plans import training
from purser.sources.derived import manifest
from purser.streaming.scoring import manifest_stream, score_stream


@pytest.fixture(scope="module")
def ring(spark):
    """Points inside a circle against those around it: no line parts them."""
    x = spark.range(600).select(
        F.concat(F.lpad(F.col("id").cast("string"), 4, "0"), F.lit("_01")).alias("PassengerId"), F.randn(1).alias("a"), F.randn(2).alias("b"))
    x = x.withColumn("label", (F.col("a") * F.col("a") + F.col("b") * F.col("b") > 1.4).cast("double"))
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(x)
    return features.with_fold(features.holdout(rows), 3, seed=17).coalesce(1).cache()


@pytest.mark.parametrize("gamma", [0.05, 0.5])
def test_cosines_stand_for_the_kernel(gamma):
    x = np.random.default_rng(1).standard_normal((80, 6))
    exact = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
    off = {}
    for size in (64, 512, 4096):
        z = curved.cosines(x, size, gamma, 3)
        off[size] = np.abs(z @ z.T - exact)
        assert off[size].mean() < 1 / np.sqrt(size) and off[size].max() < 6 / np.sqrt(size)
    assert off[4096].mean() < off[64].mean() / 4


def test_curved_margin_parts_a_ring(ring, spark, tmp_path):
    train = ring.where("split = 'train'")
    fitted = models.curved_margin(500).fit(train)
    gamma = fitted.stages[0].getOrDefault("gamma")
    flat = np.array([r["features"].toArray() for r in train.collect()])
    assert gamma == pytest.approx(1 / (2 * flat.var()))
    accuracy = {name: evaluate.accuracy_by_split(models.scored(m, ring)).first()["val_accuracy"]
                for name, m in (("curved", fitted), ("linear", models.max_margin(500).fit(train)))}
    assert accuracy["curved"] > 90 > 75 > accuracy["linear"]
    fitted.write().save(str(tmp_path / "curved"))
    again = type(fitted).load(str(tmp_path / "curved"))
    assert scores(again, ring) == scores(fitted, ring)
    assert fitted.stages[0].transform(ring.limit(0)).count() == 0
    with pytest.raises(ValueError, match="no rows"):
        models.curved_margin(1).fit(ring.limit(0))


def scores(model, df):
    return sorted((r["PassengerId"], r["score"]) for r in models.scored(model, df).collect())


def test_stack_is_saved_and_loaded(ring, tmp_path):
    bases = {"ridge": models.ridge(500), "LR": models.logistic(500), "tree": models.decision_tree(features=2)}
    stack = stacking.Stacking(bases, models.gaussian_bayes(stacking.META), folds=3, threads=1)
    stack.write().save(str(tmp_path / "stack"))
    again = stacking.Stacking.load(str(tmp_path / "stack"))
    assert (again.uid, list(again.bases), again.folds, again.fold, again.threads) == (stack.uid, list(bases), 3, "fold", 1)
    fitted = again.fit(ring.where("split = 'train'"))
    fitted.write().save(str(tmp_path / "fitted"))
    loaded = stacking.StackingModel.load(str(tmp_path / "fitted"))
    assert list(loaded.bases) == list(bases) and loaded.uid == fitted.uid
    assert scores(loaded, ring) == scores(fitted, ring)
    with pytest.raises(Exception, match="(?i)exists"):
        fitted.write().save(str(tmp_path / "fitted"))


def test_saved_scoring_equals_scoring_at_once(spark, sf_dir, tmp_path):
    """From files: a run that saves, then another session, and a stream, by what was saved."""
    names = ("train", "inbox", "out", "again", "model", "streamed", "progress")
    train, inbox, out, again, model, streamed, progress = (str(tmp_path / name) for name in names)
    manifest(spark, sf_dir, split="train").write.csv(train, header=True)
    manifest(spark, sf_dir, split="score").drop("Transported").coalesce(1).write.csv(inbox, header=True)
    run(spark, train, inbox, out, model="logistic", save=model)
    other = spark.newSession()
    score_saved(other, model, inbox, again)
    encoder, fitted, means = training.load_fitted(other, model)
    score_stream(manifest_stream(spark, inbox), encoder, fitted, means, streamed, progress).awaitTermination(300)
    results = [sorted(map(tuple, spark.read.csv(p, header=True).collect())) for p in (out, again, f"{streamed}/batch=0")]
    assert results[0] and results[0] == results[1] == results[2]
