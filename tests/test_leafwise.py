"""Best-first trees against a plain grower that splits one leaf at a time, and what the caps allow."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from purser.operators import evaluate, features, leafwise, models
from purser.operators.leafwise import UNIT


@pytest.fixture(scope="module")
def toy(spark):
    x = spark.range(500).select(
        F.concat(F.lpad(F.col("id").cast("string"), 4, "0"), F.lit("_01")).alias("PassengerId"),
        F.round(F.randn(1), 1).alias("a"), F.round(F.randn(2), 1).alias("b"), (F.rand(3) > 0.5).cast("double").alias("c"))
    x = x.withColumn("label", (F.col("a") * F.col("b") + F.col("c") > 0.4).cast("double"))
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(x)
    return features.with_fold(features.holdout(rows), 3, seed=17).coalesce(2).cache()


def plain_tree(bins, g, h, growth):
    """Leaf by leaf: every leaf's best split by direct sums; the largest gain is split next."""

    def best(at):
        rows = np.flatnonzero(at["rows"])
        at["gain"] = 0
        if at["depth"] >= growth.depth or len(rows) < growth.least_split:
            return at
        for c in range(bins.shape[1]):
            for b in range(leafwise.BINS):
                left = bins[rows, c] <= b
                sides = [rows[left], rows[~left]]
                if min(map(len, sides)) < max(growth.least_rows, 1) or min(h[s].sum() for s in sides) < leafwise.LEAST_WEIGHT * UNIT:
                    continue
                gain = sum(g[s].sum() ** 2 / h[s].sum() for s in sides) - g[rows].sum() ** 2 / h[rows].sum()
                if gain > at["gain"] and gain > 1e-6 * UNIT:
                    at |= {"gain": gain, "column": c, "bin": b}
        return at

    root = best({"rows": np.ones(len(g), bool), "depth": 0})
    leaves = [root]
    while len(leaves) < growth.leaves:
        top = max(leaves, key=lambda x: x["gain"])
        if top["gain"] <= 0:
            break
        leaves = [x for x in leaves if x is not top]
        left = top["rows"] & (bins[:, top["column"]] <= top["bin"])
        top["left"], top["right"] = (best({"rows": r, "depth": top["depth"] + 1}) for r in (left, top["rows"] & ~left))
        leaves += [top["left"], top["right"]]

    def nested(at):
        if "left" not in at:
            return {"value": -float(g[at["rows"]].sum()) / float(h[at["rows"]].sum())}
        return {"column": at["column"], "bin": at["bin"], "left": nested(at["left"]), "right": nested(at["right"])}

    return nested(root)


def same(a, b):
    if "value" in a or "value" in b:
        return math.isclose(a["value"], b["value"], rel_tol=1e-9)
    return (a["column"], a["bin"]) == (b["column"], b["bin"]) and same(a["left"], b["left"]) and same(a["right"], b["right"])


def count_leaves(tree):
    return 1 if "value" in tree else count_leaves(tree["left"]) + count_leaves(tree["right"])


@pytest.mark.parametrize("growth", [leafwise.Growth(35, 15, 3), leafwise.Growth(6, 3, 20), leafwise.Growth(1, 5, 1), leafwise.Growth(50, 4, 1, 40)])
def test_the_tree_is_the_plain_growers(spark, growth):
    pick = np.random.default_rng(growth.leaves)
    bins = pick.integers(0, 9, (400, 4))
    g = np.round((pick.random(400) - (bins[:, 0] * bins[:, 1] > 16)) * UNIT).astype(int)
    h = np.round((0.1 + pick.random(400)) * UNIT).astype(int)
    rows = spark.createDataFrame([(b.tolist(), int(x), int(y)) for b, x, y in zip(bins, g, h)], "bins array<int>, g long, h long").repartition(3)
    tree = leafwise.grow(rows, 4, growth)
    assert same(tree, plain_tree(bins, g, h, growth)) and count_leaves(tree) <= growth.leaves
    if growth.leaves == 35:
        assert count_leaves(tree) == 35


def test_boosted_trees_learn_and_can_be_saved(toy, tmp_path):
    train = toy.where("split = 'train'")
    model = models.leafwise_boosted(rounds=4, least_rows=5).fit(train)
    out = models.scored(model, toy)
    assert set(out.columns) == {*toy.columns, "score", "prediction"}
    assert evaluate.accuracy_by_split(out).first()["val_accuracy"] > 80 and out.where("score < 0 or score > 1").count() == 0
    assert all(1 < count_leaves(t) <= 35 for t in model.trees)
    model.write().overwrite().save(str(tmp_path / "model"))
    again = leafwise.LeafwiseModel.load(str(tmp_path / "model"))
    assert again.uid == model.uid
    scores = [sorted((r["PassengerId"], r["score"]) for r in models.scored(m, toy).collect()) for m in (model, again)]
    assert scores[0] == scores[1]


def test_forest_keeps_its_caps(toy):
    model = models.leafwise_forest(trees=3, columns=2).fit(toy.where("split = 'train'"))
    assert len(model.trees) == 3 and all(1 < count_leaves(t) <= 30 for t in model.trees)
    out = models.scored(model, toy)
    assert evaluate.accuracy_by_split(out).first()["val_accuracy"] > 75 and out.where("score < 0 or score > 1").count() == 0


def test_no_rows(toy):
    with pytest.raises(ValueError, match="no rows"):
        models.leafwise_boosted().fit(toy.limit(0))


def test_trees_of_a_forest_share_their_jobs(spark, toy):
    """Before, each tree of a forest was grown for itself: four times the jobs of one."""
    jobs = {}
    for trees in (1, 4):
        group = f"forest-{trees}"
        spark.sparkContext.setJobGroup(group, group)
        models.leafwise_forest(trees=trees, columns=2).fit(toy)
        jobs[trees] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[4] < 2 * jobs[1]


def test_a_tree_is_not_written_between_rounds(toy, monkeypatch):
    """Before, the margins were written to the shared folder after every second tree."""
    names, written = [], leafwise.written
    monkeypatch.setattr(leafwise, "written", lambda df, name: names.append(name) or written(df, name))
    assert len(models.leafwise_boosted(rounds=5).fit(toy).trees) == 5 and names == ["binned"]
