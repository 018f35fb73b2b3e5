"""Cases of the findings: observed sessions, steps in one pass, numbers by key, tallies by task."""

from threading import Barrier

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from purser.operators import groups, leafwise, models, repair
from purser.plans import cleaning, training
from purser.sources.derived import manifest


def test_models_score_after_a_watched_cleaning(spark, sf_dir):
    """A session that has observed a table can't serialise a model with a training summary."""
    session = spark.newSession()
    cleaning.watched_clean_train(manifest(session, sf_dir), ("Age", "VIP"))
    rows = session.range(40).select((F.col("id") % 2).cast("double").alias("label"), F.col("id").cast("double").alias("a"))
    rows = VectorAssembler(inputCols=["a"], outputCol="features").transform(rows)
    assert len(models.scored(models.logistic(40).fit(rows), rows).collect()) == 40


def test_one_step_equals_propagating_and_then_filling(spark):
    rows = [(f"{g}_{i:02d}", None if g == 9 else f"g{g}", v, d) for g in range(10) for i, (v, d) in enumerate(
        [("A", "x"), (None, "x"), ("B", None), ("A", "y" if g % 2 else None)], 1)]
    df = spark.createDataFrame(rows, "id string, g string, v string, d string")
    one = repair.propagate_with_only(df, "g", ["v"], "id", F.col("d"), "_only").withColumn("d", F.coalesce("d", "_only")).drop("_only")
    two = repair.fill_if_unique(repair.propagate_group_value(df, "g", ["v"], "id"), "g", "d")
    assert sorted(one.collect(), key=str) == sorted(two.select(*one.columns).collect(), key=str)


def test_small_groups_are_numbered_in_one_shuffle(spark, monkeypatch):
    df = spark.range(600).selectExpr("if(id % 50 = 0, null, id % 3) g", "id % 5 a", "if(id % 40 = 1, null, id % 7) b", "id").cache()
    slot = F.col("a") * 100 + F.floor(F.col("b") / 3)
    whole = groups.number_rows(df, "g", ("a", "b", "id"), slot)
    assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(groups, "LARGE", 1)
    parts = groups.number_rows(df, "g", ("a", "b", "id"), slot)
    assert sorted(whole.collect()) == sorted(parts.select(*whole.columns).collect()) and whole.count() < 600


def test_tallies_are_the_sums_of_the_rows(spark):
    df = spark.range(500).selectExpr("array(cast(id % 4 as int), cast(id % 7 as int)) bins", "if(id = 3, null, id * 1000 - 7) g", "id h").repartition(3)
    root = leafwise.Leaf(1, 0, np.zeros((2, leafwise.BINS, 3)))
    root.column, root.bin = 0, 1
    found = leafwise._sums(df, {2, 3}, {1: root}, (2, leafwise.BINS, 3))
    expected = {n: np.zeros((2, leafwise.BINS, 3)) for n in (2, 3)}
    for i in range(500):
        for column, b in ((0, i % 4), (1, i % 7)):
            expected[2 + (i % 4 > 1)][column, b] += (0 if i == 3 else i * 1000 - 7, i, 1)
    assert set(found) == {2, 3} and all((found[n] == expected[n]).all() for n in found)


def test_files_of_the_training_set_have_few_rows(spark, sf_dir, monkeypatch):
    """A scan puts at most 32 files into one task, so its rows are bounded however few bytes they take."""
    monkeypatch.setattr(training, "FILE_ROWS", 50)
    rows = training.training_set(manifest(spark, sf_dir)).rows
    files = rows.groupBy(F.input_file_name()).count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    assert files["most"] <= 50 and files["all"] == rows.count() > 1000


def test_fits_side_by_side_share_no_job_properties(spark):
    """One query's number, cleared while another looked for its own, was "Cannot parse null string"."""
    sc = spark.sparkContext
    sc.setLocalProperty("purser.caller", "here")
    both = Barrier(2)

    def one(name):
        sc.setLocalProperty("purser.test", name)
        both.wait(60)
        return sc.getLocalProperty("purser.test"), sc.getLocalProperty("purser.caller")

    assert models.in_parallel(spark, [lambda n=n: one(n) for n in "ab"], 2) == [("a", "here"), ("b", "here")]
    sc.setLocalProperty("purser.caller", None)
