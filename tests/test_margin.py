"""The margin machine against Spark's, for several parts of a table at once."""

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from purser.operators import margin, models


@pytest.fixture(scope="module")
def rows(spark):
    x = spark.range(0, 3000, 1, 3).select((F.col("id") % 3).alias("fold"), F.randn(1).alias("a"), (F.randn(2) * 50 + 9).alias("b"),
                                         F.lit(0.1).alias("c"), (F.rand(4) > 0.9).cast("double").alias("d"))
    x = x.withColumn("label", (F.col("a") + F.col("b") / 50 + F.col("d") + F.randn(5) > 0.6).cast("double"))
    return VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(x).cache()


def test_machines_of_all_parts_are_sparks(rows):
    parts = [F.col("fold") != 0, F.col("fold") == 1, F.lit(True), F.when(F.col("fold") > 0, True)]
    machine = models.max_margin(2000).setMaxIter(15)  # later steps part where a row lies on the margin but for rounding
    for part, model in zip(parts, machine.fit_parts(rows, parts), strict=True):
        plain = LinearSVC(regParam=1 / 6000, maxIter=15).fit(rows.where(part))
        assert type(model) is type(plain) and model.getRegParam() == plain.getRegParam()
        assert model.coefficients.toArray() == pytest.approx(plain.coefficients.toArray(), abs=1e-6) and model.coefficients[2] == 0
        assert model.intercept == pytest.approx(plain.intercept, abs=1e-6)
        alone = machine.fit(rows.where(part))
        assert alone.coefficients == model.coefficients and alone.intercept == model.intercept


def test_parts_share_their_passes(spark, rows):
    """Before, each part's machine made its own passes."""
    jobs = {}
    for n in (1, 6):
        group = f"margin-{n}"
        spark.sparkContext.setJobGroup(group, group)
        models.max_margin(2000).setMaxIter(5).fit_parts(rows, [F.lit(True)] * n)
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] == jobs[6]


def test_what_is_no_number_class_or_row(rows):
    for bad in (rows.withColumn("label", F.lit(2.0)), rows.limit(0), rows.withColumn("label", F.lit(None).cast("double"))):
        with pytest.raises(Exception):
            models.max_margin(10).fit(bad)


def test_a_failed_pass_reaches_every_asker():
    def fails(asked):
        raise ValueError("no pass")

    together = margin.Together(1, fails)
    with pytest.raises(ValueError, match="no pass"):
        together.ask(0, np.zeros(1))
    together.leave()
