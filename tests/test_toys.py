"""Small frames with answers worked out by hand, one per trap."""

import pytest
from pyspark.sql import functions as F

from purser.functions import scalars
from purser.operators import evaluate, features, profile, quantiles, repair


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_last_first_seen_value_wins(spark):
    df = spark.createDataFrame(
        [(1, "g", "E"), (2, "g", "M"), (3, "g", "E"), (4, "g", None), (5, "h", None), (6, "i", None), (7, "i", "M")],
        "ord int, g string, v string",
    )
    expected = [(1, "M"), (2, "M"), (3, "M"), (4, "M"), (5, None), (6, "M"), (7, "M")]
    assert rows(repair.propagate_group_value(df, "g", ["v"], "ord"), "ord", "v") == expected
    assert rows(repair.lookup_overwrite(df, "g", "v", "ord"), "ord", "v") == expected


def test_all_missing_groups_are_absent(spark):
    df = spark.createDataFrame([("g", "E"), ("g", "M"), ("g", "E"), ("h", None), (None, "E")], "g string, v string")
    assert rows(profile.distinct_per_group(df, "g", "v")) == [("g", 2)]
    assert rows(profile.crosstab(df, "g", "v")) == [("g", 2, 1)]
    assert rows(profile.fd_check(df, "g", ["v"])) == [("v", 2, 1)]


def test_mean_fill(spark):
    df = spark.createDataFrame(
        [("a", True, 3.0), ("a", True, 4.0), ("a", True, None),  # mean 3.5, up to 4
         ("b", True, 0.0), ("b", True, None),  # a mean of zero fills nothing
         ("c", False, None),  # nothing known
         ("a", None, None), (None, True, None)],
        "r string, vip boolean, x double",
    )
    filled = repair.fit_group_means(df, ("r", "vip"), ("x",)).transform(df)
    assert rows(filled) == rows(spark.createDataFrame(
        [("a", True, 3.0), ("a", True, 4.0), ("a", True, 4.0), ("b", True, 0.0), ("b", True, None), ("c", False, None),
         ("a", None, None), (None, True, None)], df.schema))


def test_age_is_rounded_up_everywhere(spark):
    df = spark.createDataFrame(
        [("Earth", 0.5), ("Earth", 2.0), ("Earth", None), (None, 7.0), ("Mars", None)], "planet string, age double"
    )
    fitted = repair.fit_group_means(df, ("planet",), ("age",), zero_is_missing=False, ceil_all=True)
    # Earth's mean is 1.25
    assert rows(fitted.transform(df)) == rows(spark.createDataFrame(
        [("Earth", 1.0), ("Earth", 2.0), ("Earth", 2.0), (None, None), ("Mars", None)], df.schema))


def test_cut(spark):
    df = spark.createDataFrame([(x,) for x in range(1, 9)], "x int")
    bins = features.fit_cut(df, "x", 3, "SML")
    assert [r["y"] for r in bins.transform(df, "y").orderBy("x").collect()] == list("SSSMMLLL")
    same = spark.createDataFrame([(5,)] * 3, "x int")
    assert {r["y"] for r in features.fit_cut(same, "x", 3, "SML").transform(same, "y").collect()} == {"M"}
    beyond = spark.createDataFrame([(-4,), (40,), (None,)], "x int")
    assert rows(bins.transform(beyond, "y")) == rows(
        spark.createDataFrame([(-4, "S"), (40, "L"), (None, None)], "x int, y string"))


def test_qcut(spark):
    values = [0.0, 0.0, 1.0, 5.0, 7.0, 9.0, 20.0, 21.0, 22.0, 30.0, 45.0]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    bins = features.fit_qcut(df, "x", 5, "ABCDE")
    assert bins.edges == (0, 1, 7, 20, 22, 45)
    assert [r["y"] for r in bins.transform(df, "y").orderBy("x").collect()] == list("AAABBCCDDEE")
    ties = spark.createDataFrame([(0.0,)] * 9 + [(1.0,)], "x double")
    with pytest.raises(ValueError, match="not unique"):
        features.fit_qcut(ties, "x", 5, "ABCDE")
    assert features.fit_qcut(ties, "x", 5, "ABCDE", duplicates="drop").edges == (0.0, 1.0)


def test_exact_quantiles_match_a_sort(spark):
    import random

    draw = random.Random(5)
    values = [draw.lognormvariate(0, 3) for _ in range(4001)] + [-1e300, 1e300, 0.0] + [2.5] * 900
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(7)
    ordered = sorted(values)
    probs = (0, 0.01, 0.25, 0.5, 0.75, 0.999, 1)
    n, got = quantiles.exact_quantiles(df, "x", probs)
    assert n == len(values)
    for p, q in zip(probs, got):
        h = (n - 1) * p
        low, high = ordered[int(h)], ordered[min(int(h) + 1, n - 1)]
        assert q == pytest.approx(low + (high - low) * (h - int(h)), rel=1e-12)


def test_scale(spark):
    df = spark.createDataFrame([(0.0, 4.0), (1.0, 4.0), (5.0, 4.0)], "x double, c double")
    fitted = features.fit_scale(df, ("x", "c"))
    assert fitted.stats[0][1:] == (2.0, pytest.approx(2.1602469))
    assert {r["c"] for r in fitted.transform(df).collect()} == {0.0}


def test_one_hot(spark):
    df = spark.createDataFrame([("b", "x", True), (None, "y", False), ("a", "x", True)], "h string, k string, f boolean")
    fitted = features.fit_onehot(df, ["h", "k"], known={"k": ["y", "x", "z"]})
    out = fitted.transform(df)
    assert out.columns == ["f", "h_a", "h_b", "k_y", "k_x", "k_z"]
    assert rows(out) == [(False, False, False, True, False, False), (True, False, True, False, True, False),
                         (True, True, False, False, True, False)]
    unseen = spark.createDataFrame([("c", "x", True)], df.schema)
    assert rows(fitted.transform(unseen)) == [(True, False, False, False, True, False)]


def test_ratio(spark):
    df = spark.createDataFrame([(0.0, 0.0), (None, 2.0), (3.0, 0.0), (1.0, 4.0), (1.0, None)], "n double, t double")
    assert [r[0] for r in df.select(scalars.ratio("n", "t")).collect()] == [0, 0, 0, 0.25, 0]


def test_split(spark):
    df = spark.createDataFrame([("A/1/P",), ("A",), (None,)], "Cabin string")
    assert rows(scalars.split_cabin(df)) == rows(
        spark.createDataFrame([("A", "1", "P"), ("A", None, None), (None, None, None)], "a string, b string, c string"))


def test_metrics(spark):
    pairs = [(1, 1), (1, 1), (1, 0), (0, 0), (0, 0), (0, 0), (0, 1), (1, 0)]
    df = spark.createDataFrame(pairs, "label int, prediction int")
    assert rows(evaluate.confusion_matrix(df)) == [(0, 3, 1), (1, 2, 2)]
    report = {r["class"]: r for r in evaluate.classification_report(df).collect()}
    assert report["Transferred"]["precision"] == pytest.approx(2 / 3, abs=1e-6)
    assert report["Transferred"]["recall"] == 0.5
    assert report["Not-Transferred"]["precision"] == 0.6
    assert report["accuracy"]["f1"] == 0.625 and report["accuracy"]["support"] == 8


def test_one_sided_metrics_are_zero_not_an_error(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int")
    report = {r["class"]: r for r in evaluate.classification_report(df).collect()}
    assert report["Transferred"]["f1"] == 0 and report["accuracy"]["f1"] == 1


def test_threshold(spark):
    df = spark.createDataFrame([(0.49, 0), (0.5, 1), (0.51, 1)], "score double, label int")
    assert [r[0] for r in df.select(evaluate.threshold_score("score")).collect()] == [False, True, True]
    # the accuracy of a score counts one half as false
    assert evaluate.binary_accuracy(df).first()[0] == pytest.approx(66.667)


def test_correlation(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 7.0, True), (2.0, 4.0, 7.0, False), (3.0, None, 7.0, True), (4.0, 8.0, 7.0, None)],
        "a double, b double, c double, f boolean",
    )
    corr = {(r["col_a"], r["col_b"]): r["corr"] for r in profile.corr_matrix(df, ("a", "b", "c", "f")).collect()}
    assert corr["a", "b"] == corr["b", "a"] == 1.0
    assert corr["a", "c"] is None and corr["c", "c"] is None
    assert corr["a", "f"] == 0.0  # 1, 2, 3 against 1, 0, 1
    assert len(corr) == 16


def test_correlation_of_large_offsets(spark):
    df = spark.createDataFrame([(1e9 + i, 1e9 - i) for i in range(10)], "a double, b double")
    corr = {(r["col_a"], r["col_b"]): r["corr"] for r in profile.corr_matrix(df, ("a", "b")).collect()}
    assert corr["a", "b"] == -1.0


def test_box_and_outliers(spark):
    df = spark.createDataFrame([("g", float(x)) for x in (1, 2, 3, 4, 100)] + [("h", 5.0), (None, 9.0), ("g", None)],
                               "g string, x double")
    box = {r["value"]: r for r in profile.box_stats(df, [("x", "g")]).collect()}
    assert (box["g"]["q1_value"], box["g"]["q3_value"], box["g"]["upper_value"]) == (2, 4, 7)
    assert box["g"]["n"] == 5 and box["g"]["n_outliers"] == 1 and box["h"]["n_outliers"] == 0
    assert rows(profile.outlier_rows(df, "x", "g")) == [("g", 100.0)]


def test_unlisted_values_are_counted(spark):
    df = spark.createDataFrame([("g", "X"), ("g", "Z"), ("g", "X"), ("h", "Y")], "g string, v string")
    assert rows(profile.crosstab(df, "g", "v")) == [("g", 2, 0, 1), ("h", 0, 1, 0)]
    out = profile.sorted_group_profile(df, "g", "v")
    assert out.columns == ["g", "X", "Y", "Z", "Uniquevs"] and [r["Uniquevs"] for r in out.collect()] == [2, 1]


def test_boxes_of_many_groups(spark):
    df = spark.range(303).selectExpr("cast(id % 101 as string) g", "cast(id as double) x")
    box = profile.box_stats(df, [("x", "g")]).collect()
    assert len(box) == 101 and all(r["median_value"] == float(r["value"]) + 101 and r["n"] == 3 for r in box)
    assert profile.outlier_rows(df, "x", "g").count() == 0


def test_group_quantiles_match_a_sort(spark):
    import random

    draw = random.Random(6)
    data = [(draw.choice("aab"), draw.lognormvariate(0, 4)) for _ in range(5000)] + [("a", 2.5)] * 400 + [("c", 1.0), ("c", None), (None, 3.0)]
    df = spark.createDataFrame(data, "g string, x double").repartition(5)
    probs = (0, 0.1, 0.5, 0.9, 1)
    _, found = quantiles.group_quantiles(df, "x", probs, ["g"])
    got = {r["g"]: r for r in found.collect()}
    assert got.keys() == {"a", "b", "c"}
    for g, r in got.items():
        ordered = sorted(x for h, x in data if h == g and x is not None)
        assert r["n"] == len(ordered)
        for p, q in zip(probs, r["quantiles"]):
            h = (len(ordered) - 1) * p
            low, high = ordered[int(h)], ordered[min(int(h) + 1, len(ordered) - 1)]
            assert q == pytest.approx(low + (high - low) * (h - int(h)), rel=1e-12)


def test_correlation_of_many_columns(spark):
    df = spark.range(20).select(*[(F.col("id") * (i + 1)).cast("double").alias(f"c{i}") for i in range(17)])
    corr = profile.corr_matrix(df, df.columns).collect()
    assert len(corr) == 289 and {r["corr"] for r in corr} == {1.0}


def test_many_levels_and_levels_with_dots(spark):
    df = spark.range(1001).select(F.concat(F.lit("X."), F.col("id").cast("string")).alias("h"))
    fitted = features.fit_onehot(df)
    assert len(fitted.columns()) == 1001
    two = features.fit_onehot(df.limit(2))
    assert two.transform(df.limit(2)).columns == two.columns()


def test_many_fitted_combinations(spark):
    df = spark.range(100_001).selectExpr("id r", "cast(null as double) x").unionByName(spark.range(100_001).selectExpr("id r", "id + 0.5 x"))
    filled = repair.fit_group_means(df, ("r",), ("x",), ceil=False).transform(df)
    assert filled.where("x <> r + 0.5 or x is null").count() == 0 and filled.count() == 200_002


def test_members_are_ordered_by_number(spark):
    from purser.plans import cleaning

    df = spark.createDataFrame([("0001_9", "A"), ("0001_99", "B"), ("0001_100", "C")], "PassengerId string, v string")
    out = repair.propagate_group_value(cleaning.by_group(df), "GroupNumber", ("v",), cleaning.member_number())
    assert {r["v"] for r in out.collect()} == {"C"}


def test_hierarchy(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x")], "p string, q string")
    assert rows(profile.hierarchy_counts(df, ("p", "q"))) == rows(spark.createDataFrame(
        [(None, None, 0, 4, None), ("a", None, 1, 3, 75.0), ("b", None, 1, 1, 25.0),
         ("a", "x", 2, 2, 66.666667), ("a", "y", 2, 1, 33.333333), ("b", "x", 2, 1, 100.0)],
        "p string, q string, d int, n long, pct double"))


def test_zero_fill_needs_a_known_sleeper(spark):
    df = spark.createDataFrame([(True, None), (None, None), (False, None), (True, 4.0)], "CryoSleep boolean, x double")
    out = repair.zero_fill_where(df, F.col("x").isNull() & F.col("CryoSleep"), ("x",))
    assert rows(out) == rows(spark.createDataFrame([(True, 0.0), (None, None), (False, None), (True, 4.0)], df.schema))


def test_unknown_condition_takes_the_other_label(spark):
    df = spark.createDataFrame([(None,), (0.0,), (2.0,)], "TotalExpenses double")
    assert [r[0] for r in df.select(scalars.is_spend()).collect()] == ["Not-Spent", "Not-Spent", "Spent"]


def test_too_many_columns_are_an_error(spark, monkeypatch):
    from purser.operators import features

    df = spark.createDataFrame([(i % 3, str(i)) for i in range(9)], "g int, v string")
    monkeypatch.setattr(profile, "MAX_COLUMNS", 8)
    monkeypatch.setattr(features, "MAX_COLUMNS", 8)
    with pytest.raises(ValueError, match="too many"):
        profile.crosstab(df, "g", "v")
    with pytest.raises(ValueError, match="too many"):
        features.fit_onehot(df, ["v"])
    assert rows(profile.crosstab(df, "g", "v", values=["0", "7"])) == [(0, 1, 0), (1, 0, 1), (2, 0, 0)]
    assert profile.crosstab_counts(df, "g", "v").count() == 9


def test_correlation_of_pairs_that_never_meet(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (2.0, None, 5.0), (None, 3.0, 5.0), (4.0, 1.0, 5.0)], "a double, b double, c double")
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in profile.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert len(got) == 9 and got["a", "a"] == 1.0 and got["c", "c"] is None and got["a", "b"] is None and got["a", "c"] is None
