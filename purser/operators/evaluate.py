"""Quality of a binary prediction. Everything is a small aggregate over scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def threshold_score(score: str | Column, cut: float = 0.5) -> Column:
    """Score to label: at the cut counts as true."""
    score = F.col(score) if isinstance(score, str) else score
    return score >= cut


def accuracy_by_split(df: DataFrame, label: str = "label", pred: str = "prediction", split: str = "split") -> DataFrame:
    """Accuracy in per cent on 'train' and 'val', and the gap between the two."""
    hit = (F.col(label) == F.col(pred)).cast("double")
    acc = {s: F.avg(F.when(F.col(split) == s, hit)) * 100 for s in ("train", "val")}
    return df.agg(
        F.round(acc["train"], 3).alias("train_accuracy"),
        F.round(acc["val"], 3).alias("val_accuracy"),
        F.round(acc["train"] - acc["val"], 4).alias("difference"),
    )


def binary_accuracy(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Share of rows where 'score above one half' agrees with the label, in per cent."""
    hit = (F.col(score) > 0.5) == (F.col(label) == 1)
    return df.agg(F.round(F.avg(hit.cast("double")) * 100, 3).alias("binary_accuracy"))


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Rows per actual class, one column per predicted class."""
    table = df.groupBy(label).pivot(pred, [0, 1]).agg(F.count(F.lit(1))).na.fill(0)
    return table.withColumnsRenamed({"0": "predicted_0", "1": "predicted_1"})


def classification_report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and both averages.

    One count per (label, prediction); the report itself is arithmetic on four numbers.
    """
    y, p = F.col(label), F.col(pred)
    counts = df.agg(*[
        F.count_if((y == a) & (p == b)).cast("double").alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)
    ])

    def safe(num: Column, den: Column) -> Column:
        return F.coalesce(F.try_divide(num, den), F.lit(0.0))

    cells = {}
    for k in (0, 1):
        hit, support = F.col(f"c{k}{k}"), F.col(f"c{k}0") + F.col(f"c{k}1")
        guessed = F.col(f"c0{k}") + F.col(f"c1{k}")
        precision, recall = safe(hit, guessed), safe(hit, support)
        cells[str(k)] = (precision, recall, safe(2 * precision * recall, precision + recall), support)
    total = cells["0"][3] + cells["1"][3]
    accuracy = safe(F.col("c00") + F.col("c11"), total)
    macro = tuple((cells["0"][i] + cells["1"][i]) / 2 for i in range(3))
    weighted = tuple(safe(cells["0"][i] * cells["0"][3] + cells["1"][i] * cells["1"][3], total) for i in range(3))
    lines = {
        "Not-Transferred": cells["0"],
        "Transferred": cells["1"],
        "accuracy": (F.lit(None), F.lit(None), accuracy, total),
        "macro avg": (*macro, total),
        "weighted avg": (*weighted, total),
    }
    names = ("precision", "recall", "f1")
    rows = [
        F.struct(F.lit(name).alias("class"),
                 *[F.round(v.cast("double"), 6).alias(n) for n, v in zip(names, values)],
                 values[3].cast("bigint").alias("support"))
        for name, values in lines.items()
    ]
    return counts.select(F.inline(F.array(*rows)))


def fold_scores(df: DataFrame, label: str = "label", pred: str = "prediction", fold: str = "fold") -> DataFrame:
    hit = (F.col(label) == F.col(pred)).cast("double")
    return df.groupBy(fold).agg(F.avg(hit).alias("score"), F.count(F.lit(1)).alias("n"))


def cv_summary(scores: DataFrame, score: str = "score") -> DataFrame:
    """Mean, population deviation and mean ± deviation of fold scores, in per cent."""
    mean, deviation = F.avg(score) * 100, F.stddev_pop(score) * 100
    return scores.agg(
        F.count(score).alias("folds"),
        F.round(mean, 3).alias("mean"),
        F.round(deviation, 3).alias("std"),
        F.round(mean + deviation, 3).alias("range_high"),
        F.round(mean - deviation, 3).alias("range_low"),
    )


def gnb_parameters(df: DataFrame, cols: list[str], label: str = "label") -> DataFrame:
    """Prior, mean and population variance per class and feature."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.var_pop(c).alias("variance")) for c in cols
    ])
    classes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"), cells.alias("cells"))
    total = classes.agg(F.sum("n")).scalar()
    rows = classes.select(label, (F.col("n") / total).alias("prior"), F.inline("cells"))
    return rows.select(label, "feature", *[F.round(c, 6).alias(c) for c in ("prior", "mean", "variance")])
