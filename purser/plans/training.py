"""From manifests to encoded model input, and to a scored submission."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession, functions as F

from purser.operators import models, repair
from purser.operators.evaluate import threshold_score
from purser.operators.features import Bins, OneHot, Scaler, holdout, with_fold
from purser.operators.models import scored
from purser.operators.stacking import META, Stacking
from purser.plans import cleaning
from purser.session import small_table, written
from purser.sources.manifest import LABEL, submission

FOLDS = 3
#: Fewer rows are dealt by their key: adaptive execution would leave them in few files. More come in even ones from their last join.
FEW_ROWS = 1_000_000
#: Rows of a training file. A scan puts few files into one task (each counts four megabytes more than it has), so a task's rows, which take
#: dozens of times their Parquet bytes once a fit holds them, have a bound however well they are compressed.
FILE_ROWS = 30_000
#: Fits run side by side, two at least, while they hold no more rows than this.
ROWS_AT_ONCE = 16_000_000


@dataclass(frozen=True)
class Encoder:
    """Fitted features and one-hot levels: cleaned rows in, one vector per row out."""

    features: cleaning.FeatureParams
    levels: OneHot
    ratios: bool

    def names(self) -> list[str]:
        encoded = {c for c, _ in self.levels.levels}
        plain = [c for c in (*cleaning.MODEL_COLUMNS, *(cleaning.RATIOS if self.ratios else ())) if c not in encoded]
        return [*plain, *self.levels.columns()]

    def transform(self, clean: DataFrame, *keep: str) -> DataFrame:
        """The vector's places are named by ``names``; a level may be any text, as it is no column name here."""
        return self.vectors(self.columns(clean, *keep), *keep)

    def columns(self, clean: DataFrame, *keep: str) -> DataFrame:
        """What the vectors are made of."""
        return cleaning.model_columns(self.features.transform(clean), cleaning.KEY, *keep, ratios=self.ratios)

    def vectors(self, table: DataFrame, *keep: str) -> DataFrame:
        encoded = {c for c, _ in self.levels.levels}
        plain = [F.col(c) for c in self.names() if c in table.columns and c not in encoded]
        cells = [c.cast("double") for c in (*plain, *self.levels.flags())]
        return table.select(cleaning.KEY, *keep, array_to_vector(F.array(*cells)).alias("features"))


def fit_encoder(clean: DataFrame, ratios: bool = False) -> Encoder:
    params = cleaning.fit_features(clean)
    binned = params.age.transform(clean).withColumns({"Is_Spend": cleaning.is_spend(), "GroupSize": F.lit("Small")})
    return Encoder(params, cleaning.fit_encoding(binned), ratios)


@dataclass(frozen=True)
class TrainingSet:
    """Encoded rows with label, holdout split and fold, written to the shared folder."""

    rows: DataFrame
    encoder: Encoder
    n_train: int
    means: cleaning.ScoringMeans

    @property
    def train(self) -> DataFrame:
        return self.rows.where("split = 'train'")

    @property
    def val(self) -> DataFrame:
        return self.rows.where("split = 'val'")


def training_set(manifest: DataFrame, ratios: bool = False) -> TrainingSet:
    """A small table is dealt evenly by its key, before its rows become vectors: fits read them dozens of times."""
    clean, means = cleaning.fit_clean_train(manifest.drop("Name"))  # no model reads it
    clean = written(clean.drop("Num", "JourneyRoute"), "cleaned")
    encoder = fit_encoder(clean, ratios)
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = encoder.columns(clean, LABEL)
    rows = encoder.vectors(table.repartition(parts, cleaning.KEY) if clean.count() < FEW_ROWS else table, LABEL)
    rows = rows.withColumn("label", F.col(LABEL).cast("double")).drop(LABEL)
    rows = written(with_fold(holdout(rows), FOLDS, seed=17), "training-set", file_rows=FILE_ROWS)
    return TrainingSet(rows, encoder, rows.where("split = 'train'").count(), means)


def base_models(n_train: int) -> dict[str, Estimator]:
    """The live base classifiers of the stack."""
    return {
        "RF": models.random_forest(),
        "GBT": models.boosted_trees(),
        "SVC": models.max_margin(n_train),
        "LR": models.logistic(n_train),
    }


def stacked(n_train: int) -> Stacking:
    return Stacking(base_models(n_train), models.gaussian_bayes(META), folds=FOLDS, threads=side_by_side(n_train))


def side_by_side(n_train: int) -> int:
    """How many fits run at once: each keeps its own copy of the rows, and a fit of few rows leaves most cores idle between its jobs."""
    return max(2, min(8, ROWS_AT_ONCE // max(n_train, 1)))


def score_manifest(
    manifest: DataFrame, encoder: Encoder, model: Model, means: cleaning.ScoringMeans | None = None,
) -> DataFrame:
    """Clean and encode an unlabelled manifest with parameters fitted in training, score it, cut at one half.

    Without ``means`` those of the imputation are fitted again, on the rows to score.
    """
    rows = encoder.transform(cleaning.clean_score(manifest, means))
    return submission(scored(model, rows), threshold_score("score"))


def save_fitted(folder: str, encoder: Encoder, model: Model, means: cleaning.ScoringMeans) -> None:
    """Write all that scoring needs to a folder, which should be shared and new: model, encoder, and the means learned in training."""
    spark = means.ages.table.sparkSession
    model.write().save(f"{folder}/model")
    groups = {name: getattr(means, name) for name in ("ages", "routes")}
    for name, group in groups.items():
        group.table.write.parquet(f"{folder}/{name}")
    held = {
        "encoder": asdict(encoder), "overall": means.overall.means,
        **{name: {"keys": g.keys, "cols": g.cols, "ceil_all": g.ceil_all} for name, g in groups.items()},
    }
    small_table(spark, [(json.dumps(held),)], "value string").write.text(f"{folder}/fitted")


def load_fitted(spark: SparkSession, folder: str) -> tuple[Encoder, Model, cleaning.ScoringMeans]:
    """What ``save_fitted`` wrote, in this or any other session."""
    held = json.loads(spark.read.text(f"{folder}/fitted").first()["value"])

    def bins(b: dict) -> Bins:
        return Bins(b["col"], tuple(b["edges"]), tuple(b["labels"]))

    def group(name: str) -> repair.GroupMeans:
        g = held[name]
        return repair.GroupMeans(tuple(g["keys"]), tuple(g["cols"]), spark.read.parquet(f"{folder}/{name}"), g["ceil_all"])

    f = held["encoder"]["features"]
    params = cleaning.FeatureParams(bins(f["size"]), bins(f["age"]), Scaler(tuple(map(tuple, f["scale"]["stats"]))), f["ratio_after_scale"])
    levels = OneHot(tuple((c, tuple(v)) for c, v in held["encoder"]["levels"]["levels"]))
    overall = repair.GlobalMeans(tuple(map(tuple, held["overall"])))
    model = DefaultParamsReader.loadParamsInstance(f"{folder}/model", spark)
    return Encoder(params, levels, held["encoder"]["ratios"]), model, cleaning.ScoringMeans(group("ages"), group("routes"), overall)
