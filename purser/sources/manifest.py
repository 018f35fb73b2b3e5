"""Manifest files in, submission files out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from purser.functions.scalars import SPEND

LABEL = "Transported"

SCORING_SCHEMA = T.StructType(
    [
        T.StructField("PassengerId", T.StringType()),
        T.StructField("HomePlanet", T.StringType()),
        T.StructField("CryoSleep", T.BooleanType()),
        T.StructField("Cabin", T.StringType()),
        T.StructField("Destination", T.StringType()),
        T.StructField("Age", T.DoubleType()),
        T.StructField("VIP", T.BooleanType()),
        *[T.StructField(c, T.DoubleType()) for c in SPEND],
        T.StructField("Name", T.StringType()),
    ]
)
TRAIN_SCHEMA = T.StructType([*SCORING_SCHEMA.fields, T.StructField(LABEL, T.BooleanType())])


def nan_to_null(df: DataFrame) -> DataFrame:
    """Null as the only missing marker: aggregates skip it, unlike NaN."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in doubles}) if doubles else df


def read_manifest(
    spark: SparkSession, path: str, schema: T.StructType = TRAIN_SCHEMA, mode: str = "FAILFAST"
) -> DataFrame:
    """Scan a manifest CSV in one pass, with a declared schema.

    A malformed value stops the scan; ``mode='PERMISSIVE'`` reads it as missing.
    """
    return nan_to_null(spark.read.schema(schema).csv(path, header=True, mode=mode))


def submission(scored: DataFrame, prediction: str | Column = "prediction", key: str = "PassengerId") -> DataFrame:
    """Key and predicted label; the key has travelled with its row, so nothing is glued by position."""
    return scored.select(key, F.col(prediction).cast("boolean").alias(LABEL) if isinstance(prediction, str)
                         else prediction.cast("boolean").alias(LABEL))


def write_submission(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
