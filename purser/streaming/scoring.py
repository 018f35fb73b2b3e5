"""Score manifests as their files arrive.

Repairs need the rows of a group together, so each arriving file is taken as one complete manifest and goes
through the same batch plan, with the means learned in training.
"""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from purser.plans.cleaning import ScoringMeans
from purser.plans.training import Encoder, score_manifest
from purser.sources.manifest import SCORING_SCHEMA, nan_to_null, write_submission


def manifest_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Scoring manifests (CSV with header) in ``folder``, one file per micro-batch."""
    reader = spark.readStream.schema(SCORING_SCHEMA).options(header=True, mode="FAILFAST", maxFilesPerTrigger=1)
    return nan_to_null(reader.csv(folder))


def score_stream(
    stream: DataFrame, encoder: Encoder, model: Model, means: ScoringMeans | None, out: str, progress: str,
) -> StreamingQuery:
    """Write one submission per manifest under ``out``; a repeated batch overwrites its own folder.

    ``progress`` keeps the stream's place and must be on shared storage, as must ``out``.
    """

    def score(batch: DataFrame, batch_id: int) -> None:
        write_submission(score_manifest(batch, encoder, model, means), f"{out}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(score)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
