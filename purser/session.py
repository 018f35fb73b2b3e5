"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T


def build_session(app: str = "purser", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and the clock pinned to UTC."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Several joins in a row share the group key: a hot group is still split, at the price of a shuffle.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or the warehouse where that is not set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return folder or spark.conf.get("spark.sql.warehouse.dir")


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder, under this application's id."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark).rstrip('/')}/purser/{app}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder, in files of at most ``file_rows`` rows if given, and read it back.

    Cuts the lineage of a plan that several later jobs read. Parquet rather than
    a row checkpoint, so that each of those jobs reads only its own columns, and
    a lost executor costs a re-read instead of the plan behind the table.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.write.option("maxRecordsPerFile", file_rows) if file_rows else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_written(spark: SparkSession) -> None:
    """Delete all tables this application wrote, once nothing reads them any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark).rstrip('/')}/purser/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_table(spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType | str) -> DataFrame:
    """Driver rows as a table that is part of the plan: broadcasting it takes no job, and its size is known."""
    fields = spark.createDataFrame([], schema).schema
    if not rows:
        return spark.createDataFrame([], fields)
    columns = dict(zip(fields.names, map(list, zip(*rows, strict=True)), strict=True))
    return spark.createDataFrame(pa.table(columns), fields)
