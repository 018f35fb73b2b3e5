"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_held: tuple[str, Callable[[], None]] | None = None


def remembering(operator: str, forget: Callable[[], None]) -> None:
    """Said by a task of an operator that keeps something in its worker process for the tasks to come.

    Worker processes live on through the stages of a pipeline, so what another operator kept there is forgotten first, and its
    memory given back to the system.
    """
    global _held
    before, _held = _held, (operator, forget)
    if before and before[0] != operator:
        before[1]()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps what lies between blocks in use
            trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns an operator needs, under fixed names; a null text is empty, other columns are left behind."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    """How many parts a shuffle makes, as the session is set."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fold that no model learns labels from: crc32 of the id as text, modulo 4, is 2. A null id is held out."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(True))
