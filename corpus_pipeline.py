"""The corpus pipeline: filters, deduplicates, cleans and packs the documents of a folder of tables.

Each stage takes (spark, docs, sf_dir) and returns a table that is written before the next one reads it. All but the
last return the columns of ``docs``, whatever they are beside doc_id and text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from purser.llm import language, minhash, packing, secrets, toxicity
from purser.llm.common import table
from purser.session import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the threshold."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = docs.select(F.struct("*").alias("row"), model.column(F.col("text")).alias("found"))
    return scored.where(F.col("found.score") < toxicity.THRESHOLD).select("row.*")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose smallest compressed size is clearly one language's."""
    model = language.fit_language(docs)
    found = docs.select(F.struct("*").alias("row"), model.column(F.col("text")).alias("found"))
    return found.where(~F.col("found.rejected")).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest id; one row of it. Rows without an id stay."""
    kept = minhash.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id")
    whole = docs.join(kept, "doc_id", "left_semi").select("doc_id", F.xxhash64("text").alias("key"), F.struct("*").alias("row"))
    rows = whole.groupBy("doc_id").agg(F.min_by("row", "key").alias("row"))
    return rows.select("row.*").unionByName(docs.where("doc_id is null"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in place of each secret; n_chars follows the new text."""
    masked = F.when(F.col("row.text").isNotNull(), secrets.masked_text())
    found = secrets.find_secrets(docs).select("row", F.size("spans").alias("n"), masked.alias("masked"))
    new = {"text": F.col("masked")} | ({"n_chars": F.when(F.col("n") > 0, F.length("masked").cast("long")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {})
    return found.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in token sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack),
]
#: Compression, sketches and tokenizers are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
