"""Exact copies: an extendible-hash index of the distinct texts, on shared files.

The key of a text is a 64-bit hash of its normalised form. A directory names buckets by the leading bits of the keys: it
starts with one bucket, and the bits are doubled as long as a bucket holds more distinct keys than fit, so only
overfull buckets are split. A bucket that no bit can split, one key's, stays.

Copies are combined where they are read, byte by byte: an entry is one distinct text with its largest id and its
number of rows. Owner tasks take ranges of keys, whole buckets as far as possible, and write the entries of these,
sorted by key. Entries that share a key without being equal are a chain; rows of a chain's key are told
apart by their bytes, all others by the key, as every row with the key has the same bytes.

All of this is DataFrame functions. Tables are written to the shared folder; a lost executor costs a re-read.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from purser.llm.common import partitions
from purser.session import new_path, small_table, written

#: Distinct keys that a bucket holds.
CAPACITY = 4_096
#: So many bits are looked at in one pass over the keys of overfull buckets.
BITS = 12
DIRECTORY = "depth int, low long, high long, keys long"


def normalised(text: str | Column) -> Column:
    """The text with A-Z, and no other letter, in lower case; a null text is empty."""
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


@dataclass(frozen=True)
class CopyIndex:
    """``directory``: the buckets, as (depth, low, high, keys) with the keys from low to high; ``entries``: the distinct texts,
    as (bucket, key, normal, keep_id, n) with the bucket's lowest key; ``rows``: (doc_id, key) of every row."""

    directory: DataFrame
    entries: DataFrame
    rows: DataFrame


def directory(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The buckets of a table of distinct keys (key long), one pass over the keys still in question for every ``BITS`` doublings.

    Buckets are as shallow as their number of keys allows, and cover all keys, also those that don't occur.
    """
    spark = keys.sparkSession
    total = keys.count()
    if total <= capacity:
        return small_table(spark, [(0, -(1 << 63), (1 << 63) - 1, total)], DIRECTORY)
    found, overfull, depth = [], None, 0
    while overfull is None or not overfull.isEmpty():
        bits = min(BITS, 64 - depth)
        inside = keys.select("key")
        if overfull is not None:
            inside = inside.withColumn("prefix", F.shiftrightunsigned("key", 64 - depth)).join(overfull, "prefix", "left_semi")
        cell = F.shiftrightunsigned("key", 64 - depth - bits).alias("prefix")
        cells = inside.groupBy(cell).agg(F.count(F.lit(1)).alias("n"))
        # The directory before each doubling is the one after it with the cells added up.
        counts = cells.select(F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("used"), "prefix", "n")
        counts = counts.select("used", F.expr(f"shiftrightunsigned(prefix, {bits} - used)").alias("prefix"), "n")
        counts = written(counts.groupBy("used", "prefix").agg(F.sum("n").alias("n")), "copy-cells")
        halves = counts.where((F.col("n") > capacity) & (F.col("used") < bits)).select(
            (F.col("used") + 1).alias("used"), F.explode(F.array(F.shiftleft("prefix", 1), F.shiftleft("prefix", 1).bitwiseOR(F.lit(1)))).alias("prefix"))
        halves = halves.join(counts, ["used", "prefix"], "left").select("used", "prefix", F.coalesce("n", F.lit(0)).alias("n"))
        fits = F.col("n") <= capacity
        if depth + bits == 64:
            fits = fits | (F.col("used") == bits)  # no bit is left to split by
        low = F.expr(f"shiftleft(prefix, {64 - depth} - used)")
        rest = F.expr(f"shiftrightunsigned(shiftrightunsigned(-1L, {depth} + used - 1), 1)")  # a shift by 64 would be none
        buckets = halves.where(fits).select((F.col("used") + depth).alias("depth"), low.alias("low"), "used", F.col("n").alias("keys"))
        found.append(buckets.select("depth", "low", F.col("low").bitwiseOR(rest).alias("high"), "keys"))
        overfull = counts.where((F.col("n") > capacity) & (F.col("used") == bits)).select("prefix")
        depth += bits
        if depth == 64:
            break
    return reduce(DataFrame.unionByName, found)


def build_index(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key: Callable[[Column], Column] = text_key, capacity: int = CAPACITY,
) -> CopyIndex:
    """Index every row and whole text of ``docs``. Other columns are not looked at; an empty table has one empty bucket."""
    spark = docs.sparkSession
    normal = docs.select(F.col(doc_id).cast("long").alias("doc_id"), normalised(text).alias("normal")).withColumn("key", key(F.col("normal")))
    rows = written(normal.select("doc_id", "key"), "copy-keys")
    buckets = written(directory(rows.select("key").distinct(), capacity), "copy-directory")
    combined = normal.groupBy("key", "normal").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    # Keys are evenly spread hashes, so equal ranges of them are equal shares; a bucket goes to one owner.
    owners = partitions(spark)
    owner = (F.shiftrightunsigned("bucket", 33) * owners / (1 << 31)).cast("int")
    owned = bucket_of(combined, buckets).repartitionById(owners, owner).sortWithinPartitions("bucket", "key")
    path = new_path(spark, "copy-entries")
    owned.write.option("compression", "zstd").parquet(path)  # whole texts: half the size
    return CopyIndex(buckets, spark.read.schema(owned.schema).parquet(path), rows)


def bucket_of(keys: DataFrame, buckets: DataFrame) -> DataFrame:
    """``keys`` with the bucket of each key, looked up by the leading bits that all buckets have in common."""
    common = 64 - (buckets.agg(F.min("depth").alias("least")).first()["least"] or 0)

    def leading(column: str) -> Column:
        return F.shiftrightunsigned(column, common) if common < 64 else F.lit(0).cast("long")

    named = buckets.select(leading("low").alias("cell"), "low", "high")
    found = keys.withColumn("cell", leading("key")).join(named, "cell").where(F.col("key").between(F.col("low"), F.col("high")))
    return found.select(F.col("low").alias("bucket"), *keys.columns)


def copies(index: CopyIndex, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key: Callable[[Column], Column] = text_key) -> DataFrame:
    """Per row of the indexed ``docs``: doc_id, keep_id (the largest id of the equal texts), group_size (their rows), kept, text_sha256.

    Null texts are empty texts. A row without an id stays only where none of the equal texts has one (keep_id is null then).
    Rows that repeat the kept id are all kept: they are one document. An empty table gives an empty one.
    """
    entries = index.entries
    chains = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    chains = written(chains, "copy-chains")
    found = ("keep_id", F.col("n").alias("group_size"), F.sha2("normal", 256).alias("text_sha256"))
    if chains.isEmpty():
        out = index.rows.join(entries.select("key", *found), "key")
    else:
        alone = entries.join(chains, "key", "left_anti").select("key", *found)
        chained = entries.join(chains, "key", "left_semi").select("key", "normal", *found)
        normal = docs.select(F.col(doc_id).cast("long").alias("doc_id"), normalised(text).alias("normal")).withColumn("key", key(F.col("normal")))
        columns = ("doc_id", "keep_id", "group_size", "text_sha256")
        out = index.rows.join(alone, "key").select(*columns).unionByName(normal.join(chained, ["key", "normal"]).select(*columns))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def find(index: CopyIndex, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key: Callable[[Column], Column] = text_key) -> DataFrame:
    """Per row of other documents: doc_id and, where the index holds an equal text, its keep_id and number of rows; else nulls."""
    normal = docs.select(F.col(doc_id).cast("long").alias("doc_id"), normalised(text).alias("normal")).withColumn("key", key(F.col("normal")))
    return normal.join(index.entries, ["key", "normal"], "left").select("doc_id", "keep_id", F.col("n").alias("copies"))


def exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key: Callable[[Column], Column] = text_key, capacity: int = CAPACITY) -> DataFrame:
    """Build the index of ``docs`` and name each row's group by it."""
    return copies(build_index(docs, doc_id, text, key, capacity), docs, doc_id, text, key)


#: DuckDB SQL for ``exact_copies`` over ``documents``.
SQL = f"""
WITH rows AS (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS normal FROM documents),
kept AS (SELECT *, max(doc_id) OVER (PARTITION BY normal) AS keep_id, count(*) OVER (PARTITION BY normal) AS group_size FROM rows)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(normal) AS text_sha256 FROM kept"""
