"""Near-duplicate documents: ProbMinHash sketches, banding, verification and components.

Two texts are linked when the probability Jaccard similarity of their weighted five-word shingles is at least
the threshold. Texts with the same words are one node from the start. Candidates share a band of the sketch. No
bucket is expanded into its pairs:

1. Every member of a bucket is verified against one pivot, drawn by a hash that differs from bucket to bucket.
2. Buckets whose members are not yet in one component are dealt into slots; for each pair of slots, a task compares the
   sketches of members of different components, verifies what may be similar, and returns a spanning forest.

So every pair that shares a band is connected already, or verified, or so unlike in its sketches that it misses the
threshold but for one in three million (five deviations). The part of a bucket that one verification leaves unconnected is
sent, and compared, slot by slot, which grows with the square of that part over the slots' size; the rest grows with the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from purser.llm.common import remembering
from purser.llm.graph import components
from purser.llm.shingles import REGISTERS, forget_words, mixed, prob_minhash, shingles, similarity, words
from purser.session import written

THRESHOLD = 0.8
#: A pair at the threshold shares no band with a probability of (1 - 0.8^5)^32 = 3 in a million.
BANDS, ROWS = 32, 5
SLOT = 256
#: The share of equal registers at which a pair is verified: five standard deviations below the threshold.
LEAST_SHARE = THRESHOLD - 5 * (THRESHOLD * (1 - THRESHOLD) / REGISTERS) ** 0.5
SKETCHED = "doc_id long, key binary, bands array<long>, sketch binary"


def sketch_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of known id: a key of its text, a bucket for each band and 16 bits of each register.

    The key is that of the words, so texts that differ in marks and case only have the same one. A text without words has
    the key of the text itself and no bands. Null texts have no key: they are no copies of each other.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull())

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembering("near duplicates", _forget)
        salt = mixed(np.arange(BANDS, dtype=np.uint64))[None, :]
        mix = mixed(np.arange(100, 100 + ROWS, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                texts = part["text"].to_pylist()
                tokens = [words(t or "") for t in texts]
                found = prob_minhash([shingles(t) for t in tokens])
                band = found[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
                buckets = mixed((band * mix).sum(2, dtype=np.uint64) ^ salt).view(np.int64)
                keys = [
                    None if text is None else xxhash.xxh3_128_digest("w" + " ".join(t) if t else "t" + text)
                    for text, t in zip(texts, tokens, strict=True)
                ]
                short = found.astype("<u2")
                yield pa.record_batch(
                    [part["doc_id"], pa.array(keys, pa.binary()),
                     pa.array([b if t else [] for b, t in zip(buckets, tokens, strict=True)], pa.list_(pa.int64())),
                     pa.array([s.tobytes() for s in short], pa.binary())],
                    names=["doc_id", "key", "bands", "sketch"])

    return rows.mapInArrow(sketch, SKETCHED)


@lru_cache(maxsize=64)
def _shingles_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    return shingles(words(text))


def _forget() -> None:
    _shingles_of.cache_clear()
    forget_words()


def _verified(pairs: DataFrame) -> DataFrame:
    """Of (a, b, text_a, text_b) the pairs (a, b) at the threshold."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembering("near duplicates", _forget)
        for batch in batches:
            good = [
                similarity(_shingles_of(x.as_py()), _shingles_of(y.as_py())) >= THRESHOLD
                for x, y in zip(batch["text_a"], batch["text_b"], strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(verify, "a long, b long")


def _forest(members: DataFrame) -> DataFrame:
    """Links (a, b) that connect the components met in each pair of slots of a bucket.

    ``members`` are (bucket, band, slot pair, doc_id, component, bands, sketch, text). A pair is looked at in the first band it
    shares only, by the same hashes that made the buckets; the sketches are for the estimate alone.
    """

    def connect(key: tuple, rows: pa.Table) -> pa.Table:
        remembering("near duplicates", _forget)
        band = rows["band"][0].as_py()
        order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
        doc, side = rows["doc_id"].to_numpy()[order], rows["side"].to_numpy()[order]
        parent = {c: c for c in rows["component"].to_pylist()}
        of = rows["component"].to_numpy()[order]
        sketch = np.array([np.frombuffer(x.as_py(), "<u2") for x in rows["sketch"]]).reshape(len(doc), -1)[order]
        bands = np.array(rows["bands"].to_pylist(), np.int64).reshape(len(doc), -1)[order]
        texts = rows["text"].take(pa.array(order))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        found = []
        for i in range(len(doc)):
            # Between two slots only what crosses; inside one, each pair once.
            others = np.flatnonzero((of != of[i]) & (np.arange(len(doc)) > i) & ((side != side[i]) | (side[i] == 2)))
            if not len(others):
                continue
            shared = bands[others] == bands[i]
            likely = ((sketch[others] == sketch[i]).mean(1) >= LEAST_SHARE) & (shared.argmax(1) == band) & shared.any(1)
            for j in others[likely].tolist():
                a, b = root(int(of[i])), root(int(of[j]))
                if a != b and similarity(_shingles_of(texts[i].as_py()), _shingles_of(texts[j].as_py())) >= THRESHOLD:
                    parent[max(a, b)] = min(a, b)
                    found.append((int(doc[i]), int(doc[j])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return members.groupBy("bucket", "low", "high").applyInArrow(connect, "a long, b long")


def _slot_pairs(n: Column, slot: Column) -> Column:
    """For a member of one of n slots: the pairs (low, high, side) it is in; side 2 where both slots are its own."""
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda other: F.struct(
            F.least(slot, other).alias("low"), F.greatest(slot, other).alias("high"),
            F.when(slot == other, 2).when(slot < other, 0).otherwise(1).alias("side")))


def link_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The sketched rows (doc_id, key) and (node, component) of the linked representatives of equal texts."""
    sketched = written(sketch_rows(docs, doc_id, text), "sketches")
    rep_of = sketched.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"))
    reps = sketched.join(rep_of.select("key", F.col("rep").alias("doc_id")), ["key", "doc_id"], "left_semi")
    members = reps.select("doc_id", F.posexplode("bands").alias("band", "bucket"))
    pivots = members.groupBy("bucket").agg(
        F.min_by("doc_id", F.xxhash64("doc_id", "bucket")).alias("pivot"), F.count(F.lit(1)).alias("n")
    ).where("n > 1")
    met = written(members.join(pivots, "bucket"), "buckets")
    met_ids = met.select("doc_id").distinct()
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    texts = written(texts.join(met_ids, "doc_id", "left_semi").distinct(), "texts")

    pairs = met.where("doc_id <> pivot").select(F.least("doc_id", "pivot").alias("a"), F.greatest("doc_id", "pivot").alias("b")).distinct()
    pairs = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    pairs = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    links = written(_verified(pairs.select("a", "b", "text_a", "text_b")), "links")

    so_far = components(links, "first-components").withColumnRenamed("node", "doc_id")
    labelled = met.join(so_far, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed_buckets = labelled.groupBy("bucket").agg(
        F.min("component").alias("c1"), F.max("component").alias("c2"), F.count(F.lit(1)).alias("rows")
    ).where("c1 <> c2 and rows > 2")
    slots = F.ceil(F.col("rows") / SLOT).cast("int")
    slot = F.pmod(F.xxhash64("doc_id"), slots).cast("int")
    open_members = labelled.join(mixed_buckets.select("bucket", "rows"), "bucket").select(
        "bucket", "band", "doc_id", "component", F.explode(_slot_pairs(slots, slot)).alias("pair"))
    open_members = open_members.select("bucket", "band", "doc_id", "component", "pair.*")
    carried = reps.select("doc_id", "bands", "sketch").join(texts, "doc_id")
    more = written(_forest(open_members.join(carried, "doc_id")), "more-links")
    return sketched.join(rep_of, "key", "left").select("doc_id", "rep"), components(
        so_far.select(F.col("doc_id").alias("a"), F.col("component").alias("b")).unionByName(more))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, class_id (the smallest id that links reach, itself included) and kept (doc_id = class_id).

    Rows that repeat an id are one document: their texts are in one class and, if kept, each row is. A row without an id
    has no class and is kept. Null texts are linked with nothing, texts without words with equal texts only. Long texts
    are shingled whole. An empty table gives an empty one; other columns are not looked at.
    """
    rows, linked = link_documents(docs, doc_id, text)
    node = F.coalesce("rep", "doc_id")
    classes = rows.withColumn("node", node).join(linked, "node", "left").select(
        "doc_id", F.coalesce("component", "node").alias("class_id"))
    # A repeated id can stand for several texts.
    classes = written(classes, "classes")
    ties = classes.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).where("a <> b")
    if not ties.isEmpty():
        merged = components(ties.select("a", "b"), "repeated-ids").select(F.col("node").alias("class_id"), "component")
        classes = classes.join(merged, "class_id", "left").select("doc_id", F.coalesce("component", "class_id").alias("class_id"))
    out = classes.withColumn("kept", F.col("doc_id") == F.col("class_id"))
    unnamed = docs.where(F.col(doc_id).isNull()).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"))
    return out.unionByName(unnamed)
