"""Operator 13: the index and its directory against plain Python, with keys short enough to collide and overfill."""

import hashlib
from collections import defaultdict

import pytest
from cases import AWKWARD, DOC
from pyspark.sql import functions as F

from purser.llm import exact_copies

UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(UPPER)].append(d)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(d, keep, len(ids), d == keep, sha) for d in ids]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_copies_of_the_corpus(docs, texts):
    assert found(exact_copies.exact_copies(docs)) == brute(texts.items())


def test_awkward_rows(awkward, nothing):
    assert found(exact_copies.exact_copies(awkward)) == brute([r[:2] for r in AWKWARD])
    assert exact_copies.exact_copies(nothing).collect() == []


@pytest.fixture(scope="module")
def copied(spark):
    """400 texts of one to five rows in different case, a hot one of 300, and letters whose case must stay."""
    rows = [(i, f"Text {i % 400} É" if i % 2 else f"TEXT {i % 400} É", None, None, None) for i in range(1200)]
    rows += [(5000 + i, "hot", None, None, None) for i in range(300)] + [(9000, "text 1 é", None, None, None)]
    return spark.createDataFrame(rows, DOC), [r[:2] for r in rows]


@pytest.mark.parametrize("bits", [0, 3, 8, 64])
def test_chains_of_colliding_keys(copied, bits):
    """Keys with few bits: many texts share one, up to all of them, and are told apart by their bytes."""
    docs, rows = copied

    def key(text):
        return F.shiftleft(F.xxhash64(text), 64 - bits) if bits else F.lit(7).cast("long")

    assert found(exact_copies.exact_copies(docs, key=key, capacity=16)) == brute(rows)


@pytest.mark.parametrize("bits", [5, 12])
@pytest.mark.parametrize("capacity", [1, 30])
def test_directory_splits_overfull_buckets_only(spark, monkeypatch, bits, capacity):
    monkeypatch.setattr(exact_copies, "BITS", bits)
    keys = [r["k"] for r in spark.range(300).select(F.xxhash64("id").alias("k")).collect()] + [5, 6, 7, -1, -2]
    table = spark.createDataFrame([(k,) for k in keys], "key long")
    buckets = sorted(exact_copies.directory(table, capacity).collect(), key=lambda b: b["low"])
    assert buckets[0]["low"] == -(1 << 63) and buckets[-1]["high"] == (1 << 63) - 1
    assert all(a["high"] + 1 == b["low"] for a, b in zip(buckets, buckets[1:]))
    for b in buckets:
        width = 1 << (64 - b["depth"])
        assert b["high"] - b["low"] + 1 == width and b["keys"] == sum(b["low"] <= k <= b["high"] for k in keys) <= capacity
        parent = (b["low"] & ((1 << 64) - 1)) // (2 * width) * 2 * width
        inside = sum(parent <= k & ((1 << 64) - 1) < parent + 2 * width for k in keys)
        assert b["depth"] == 0 or inside > capacity


def test_owners_hold_ranges_of_whole_keys(copied):
    docs, rows = copied
    index = exact_copies.build_index(docs, capacity=32)
    held = index.entries.collect()
    assert len(held) == len({t.translate(UPPER) for _, t in rows}) and {r["bucket"] for r in held} <= {r["low"] for r in index.directory.collect()}
    assert max(r["keys"] for r in index.directory.collect()) <= 32 < len(held)
    owners = index.entries.groupBy(F.input_file_name().alias("f")).agg(
        F.min(F.shiftrightunsigned("key", 1)).alias("low"), F.max(F.shiftrightunsigned("key", 1)).alias("high"),
        F.collect_set("bucket").alias("buckets")).orderBy("low").collect()
    assert sum(len(o["buckets"]) for o in owners) == len({r["bucket"] for r in held})
    assert len(owners) > 1 and all(a["high"] < b["low"] for a, b in zip(owners, owners[1:]))


def test_other_documents_are_looked_up(copied, spark):
    docs, _ = copied
    index = exact_copies.build_index(docs)
    others = spark.createDataFrame([(1, "HOT"), (2, "Text 1 É"), (3, "no such text"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["copies"]) for r in exact_copies.find(index, others).collect()}
    assert got == {1: (5299, 300), 2: (801, 3), 3: (None, None), 4: (None, None)}
