"""Packing of documents into token sequences along a space-filling curve.

Each text becomes a hashed vector of its byte four-grams, projected to three dimensions. Documents are
range-sorted by the Hilbert key of that point, so neighbours on the curve have similar texts, and are laid end
to end in this order; the stream is cut every ``length`` ids. Only the last sequence of a part of the
shuffle can be short, and these ends, one for each part, are put together whole, best fit first.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from purser.llm.common import id_and_text, partitions
from purser.llm.tokens import encoder
from purser.session import small_table, written

LENGTH = 4096
BUCKETS = 64
BITS = 16
#: Projected coordinates of unit vectors lie well inside plus and minus this.
EXTENT = 4.0
SEED = 3
KEYED = "doc_id long, text string, curve long"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean"
)
COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def hashed_vector(text: str) -> np.ndarray:
    """Unit vector of signed, hashed byte four-grams of the whole text; zero for texts of under four bytes."""
    raw = np.frombuffer(text.encode(), np.uint8)
    if len(raw) < 4:
        return np.zeros(BUCKETS)
    wide = raw.astype(np.uint32)
    grams = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
    mixed = (grams * np.uint32(2654435761)) >> np.uint32(25)  # seven bits: a bucket and a sign
    counts = np.bincount(mixed, minlength=2 * BUCKETS)
    vector = (counts[:BUCKETS] - counts[BUCKETS:]).astype(np.float64)
    return vector / (np.linalg.norm(vector) or 1.0)


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of integer points (rows) with ``bits`` bits in each of their dimensions.

    Level by level from the coarsest: Gray-code the cell's corner, and undo the rotation and reflection that the
    curve has in that cell.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(dims):
            set_here = (x[i] & level) != 0
            swap = np.where(set_here, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_here, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << b), (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | x[i] >> b & 1
    return key


def curve_keys(texts: list[str], dims: int = 3) -> np.ndarray:
    """The Hilbert key of each text."""
    plane = np.random.default_rng(SEED).standard_normal((BUCKETS, dims))
    points = np.array([hashed_vector(t) for t in texts]).reshape(len(texts), BUCKETS) @ plane
    cells = np.clip((points / EXTENT + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert_key(cells.astype(np.int64))


def pack(
    docs: DataFrame, vocabulary: str, end_id: int = 2, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The pieces of all documents in sequences of at most ``length`` ids, each id in exactly one piece.

    A null text is empty and has the end id alone; a null id stays null; rows that repeat are packed each for itself;
    an empty table has no pieces; other columns are not looked at. Ties on the curve go by document id.
    """
    docs = id_and_text(docs, doc_id, text)
    end = struct.pack("<I", end_id)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                piece = batch.slice(i, 1024)
                keys = pa.array(curve_keys(piece["text"].to_pylist()), pa.int64())
                yield pa.record_batch([piece["doc_id"], piece["text"], keys], names=["doc_id", "text", "curve"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, first_sequence = encoder(vocabulary, spaced=False), TaskContext.get().partitionId() << 40
        at = 0
        held: list[tuple] = []  # the pieces of the sequence that isn't full yet

        def rows(done: list[tuple], is_open: bool) -> pa.RecordBatch:
            kinds = [pa.int64()] * len(COLUMNS) + [pa.bool_()]
            cells = zip(*(piece + (is_open,) for piece in done), strict=True)
            return pa.record_batch([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=[*COLUMNS, "open"])

        for batch in batches:
            done: list[tuple] = []
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                for name, ids in zip(part["doc_id"].to_pylist(), encode(part["text"].to_pylist()), strict=True):
                    ids += end
                    n, start = len(ids) // 4, 0
                    while start < n:
                        sequence, offset = divmod(at, length)
                        size = min(n - start, length - offset)
                        crc = zlib.crc32(ids[4 * start : 4 * (start + size)])
                        held.append((name, start, size, crc, n, first_sequence + sequence, offset))
                        start, at = start + size, at + size
                        if offset + size == length:
                            done += held
                            held = []
            if done:
                yield rows(done, False)
        if held:
            yield rows(held, True)

    n = partitions(docs.sparkSession)
    ordered = docs.mapInArrow(keyed, KEYED).repartitionByRange(n, "curve", "doc_id").sortWithinPartitions("curve", "doc_id", "text")
    cut = written(ordered.select("doc_id", "text").mapInArrow(pieces, PIECES), "pieces")
    return _ends_together(docs.sparkSession, cut, length)


def _ends_together(spark: SparkSession, cut: DataFrame, length: int) -> DataFrame:
    """Put the short last sequences of the shuffle's parts into common ones."""
    # One row for each part of the shuffle at most, whatever the input.
    ends = cut.where("open").groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    rooms: list[list[int]] = []  # ids in it, sequence id
    moved = []
    for end in sorted(ends, key=lambda r: (-r["n"], r["sequence_id"])):
        fitting = [room for room in rooms if room[0] + end["n"] <= length]
        room = max(fitting, key=lambda r: r[0]) if fitting else [0, end["sequence_id"]]
        if not fitting:
            rooms.append(room)
        moved.append((end["sequence_id"], room[1], room[0]))
        room[0] += end["n"]
    to = small_table(spark, moved, "sequence_id long, _to long, _shift long")
    return cut.join(F.broadcast(to), "sequence_id", "left").select(
        *COLUMNS[:-2], F.coalesce("_to", "sequence_id").alias("sequence_id"),
        (F.col("offset") + F.coalesce("_shift", F.lit(0))).alias("offset"))
