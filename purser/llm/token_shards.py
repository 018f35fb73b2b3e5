"""Token ids in binary shards of patched frame-of-reference blocks.

A shard is one self-contained byte string (all integers little-endian):

====================  =====================================================================
``PFR1``              magic
u32 x 4               block size, documents, blocks, 0
u64                   ids in the shard
i64 x documents       document ids
u8 x documents        1 where the document id is known
u64 x (documents+1)   first id of each document, counted from the shard's start; the last is the end
u64 x (blocks+1)      first byte of each block, counted from the end of this header: the index
u32 x blocks          base: the smallest id of the block
u8 x blocks           width: bits of a packed value
u16 x blocks          exceptions of the block
blocks                packed (id - base) of ``width`` bits each, padded to a whole block; then the
                      exceptions' positions (u8) and whole differences (u32)
====================  =====================================================================

The width is that of a percentile of the block's differences, so a few large ids don't widen the rest.
The block index gives any id range without reading the other blocks (``read_ids``).

Shards are rows of a Parquet table (part, position, shard), so any store that Spark writes can hold them;
parts follow each other in ascending document id.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from purser.llm.common import id_and_text, partitions
from purser.llm.tokens import encoder
from purser.session import written

MAGIC = b"PFR1"
BLOCK = 128
PERCENTILE = 0.9
SHARD_IDS = 1 << 20
SHARDS = "part int, position int, first long, n_ids long, shard binary"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long, part int"


def _bits(values: np.ndarray) -> np.ndarray:
    """Number of bits of each value."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values, the lowest ``width`` bits of each, as rows of 64-bit words."""
    columns = np.ascontiguousarray(values.T).astype(np.uint64) & np.uint64((1 << width) - 1)
    words = np.zeros((BLOCK * width // 64, values.shape[0]), np.uint64)
    for i, column in enumerate(columns):
        word, shift = divmod(i * width, 64)
        words[word] |= column << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= column >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T)


def _unpacked(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of ``_packed``."""
    words, mask = np.ascontiguousarray(words.T), np.uint64((1 << width) - 1)
    columns = np.empty((BLOCK, words.shape[1]), np.uint32)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        value = words[word] >> np.uint64(shift)
        if shift + width > 64:
            value |= words[word + 1] << np.uint64(64 - shift)
        columns[i] = value & mask
    return np.ascontiguousarray(columns.T)


def _odd_places(ends: np.ndarray, n_odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For blocks that end at ``ends``: the bytes of their exceptions' positions and of their values' first bytes."""
    counts = n_odd.astype(np.int64)
    rank = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    end, n = np.repeat(ends, counts), np.repeat(counts, counts)
    return end - 5 * n + rank, end - 4 * n + 4 * rank


def pack_ids(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[bytes, bytes]:
    """The block part of a shard: its index (starts, bases, widths, exception counts) and the blocks."""
    n_blocks = -(-len(ids) // BLOCK)
    if not n_blocks:
        return np.zeros(1, "<u8").tobytes(), b""
    blocks = np.concatenate([ids, np.repeat(ids[-1:], n_blocks * BLOCK - len(ids))]).reshape(n_blocks, BLOCK)
    base = blocks.min(1)
    rest = blocks - base[:, None]
    at = min(BLOCK - 1, int(percentile * BLOCK))
    width = _bits(np.partition(rest, at, axis=1)[:, at])
    odd = rest >> np.minimum(width, 31)[:, None] > 0
    odd[width == 32] = False
    n_odd = odd.sum(1).astype("<u2")
    starts = np.concatenate([[0], np.cumsum(width.astype(np.int64) * (BLOCK // 8) + n_odd.astype(np.int64) * 5)])
    out = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width[width > 0]).tolist():
        of = np.flatnonzero(width == w)
        packed = _packed(rest[of], w).view(np.uint8)
        out[starts[of][:, None] + np.arange(packed.shape[1])] = packed
    rows, places = np.nonzero(odd)
    at_place, at_value = _odd_places(starts[1:], n_odd)
    out[at_place] = places
    out[at_value[:, None] + np.arange(4)] = rest[rows, places].astype("<u4")[:, None].view(np.uint8)
    index = starts.astype("<u8").tobytes() + base.astype("<u4").tobytes() + width.tobytes() + n_odd.tobytes()
    return index, out.tobytes()


def write_shard(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """One shard of whole documents."""
    lengths = np.array([len(x) // 4 for x in ids], np.uint64)
    flat = np.frombuffer(b"".join(ids), "<u4")
    index, blocks = pack_ids(flat)
    return b"".join((
        MAGIC, struct.pack("<IIIIQ", BLOCK, len(ids), -(-len(flat) // BLOCK), 0, len(flat)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is not None for d in doc_ids),
        np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes(), index, blocks,
    ))


class Shard:
    """Reads a shard by its header and block index."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a token shard")
        self.raw = raw
        self.block, n_docs, n_blocks, _, self.n_ids = struct.unpack_from("<IIIIQ", raw, 4)
        self.at = 28
        doc_ids = self._take("<i8", n_docs)
        known = self._take("u1", n_docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(doc_ids, known, strict=True)]
        self.doc_starts = self._take("<u8", n_docs + 1).astype(np.int64)
        self.starts = self._take("<u8", n_blocks + 1).astype(np.int64)
        self.base = self._take("<u4", n_blocks)
        self.width = self._take("u1", n_blocks)
        self.n_odd = self._take("<u2", n_blocks)

    def _take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.raw, kind, n, self.at)
        self.at += out.nbytes
        return out

    def read_ids(self, first: int, last: int) -> np.ndarray:
        """Ids first..last (exclusive), decoding only the blocks that hold them."""
        if last <= first:
            return np.zeros(0, "<u4")
        low, high = first // self.block, -(-last // self.block)
        body = np.frombuffer(self.raw, np.uint8, offset=self.at)
        width, n_odd = self.width[low:high], self.n_odd[low:high]
        out = np.zeros((high - low, self.block), np.uint32)
        for w in np.unique(width[width > 0]).tolist():
            of = np.flatnonzero(width == w)
            packed = body[self.starts[low + of][:, None] + np.arange(w * self.block // 8)]
            out[of] = _unpacked(packed.view(np.uint64), w)
        at_place, at_value = _odd_places(self.starts[low + 1 : high + 1], n_odd)
        rows = np.repeat(np.arange(high - low), n_odd)
        out[rows, body[at_place]] = body[at_value[:, None] + np.arange(4)].view("<u4")[:, 0]
        out += self.base[low:high, None]
        return out.reshape(-1)[first - low * self.block : last - low * self.block]


def write_token_shards(
    docs: DataFrame, vocabulary: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text",
    shard_ids: int = SHARD_IDS,
) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write the shards to the shared folder, read back as a table.

    Documents are dealt into ranges of ids and sorted inside them, so parts are in ascending document id; rows
    with the same id stay side by side. A null text has the end id alone; a null document id comes first and
    stays null; an empty table has no shards. A shard closes at the first document end past ``shard_ids`` ids.
    """
    docs = id_and_text(docs, doc_id, text)
    spread = docs.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    end = struct.pack("<I", end_id)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocabulary, spaced=True), TaskContext.get().partitionId()
        names, held, size, first, position = [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            cells = (part, position, first, size, write_shard(names, held))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.record_batch(
                [pa.array([c], k) for c, k in zip(cells, kinds, strict=True)],
                names=["part", "position", "first", "n_ids", "shard"])

        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                piece = batch.slice(i, 128)
                for name, ids in zip(piece["doc_id"].to_pylist(), encode(piece["text"].to_pylist()), strict=True):
                    names.append(name)
                    held.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= shard_ids:
                        yield row()
                        names, held, size, first, position = [], [], 0, first + size, position + 1
        if names:
            yield row()

    return written(spread.mapInArrow(shards, SHARDS), "token-shards")


def read_token_shards(shards: DataFrame) -> DataFrame:
    """Per document of the shards: its id, the ids of all documents before it, its ids' number and CRC-32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, raw in zip(*(batch[c].to_pylist() for c in ("part", "first", "shard")), strict=True):
                shard = Shard(raw)
                ids = shard.read_ids(0, shard.n_ids).tobytes()
                bounds = shard.doc_starts.tolist()
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.record_batch(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array(shard.doc_starts[:-1] + first),
                     pa.array(np.diff(shard.doc_starts)), pa.array(crc, pa.int64()),
                     pa.array([part] * len(crc), pa.int32())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "part"])

    # One row per part of the shuffle that wrote them: as many as the session's partitions, whatever the input.
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    return (
        shards.select("part", "first", "shard").mapInArrow(read, READ)
        .join(F.broadcast(starts), "part")
        .select("doc_id", (F.col("start") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
    )
