"""Language identification by compression.

For each language a zstandard raw-content dictionary is made of excerpts of documents labelled with it. A text is
compressed whole with every dictionary, in pieces whose sizes are summed; the smallest sum names the language. The score is
the share of bytes saved against the runner-up, and a text whose score is too small is rejected. Each piece starts from the
dictionary alone, so the score of a long text is about that of its pieces.

Every dictionary is as long as its language's excerpts allow, whatever the others have. Two languages are compared
with equally much text: the longer dictionary is cut into pieces of the shorter one's length, and the language of less text
wins only if it is clearly better than with each of several such pieces.

Letters only: a text is lower-cased and its words are joined by one blank, so that case, digits and marks,
which no language owns, decide nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from purser.llm.common import held_out, remembering

UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
#: The sample that the dictionaries are made of: so many excerpts of so many characters in each language at most.
EXCERPTS = 512
EXCERPT_CHARS = 400
DICTIONARY_BYTES = 131_072
LEVEL = 6
PIECE = 16_384
MIN_MARGIN = 0.001
#: So many pieces of a longer dictionary a shorter one is compared with, and the share of bytes it must save against each.
RIVALS = 8
CLEAR = 0.01


def letters(text: str) -> bytes:
    """The words of a text; empty where it has no letter."""
    return " ".join(WORD.findall(text.lower())).encode()


@dataclass(frozen=True)
class LanguageModel:
    """The dictionary of each language."""

    dictionaries: tuple[tuple[str, bytes], ...]

    def column(self, text: str | Column) -> Column:
        """struct<lang, score, rejected> of a text column. Texts without a letter, and nulls, are unknown and rejected."""
        shared = _broadcast(self)

        @F.arrow_udf("lang string, score double, rejected boolean")
        def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            remembering("language", _forget)
            dictionaries = shared.value.dictionaries
            for batch in batches:
                found = [_predict(text.as_py(), dictionaries) for text in batch]
                yield pa.StructArray.from_arrays(
                    [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                     pa.array([f[0] == UNKNOWN or f[1] < MIN_MARGIN for f in found], pa.bool_())],
                    names=["lang", "score", "rejected"])

        return predict.asNondeterministic()(text)  # evaluated once, not again in a filter below


def _broadcast(model: LanguageModel):
    from pyspark.sql import SparkSession

    return SparkSession.active().sparkContext.broadcast(model)


@lru_cache(maxsize=128)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


def _size(words: bytes, content: bytes) -> int:
    compressor = _compressor(content)
    return sum(len(compressor.compress(words[at : at + PIECE])) for at in range(0, len(words), PIECE))


@lru_cache(maxsize=1_024)
def _pieces(content: bytes, size: int) -> list[bytes]:
    """At most ``RIVALS`` pieces of a size, evenly spaced over a dictionary."""
    n = min(RIVALS, len(content) // size)
    starts = [0] if n == 1 else [(len(content) - size) * i // (n - 1) for i in range(n)]
    return [content[start : start + size] for start in starts]


def _forget() -> None:
    _compressor.cache_clear()
    _pieces.cache_clear()


def _predict(text: str | None, dictionaries: tuple[tuple[str, bytes], ...]) -> tuple[str, float]:
    words = letters(text or "")
    if not words or not dictionaries:
        return UNKNOWN, 0.0
    if len(dictionaries) == 1:
        return dictionaries[0][0], 1.0
    sizes = {lang: _size(words, content) for lang, content in dictionaries}
    # From the longest dictionary on, so that a rival never has more text than the language that leads.
    (best, held), *rivals = sorted(dictionaries, key=lambda d: (-len(d[1]), sizes[d[0]], d[0]))
    score = None
    for lang, content in rivals:
        if len(content) == len(held):
            if sizes[lang] < sizes[best]:
                best, held, score = lang, content, None
            continue
        against = min(_size(words, piece) for piece in _pieces(held, len(content)))
        margin = (against - sizes[lang]) / against
        if margin > (CLEAR if 2 * len(content) <= len(held) else 0):
            best, held, score = lang, content, margin
    if score is None:
        against = min(size for lang, size in sizes.items() if lang != best)
        score = max(0.0, (against - sizes[best]) / against)
    return best, score


def fit_language(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Make the dictionaries from rows outside the held-out fold that have a text and a language.

    The sample is bounded: each language's rows are dealt into ``EXCERPTS`` slots by a hash of the id, one row of each
    slot is taken, and of it an excerpt of ``EXCERPT_CHARS`` characters at a place that the hash gives. An empty table,
    or one without languages, gives a model that knows none and rejects all. Repeated rows count once.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    chosen = rows.groupBy("lang", F.pmod(F.xxhash64("doc_id"), F.lit(EXCERPTS)).alias("slot")).agg(
        F.min_by("doc_id", F.xxhash64("doc_id", F.lit(1))).alias("doc_id"))
    room = F.greatest(F.length("text") - EXCERPT_CHARS, F.lit(0)) + 1
    start = F.pmod(F.xxhash64("doc_id", F.lit(2)), room) + 1
    sample = (
        rows.join(F.broadcast(chosen), ["lang", "doc_id"])  # at most EXCERPTS rows for each language
        .groupBy("lang", "slot").agg(F.min(F.substring("text", start.cast("int"), F.lit(EXCERPT_CHARS))).alias("text"))
    )
    content: dict[str, list[bytes]] = {}
    for row in sorted(sample.collect(), key=lambda r: (r["lang"], r["slot"])):
        if words := letters(row["text"]):
            content.setdefault(row["lang"], []).append(words)
    if not content:
        return LanguageModel(())
    return LanguageModel(tuple((name, b" ".join(parts)[:DICTIONARY_BYTES]) for name, parts in sorted(content.items())))


def identify(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, fold, predicted language, score, and whether it is rejected. Rows are independent; a null id stays null."""
    found = docs.select(F.col(doc_id).cast("long").alias("doc_id"), model.column(F.col(text)).alias("found"))
    return found.select(
        "doc_id", held_out().alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"),
        F.col("found.rejected").alias("rejected"))
