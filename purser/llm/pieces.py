"""SentencePiece BPE encoding by a prefix table, and decoding.

The library merges the adjacent pair whose joined piece ranks best until none is left. Of the encodings of all
prefixes of a stretch, each one's last piece is unique: it is the piece that ends there and that is compatible
with the last piece of the prefix before it. Two pieces are compatible when encoding their joined text gives
just the two. So one pass of an automaton that reports every piece ending at a position fills a table of last
pieces, and the ids are read from it backwards: time is linear in the text.

Pieces hold the blank mark only in front, so stretches that begin with a blank are independent, and so are
those between characters that are in no piece (these become byte pieces). Several blanks in a row have pieces
of equal rank, where position decides and a last piece isn't unique: such a stretch is merged step by step.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from purser.llm.common import id_and_text

BLANK = "▁"
MAX_KNOWN = 1_000_000
MAX_KNOWN_CHARS = 48
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Pairs(dict):
    """Whether two pieces (by id) can follow each other; tested when first asked for."""

    def __init__(self, pieces: dict[int, str], rank: dict[str, float], parts: dict[str, tuple[str, str]]):
        super().__init__()
        self._pieces, self._rank, self._parts = pieces, rank, parts
        self._spines: dict[tuple[str, int], list[tuple[str, float]]] = {}

    def _spine(self, piece: str, side: int) -> list[tuple[str, float]]:
        """The pieces at one edge from a character up to ``piece``, each with the rank of the merge that ends it."""
        found = self._spines.get((piece, side))
        if found is None:
            found, end = [], float("inf")
            at = piece
            while True:
                found.append((at, end))
                if at not in self._parts:
                    break
                end, at = self._rank[at], self._parts[at][side]
            found.reverse()
            self._spines[piece, side] = found
        return found

    def __missing__(self, pair: tuple[int, int]) -> bool:
        left, right = self._spine(self._pieces[pair[0]], 1), self._spine(self._pieces[pair[1]], 0)
        i = j = 0
        while True:
            (a, ends_a), (b, ends_b) = left[i], right[j]
            across = self._rank.get(a + b, float("inf"))
            # Of equal ranks the leftmost merge comes first.
            if across < ends_a and across <= ends_b and across != float("inf"):
                fits = False
                break
            if ends_a == ends_b == float("inf"):
                fits = True
                break
            if ends_a <= ends_b:
                i += 1
            else:
                j += 1
        if len(self) < MAX_KNOWN:
            self[pair] = fits
        return fits


class PrefixTableEncoder:
    """Encodes texts as the library does, with an end id; ids come as decimal text."""

    def __init__(self, model: str):
        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        skip = (sp.is_control, sp.is_unknown, sp.is_unused, sp.is_byte)
        normal = [i for i in range(sp.get_piece_size()) if not any(f(i) for f in skip)]
        self._pieces = {i: sp.id_to_piece(i) for i in normal}
        self._ids = {p: i for i, p in self._pieces.items()}
        self._rank = {p: -sp.get_score(i) for p, i in self._ids.items() if len(p) > 1}
        self._bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self._eos = str(sp.eos_id())
        alphabet = {c for p in self._ids for c in p}
        inside = any(BLANK in p.lstrip(BLANK) for p in self._ids)
        if inside or not alphabet <= self._ids.keys():
            raise ValueError("the prefix table needs pieces with blanks in front only, and a piece for each of their characters")
        letters = "".join(re.escape(c) for c in sorted(alphabet - {BLANK}))
        self._stretches = re.compile(f"{BLANK}+[{letters}]*|[{letters}]+|[^{letters}{BLANK}]")
        self._alphabet = alphabet
        parts = {}
        self._automaton = ahocorasick.Automaton()
        for piece, i in self._ids.items():
            if BLANK * 2 in piece:
                continue
            whole = self._merge(piece, parts)
            if whole == [piece]:  # others are never made by merging
                self._automaton.add_word(piece, (i, len(piece)))
        self._automaton.make_automaton()
        self._pairs = Pairs(self._pieces, self._rank, parts)
        self._known: dict[str, str] = {}

    def _merge(self, text: str, parts: dict[str, tuple[str, str]] | None = None) -> list[str]:
        """Pair after pair, best rank first, leftmost first. ``parts`` gets the last two parts of a whole piece."""
        symbols: list[str | None] = list(text)
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(symbols) and (joined := symbols[i] + symbols[j]) in self._rank:
                heapq.heappush(queue, (self._rank[joined], i, j, joined))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, joined = heapq.heappop(queue)
            if symbols[i] is None or symbols[j] is None or after[i] != j or symbols[i] + symbols[j] != joined:
                continue
            if parts is not None and joined == text:
                parts[text] = (symbols[i], symbols[j])
            symbols[i], symbols[j] = joined, None
            after[i] = after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in symbols if s is not None]

    def _encode(self, stretch: str) -> list[int]:
        if stretch[0] not in self._alphabet:
            return [self._bytes[b] for b in stretch.encode()]
        if BLANK * 2 in stretch:
            return [self._ids[p] for p in self._merge(stretch)]
        pairs, last = self._pairs, [None] * (len(stretch) + 1)
        for end, match in self._automaton.iter(stretch):
            if last[end + 1] is None:
                start = end + 1 - match[1]
                if start == 0 or last[start] is not None and pairs[last[start][0], match[0]]:
                    last[end + 1] = match
        ids, at = [], len(stretch)
        while at:
            piece, length = last[at]
            ids.append(piece)
            at -= length
        return ids[::-1]

    def __call__(self, text: str) -> str:
        """All ids in decimal, joined by one space; the end id is the last."""
        stretches = self._stretches.findall(self.processor.normalize(text)) if text else []
        known = self._known
        if len(known) > MAX_KNOWN:
            known.clear()
        out = []
        for stretch in stretches:
            ids = known.get(stretch)
            if ids is None:
                ids = " ".join(map(str, self._encode(stretch)))
                if len(stretch) <= MAX_KNOWN_CHARS:
                    known[stretch] = ids
            out.append(ids)
        out.append(self._eos)
        return " ".join(out)

    def decode(self, ids: str) -> str:
        return self.processor.decode(list(map(int, ids.split())))


@lru_cache(maxsize=1)
def prefix_table_encoder(model: str) -> PrefixTableEncoder:
    """One per worker process."""
    return PrefixTableEncoder(model)


def encode_and_decode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the number of ids of its whole text, digests of the ids and of the text decoded from them.

    Rows are independent: nothing is shuffled and repeated rows give repeated results. A null text is empty and has the
    end id alone; a null id stays null; an empty table gives an empty one; other columns are not looked at.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = prefix_table_encoder(model)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for text in batch["text"]:
                ids = encode(text.as_py())
                counts.append(ids.count(" ") + 1)
                of_ids.append(hashlib.sha256(ids.encode()).hexdigest())
                of_text.append(hashlib.sha256(encode.decode(ids).encode()).hexdigest())
            yield pa.record_batch(
                [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs, doc_id, text).mapInArrow(rows, ENCODED)
