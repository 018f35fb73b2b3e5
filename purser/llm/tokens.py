"""Token ids of whole texts by the ``tokenizers`` library, with a bounded memory of the ids of a word.

The library first cuts a text at the special tokens of its vocabulary, each of which is one id, and then cuts what lies between
at white space (a blank before a word belongs to the word) and where a run of letters ends. So the distinct words of a batch are encoded once by the library and looked up afterwards;
the ids are those the library gives for the whole text (``tests/llm/test_tokens.py``).
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from purser.llm.common import remembering

#: Characters of the Unicode property White_Space (fixed values).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters of one form under normalisation, and what may follow so that their run surely ends.
LETTERS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
AFTER = rf"(?=[\x00-@\[-`{{-\x7f{WHITE}]|\Z)"
#: Byte-level vocabularies keep white space: the last blank before a word is the word's own.
SPACED = re.compile(rf" ?[{LETTERS}]+{AFTER}| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Word vocabularies drop it.
BARE = re.compile(rf"[{LETTERS}]+{AFTER}|[^{WHITE}]+")
WORD = re.compile(rf" ?[{LETTERS}]+")
MAX_KNOWN = 1_500_000
MAX_KNOWN_CHARS = 48


class WordIds(dict):
    """The ids of words and other stretches, encoded when first asked for."""

    def __init__(self, path: str, spaced: bool):
        super().__init__()
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True  # chunks hold no special token, but one in capitals may look so in lower case
        self._model = self._tokenizer.model
        self._spaced = spaced
        # How a byte-level vocabulary writes the UTF-8 of each character of WORD.
        write = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self._written = str.maketrans({c: write(c)[0][0] for c in map(chr, range(256)) if c == " " or WORD.fullmatch(c)})
        self.long: list[str] = []
        added = self._tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError(f"{path}: only special tokens that are matched as they stand are known here")
        self.special = {t.content: array("I", [i]).tobytes() for i, t in added.items()}

    def __missing__(self, chunk: str) -> bytes:
        if WORD.fullmatch(chunk) and (self._spaced or chunk.islower()):
            ids = [t.id for t in self._model.tokenize(chunk.translate(self._written))]
        else:
            ids = self._tokenizer.encode(chunk, add_special_tokens=False).ids
        self[chunk] = out = array("I", ids).tobytes()
        if len(chunk) > MAX_KNOWN_CHARS:
            self.long.append(chunk)
        return out

    def shrink(self) -> None:
        """Keep at most MAX_KNOWN short entries."""
        for chunk in self.long:
            del self[chunk]
        self.long.clear()
        if len(self) > MAX_KNOWN:
            self.clear()


class ChunkEncoder:
    """Encodes texts; remembers at most ``MAX_KNOWN`` short words between two batches.

    ``spaced`` for byte-level vocabularies; otherwise the vocabulary is one of lower-case words.
    """

    def __init__(self, path: str, spaced: bool):
        self._known = WordIds(path, spaced)
        self._spaced = spaced
        self._chunks = SPACED if spaced else BARE
        longest_first = sorted(self._known.special, key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, longest_first))) if longest_first else None

    def _split(self, text: str) -> list[str]:
        if not self._spaced and (text.isascii() or max(text) <= "\xff"):
            text = text.lower()  # as the vocabulary's normalizer does; elsewhere it is left to the library
        return self._chunks.findall(text)

    def _ids(self, text: str) -> bytes:
        return b"".join(map(self._known.__getitem__, self._split(text)))

    def _ids_around_special(self, text: str) -> bytes:
        out, at = [], 0
        for found in self._special.finditer(text):
            out += self._ids(text[at : found.start()]), self._known.special[found.group()]
            at = found.end()
        return b"".join([*out, self._ids(text[at:])])

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        has_special = self._special.search if self._special else lambda text: None
        ids = [self._ids_around_special(text) if has_special(text) else self._ids(text) for text in texts]
        self._known.shrink()
        return ids


def encoder(path: str, spaced: bool) -> ChunkEncoder:
    """One encoder per worker process and vocabulary; a worker is one core, so the library gets one thread."""
    remembering("tokens", _encoder.cache_clear)
    return _encoder(path, spaced)


@lru_cache(maxsize=2)
def _encoder(path: str, spaced: bool) -> ChunkEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ChunkEncoder(path, spaced)


def as_ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4")
