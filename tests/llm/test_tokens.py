"""Operators 2, 3 and 10: ids against the libraries, whole."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from cases import AWKWARD
from tokenizers import Tokenizer

from purser.llm import packing, pieces, token_shards
from purser.llm.tokens import as_ids, encoder

BYTE, WORDS, PIECE = map(public_tokenizers.path, ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ALPHABET = " \t\n\r\x0b\x85\xa0 　\x1c᠎​́ab'sZÉé1٣中,.!éİΣςß😀▁"


def odd_texts(n=3_000):
    pick = random.Random(1)
    odd = ["".join(pick.choice(ALPHABET) for _ in range(pick.randint(0, 40))) for _ in range(n)]
    special = ["<|endoftext|>", "<|startoftext|>", "<|endoftext|>" * 3, "<|ENDOFTEXT|>", "a <|endoftext|> b", "word<|endoftext|>word",
               " <|startoftext|>  two  <|endoftext|> ", "<|endoftext", "é<|endoftext|>́x", "'s<|startoftext|>'s\n<|endoftext|>\n\n"]
    special += ["".join(pick.choice([*ALPHABET, "<|endoftext|>", "<|startoftext|>"]) for _ in range(20)) for _ in range(300)]
    return [*odd, *special, "<|endoftext|> a<|endoftext|>b", "", "a" * 5000, "don't it's. we'LL éa \xb5 \xaa1", "  two   three    four"]


@pytest.mark.parametrize(("path", "spaced"), [(BYTE, True), (WORDS, False)])
def test_ids_are_the_librarys(texts, path, spaced):
    library = Tokenizer.from_file(path)
    every = [*texts.values(), *odd_texts()]
    wanted = [e.ids for e in library.encode_batch(every, add_special_tokens=False)]
    assert [as_ids(x).tolist() for x in encoder(path, spaced)(every)] == wanted


def test_prefix_table_equals_library(texts):
    encode = pieces.prefix_table_encoder(PIECE)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    pick = random.Random(2)
    names = [library.id_to_piece(i) for i in range(259, library.get_piece_size())]
    joined = ["".join(pick.choice(names) for _ in range(pick.randint(1, 6))).replace("▁", " ") for _ in range(5_000)]
    for text in [*texts.values(), *odd_texts(), *joined, *(" " * k + "a" for k in range(100)), "ab" * 3_000]:
        ids = library.encode(text, add_eos=True)
        assert encode(text) == " ".join(map(str, ids)), ascii(text)[:200]
        assert encode.decode(encode(text)) == library.decode(ids)


def test_each_prefix_has_one_last_piece():
    """What the table relies on: of the pieces that end at a place, one fits, and it is the library's last."""
    encode = pieces.prefix_table_encoder(PIECE)
    for word in ("▁Thntblere", "▁retitioning", "▁aaaaaaaa", "▁Zukeitpf", "ciónrauedo"):
        last = [None] * (len(word) + 1)
        for end, (piece, length) in encode._automaton.iter(word):
            start = end + 1 - length
            if start == 0 or last[start] is not None and encode._pairs[last[start], piece]:
                assert last[end + 1] is None
                last[end + 1] = piece
        for end in range(1, len(word) + 1):
            assert last[end] == encode._ids[encode._merge(word[:end])[-1]]


def expected_pieces(rows):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    out = []
    for doc, text in rows:
        ids = library.encode(text or "", add_eos=True)
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        out.append((doc, len(ids), digest, hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    return sorted(out, key=str)


def test_encode_and_decode(docs, texts, awkward, nothing):
    rows = [tuple(r) for r in pieces.encode_and_decode(docs, PIECE).collect()]
    assert sorted(rows, key=str) == expected_pieces(texts.items())
    rows = [tuple(r) for r in pieces.encode_and_decode(awkward, PIECE).collect()]
    assert sorted(rows, key=str) == expected_pieces([r[:2] for r in AWKWARD])
    assert pieces.encode_and_decode(nothing, PIECE).collect() == []


def ids_of(path, text, end):
    library = ids_of.libraries.setdefault(path, Tokenizer.from_file(path))
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, end], "<u4")


ids_of.libraries = {}


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5_000])
def test_blocks_round_trip(n):
    pick = np.random.default_rng(n)
    for ids in (pick.integers(0, 50_257, n), pick.integers(0, 2**32, n), np.where(pick.random(n) < 0.05, 2**31 + 5, 17)):
        ids = ids.astype("<u4")
        cut = sorted(pick.integers(0, n + 1, 3).tolist())
        docs = [ids[a:b].tobytes() for a, b in zip([0, *cut], [*cut, n], strict=True)]
        shard = token_shards.Shard(token_shards.write_shard([None, 2, 3, 2], docs))
        assert shard.doc_ids == [None, 2, 3, 2] and shard.doc_starts.tolist() == [0, *cut, n]
        assert (shard.read_ids(0, n) == ids).all()
        for a, b in ((0, n), (n // 3, n // 2), (n, n), (max(0, n - 1), n)):
            assert (shard.read_ids(a, b) == ids[a:b]).all()


def check_shards(frame, rows, **kwargs):
    got = token_shards.read_token_shards(token_shards.write_token_shards(frame, BYTE, **kwargs)).collect()
    wanted, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = ids_of(BYTE, text, 0)
        wanted.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == wanted


def test_token_shards(docs, texts, awkward, nothing):
    check_shards(docs, texts.items())
    check_shards(docs, texts.items(), shard_ids=1_000)
    check_shards(awkward, [r[:2] for r in AWKWARD])
    assert token_shards.read_token_shards(token_shards.write_token_shards(nothing, BYTE)).collect() == []


def check_packing(frame, rows, length):
    got = packing.pack(frame, WORDS, length=length).collect()
    wanted: dict = {}
    for doc, text in rows:
        wanted.setdefault(doc, []).append(ids_of(WORDS, text, 2))
    by_doc: dict = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert by_doc.keys() == wanted.keys()
    for doc, copies in wanted.items():
        if len(copies) == 1 or len({c.tobytes() for c in copies}) == 1:
            at = 0
            for r in sorted(by_doc[doc], key=lambda r: r["start"])[:: len(copies)]:
                piece = copies[0][at : at + r["length"]]
                assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(copies[0]), zlib.crc32(piece.tobytes()))
                at += r["length"]
            assert at == len(copies[0])
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    short = 0
    for spans in sequences.values():
        at = 0
        for offset, size in sorted(spans):
            assert offset == at
            at += size
        assert at <= length
        short += at < length
    assert short <= 9


def test_packing(docs, texts, awkward, nothing):
    check_packing(docs, texts.items(), 4096)
    check_packing(docs, texts.items(), 64)
    check_packing(awkward.where("doc_id is null or doc_id <> 3"), [r[:2] for r in AWKWARD if r[0] != 3], 1 << 20)
    assert packing.pack(nothing, WORDS).collect() == []


def test_hilbert_keys_step_to_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert_key(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    assert set(np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1)) == {1}


def test_copies_share_a_key():
    keys = packing.curve_keys(["The same words here", "The same words here", "", "abc", "Ganz andere Wörter sind das"])
    assert keys[0] == keys[1] and keys[2] == keys[3] and keys[0] != keys[4]


