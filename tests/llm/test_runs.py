"""Operator 11: Lyndon arrays and runs against their definitions, and the query against plain Python."""

import hashlib
import random
import re
import zlib

import pytest
from cases import AWKWARD
from hypothesis import given, settings, strategies as st

from purser.llm import queries, runs


def brute_lyndon(x):
    """The next smaller suffix ends the longest Lyndon word."""
    n = len(x)
    return [next((j for j in range(i + 1, n) if x[j:] < x[i:]), n) - i for i in range(n)]


def brute_runs(x, least=24, periods=3):
    n, found = len(x), []
    for q in range(1, n // periods + 1):
        at = 0
        while at + q < n:
            if x[at] != x[at + q]:
                at += 1
                continue
            end = at + q
            while end < n and x[end] == x[end - q]:
                end += 1
            part = x[at:end]
            if end - at >= max(least, periods * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                found.append((at, end - at, q))
            at = end - q + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    best = (None, None, None, None)
    if found:
        s, length, q = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]))
        best = (s, length, q, 1000 * length // q)
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in (
        "".join(f"{s},{length},{q}\n" for s, length, q in found), " ".join(w for i, w in enumerate(words) if i not in drop))]
    return (doc_id, len(found), *best, *sha)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_grouping_gives_lyndon_arrays(x):
    assert runs.lyndon_array(x) == brute_lyndon(x)
    assert runs.lyndon_array([-v for v in x]) == brute_lyndon([-v for v in x])


@settings(deadline=None, max_examples=300)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_short_runs(x):
    assert runs.periodic_runs(x, 2, 2) == brute_runs(x, 2, 2)
    assert runs.periodic_runs(x, 5, 3) == brute_runs(x, 5, 3)


def periodic_text(pick):
    """Blocks repeated inside blocks that are repeated, with some words changed."""
    words = []
    while len(words) < pick.randint(30, 400):
        block = [pick.choice("abcdefgh") for _ in range(pick.randint(1, 30))]
        if pick.random() < 0.5:
            block = block * pick.randint(1, 6) + ["z"]
        words += block * pick.randint(1, 6)
    for _ in range(pick.randint(0, 3)):
        words[pick.randrange(len(words))] = "y"
    return words


def test_runs_of_many_texts_at_once():
    pick = random.Random(3)
    texts = [periodic_text(pick) for _ in range(120)] + [[], ["a"], ["a"] * 23, ["a"] * 24, ["a", "b"] * 5000]
    assert runs.runs_of_texts(texts[:-1]) == [brute_runs(t) for t in texts[:-1]]
    assert runs.runs_of_texts(texts)[-1] == [(0, 10_000, 2)]
    assert sum(map(len, runs.runs_of_texts(texts))) > 100


def test_collapsed_text_drops_all_later_periods():
    assert runs.collapsed(list("abcabcabcx"), [(0, 9, 3)]) == "a b c x"
    assert runs.collapsed(list("aaab"), []) == "a a a b"


def test_query(spark, sf_dir, texts):
    got = {tuple(r) for r in queries.QUERIES["op11_runs"](spark, sf_dir).collect()}
    assert got == {brute_row(d, t) for d, t in texts.items()}
    assert any(r[1] for r in got) and any(r[5] and r[5] >= 5000 for r in got)


def test_awkward_rows(spark, awkward, nothing):
    rows = [tuple(r) for r in runs.digests(runs.find_runs(awkward, rewrite=runs.with_repeats)).collect()]
    short = {str(brute_row(*r[:2])) for r in AWKWARD if r[0] != 5}
    assert {str(r) for r in rows if r[0] != 5} == short and len(rows) == len(AWKWARD)
    assert next(r for r in rows if r[0] == 5)[1:6] == (1, 0, 30_000, 1, 30_000_000)
    assert runs.find_runs(nothing).collect() == []


@pytest.mark.parametrize("n", [3_000])
def test_long_nested_periods_take_no_quadratic_time(n):
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < n:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    x = [ord(c) for c in fibonacci[-1]]
    assert runs.periodic_runs(x) == brute_runs(x)
