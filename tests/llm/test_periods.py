"""Periodic runs against a brute-force version that tries every period, and the planted query row by row."""
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.llm import periods, queries

SF = "/root/testdata/sf0.001"


def brute_runs(words):
    """All maximal stretches of every period up to half the words; the smallest period of a stretch stays."""
    best = {}
    for q in range(1, len(words) // 2 + 1):
        i = q
        while i < len(words):
            if words[i] != words[i - q]:
                i += 1
                continue
            first = i
            while i < len(words) and words[i] == words[i - q]:
                i += 1
            if i - first + q >= max(12, 2 * q):
                best.setdefault((first - q, i), q)
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def brute_collapse(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def check(texts):
    for text, (n, found, kept) in zip(texts, periods.judge(texts), strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        want = brute_runs(words)
        assert (n, found, kept) == (len(words), want, brute_collapse(words, want))


def fibonacci(n):
    a, b = "a ", "a b "
    while len(b) < 2 * n:
        a, b = b, b + a
    return b[:2 * n]


SHAPES = ["a " * 50, "a " * 12, "a " * 11, "a b " * 6, "a b " * 5 + "a", "a " * 40 + "b " + "a " * 40, "a a b " * 12 + "a b " + "a a b " * 12, fibonacci(300),
          ("a " * 20 + "b ") * 6, "x " + "a b c d e f g " * 2 + "y", "a b c d e f g h " * 2, "a b c d e f g h i j k l m n o p q " * 2 + "a b c", "", " \n", "one",
          " ".join(f"{i % 100}" for i in range(1000)), ("p " * 30 + "q r ") * 3 + "z " + "p " * 60]


def test_shapes():
    check(SHAPES)
    check([" ".join(shape for shape in random.Random(k).sample(SHAPES, 3)) for k in range(12)])


@pytest.mark.parametrize("seed", range(6))
def test_random_texts_of_few_words_and_planted_powers(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(60):
        out = []
        while len(out) < rng.randint(1, 160):
            root = [rng.choice("abc"[:rng.randint(1, 3)]) for _ in range(rng.randint(1, 20))]
            out += (root * rng.randint(1, 6))[:rng.randint(1, 60)]
        texts.append(" ".join(out))
    check(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", max_size=80), max_size=4))
def test_any_words(texts):
    check([" ".join(text) for text in texts] or [""])


@pytest.mark.parametrize("text", ["a " * 400_000, ("a " * 50_000 + "b ") * 2, "a b c " * 100_000, " ".join(map(str, range(30_000))) + " " + " ".join(map(str, range(30_000)))])
def test_long_texts_are_quick(text):
    start = time.time()
    (n, found, _), = periods.judge([text])
    assert time.time() - start < 30 and found and max(length for _, length, _ in found) > n // 3


def test_pieces_do_not_matter(monkeypatch):
    monkeypatch.setattr(periods, "PIECE", 64)
    monkeypatch.setattr(periods.pieces, "__defaults__", (64,))
    check(SHAPES)


ROWS = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 30), (4, "a " * 30), (None, "x y " * 9), (5, "w" * 100_000)]


def test_edges(spark):
    docs = spark.createDataFrame([row + ([1], 5, "z") for row in ROWS], "doc_id long, text string, runs array<int>, n_words long, collapsed string")
    out = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periods.find_runs(docs).collect()), key=repr)
    assert out == sorted([(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 30, [(0, 30, 1)], "a"), (4, 30, [(0, 30, 1)], "a"),
                          (None, 18, [(0, 18, 2)], "x y"), (5, 1, [], "w" * 100_000)], key=repr)
    assert periods.find_runs(docs.where("false")).count() == 0


def test_query(spark):
    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()
    want = []
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        (_, found, _), = periods.judge([" ".join(words)])
        if n < 1500:
            assert found == brute_runs(words)
        top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        want.append((doc_id, len(found), *(top or (None,) * 3), top and 1000 * top[1] // top[2], digest("".join(f"{s},{m},{q}\n" for s, m, q in found)),
                     digest(brute_collapse(words, found))))
    assert sorted(map(tuple, queries.queries()["op11_periodic_runs"](spark, SF).collect())) == sorted(want)
    assert np.mean([row[1] > 0 for row in want]) > 0.05
