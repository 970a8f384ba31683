"""Byte-level BPE: the perfect hash on its own, and whole texts against the tiktoken library and an exact round trip."""
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tideline.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(bpe.read_ranks(None, PATH)), special_tokens={})


@pytest.fixture(scope="module")
def words():
    return bpe.Vocabulary(**bpe.tables(bpe.read_ranks(None, PATH)))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_perfect_hash_is_minimal(size):
    keys = [f"key {i}".encode() for i in range(size)]
    assert sorted(bpe._slots(bpe.perfect_hash(keys), size, keys)) == list(range(size))


def test_every_token_is_found_and_others_are_not(words):
    ranks = dict(bpe.read_ranks(None, PATH))
    keys = list(ranks) + [key + b"\xff\x00" for key in ranks]
    assert np.array_equal(words.find(keys), [ranks.get(key, -1) for key in keys])
    assert [words.find_one(key) for key in keys[::97]] == [ranks.get(key, bpe.NONE) for key in keys[::97]]


def test_merges_equal_the_library(words, library):
    random.seed(3)
    for alphabet in ("ab", "the inga", "aé中\U0001F600", "".join(map(chr, range(1, 300)))):
        for length in (1, 2, 3, 10, 60, 3000):
            piece = "".join(random.choice(alphabet) for _ in range(length)).encode()
            known = int(words.find([piece])[0])
            assert ([known] if known >= 0 else words.merge(piece)) == library._core_bpe.encode_single_piece(piece)


TEXTS = [(1, None), (2, ""), (3, " \n\t  x"), (4, "don't we'll 'S   \x1c\x85 á \U0001F469‍\U0001F680<|endoftext|>"), (5, "a" * 70_000), (6, "x y " * 80_000),
         (7, "same"), (7, "same"), (None, "no id"), (8, "".join(map(chr, range(1, 0xD800, 7))))]


def test_texts_equal_the_library_and_come_back(spark, library):
    docs = spark.createDataFrame([row + ([0], b"x") for row in TEXTS], "doc_id long, text string, ids array<int>, bytes binary")
    out = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    want = [(doc_id, library.encode_ordinary(text or ""), (text or "").encode()) for doc_id, text in TEXTS]
    assert sorted(((r.doc_id, r.ids, bytes(r.bytes)) for r in out), key=repr) == sorted(want, key=repr)
    assert bpe.encode(docs.where("false"), PATH, public_tokenizers.PATTERN).count() == 0


def test_small_vocabulary_and_refusals(spark, tmp_path):
    import base64
    ranks = [(bytes([b]), b) for b in range(256)] + [(b"ab", 256), (b"bc", 257), (b"abc", 258)]
    path = tmp_path / "ranks"
    path.write_text("".join(f"{base64.b64encode(key).decode()} {rank}\n" for key, rank in ranks))
    docs = spark.createDataFrame([(1, "abc"), (2, "bcab"), (3, "xab")], "doc_id long, text string")
    assert {r.doc_id: r.ids for r in bpe.encode(docs, str(path), ".+").collect()} == {1: [258], 2: [257, 256], 3: [120, 256]}
    with pytest.raises(ValueError, match="every byte"):
        bpe.tables(ranks[1:])


def test_query(spark, library):
    import hashlib
    out = queries.queries()["op13_byte_bpe"](spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, out)) == sorted(want)
