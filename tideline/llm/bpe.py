"""Byte-level BPE: a minimal perfect hash answers whole pre-tokens of the vocabulary, a heap over linked bytes merges the others."""
import base64
import gc
import heapq
import itertools
import struct

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, read_table, text_or_empty
from .registry import query

#: A rank file above this is refused: its tables are broadcast.
MAX_BYTES = 64 << 20
#: Pre-tokens that are looked up at once, and merged pre-tokens (and pairs) that a worker remembers before it sets them aside for new ones.
CHUNK, REMEMBERED = 500_000, 300_000
#: Keys a bucket of the perfect hash holds on average.
LOAD = 3
#: Above every rank: two neighbours that make no token.
NONE = 1 << 31

_STEP, _SPREAD, _ALL = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1


#: Links of short pre-tokens, copied for each.
_AFTER, _BEFORE = list(range(1, 65)), list(range(-1, 63))


def _halves(keys):
    """128 bits of hash of every key, as two uint64 arrays."""
    import xxhash
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _place(right, shift, size):
    """Slot of a key under a bucket's shift."""
    x = right + shift * np.uint64(_STEP)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(_SPREAD)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


def perfect_hash(keys):
    """``shifts`` of a minimal perfect hash: every one of the n different keys has a slot of its own in 0..n-1.

    A key's bucket holds one number. Not negative, it shifts the hash of all keys of the bucket to free slots; -1 - s names the slot s of a bucket with
    one key. Buckets are placed from the largest down, the smallest shift that fits first.
    """
    size = len(keys)
    left, right = _halves(keys)
    bucket = (left % np.uint64(size // LOAD + 1)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    counts = np.bincount(bucket, minlength=size // LOAD + 1)
    stops = np.cumsum(counts)
    shifts, free = np.zeros(len(counts), np.int64), np.ones(size, bool)
    for b in np.argsort(-counts, kind="stable"):
        n = counts[b]
        if n < 2:
            break
        members, tried = right[order[stops[b] - n:stops[b]]], 0
        while True:
            trial = np.arange(tried, tried + 256, dtype=np.uint64)
            slots = np.sort(_place(members[None, :], trial[:, None], size), axis=1)
            fits = np.flatnonzero(free[slots].all(axis=1) & (slots[:, 1:] != slots[:, :-1]).all(axis=1))
            if len(fits):
                shifts[b] = tried + fits[0]
                free[slots[fits[0]]] = False
                break
            tried += 256
            if tried > 1 << 24:
                raise ValueError("two keys of the vocabulary are equal")
    shifts[counts == 1] = -1 - np.flatnonzero(free)[:(counts == 1).sum()]
    return shifts


def read_ranks(spark, path):
    """``[(bytes, rank)]`` of a rank file (base64 and number a line). A path with a scheme is read by Spark, another by the driver."""
    if "://" in path:
        data = bytes(spark.read.format("binaryFile").load(path).first().content)
    else:
        with open(path, "rb") as file:
            data = file.read(MAX_BYTES + 1)
    if len(data) > MAX_BYTES:
        raise ValueError(f"the rank file has more than {MAX_BYTES} bytes")
    return [(base64.b64decode(token), int(rank)) for token, rank in map(bytes.split, filter(bytes.strip, data.splitlines()))]


def tables(ranks):
    """What tasks need of a vocabulary, as plain values: shifts, and tokens and ranks in the order of their slots."""
    keys = [token for token, _ in ranks]
    if len(set(keys)) < len(keys) or len({rank for _, rank in ranks}) < len(ranks) or not {bytes([b]) for b in range(256)} <= set(keys):
        raise ValueError("tokens and ranks of a vocabulary must be unique, and every byte must be a token")
    shifts = perfect_hash(keys)
    slots = _slots(shifts, len(keys), keys)
    order = np.argsort(slots)
    return {"shifts": shifts, "tokens": [keys[i] for i in order], "ids": np.array([rank for _, rank in ranks], np.int64)[order]}


def _slots(shifts, size, keys):
    left, right = _halves(keys)
    shift = shifts[(left % np.uint64(len(shifts))).astype(np.int64)]
    return np.where(shift < 0, -1 - shift, _place(right, np.maximum(shift, 0).astype(np.uint64), size))


class Pairs(dict):
    """Id of the token that two neighbouring ids make (key: left << 32 | right), ``NONE`` where there is none. Filled through the perfect hash."""

    def __init__(self, words):
        super().__init__()
        self.words = words

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.clear()
        self[key] = found = self.words.find_one(self.words.by_id[key >> 32] + self.words.by_id[key & 0xFFFFFFFF])
        return found


class Vocabulary:
    """Both tiers over ``tables``."""

    def __init__(self, shifts, tokens, ids):
        self.shifts, self.tokens, self.ids = shifts, tokens, ids
        self.by_id = dict(zip(ids.tolist(), tokens, strict=True))
        self.shift_list, self.id_list = shifts.tolist(), ids.tolist()
        self.merged, self.older, self.pairs = {}, {}, Pairs(self)
        self.single = self.find([bytes([b]) for b in range(256)]).tolist()
        #: Where the bytes' own ids are bytes too, one call gives them.
        self.low = bytes(self.single) if max(self.single) < 256 else None
        self.byte_pairs = [[self.pairs[a << 32 | b] for b in self.single] for a in self.single]

    def find(self, keys):
        """Ids of byte strings; -1 for those that are no tokens."""
        slots = _slots(self.shifts, len(self.tokens), keys)
        same = np.fromiter((self.tokens[s] == key for s, key in zip(slots.tolist(), keys, strict=True)), bool, len(keys))
        return np.where(same, self.ids[slots], -1)

    def find_one(self, key):
        """Id of one byte string, or ``NONE``: the arithmetic of ``find`` on plain integers."""
        import xxhash
        left, right = struct.unpack("=QQ", xxhash.xxh3_128_digest(key))
        shift = self.shift_list[left % len(self.shift_list)]
        if shift >= 0:
            x = (right + shift * _STEP) & _ALL
            x = (x ^ (x >> 31)) * _SPREAD & _ALL
            slot = (x ^ (x >> 32)) % len(self.tokens)
        else:
            slot = -1 - shift
        return self.id_list[slot] if self.tokens[slot] == key else NONE

    def merge(self, piece):
        """Ids of a pre-token: always the pair of lowest rank is joined, the leftmost of equals. Heap entries are rank << 32 | place."""
        pairs, push, pop, byte_pairs = self.pairs, heapq.heappush, heapq.heappop, self.byte_pairs
        rank = [byte_pairs[a][b] for a, b in itertools.pairwise(piece)]
        heap = [r << 32 | i for i, r in enumerate(rank) if r < NONE]
        ids = list(piece.translate(self.low)) if self.low else [self.single[b] for b in piece]
        if not heap:
            return ids
        end = len(ids)
        rank.append(NONE)
        after, before = (_AFTER[:end], _BEFORE[:end]) if end <= len(_AFTER) else (list(range(1, end + 1)), list(range(-1, end - 1)))
        heapq.heapify(heap)
        while heap:
            top = pop(heap)
            i, joined = top & 0xFFFFFFFF, top >> 32
            if rank[i] != joined:
                continue
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j], rank[j] = joined, -1, NONE
            if k < end:
                before[k] = i
                rank[i] = r = pairs[joined << 32 | ids[k]]
                if r < NONE:
                    push(heap, r << 32 | i)
            else:
                rank[i] = NONE
            if i:
                h = before[i]
                rank[h] = r = pairs[ids[h] << 32 | joined]
                if r < NONE:
                    push(heap, r << 32 | h)
        return [x for x in ids if x >= 0]

    def encode(self, pieces):
        """Ids of a list of pre-tokens as one array, and how many each has. Equal pre-tokens are looked up once."""
        import pandas as pd
        codes, different = pd.factorize(np.array(pieces, object))
        keys = [piece.encode() for piece in different]
        whole = self.find(keys) if keys else np.zeros(0, np.int64)
        lists = [[x] for x in whole.tolist()]
        for k in np.flatnonzero(whole < 0).tolist():
            known = self.merged.get(keys[k]) or self.older.get(keys[k])
            if known is None:
                known = self.merge(keys[k])
                if len(keys[k]) <= 64:
                    self.merged[keys[k]] = known
            lists[k] = known
        if len(self.merged) >= REMEMBERED:
            self.merged, self.older = {}, self.merged
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        pool = np.fromiter(itertools.chain.from_iterable(lists), np.int32, sizes.sum())
        counts = sizes[codes]
        starts = (np.cumsum(sizes) - sizes)[codes] - (np.cumsum(counts) - counts)
        return pool[np.repeat(starts, counts) + np.arange(counts.sum())], counts


def _chunks(texts, pattern):
    """Lists of ``(row, pre-token)`` in order, about ``CHUNK`` at a time, however long a text is: rows and pre-tokens as two lists."""
    rows, pieces = [], []
    for row, text in enumerate(texts):
        found = (m[0] for m in pattern.finditer(text)) if len(text) > CHUNK else iter(pattern.findall(text))
        while part := list(itertools.islice(found, CHUNK)):
            pieces += part
            rows.append((row, len(part)))
            if len(pieces) >= CHUNK:
                yield rows, pieces
                rows, pieces = [], []
    yield rows, pieces


def coded(batch, words, pattern, pa):
    """An Arrow batch of (doc_id, text) with ids in place of texts."""
    texts, parts = batch.column(1).to_pylist(), []
    sizes = np.zeros(len(texts), np.int64)
    for rows, pieces in _chunks(texts, pattern):
        ids, counts = words.encode(pieces)
        parts.append(ids)
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0] + [n for _, n in rows])]
        np.add.at(sizes, [row for row, _ in rows], np.diff(ends))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))
    return pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])


def encode(docs, vocabulary, pattern, column="text"):
    """``doc_id, ids``: token ids of the whole text of every row, without special tokens. ``vocabulary`` is the path of a rank file.

    ``pattern`` cuts a text into pre-tokens, which are encoded one by one. Null and empty texts have no ids (an empty array); repeated rows stay
    repeated, other columns are left out. Rows need no exchange. A batch is a few MB of text, a longer text is worked through in parts.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(tables(read_ranks(spark, vocabulary)))
    source = docs.select("doc_id", text_or_empty(column).alias("text"))

    def run(batches):
        import pyarrow as pa
        import regex
        words, cut = Vocabulary(**shared.value), regex.compile(pattern)
        # No cycles are made here; collections would only walk the remembered pre-tokens over and over.
        gc.disable()
        try:
            yield from (coded(batch, words, cut, pa) for batch in batches)
        finally:
            gc.enable()

    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType(), False))]))


def decode(encoded, vocabulary):
    """The rows of ``encoded`` (``doc_id, ids``) plus ``bytes``: what the ids stand for. Null ids give null; an id without a token ends the job."""
    spark = encoded.sparkSession
    bound_batches(spark)
    ranks = read_ranks(spark, vocabulary)
    if max(rank for _, rank in ranks) > MAX_BYTES:
        raise ValueError("ranks of a vocabulary must be near its size")
    shared = spark.sparkContext.broadcast(ranks)
    source = encoded.select("doc_id", "ids")

    def run(batches):
        import pyarrow as pa
        token = np.full(max(rank for _, rank in shared.value) + 1, None, object)
        for key, rank in shared.value:
            token[rank] = key
        for batch in batches:
            out = []
            for ids in batch.column(1):
                out.append(b"".join(token[ids.values.to_numpy()].tolist()) if ids.is_valid else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "ids", "bytes"])

    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("bytes", T.BinaryType())]))


@query("op13_byte_bpe")
def op13(spark, sf_dir):
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = decode(encode(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("bytes", 256).alias("decoded_sha256"))
