"""Suffix-array dedup of byte strings: suffixes grouped by Lyndon prefix, in linear time, over shards of text that may repeat."""
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from . import winnow
from .common import bound_batches, read_table, stored
from .passages import LONGS, table
from .registry import query

#: Bytes of a repeated string, and of the k-grams that anchor it.
WIDTH, GRAM = 200, 64
#: Distinct runs of one anchor that one suffix array holds; more are dealt out, and what meets only across parts is found by counting windows.
PART_RUNS = 4096
#: Bytes of one suffix array, about: whole groups are added until it is reached.
ARRAY_BYTES = 1 << 16


def suffix_array(symbols):
    """Suffix array of non-negative integers whose last one is the only smallest, by grouping in two passes.

    First, groups of suffixes that share a prefix are taken in descending order. The members of a group point to the nearest earlier suffix of a smaller
    group; those pointed to equally often from this group move, within their own group, behind the rest: their prefix has grown by so many copies of this
    one. In the end each group shares its Lyndon prefix. Second, suffixes are emitted in ascending order: each places the suffix before it, and that one's
    pointers in turn, at the next free place of their groups.
    """
    n = len(symbols)
    order = sorted(range(n), key=symbols.__getitem__)
    group, end, start_at, members = [0] * n, {}, [0] * n, {}
    begin = 0
    for place in range(1, n + 1):
        if place == n or symbols[order[place]] != symbols[order[begin]]:
            members[begin] = order[begin:place]
            for i in members[begin]:
                group[i] = begin
            end[begin], start_at[place - 1] = place - 1, begin
            begin = place
    previous, last = [-1] * n, n - 1
    while last >= 0:
        g = start_at[last]
        pointed = {}
        for i in sorted(i for i in members.pop(g) if group[i] == g):
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        by_count = {}
        for j, count in pointed.items():
            by_count.setdefault(count, {}).setdefault(group[j], []).append(j)
        for count in sorted(by_count, reverse=True):
            for old, moved in by_count[count].items():
                stop = end[old]
                new = stop - len(moved) + 1
                if new == old:
                    continue
                for j in moved:
                    group[j] = new
                members[new] = moved
                end[new], start_at[stop] = stop, new
                end[old], start_at[new - 1] = new - 1, old
        last = g - 1
    out, free = [-1] * n, {}
    out[0] = n - 1
    for place in range(n):
        j = out[place] - 1
        while j >= 0:
            g = group[j]
            at = free.get(g, g)
            if out[at] != -1:
                break
            out[at], free[g] = j, at + 1
            j = previous[j]
    return out


class Shard:
    """Some whole texts as bytes, and the runs of their windows."""

    def __init__(self, texts, width, gram):
        data = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        self.bounds = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
        self.buffer, self.width = b"".join(data), width
        self.document, self.first, self.last, anchors = winnow.runs(np.frombuffer(self.buffer, np.uint8).astype(np.uint64) + np.uint64(1), self.bounds, width, gram)
        self.anchor = anchors.view(np.int64) if len(anchors) else np.zeros(0, np.int64)

    def spans(self):
        return zip(self.first.tolist(), (self.last + self.width).tolist(), strict=True)

    def contents(self):
        digest, buffer = xxhash.xxh3_64_intdigest, self.buffer
        return np.fromiter((digest(buffer[a:b]) for a, b in self.spans()), np.uint64, len(self.first)).view(np.int64)


def shards(batch, width, gram):
    texts = batch.column("text").to_pylist()
    for a, b in winnow.chunks([len(t) if t else 0 for t in texts]):
        yield range(a, b), Shard(texts[a:b], width, gram)


def run_table(docs, width, gram):
    def scan(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for rows, shard in shards(batch, width, gram):
                yield table(LONGS, [ids.take(pa.array(rows.start + shard.document)), shard.anchor, shard.contents()])
    return docs.mapInArrow(scan, "doc_id long, anchor long, content long")


RUN = [("anchor", pa.int64()), ("part", pa.int32()), ("split", pa.bool_()), ("doc_id", pa.int64()), ("content", pa.int64()), ("known", pa.bool_()), ("data", pa.binary())]


def open_runs(rows, width, gram):
    """The bytes of each run that a document's list ``open`` names, once a document row."""
    def scan(batches):
        for batch in batches:
            ids, named = batch.column("doc_id").to_pylist(), batch.column("open")
            for rows_, shard in shards(batch, width, gram):
                out, now = [], None
                for i, (content, (a, b)) in enumerate(zip(shard.contents().tolist(), shard.spans(), strict=True)):
                    at = rows_.start + int(shard.document[i])
                    if at != now:
                        now, wanted = at, {x["content"]: x for x in named[at].as_py()}
                    x = wanted.pop(content, None)
                    if x:
                        out.append((int(shard.anchor[i]), x["part"], x["split"], ids[at], content, x["known"], shard.buffer[a:b]))
                if out:
                    yield table(RUN, list(zip(*out, strict=True)))
    return rows.mapInArrow(scan, "anchor long, part int, split boolean, doc_id long, content long, known boolean, data binary")


_BLANKS = re.compile(rb"[^\x00\x09-\x0D\x20]*[\x00\x09-\x0D\x20]")


def byte_order(runs, width):
    """Window starts of ``runs`` (bytes) in the order of their suffixes: arrays ``run, at``.

    The suffix array is built over tokens, a word with the blank that ends it. No token begins another, so the order of token sequences is that of
    bytes. A suffix that starts inside a token then falls in place by the rest of that token and the rank of the next.
    """
    tokens = [_BLANKS.findall(data + b"\0") for data in runs]
    rests = {}
    for token in {t for row in tokens for t in row}:
        rests[token] = [token[i:] for i in range(len(token))]
    rank = {rest: i for i, rest in enumerate(sorted({x for row in rests.values() for x in row}))}
    places = {token: np.array([rank[x] for x in row]) for token, row in rests.items()}
    symbols, byte_rests, following, at = [], [], [], 0
    for row in tokens:
        symbols.extend([rank[t] + 2 for t in row])
        symbols.append(1)
        byte_rests.extend([places[t] for t in row])
        following.append(np.repeat(np.arange(at + 1, at + 1 + len(row)), [len(t) for t in row]))
        at = len(symbols)
    symbols.append(0)
    token_rank = np.empty(len(symbols), np.int64)
    token_rank[suffix_array(symbols)] = np.arange(len(symbols))
    keys = np.concatenate(byte_rests) * len(symbols) + token_rank[np.concatenate(following)]
    lengths = np.array([len(data) + 1 for data in runs])
    run = np.repeat(np.arange(len(runs)), lengths)
    at = np.arange(len(keys)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    start = np.flatnonzero(at + width < lengths[run])
    start = start[np.argsort(keys[start], kind="stable")]
    return run[start], at[start]


def window_classes(runs, width):
    """Windows of ``runs`` (bytes) in the order of one suffix array over all: arrays ``run, at, place, same``.

    ``place`` is where a window starts in the runs one after another, each with one byte more; ``same`` says whether it equals the window before it.
    """
    run, at = byte_order(runs, width)
    lengths = np.array([len(data) + 1 for data in runs])
    text = np.frombuffer(b"".join(data + b"\0" for data in runs), np.uint8)
    place = (np.cumsum(lengths) - lengths)[run] + at
    same = np.zeros(len(place), bool)
    reach = np.arange(width)
    for a in range(0, len(place) - 1, 4096):
        block = text[place[a:a + 4097, None] + reach]
        same[a + 1:a + len(block)] = (block[1:] == block[:-1]).all(1)
    return run, at, place, same, text


def repeated_windows(runs, width):
    """For each of ``runs`` the starts of the windows that also start elsewhere in them."""
    run, at, _, same, _ = window_classes(runs, width)
    twice = same | np.append(same[1:], False)
    found = [[] for _ in runs]
    for number, i in zip(run[twice].tolist(), at[twice].tolist(), strict=True):
        found[number].append(i)
    return found


FOUND = [("anchor", pa.int64()), ("whole", pa.int64()), ("doc_id", pa.int64()), ("content", pa.int64()), ("at", pa.int32()), ("kind", pa.int32())]
#: Kinds of found rows: a window that repeats; one of a split group that does not inside its part; one that stands for its equals in the part.
REPEATS, OPEN, STANDS = 0, 1, 2


def judge_part(held, width):
    """Rows of ``FOUND`` for runs ``(anchor, split, doc_id, content, known, data)``; known runs repeat anyway and only stand for others."""
    run, at, place, same, text = window_classes([x[5] for x in held], width)
    twice = same | np.append(same[1:], False)
    split, known = (np.array([x[i] for x in held], bool)[run] for i in (1, 4))
    kind = np.where(twice & ~known, REPEATS, np.where(split & ~twice & ~known, OPEN, -1))
    heads = np.flatnonzero(split & ~same & (twice | known))
    every = np.concatenate([np.flatnonzero(kind >= 0), heads])
    if not len(every):
        return None
    kinds = np.concatenate([kind[kind >= 0], np.full(len(heads), STANDS)])
    whole = winnow.span_hashes(text.astype(np.uint64) + np.uint64(1), place[every], place[every] + width, 0x8CB92BA72F3D8DD7).view(np.int64)
    anchor, doc_id, content = (np.array([x[i] for x in held], object)[run[every]] for i in (0, 2, 3))
    return table(FOUND, [anchor.tolist(), whole, doc_id.tolist(), content.tolist(), at[every].astype(np.int32), kinds.astype(np.int32)])


def shared_windows(runs, width, array_bytes=ARRAY_BYTES):
    """``doc_id, content, at``: windows that runs of one anchor share, by suffix arrays over whole parts.

    For anchors of more than one part, windows that are single in their part are counted over all parts, against one of each class of equals: by 128
    bits of hash (their own and their anchor's).
    """
    names = ("anchor", "part", "split", "doc_id", "content", "known", "data")

    def scan(batches):
        held, size, group = [], 0, None
        for batch in batches:
            for anchor, part, *row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if (anchor, part) != group and size >= array_bytes:
                    if (found := judge_part(held, width)) is not None:
                        yield found
                    held, size = [], 0
                group = (anchor, part)
                held.append((anchor, *row))
                size += len(row[-1])
        if held and (found := judge_part(held, width)) is not None:
            yield found

    dealt = runs.repartition(F.col("anchor"), F.col("part")).sortWithinPartitions("anchor", "part")
    found = stored(dealt.mapInArrow(scan, "anchor long, whole long, doc_id long, content long, at int, kind int"), "found")
    left = found.where(f"kind <> {REPEATS}")
    twice = left.groupBy("anchor", "whole").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    across = found.where(f"kind = {OPEN}").join(twice, ["anchor", "whole"])
    return found.where(f"kind = {REPEATS}").select("doc_id", "content", "at").union(across.select("doc_id", "content", "at"))


def find_repeats(docs, width=WIDTH, gram=GRAM, part_runs=PART_RUNS):
    """Tables ``(doc_id, content)`` of runs that occur twice or more, and ``(doc_id, content, places)`` of single windows that do, in runs that occur once."""
    runs = stored(run_table(docs, width, gram), "runs")
    classes = stored(runs.groupBy("anchor", "content").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")), "classes")
    shared = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    again = classes.where("n > 1").select("anchor", "content")
    whole = runs.join(again, ["anchor", "content"]).select("doc_id", "content").distinct()
    opened = classes.join(shared, "anchor").select("doc_id", F.struct(
        "content", F.expr(f"cast(pmod(content, ceil(kinds / {part_runs})) as int)").alias("part"), F.expr(f"kinds > {part_runs}").alias("split"),
        F.expr("n > 1").alias("known")).alias("x")).groupBy("doc_id").agg(F.collect_list("x").alias("open"))
    data = stored(open_runs(joined(docs, opened, "inner"), width, gram), "open-runs")
    single = shared_windows(data, width).groupBy("doc_id", "content").agg(F.collect_set("at").alias("places"))
    return whole, single


def joined(docs, lists, how):
    """Documents with their lists; a null doc_id is an id like any other."""
    return docs.join(lists.withColumnRenamed("doc_id", "list_id"), F.col("doc_id").eqNullSafe(F.col("list_id")), how).drop("list_id")


OUT = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]


def remove_repeats(docs, width=WIDTH, gram=GRAM, part_runs=PART_RUNS):
    """``doc_id, n_bytes, n_removed, n_spans, kept`` for every row of ``docs``: the UTF-8 bytes outside all strings of ``width`` bytes that start twice.

    Both places count, in one text or two; equal rows are two texts. Null and empty texts have no bytes. Strings are judged on the input. Rows without
    doc_id take part. Other columns are not read. Texts pass whole; what repeats as a whole run needs only counts, and only distinct runs that share an
    anchor with others come to a suffix array.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    whole, single = find_repeats(docs, width, gram, part_runs)
    parts = whole.groupBy("doc_id").agg(F.collect_list("content").alias("whole")).withColumnRenamed("doc_id", "left_id")
    places = single.groupBy("doc_id").agg(F.collect_list(F.struct("content", "places")).alias("single"))
    known = parts.join(places, F.col("left_id").eqNullSafe(F.col("doc_id")), "full").select(F.coalesce("left_id", "doc_id").alias("doc_id"), "whole", "single")

    def scan(batches):
        for batch in batches:
            ids, whole_, single_ = batch.column("doc_id").to_pylist(), batch.column("whole"), batch.column("single")
            for rows, shard in shards(batch, width, gram):
                gone, now = np.zeros(len(shard.buffer) + 1, np.int32), None
                for i, content in enumerate(shard.contents().tolist()):
                    at = rows.start + int(shard.document[i])
                    if at != now:
                        now, full = at, set(whole_[at].as_py() or ())
                        loose = {x["content"]: x["places"] for x in single_[at].as_py() or ()}
                    a = int(shard.first[i])
                    if content in full:
                        gone[a] += 1
                        gone[shard.last[i] + width] -= 1
                    else:
                        for place in loose.get(content, ()):
                            gone[a + place] += 1
                            gone[a + place + width] -= 1
                keep = np.cumsum(gone[:-1]) == 0
                buffer, out = np.frombuffer(shard.buffer, np.uint8), []
                for at, a, b in zip(rows, shard.bounds[:-1], shard.bounds[1:], strict=True):
                    mask = keep[a:b]
                    removed = int(len(mask) - mask.sum())
                    spans = int((~mask[:1]).sum() + (mask[:-1] & ~mask[1:]).sum()) if removed else 0
                    out.append((ids[at], int(b - a), removed, spans, buffer[a:b][mask].tobytes() if removed else shard.buffer[a:b]))
                yield table(OUT, list(zip(*out, strict=True)))

    return joined(docs, known, "left").mapInArrow(scan, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


@query("op5_suffix_dedup")
def op5(spark, sf_dir):
    done = remove_repeats(read_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
