"""Periodic runs of words: an online sparse dynamic programme over the diagonals of a text against itself.

A diagonal is a lag: on it, the match length at a word is one more than at the word before if the word also stands lag words earlier, else nothing. A
stretch of matches on a diagonal that neither side extends is a run of that period. Two things keep the diagonals few. A run of period q has at
least q matches, so lags from L to 2 L - 1 are opened only where L words in a row recur (L a power of two), and only by earlier occurrences that
another word precedes: others lie on a diagonal opened before. And where the last words already have a period that divides the lag, over the lag or
more, the lag is no smallest period and is not opened. Together that is O(log n) openings a word, also in texts of one word.
"""
import heapq
import re

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, WORD, bound_batches, read_table, text_or_empty
from .registry import query

#: A run has at least so many words, and at least two periods.
LEAST = 12
#: Shortest context that opens a diagonal; runs of lags below twice that have at least 12 - 6 matches.
CONTEXT = 4
#: Characters of texts that are cut into words at once.
PIECE = 1 << 20

_word, _blank = re.compile(WORD), re.compile(BLANKS)


def pieces(text, size=PIECE):
    """Lists of the words of a text, at most about ``size`` characters at a time."""
    start = 0
    while start < len(text):
        gap = _blank.search(text, start + size) if start + size < len(text) else None
        stop = gap.start() if gap else len(text)
        yield _word.findall(text[start:stop])
        start = stop


class Numbers:
    """Numbers of words, the same for equal words."""

    def __init__(self):
        self.known = {}

    def of(self, words):
        import pandas as pd
        codes, different = pd.factorize(np.array(words, object))
        return np.array([self.known.setdefault(word, len(self.known)) for word in different], np.int64)[codes]


def _name(keys, at):
    """Places whose key occurs more than once, by key and place, with a number for each key."""
    order = np.argsort(keys, kind="stable")
    names = np.concatenate([[0], np.cumsum(np.diff(keys[order]) != 0)])
    again = np.bincount(names)[names] > 1
    return names[again], at[order][again]


def openings(codes, owner):
    """Arrays ``end, length, name, before``, in order of ``end``: words where a context of ``length`` words ends that recurs less than twice its length away.

    ``owner`` is the text of each word: equal contexts of one text have equal names. ``before`` is the word before the context, -1 at the start of a text.
    Contexts of doubled length are pairs of names, so names are exact.
    """
    found, length = [], 1
    names, at = _name(owner * (codes.max() + 1) + codes, np.arange(len(codes)))
    dense = np.full(len(codes) + 1, -1)
    while len(at):
        if length >= CONTEXT:
            near = (np.diff(at) < 2 * length) & (np.diff(names) == 0)
            near = np.concatenate([[False], near]) | np.concatenate([near, [False]])
            first = at[near]
            inside = (first > 0) & (owner[first - 1] == owner[first])
            found.append((first + length - 1, np.full(len(first), length), names[near], np.where(inside, codes[first - 1], -1)))
        dense[:] = -1
        dense[at] = names
        right = dense[np.minimum(at + length, len(codes))]
        names, at = names[right >= 0] * (len(codes) + 1) + right[right >= 0], at[right >= 0]
        if len(at):
            names, at = _name(names, at)
        length *= 2
    if not found:
        return [np.zeros(0, np.int64)] * 4
    merged = [np.concatenate(x) for x in zip(*found, strict=True)]
    order = np.lexsort((merged[1], merged[0]))
    return [x[order] for x in merged]


def _matches(codes, i, j):
    """How many words from ``i`` on equal those from ``j`` on (``j`` < ``i``)."""
    done, step = 0, 16
    while i + done < len(codes):
        left = codes[i + done:i + done + step]
        unlike = np.flatnonzero(left != codes[j + done:j + done + len(left)])
        if len(unlike):
            return done + int(unlike[0])
        done += len(left)
        step *= 4
    return len(codes) - i


def runs(codes, opened):
    """``(start, length, period)`` of all runs of one text, from its word numbers and its rows of ``openings`` (ends counted from its first word).

    Words are taken in order. ``active`` has the open lags with the start of their stretch; its end is looked up when a lag is opened, so match lengths
    grow by blocks of words. A diagonal that ends gives its run at once; of those with the same stretch the smallest lag, which is the period.
    """
    earlier, active, ending, found = {}, {}, [], []

    def emit(upto):
        last = None
        while ending and ending[0][0] <= upto:
            stop, start, lag = heapq.heappop(ending)
            active.pop(lag)
            if last != (stop, start):
                found.append((start, stop - start, lag))
            last = stop, start

    for i, length, name, before in zip(*(x.tolist() for x in opened), strict=True):
        emit(i)
        places = earlier.setdefault((length, name), {})
        for word, ends in places.items():
            if word == before:
                continue
            for j in reversed(ends):
                lag = i - j
                if lag >= 2 * length:
                    break
                if lag < length and length > CONTEXT:
                    continue
                small = min(active, default=0)
                if small and small < lag and lag % small == 0 and i + 1 - active[small] >= lag:
                    continue
                start, stop = j - length + 1, i + 1 + _matches(codes, i + 1, j + 1)
                if stop - start >= max(LEAST, 2 * lag):
                    active[lag] = start
                    heapq.heappush(ending, (stop, start, lag))
        places.setdefault(before, []).append(i)
    emit(len(codes))
    return sorted(found, key=lambda run: (run[0], run[2]))


def _kept(count, found):
    """Which words are in no run after its first period."""
    edge = np.zeros(count + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def _collapsed(text, keep):
    """Kept words of a text, joined by one space."""
    parts, done = [], 0
    for words in pieces(text):
        mask = keep[done:done + len(words)]
        part = words if mask.all() else [word for word, stays in zip(words, mask.tolist(), strict=True) if stays]
        done += len(words)
        if part:
            parts.append(" ".join(part))
    return " ".join(parts)


def judge(texts):
    """``(count of words, runs, collapsed text)`` of every text of a group."""
    numbers, codes, flat, counts = Numbers(), [], [], []
    for text in texts:
        counts.append(0)
        for words in pieces(text):
            flat += words
            counts[-1] += len(words)
            if len(flat) > PIECE:
                codes.append(numbers.of(flat))
                flat = []
    codes = np.concatenate([*codes, numbers.of(flat)])
    bounds = np.concatenate([[0], np.cumsum(counts)])
    opened = openings(codes, np.repeat(np.arange(len(texts)), counts)) if len(codes) else [codes] * 4
    cuts = np.searchsorted(opened[0], bounds)
    for k, text in enumerate(texts):
        own = slice(cuts[k], cuts[k + 1])
        found = runs(codes[bounds[k]:bounds[k + 1]], [opened[0][own] - bounds[k], *(x[own] for x in opened[1:])]) if cuts[k] < cuts[k + 1] else []
        yield counts[k], found, _collapsed(text, _kept(counts[k], found))


def _groups(texts, size=PIECE):
    """Consecutive texts of together about ``size`` characters; a longer text is a group of its own."""
    group, held = [], 0
    for text in texts:
        if group and held + len(text) > size:
            yield group
            group, held = [], 0
        group.append(text)
        held += len(text)
    if group:
        yield group


RUN = T.StructType([T.StructField(name, T.LongType(), False) for name in ("start", "length", "period")])


def find_runs(docs, column="text"):
    """One row per row of ``docs``: ``doc_id, n_words, runs, collapsed``. Runs are (start, length, period) by start and period, words count from 0.

    A run is a stretch of at least 12 words and two of its smallest periods that no neighbour extends. ``collapsed`` is the text without the words that
    some run holds after its first period, joined by one space. Null, empty and blank texts have no words, no runs and an empty collapsed text. Rows are
    judged one by one: nothing is shuffled, repeated rows stay, other columns are left out.
    """
    bound_batches(docs.sparkSession)
    source = docs.select("doc_id", text_or_empty(column).alias("text"))
    run_type = T.ArrayType(RUN, False)

    def run(batches):
        import pyarrow as pa
        held = pa.list_(pa.struct([pa.field(name, pa.int64(), False) for name in RUN.names]))
        for batch in batches:
            out = [row for group in _groups(batch.column(1).to_pylist()) for row in judge(group)]
            counts, found, kept = zip(*out, strict=True) if out else ((), (), ())
            found = [[dict(zip(RUN.names, item, strict=True)) for item in items] for items in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, held), pa.array(kept, pa.string())],
                                             ["doc_id", "n_words", "runs", "collapsed"])

    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("runs", run_type),
                                                T.StructField("collapsed", T.StringType())]))


def plant_runs(docs):
    """``doc_id, text``, the text of about every tenth document made periodic from one of its words on, as the contract of op11 says."""
    words = f"filter(split(coalesce(text, ''), r'{BLANKS}'), w -> w <> '')"
    seeded = docs.select("doc_id", "text", F.expr("crc32(cast(cast(doc_id as string) as binary))").alias("h")).withColumn("g", F.expr("h div 10"))
    seeded = seeded.withColumn("words", F.expr(f"if(h % 10 = 0, {words}, null)")).withColumn("n", F.expr("cast(size(words) as bigint)"))
    seeded = seeded.withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    planted = "array_join(transform(words, (w, i) -> if(i < a, w, words[cast(a + (i - a) % p as int)])), ' ')"
    return seeded.select("doc_id", F.expr(f"if(h % 10 = 0 and n > 0, {planted}, text)").alias("text"))


@query("op11_periodic_runs")
def op11(spark, sf_dir):
    found = find_runs(plant_runs(read_table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = found.withColumn("top", F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))"))
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return longest.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.expr("-top.start").alias("start"), F.col("top.length").alias("length"),
                          F.expr("-top.period").alias("period"), F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
                          F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
