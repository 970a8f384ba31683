"""Substring dedup by words: recurring passages are confirmed, compiled into Aho-Corasick automata by shard, and located in the texts."""
import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from . import winnow
from .common import bound_batches, read_table, stored
from .registry import query

#: Words of a window, and of the k-grams that anchor it.
WINDOW, GRAM = 50, 16

RUNS = "doc_id long, anchor long, content long"


class Shard:
    """Some whole texts as one list of words, and the runs of their windows."""

    def __init__(self, texts, width, gram):
        self.words = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
        self.bounds = np.concatenate([[0], np.cumsum([len(w) for w in self.words])]).astype(np.int64)
        self.flat = [w for words in self.words for w in words]
        self.buffer = b" ".join(self.flat)
        lengths = np.fromiter(map(len, self.flat), np.int64, len(self.flat))
        self.stops = np.cumsum(lengths + 1) - 1
        self.starts = self.stops - lengths
        self.values = winnow.span_hashes(np.frombuffer(self.buffer, np.uint8).astype(np.uint64), self.starts, self.stops)
        self.width = width
        self.document, self.first, self.last, anchors = winnow.runs(self.values, self.bounds, width, gram)
        self.anchor = anchors.view(np.int64) if len(anchors) else np.zeros(0, np.int64)
        self.windows = None

    def contents(self):
        """A hash of the words of each run, joined by single blanks."""
        buffer = self.buffer
        ends = self.stops[self.last + self.width - 1] if len(self.last) else self.last
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter((digest(buffer[a:b]) for a, b in zip(self.starts[self.first].tolist() if len(self.first) else (), ends.tolist(), strict=True)),
                           np.uint64, len(self.first)).view(np.int64)

    def window_hashes(self, places):
        """A second hash, of whole windows; all of the shard are taken at once, when first asked for."""
        if self.windows is None:
            every = np.arange(max(0, len(self.values) - self.width + 1))
            self.windows = winnow.span_hashes(self.values, every, every + self.width, 0x8CB92BA72F3D8DD7).view(np.int64)
        return self.windows[places]


def shards(batch, width, gram):
    """The rows of an Arrow batch in shards of bounded size: ``(rows, shard)``."""
    texts = batch.column("text").to_pylist()
    for a, b in winnow.chunks([len(t) if t else 0 for t in texts]):
        yield range(a, b), Shard(texts[a:b], width, gram)


def table(kinds, columns):
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, kinds, strict=True)], names=[name for name, _ in kinds])


LONGS = [(name, pa.int64()) for name in ("doc_id", "anchor", "content")]


def run_table(docs, width, gram):
    """One row for each run of windows of each text: ``doc_id, anchor, content``."""
    def scan(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for rows, shard in shards(batch, width, gram):
                yield table(LONGS, [ids[rows.start + shard.document], shard.anchor, shard.contents()])
    return docs.mapInArrow(scan, RUNS)


def open_windows(rows, width, gram):
    """Windows ``doc_id, anchor, whole`` of the runs that a document's list ``open`` names."""
    kinds = [(name, pa.int64()) for name in ("doc_id", "anchor", "whole")]

    def scan(batches):
        for batch in batches:
            ids, named = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("open")
            for rows_, shard in shards(batch, width, gram):
                contents, out = shard.contents(), ([], [], [])
                wanted = {}
                for i in np.arange(len(contents)):
                    at = rows_.start + int(shard.document[i])
                    if at not in wanted:
                        wanted[at] = set(named[at].as_py())
                    if int(contents[i]) in wanted[at]:
                        places = np.arange(shard.first[i], shard.last[i] + 1)
                        out[0].append(np.full(len(places), ids[at]))
                        out[1].append(np.full(len(places), shard.anchor[i]))
                        out[2].append(shard.window_hashes(places))
                if out[0]:
                    yield table(kinds, [np.concatenate(x) for x in out])
    return rows.mapInArrow(scan, "doc_id long, anchor long, whole long")


def find_earlier(docs, width=WINDOW, gram=GRAM):
    """What starts in an earlier document: tables ``(doc_id, content, first)`` of whole runs and ``(doc_id, whole, anchor, first)`` of single windows.

    ``first`` is the smallest doc_id in which all of it starts; it is below doc_id. Runs are compared by 128 bits of hash (anchor and content). A run
    that is new with its document, but whose anchor other runs share, is compared window by window: one document for each distinct run, not each copy.
    """
    runs = stored(run_table(docs.where("doc_id is not null"), width, gram), "runs")
    classes = stored(runs.groupBy("anchor", "content").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("final")), "classes")
    shared = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    recurring = classes.where("first < final").select("anchor", "content", "first")
    copies = runs.join(recurring, ["anchor", "content"]).where("doc_id > first").select("doc_id", "content", "first").distinct()
    opened = classes.join(shared, "anchor").select(F.col("first").alias("doc_id"), "content")
    opened = opened.groupBy("doc_id").agg(F.collect_set("content").alias("open"))
    windows = stored(open_windows(docs.join(opened, "doc_id"), width, gram), "windows")
    earliest = windows.groupBy("anchor", "whole").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("final")).where("first < final")
    single = windows.join(earliest.drop("final"), ["anchor", "whole"]).where("doc_id > first").select("doc_id", "anchor", "whole", "first").distinct()
    return copies, single


class Automaton:
    """Confirmed passages of a shard as one Aho-Corasick automaton whose letters are words."""

    def __init__(self):
        self.letters, self.found, self.built = {}, {}, ahocorasick.Automaton(ahocorasick.STORE_ANY)

    def add(self, words, first):
        letters = self.letters
        key = "".join([letters.setdefault(w, chr(len(letters) + 1 if len(letters) < 0xD7FE else len(letters) + 0x801)) for w in words])
        if key not in self.found or first < self.found[key]:
            self.found[key] = first
            self.built.add_word(key, (len(words), first))

    def close(self):
        self.built.make_automaton()

    def locate(self, words, doc_id):
        """Marks on the words of every passage that a smaller doc_id has, or None."""
        get, marks = self.letters.get, None
        for end, (length, first) in self.built.iter("".join([get(w, "\0") for w in words])):
            if doc_id is not None and first < doc_id:
                if marks is None:
                    marks = np.zeros(len(words), bool)
                marks[end - length + 1:end + 1] = True
        return marks


OUT = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]


def remove_passages(docs, width=WINDOW, gram=GRAM):
    """``doc_id, n_words, n_removed, kept`` for every row of ``docs``: kept words joined by one blank.

    A word goes when a window of ``width`` words around it also starts in a document with a smaller doc_id, judged on the input. Null and blank texts
    have no words, shorter texts no windows. Rows of one doc_id do not count as smaller than each other and are judged apart; a null doc_id is
    neither smaller nor larger, so it keeps all. Other columns are not read.

    Documents of a shard bring the passages that anchors route to them; the automaton of the shard holds them once and is run over all its texts.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    copies, single = find_earlier(docs, width, gram)
    lists = copies.groupBy("doc_id").agg(F.collect_list(F.struct("content", "first")).alias("runs"))
    others = single.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "whole", "first")).alias("singles"))
    known = lists.join(others, "doc_id", "full")

    def scan(batches):
        for batch in batches:
            ids, runs_, singles = batch.column("doc_id").to_pylist(), batch.column("runs"), batch.column("singles")
            for rows, shard in shards(batch, width, gram):
                contents, automaton, now = shard.contents(), Automaton(), None
                for i, content in enumerate(contents.tolist()):
                    at = rows.start + int(shard.document[i])
                    if at != now:
                        now = at
                        whole = {x["content"]: x["first"] for x in runs_[at].as_py() or ()}
                        loose = {(x["anchor"], x["whole"]): x["first"] for x in singles[at].as_py() or ()}
                    a, b = int(shard.first[i]), int(shard.last[i])
                    if content in whole:
                        automaton.add(shard.flat[a:b + width], whole[content])
                    elif loose:
                        anchor = int(shard.anchor[i])
                        firsts = [loose.get((anchor, w)) for w in shard.window_hashes(np.arange(a, b + 1)).tolist()]
                        j = 0
                        while j < len(firsts):
                            end = j
                            while end + 1 < len(firsts) and firsts[end + 1] == firsts[j]:
                                end += 1
                            if firsts[j] is not None:
                                automaton.add(shard.flat[a + j:a + end + width], firsts[j])
                            j = end + 1
                if automaton.found:
                    automaton.close()
                out = []
                for at, words in zip(rows, shard.words, strict=True):
                    marks = automaton.locate(words, ids[at]) if automaton.found and words else None
                    kept = words if marks is None else [w for w, gone in zip(words, marks.tolist(), strict=True) if not gone]
                    out.append((ids[at], len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
                yield table(OUT, list(zip(*out, strict=True)))

    return docs.join(known, "doc_id", "left").mapInArrow(scan, "doc_id long, n_words long, n_removed long, kept string")


SQL = r"""
with doc as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, p, hash(array_to_string(w[p:p + 49], ' ')) as h from (select doc_id, w, unnest(generate_series(1, len(w) - 49)) as p from doc where len(w) >= 50)),
early as (select doc_id, p from (select doc_id, p, min(doc_id) over (partition by h) as first from win) where first < doc_id),
gone as (select doc_id, list(distinct x) as xs from (select doc_id, unnest(generate_series(p, p + 49)) as x from early) group by doc_id)
select doc_id, len(w) as n_words, coalesce(len(xs), 0) as n_removed,
       sha256(case when xs is null then array_to_string(w, ' ') else array_to_string(list_filter(w, lambda x, i: not list_contains(xs, i)), ' ') end) as kept_sha256
from doc left join gone using (doc_id)
"""


@query("op1_substring_dedup", SQL)
def op1(spark, sf_dir):
    done = remove_passages(read_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
