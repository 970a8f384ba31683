"""MinHash near-dedup: ProbMinHash signatures of sets of word shingles, bands, exact verification, classes."""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from . import winnow
from .common import bound_batches, read_table, sieved, stored
from .passages import table
from .registry import query

#: Words of a shingle and the similarity (Jaccard, of shingle sets) from which two texts are near duplicates.
SHINGLE, SIMILAR = 5, 0.8
#: Bands and the registers of each. A pair at 0.8 meets in a band with 0.41, so it is missed by all with about 3e-6.
BANDS, ROWS = 24, 4
#: Texts that one verification group holds; larger groups are dealt out in several orders.
GROUP = 400
#: Orders in which a larger group is dealt out, each by the keys of other bands.
ORDERS = 3

_MIX = 0x8CB92BA72F3D8DD7


def word_lists(texts):
    return [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]


def shingle_counts(word_rows, k=SHINGLE):
    """Distinct shingles of many texts: arrays ``owner, shingle, count``, and a hash of each whole word sequence. Shorter texts are one shingle."""
    flat = [w for row in word_rows for w in row]
    lengths = np.fromiter(map(len, flat), np.int64, len(flat))
    stops = np.cumsum(lengths + 1) - 1
    values = winnow.span_hashes(np.frombuffer(b" ".join(flat), np.uint8).astype(np.uint64), stops - lengths, stops) if flat else np.zeros(0, np.uint64)
    sizes = np.array([len(row) for row in word_rows], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    number = np.where(sizes == 0, 0, np.maximum(1, sizes - k + 1))
    owner = np.repeat(np.arange(len(sizes)), number)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number) + bounds[owner]
    grams = winnow.span_hashes(values, start, np.minimum(start + k, bounds[owner + 1])) if len(owner) else np.zeros(0, np.uint64)
    whole = winnow.span_hashes(values, bounds[:-1], bounds[1:]) if len(sizes) else np.zeros(0, np.uint64)
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
    at = np.flatnonzero(new)
    return owner[at], grams[at], np.diff(np.append(at, len(owner))), whole


def probminhash(owner, element, weight, n, registers=BANDS * ROWS):
    """ProbMinHash signatures of ``n`` texts: for each register the element that arrives there first.

    Every element is a Poisson process with its weight as rate; each of its arrivals, seeded by element and number, goes to one register. Two
    texts agree in a register with the probability that is their probability Jaccard. A process ends once its next arrival comes later than all
    registers of its text are filled, so most elements draw once or twice.
    """
    first = np.full(n * registers, np.inf)
    who = np.zeros(n * registers, np.uint64)
    clock, live, draw = np.zeros(len(owner)), np.arange(len(owner)), 0
    while len(live):
        seed = winnow._mix(element[live] + np.uint64((draw * 2 + 1) * _MIX & (1 << 64) - 1))
        unit = (seed >> np.uint64(11)).astype(float) / (1 << 53) + 2.0 ** -54
        clock[live] -= np.log(unit) / weight[live]
        register = owner[live] * registers + (winnow._mix(seed + np.uint64(_MIX)) % np.uint64(registers)).astype(np.int64)
        order = np.lexsort((element[live], clock[live], register))
        head = np.ones(len(order), bool)
        head[1:] = register[order][1:] != register[order][:-1]
        best = order[head]
        spot = register[best]
        sooner = clock[live][best] < first[spot]
        first[spot[sooner]], who[spot[sooner]] = clock[live][best][sooner], element[live][best][sooner]
        limit = first.reshape(n, registers).max(1)
        live = live[clock[live] < limit[owner[live]]]
        draw += 1
    return who.reshape(n, registers)


def signed(docs):
    """``doc_id, whole, second, keys``: two hashes of the word sequence and the key of each band (none for a text without words).

    Every distinct shingle has weight 1, however often it stands in the text: registers agree with the Jaccard similarity of the sets, which is judged later.
    """
    kinds = [("doc_id", pa.int64()), ("whole", pa.int64()), ("second", pa.int64()), ("keys", pa.list_(pa.int64()))]

    def scan(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for a, b in winnow.chunks([len(t) if t else 0 for t in texts]):
                words = word_lists(texts[a:b])
                owner, grams, _, whole = shingle_counts(words)
                signs = probminhash(owner, grams, np.ones(len(owner)), b - a)
                places = np.arange(BANDS) * ROWS
                keys = np.stack([winnow.span_hashes(row, places, places + ROWS, _MIX) + np.arange(BANDS, dtype=np.uint64) for row in signs]).view(np.int64)
                second = np.array([winnow.span_hashes(np.array([x], np.uint64), np.zeros(1, np.int64), np.ones(1, np.int64), _MIX)[0] for x in whole], np.uint64)
                mixed = np.bitwise_xor.reduceat(np.append(grams, np.uint64(0)), np.searchsorted(owner, np.arange(b - a)))
                second = np.where([bool(w) for w in words], second ^ mixed, np.uint64(0))
                yield table(kinds, [ids.slice(a, b - a), whole.view(np.int64), second.view(np.int64), [row.tolist() if w else [] for row, w in zip(keys, words, strict=True)]])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, whole long, second long, keys array<long>")


def components(links, name):
    """Connected components of ``links`` (a, b): ``node, root``, root being the smallest node. Distributed: each round stores its tables.

    In a round every node moves to its smallest neighbour, if that is smaller, and from there to that one's. Links between the places moved to, without
    loops and repeats, make the graph of the next round, which lacks at least the largest node of every component. The smallest never moves. At the end the moves are put
    together from the last round back.
    """
    def tidy(df):
        return stored(df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-links")

    edges, levels = tidy(links), []
    while True:
        near = edges.union(edges.select("b", "a")).groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up"))
        again = near.select(F.col("node").alias("up"), F.col("up").alias("root"))
        level = stored(near.join(again, "up").select("node", "root"), f"{name}-labels")
        levels.append(level)
        moved = edges.join(level.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(level.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        edges = tidy(moved.select(F.col("x").alias("a"), F.col("y").alias("b")))
        if edges.limit(1).count() == 0:
            break
    label = levels.pop()
    while levels:
        last = label.select(F.col("node").alias("root"), F.col("root").alias("top"))
        label = stored(levels.pop().join(last, "root", "left").select("node", F.coalesce("top", "root").alias("root")), f"{name}-labels")
    return label


def join_group(texts, cells=1 << 22):
    """Links ``(i, j)`` that connect the texts of a group as all its pairs at ``SIMILAR`` or more would.

    Common shingles of all pairs are counted at once, as products of 0/1 matrices (texts by shingles) of at most ``cells`` cells. Shingles of one text only
    are left out of these; they count in its size alone.
    """
    n = len(texts)
    owner, grams, _, _ = shingle_counts(word_lists(texts))
    sizes = np.bincount(owner, minlength=n).astype(float)
    values, code, times = np.unique(grams, return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    owner, code = owner[shared[code]], place[code[shared[code]]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    both, width = np.zeros((n, n)), max(1, cells // max(1, n))
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(code, [low, low + width])
        holds = np.zeros((n, min(width, int(shared.sum()) - low)), np.float32)
        holds[owner[a:b], code[a:b] - low] = 1
        both += holds @ holds.T
    near = (both >= SIMILAR * (sizes[:, None] + sizes[None, :] - both) - 1e-9) & (sizes[:, None] > 0) & (sizes[None, :] > 0)
    links, open_ = [], np.ones(n, bool)
    for start in range(n):
        ahead = [start] if open_[start] else []
        open_[start] = False
        while ahead:
            i = ahead.pop()
            found = np.flatnonzero(near[i] & open_).tolist()
            open_[found] = False
            links.extend((j, i) for j in found)
            ahead.extend(found)
    return links


def verified_links(members):
    """Links between texts of ``members`` (``part, doc_id, text``), part by part. A repeated row counts once."""
    kinds = [("a", pa.int64()), ("b", pa.int64())]

    def scan(batches):
        held, part = [], None

        def judge():
            links = join_group([text for _, text in held])
            if links:
                return table(kinds, [[held[i][0] for i, _ in links], [held[j][0] for _, j in links]])

        for batch in batches:
            for now, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "text")), strict=True):
                if now != part:
                    if held and (found := judge()) is not None:
                        yield found
                    held, part = [], now
                if not held or held[-1] != row:
                    held.append(row)
        if held and (found := judge()) is not None:
            yield found

    return members.repartition(F.col("part")).sortWithinPartitions("part", "doc_id").mapInArrow(scan, "a long, b long")


def near_classes(docs, group=GROUP, orders=ORDERS):
    """``doc_id, class_id, class_size`` for every row of ``docs``: the smallest doc_id of its class, and the rows in it.

    Texts of equal words are one class and are compared once. Other texts are linked when their sets of five-word shingles have a Jaccard similarity of 0.8
    or more; classes are the connected components of all links. Texts without words (null, blank) are equal to each other. Rows with the same doc_id and
    another text are compared as texts of their own and share their id's class. A null doc_id takes part in no comparison: its class is null.
    Candidates come from the bands; in groups of candidates of at most ``group`` texts all pairs are verified. Larger ones are first dealt
    into parts of that size in several orders, in each of which texts with a common band key lie together. Where the texts of a band key are not all
    connected after that, those outside its main part are compared with all of its texts, in blocks. Only texts of candidates (and few others) are exchanged.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    signs = stored(signed(docs.where("doc_id is not null")), "signatures")
    texts = stored(signs.groupBy("whole", "second").agg(F.min("doc_id").alias("rep")), "texts")
    equal = signs.join(texts, ["whole", "second"]).select("doc_id", "rep")
    one = signs.join(texts.select("whole", "second", F.col("rep").alias("doc_id")), ["whole", "second", "doc_id"], "left_semi").select(
        "doc_id", "keys", "whole").dropDuplicates(["doc_id", "whole"])
    bands = one.select("doc_id", F.explode("keys").alias("key"))
    low = bands.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("final")).where("a < final").select("key", "a")
    pairs = bands.join(low, "key").where("doc_id > a").select("a", F.col("doc_id").alias("b")).distinct()
    candidate = components(pairs, "candidate")
    sizes = candidate.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    placed = candidate.join(sizes, "root")
    own = one.join(placed, F.col("doc_id") == F.col("node")).select("doc_id", "keys", "root", "n")
    small = own.where(f"n <= {group}").select("doc_id", F.struct(F.col("root").alias("root"), F.lit(0).alias("turn"), F.lit(0).alias("piece")).alias("part"))
    many = stored(own.where(f"n > {group}"), "large")

    def links_of(placed):
        members = stored(placed.groupBy("doc_id").agg(F.collect_set("part").alias("parts")), "members")
        needed, _ = sieved(docs, members, "doc_id")
        with_text = needed.join(members, "doc_id").select("doc_id", "text", F.explode("parts").alias("part"))
        return stored(verified_links(with_text.select(F.to_json("part").alias("part"), "doc_id", "text")), "verified")

    links = links_of(small.unionByName(deal(many, group, orders)))
    if many.limit(1).count():
        links = links.union(links_of(open_buckets(many, components(links, "first"), group)))
    linked = components(links.union(equal.where("doc_id <> rep").distinct()), "class")
    classes = linked.withColumnRenamed("node", "doc_id").withColumnRenamed("root", "class_id")
    out = docs.select("doc_id").join(classes, "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    total = out.where("class_id is not null").groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    return out.join(total, "class_id", "left").select("doc_id", "class_id", F.coalesce("class_size", F.lit(1)).alias("class_size"))


def deal(own, group, orders):
    """Parts of large candidate groups: in each order, a text goes with the texts of the same band key, and keys are packed into parts by hash.

    A key with more than ``group`` texts is cut by a hash of their ids, other in each order.
    """
    out = None
    for turn in range(orders):
        keyed = own.withColumn("key", F.expr(f"keys[{turn * BANDS // orders}]"))
        load = keyed.groupBy("root", "key").agg(F.count(F.lit(1)).alias("m")).join(keyed.groupBy("root").agg(F.count(F.lit(1)).alias("all")), "root")
        load = load.select("root", "key", F.expr(f"cast(ceil(m / {group}) as int)").alias("cuts"), F.expr(f"cast(ceil(all / {group}) as int)").alias("pieces"), "m")
        dealt = keyed.join(load, ["root", "key"]).select("doc_id", F.struct(F.col("root"), F.lit(turn).alias("turn"), F.expr(
            f"cast(if(m > {group // 2}, pmod(xxhash64(key, pmod(xxhash64(doc_id, {turn}), cuts)), 2147483647), pmod(key, pieces)) as int)").alias("piece")).alias("part"))
        out = dealt if out is None else out.unionByName(dealt)
    return out


def open_buckets(own, labels, group):
    """Parts that bring together, for each band key whose texts are not all connected, every text outside its largest component with every text of it."""
    half = max(1, group // 2)
    texts = own.join(labels.withColumnRenamed("node", "doc_id").withColumnRenamed("root", "label"), "doc_id", "left")
    texts = texts.select("doc_id", F.coalesce("label", "doc_id").alias("label"), F.explode("keys").alias("key"))
    load = texts.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(
        F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    load = load.select("key", F.col("main.label").alias("main"), F.expr(f"cast(ceil(m / {half}) as int)").alias("cuts"),
                       F.expr(f"cast(ceil((m - main.n) / {half}) as int)").alias("outs"))
    own_cut, own_out = "cast(pmod(xxhash64(doc_id), cuts) as int)", "cast(pmod(xxhash64(doc_id, 1), outs) as int)"
    spots = f"""array_union(transform(sequence(0, outs - 1), o -> named_struct('root', key, 'turn', o, 'piece', {own_cut})),
        if(label <> main, transform(sequence(0, cuts - 1), c -> named_struct('root', key, 'turn', {own_out}, 'piece', c)),
        cast(array() as array<struct<root:bigint,turn:int,piece:int>>)))"""
    return texts.join(load, "key").select("doc_id", F.explode(F.expr(spots)).alias("part"))


def deduplicate(docs, **options):
    """The rows of ``docs`` that stand for their class: of each class the smallest doc_id, all columns kept. Rows without doc_id stay.

    Rows are numbered and compared as texts of their own, whatever their doc_id, so unlike texts with one doc_id all stay. Of several rows of a class with
    its smallest doc_id, the one with the smallest text stays. Texts are compared for such ties only, and rows are exchanged only if they may be gone.
    """
    rows = stored(docs.where("doc_id is not null").withColumn("row_", F.monotonically_increasing_id()), "rows")
    classes = near_classes(rows.select(F.col("row_").alias("doc_id"), "text"), **options).where("class_size > 1").select(F.col("doc_id").alias("row_"), "class_id")
    shared = stored(rows.select("row_", "doc_id").join(classes, "row_"), "classes")
    first = shared.groupBy("class_id").agg(F.min("doc_id").alias("doc_id"))
    heads = stored(shared.join(first, ["class_id", "doc_id"]).select("class_id", "row_"), "heads")
    number = heads.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.min("row_").alias("row_"))
    ties = stored(heads.join(number.where("n > 1").select("class_id"), "class_id", "left_semi"), "ties")
    tied, _ = sieved(rows.select("row_", "text"), ties, "row_")
    best = tied.join(ties, "row_").groupBy("class_id").agg(F.min(F.struct("text", "row_")).alias("best")).select("best.row_")
    gone = stored(shared.select("row_").join(number.where("n = 1").select("row_").unionByName(best), "row_", "left_anti"), "gone")
    perhaps, rest = sieved(rows, gone, "row_")
    return rest.unionByName(perhaps.join(gone, "row_", "left_anti").select(rows.columns)).select(docs.columns).unionByName(docs.where("doc_id is null"))


@query("op6_near_dedup")
def op6(spark, sf_dir):
    return near_classes(read_table(spark, sf_dir, "documents"))
