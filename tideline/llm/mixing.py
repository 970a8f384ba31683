"""Mixing sources to target weights: min-cost flow from membership patterns to source quotas, then seeded selection."""
import heapq

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, read_table, stored, text_or_empty
from .registry import query

#: The contract's weights in turn, the share of all words that the mix takes, and how often a word may be taken.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
#: Membership patterns whose sums are routed on the driver; sources of a mix are named by hand, so patterns are few. More are refused, never dropped.
MAX_PATTERNS = 20_000
#: Seeded buckets of a pattern over which selection counts words.
BUCKETS = 1 << 14


def word_count(column="text"):
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def targets(sizes, weights=WEIGHTS, share=SHARE, repeats=REPEATS):
    """Targets of ``[(source, size)]`` in their given order: ``share`` of all words by weight, a source's target at most ``repeats`` its size.

    What is above goes to the rest by weight until none is above. The rest then share one level: target = weight x level.
    """
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(sizes)}
    left, open_weight = share * sum(n for _, n in sizes), sum(weight.values())
    out, level = {}, None
    for source, size in sorted(sizes, key=lambda x: x[1] / weight[x[0]]):
        if level is None and repeats * size * open_weight <= left * weight[source]:
            out[source] = float(repeats * size)
            left, open_weight = left - repeats * size, open_weight - weight[source]
        else:
            level = left / open_weight if level is None else level
            out[source] = weight[source] * level
    return out


def route(patterns, quotas, repeats=REPEATS):
    """Min-cost flow of words: ``{(pattern, source): words}`` for ``patterns`` ``{tuple of sources: words}`` and ``quotas`` ``{source: words}``.

    Each pattern offers its words once at cost 1, again at cost 3, then 5 ..., so that the total cost is convex in repetition. Successive shortest paths
    over whole words, in a fixed order; quotas that cannot be met are met as far as capacity reaches.
    """
    names = sorted(patterns, key=str)
    sources = sorted(quotas, key=str)
    node = {("p", p): i + 2 for i, p in enumerate(names)} | {("s", s): i + 2 + len(names) for i, s in enumerate(sources)}
    graph, edges = [[] for _ in range(2 + len(node))], []

    def add(a, b, capacity, cost):
        graph[a].append(len(edges))
        edges.append([b, capacity, cost])
        graph[b].append(len(edges))
        edges.append([a, 0, -cost])

    for p in names:
        for again in range(repeats):
            add(0, node["p", p], patterns[p], 2 * again + 1)
        for s in p:
            if s in quotas:
                add(node["p", p], node["s", s], repeats * patterns[p], 0)
    for s in sources:
        add(node["s", s], 1, round(quotas[s]), 0)
    height = [0] * len(graph)
    while True:
        far, came = [None] * len(graph), [None] * len(graph)
        far[0], heap = 0, [(0, 0)]
        while heap:
            cost, a = heapq.heappop(heap)
            if cost > far[a]:
                continue
            for e in graph[a]:
                b, capacity, price = edges[e]
                if capacity > 0 and (far[b] is None or cost + price + height[a] - height[b] < far[b]):
                    far[b], came[b] = cost + price + height[a] - height[b], e
                    heapq.heappush(heap, (far[b], b))
        if far[1] is None:
            break
        height = [h + (x if x is not None else far[1]) for h, x in zip(height, far, strict=True)]
        path, at = [], 1
        while at != 0:
            path.append(came[at])
            at = edges[came[at] ^ 1][0]
        amount = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= amount
            edges[e ^ 1][1] += amount
    flow = {}
    for p in names:
        for e in graph[node["p", p]]:
            b = edges[e][0]
            if e % 2 == 0 and b >= 2 + len(names) and edges[e ^ 1][1]:
                flow[p, sources[b - 2 - len(names)]] = edges[e ^ 1][1]
    return flow


def cuts(docs, budget):
    """One row per pattern: whole rounds for all its documents, and the bucket in which the rest of its budget ends with what is left there."""
    before = Window.partitionBy("mix_pattern_").orderBy("mix_bucket_").rowsBetween(Window.unboundedPreceding, -1)
    sums = docs.groupBy("mix_pattern_", "mix_bucket_").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).join(budget, "mix_pattern_")
    sums = sums.withColumn("rounds", F.expr("if(total = 0, 0, budget div total)")).withColumn("left", F.expr("budget - rounds * total - before"))
    end = F.min(F.when(F.col("left") < F.col("words"), F.struct(F.col("mix_bucket_").alias("bucket"), F.greatest("left", F.lit(0)).alias("left"))))
    found = sums.groupBy("mix_pattern_").agg(F.max("rounds").alias("mix_rounds_"), end.alias("end"))
    return found.select("mix_pattern_", "mix_rounds_", F.col("end.bucket").alias("mix_end_"), F.coalesce("end.left", F.lit(0)).alias("mix_left_"))


def select(docs, budget):
    """``docs`` (``size`` and the columns of ``mix``) plus ``taken``: each pattern's documents in seeded order, in rounds of all, until its budget of words is met.

    Whole rounds go to all documents, the last round to those first in the seeded order; the last of them gives its leading words only, so budgets
    are met exactly. Words are counted by bucket; where a budget ends is one row a pattern and broadcast (patterns are bounded). Only documents of
    these buckets are exchanged and ordered one by one. The seeded order is a hash of id and text, so rows without id are spread like others.
    """
    placed = docs.join(F.broadcast(cuts(docs, budget)), "mix_pattern_")
    ends = (F.col("mix_bucket_") == F.coalesce("mix_end_", F.lit(-1))) & (F.col("mix_left_") > 0)
    again = F.coalesce(F.col("mix_bucket_") < F.col("mix_end_"), F.lit(True)).cast("long")
    whole = placed.where(~ends).withColumn("taken", F.col("size") * (F.col("mix_rounds_") + again))
    inside = Window.partitionBy("mix_pattern_").orderBy("mix_ordinal_", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    part = placed.where(ends).withColumn("mix_done_", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    part = part.withColumn("taken", F.expr("size * mix_rounds_ + greatest(0, least(size, mix_left_ - mix_done_))"))
    return whole.select(*docs.columns, "taken").unionByName(part.select(*docs.columns, "taken"))


OUTPUTS = ("size", "source_size", "target", "taken")


def mix(docs, members, weights=WEIGHTS, share=SHARE, repeats=REPEATS, seed=7, max_patterns=MAX_PATTERNS):
    """The rows of ``docs`` plus ``size, source_size, target, taken``; ``members`` is a column with the array of sources a document belongs to.

    Sources go by code point, null last. ``source_size`` and ``target`` are sums over the sources of a document; a document of several sources counts
    in full for each of them, and its words go where the flow sends them. Texts without words (null, blank) have size 0 and give nothing. An
    empty table gives an empty result. Rows that repeat a doc_id are documents of their own. Columns of ``docs`` named like the four results are replaced by
    them, all others are handed on, whatever their names; names that start with ``mix_`` and end with ``_`` are reserved.
    """
    spark = docs.sparkSession
    kept = [name for name in docs.columns if name not in OUTPUTS]
    sized = docs.select(*kept, word_count().alias("size"), F.to_json(F.array_sort(F.array_distinct(members)), {"ignoreNullFields": "false"}).alias("mix_pattern_"),
                        F.array_sort(F.array_distinct(members)).alias("mix_names_"), F.expr(f"xxhash64(doc_id, text, {seed})").alias("mix_ordinal_"))
    sized = sized.withColumn("mix_bucket_", F.pmod("mix_ordinal_", F.lit(BUCKETS)))
    narrow = stored(sized.groupBy("mix_pattern_").agg(F.sum("size").alias("total"), F.first("mix_names_").alias("names")), "patterns")
    found = narrow.limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"the documents have more than {max_patterns} membership patterns; name coarser sources")
    patterns = {tuple(row.names): row.total for row in found}
    of_source = {}
    for names, total in patterns.items():
        for name in names:
            of_source[name] = of_source.get(name, 0) + total
    sizes = sorted(of_source.items(), key=lambda x: (x[0] is None, x[0] or ""))
    target = targets(sizes, weights, share, repeats)
    flow = route(patterns, target, repeats)
    budget = {tuple(row.names): 0 for row in found}
    for (names, _), words in flow.items():
        budget[names] += words
    rows = [(row.mix_pattern_, row.total, budget[tuple(row.names)], sum(of_source[s] for s in row.names), float(sum(target[s] for s in row.names))) for row in found]
    plan = spark.createDataFrame(rows, "mix_pattern_ string, total long, budget long, source_size long, target double")
    chosen = select(sized.drop("mix_names_"), F.broadcast(plan.select("mix_pattern_", "total", "budget")))
    return chosen.join(F.broadcast(plan.select("mix_pattern_", "source_size", "target")), "mix_pattern_").select(*kept, *OUTPUTS)


#: The targets alone, for tests: what is selected follows a seeded hash.
TARGET_SQL = r"""
with doc as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
src as (select source, sum(size) as n, row_number() over (order by source nulls last) as i from doc group by source),
weighed as (select source, cast(n as bigint) as n, [3, 1, 2][((i - 1) % 3) + 1] as w, i from src),
filled as (select *, sum(2 * n) over o - 2 * n as capped, sum(w) over () - (sum(w) over o - w) as open, sum(n) over () as total
           from weighed window o as (order by n / w, i rows unbounded preceding)),
level as (select arg_min((1.5 * total - capped) / open, (n / w, i)) filter (2 * n * open > (1.5 * total - capped) * w) as x from filled),
target as (select source, n, case when x is null or 2 * n <= w * x then 2.0 * n else w * x end as target from weighed, level)
select doc_id, size, n as source_size, round(target, 6) as target from doc join target on doc.source is not distinct from target.source
"""


@query("op4_source_mix")
def op4(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix(docs.select("doc_id", "text", "source"), F.array("source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
