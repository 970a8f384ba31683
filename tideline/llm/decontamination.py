"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against every window of every text."""
from pyspark.sql import functions as F

from .common import literal_array, lower_ascii, read_table, stored, text_or_empty
from .registry import query

NGRAM = 13
#: Test windows up to this number are broadcast (at about 100 bytes each); more are joined by a shuffle instead.
BROADCAST_WINDOWS = 500_000
#: A document counts as contaminated when at least one word in so many is hit.
SHARE = 20

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(column="text"):
    """Lower-cased (A-Z) words of digits, letters a-z and anything beyond ASCII; a null text has none."""
    return F.filter(F.split(lower_ascii(text_or_empty(column)), SEPARATORS), lambda word: word != "")


def test_windows(benchmark, n=NGRAM):
    """Windows ``(gram, len, hash, item_id)`` of the items: n consecutive words, or all words of a shorter item.

    Items without words have none. Rows of a repeated item_id are one item; a null item_id hits words but names no item.
    """
    items = benchmark.select("item_id", normal_words().alias("words")).where("size(words) > 0")
    items = items.withColumn("len", F.least(F.lit(n), F.size("words")))
    grams = items.selectExpr("item_id", "len", "explode(transform(sequence(1, size(words) - len + 1), p -> slice(words, p, len))) as gram")
    return grams.selectExpr("array_join(gram, ' ') as gram", "len", "xxhash64(gram) as hash", "item_id").distinct()


def _filter_bits(windows, count):
    """A bit set over the windows' hashes as a literal: 64 bits a window, so it passes one other window in 64."""
    size = 1 << max(12, (64 * count - 1).bit_length())
    rows = windows.selectExpr(f"pmod(hash, {size}) as bit").distinct().selectExpr("bit div 64 as at", "bit % 64 as place").groupBy("at").agg(
        F.expr("bit_or(shiftleft(1L, cast(place as int)))").alias("mask"))
    masks = [0] * (size // 64)
    for at, mask in rows.collect():
        masks[at] = mask
    return size, literal_array(masks, "bigint")


def find_hits(docs, benchmark, n=NGRAM, broadcast_windows=BROADCAST_WINDOWS):
    """One row per document row: ``doc_id, digest, n_words, spans, items`` and what the contamination rule says.

    ``spans`` are (pos, len) of every occurrence of a test window, in words from 1. ``digest`` is a hash of the text, so rows
    that repeat a doc_id with another text are judged apart, and equal rows come out as often as they came in. One scan of the
    texts; only documents' marks and true hits are shuffled. Null texts have no words; an empty benchmark hits nothing.
    """
    windows = test_windows(benchmark, n)
    known = windows.agg(F.countDistinct("hash").alias("n"), F.collect_set("len").alias("lens")).first()
    small = known.n <= broadcast_windows
    test = "true"
    if small and known.n:
        size, bits = _filter_bits(windows, known.n)
        test = f"getbit(get({bits}, cast(pmod(hash, {size}) div 64 as int)), cast(pmod(hash, {size}) % 64 as int)) = 1"
    base = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("digest"), normal_words().alias("words"))
    found = [f"""transform(filter(transform(if(size(words) >= {k}, sequence(1, size(words) - {k} + 1), cast(array() as array<int>)),
                 p -> named_struct('pos', p, 'hash', xxhash64(slice(words, p, {k})))), w -> {test.replace('hash', 'w.hash')}),
                 w -> named_struct('pos', w.pos, 'len', {k}, 'gram', array_join(slice(words, w.pos, {k}), ' ')))""" for k in sorted(known.lens)]
    mark = "array(named_struct('pos', 0, 'len', 0, 'gram', cast(null as string)))"
    rows = base.selectExpr("doc_id", "digest", "size(words) as n_words", f"explode(concat({', '.join([mark, *found])})) as w")
    rows = rows.selectExpr("doc_id", "digest", "n_words", "w.*")
    right = windows.select("gram", "item_id", F.lit(True).alias("hit"))
    joined = rows.join(F.broadcast(right) if small else right, "gram", "left").where("pos = 0 or hit")
    per = joined.groupBy("doc_id", "digest", "n_words").agg(
        F.sum(F.expr("if(pos = 0, 1, 0)")).alias("copies"), F.expr("collect_set(if(pos > 0, struct(pos, len), null))").alias("spans"),
        F.collect_set("item_id").alias("items"))
    merged = """aggregate(array_sort(spans), named_struct('upto', 0, 'n', 0L), (a, s) -> named_struct('upto', greatest(a.upto, s.pos + s.len),
                'n', a.n + greatest(0, s.pos + s.len - greatest(a.upto, s.pos)))).n"""
    per = per.withColumns({"n_words": F.col("n_words").cast("long"), "n_hit": F.expr(merged), "n_items": F.size("items").cast("long")})
    per = per.withColumn("contaminated", F.expr(f"n_hit > 0 and {SHARE} * n_hit >= n_words"))
    return per.withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).drop("copies", "copy")


def decontaminate(docs, benchmark, n=NGRAM):
    """The rows of ``docs`` without contaminated documents, all columns kept. A null doc_id is judged like any other.

    Contaminated ids are stored first: the planner then knows their true size, and rows stay in place unless there are many.
    """
    bad = stored(find_hits(docs, benchmark, n).where("contaminated").selectExpr("doc_id as bad_id_", "digest as bad_digest_").distinct(), "contaminated")
    here = docs.withColumn("digest_", F.xxhash64(text_or_empty()))
    same = F.col("doc_id").eqNullSafe(F.col("bad_id_")) & (F.col("digest_") == F.col("bad_digest_"))
    return here.join(bad, same, "left_anti").drop("digest_")


def remove_spans(docs, benchmark, n=NGRAM):
    """``doc_id, text`` with the normalised words of all hits taken out of every document."""
    hits = find_hits(docs, benchmark, n).select("doc_id", "digest", "spans").distinct()
    words = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("digest"), normal_words().alias("words"))
    cut = "filter(words, (w, i) -> not exists(spans, s -> i + 1 >= s.pos and i + 1 < s.pos + s.len))"
    return words.alias("d").join(hits.alias("h"), F.expr("d.doc_id <=> h.doc_id and d.digest = h.digest")).select(
        "d.doc_id", F.expr(f"array_join({cut}, ' ')").alias("text"))


SQL = r"""
with doc as (select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
       'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
item as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item_id, least(len(w), 13) as n, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') as gram
        from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) as p from item where len(w) > 0)),
pos as (select r, n, p, array_to_string(w[p:p + n - 1], ' ') as gram from (select r, w, n, unnest(generate_series(1, len(w) - n + 1)) as p
        from doc, (select distinct n from win) where len(w) >= n)),
hit as (select r, pos.n, p, item_id from pos join win using (n, gram)),
hurt as (select r, count(distinct x) as n_hit from (select r, unnest(generate_series(p, p + n - 1)) as x from (select distinct r, n, p from hit)) group by r),
named as (select r, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids
          from hit group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) as contaminated
from doc left join hurt using (r) left join named using (r)
"""


@query("op9_decontamination", SQL)
def op9(spark, sf_dir):
    found = find_hits(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda item: item.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(ids, 256).alias("items_sha256"), "contaminated")
