"""Document fingerprints: anchors chosen as closed syncmers of words, compared by shared anchors at matching positions."""
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLANKS, read_table, text_or_empty
from .registry import query

#: A k-mer is K words; its S-mers are pairs of words. It is an anchor when its smallest pair is its first or its last.
K, S = 5, 2
#: Anchors that a fingerprint keeps: those with the smallest hashes, over the whole text.
ANCHORS = 48
#: Bits of a packed anchor that hold its position (in words; later ones share the last value).
PLACE = 24
#: Words by which the shift of a shared anchor may differ from the usual shift of the two texts.
SLACK = 32


def anchors(text, keep=ANCHORS):
    """The fingerprint as SQL: packed (40 bits of hash, 24 bits of position) longs, distinct hashes, smallest first.

    Texts are padded by K - 1 empty words on both sides, so every text with a word has anchors; one without has none. Whether a k-mer is an
    anchor depends on its own words only. Of equal k-mers the first position counts.
    """
    words = f"filter(split({text}, '{BLANKS.replace(chr(92), chr(92) * 2)}'), w -> w <> '')"
    pad = f"array_repeat(xxhash64(''), {K - 1})"
    hashes = f"transform(array(concat({pad}, transform({words}, w -> xxhash64(w)), {pad})), h -> h)[0]"
    pairs = f"transform(array({hashes}), h -> named_struct('h', h, 'g', transform(sequence(0, size(h) - {S}), i -> xxhash64(h[i], h[i + 1]))))[0]"
    inner = ", ".join(f"x.g[i + {j}]" for j in range(1, K - S))
    whole = ", ".join(f"x.h[i + {j}]" for j in range(K))
    edge = f"least(x.g[i], x.g[i + {K - S}])"
    picked = f"filter(sequence(0, size(x.h) - {K}), i -> size(x.h) > {2 * (K - 1)} and {edge} <= least({inner}))"
    packed = f"transform({picked}, i -> shiftleft(shiftrightunsigned(xxhash64({whole}), {PLACE + 1}), {PLACE}) | least(i, {2 ** PLACE - 1}))"
    first = f"filter(v, (a, i) -> i = 0 or shiftright(a, {PLACE}) <> shiftright(v[i - 1], {PLACE}))"
    return f"transform(array({pairs}), x -> transform(array(array_sort({packed})), v -> slice({first}, 1, {keep}))[0])[0]"


def likeness(left, right, keep=ANCHORS):
    """Share (0 to 1), as SQL, of the smallest anchors of both texts together that both have, at positions shifted about alike.

    Two texts without anchors are alike (1), one without and one with are not (0).
    """
    hashes = f"transform({{}}, x -> shiftright(x, {PLACE}))"
    union = f"slice(array_sort(array_union({hashes.format(left)}, {hashes.format(right)})), 1, {keep})"
    place = f"cast({{}} & {2 ** PLACE - 1} as int)"
    shifts = f"""array_sort(flatten(transform(filter({left}, x -> array_contains(u, shiftright(x, {PLACE}))), x -> transform(
        filter({right}, y -> shiftright(y, {PLACE}) = shiftright(x, {PLACE})), y -> {place.format('y')} - {place.format('x')}))))"""
    near = f"size(filter(d, s -> abs(s - d[cast(size(d) / 2 as int)]) <= {SLACK}))"
    return f"""case when size({left}) = 0 and size({right}) = 0 then 1D when size({left}) = 0 or size({right}) = 0 then 0D
        else transform(array({union}), u -> transform(array({shifts}), d -> {near} / size(u))[0])[0] end"""


def readable(column):
    return f"array_join(transform({column}, x -> lpad(lower(hex(x)), 16, '0')), '')"


def _lower_neighbour(frame, key, value, last, bits):
    """``frame`` (distinct keys) plus ``last``: the value of the next smaller key. Windows hold 65,536 rows at most, level by level."""
    group = f"{key}_up"
    grouped = frame.withColumn(group, F.shiftright(F.col(key), 16) if bits > 16 else F.lit(0))
    out = grouped.withColumn(last, F.lag(value).over(Window.partitionBy(group).orderBy(key)))
    return grouped, out, group


def previous_value(frame, key, value, bits):
    """For each distinct ``key`` (of ``bits`` bits) the ``value`` of the next smaller key, null for the smallest."""
    grouped, out, group = _lower_neighbour(frame, key, value, "last_", bits)
    if bits <= 16:
        return out.select(key, F.col("last_").alias("previous"))
    upper = previous_value(grouped.groupBy(group).agg(F.max(value).alias(value)), group, value, bits - 16)
    return out.join(upper, group).select(key, F.coalesce("last_", "previous").alias("previous"))


#: Consecutive ids that one window orders at most (as a power of two).
BUCKET = 10


def with_next(docs, keep=ANCHORS):
    """``doc_id, text, print, next`` where ``next`` is (doc_id, text, print) of the document with the next smaller doc_id, or of the largest after
    the last.

    Of rows with one doc_id, the next document is the one with the greatest text; they share their own next document. Rows without doc_id follow
    nothing: their next is null. Texts are shuffled once, by ranges of ids; only the last document of a range gets its neighbour by a join.
    """
    own = docs.select("doc_id", text_or_empty().alias("text")).withColumn("print", F.expr(anchors("text", keep)))
    own = own.withColumn("bucket", F.shiftright(F.col("doc_id"), BUCKET))
    lower = Window.partitionBy("bucket").orderBy("doc_id").rangeBetween(Window.unboundedPreceding, -1)
    ordered = own.where("doc_id is not null").withColumn("near", F.max(F.struct("doc_id", "text", "print")).over(lower))
    ids = docs.where("doc_id is not null").select("doc_id", F.shiftright(F.col("doc_id"), BUCKET).alias("bucket")).groupBy("bucket").agg(
        F.max("doc_id").alias("top"))
    follow = previous_value(ids, "bucket", "top", 64 - BUCKET).crossJoin(F.broadcast(ids.agg(F.max("top").alias("largest"))))
    follow = follow.select("bucket", F.shiftright(F.coalesce("previous", "largest"), BUCKET).alias("next_bucket"))
    tops = docs.where("doc_id is not null").groupBy(F.shiftright(F.col("doc_id"), BUCKET).alias("next_bucket")).agg(
        F.max(F.struct("doc_id", text_or_empty().alias("text"))).alias("top"))
    far = follow.join(tops, "next_bucket").select("bucket", F.struct("top.doc_id", "top.text", F.expr(anchors("top.text", keep)).alias("print")).alias("far"))
    named = ordered.join(far, "bucket").select("doc_id", "text", "print", F.coalesce("near", "far").alias("next"))
    without = own.where("doc_id is null").select("doc_id", "text", "print", F.lit(None).cast(named.schema["next"].dataType).alias("next"))
    return named.unionByName(without)


def compare_edits(docs, keep=ANCHORS):
    """Fingerprint of every row, of its text with the second half replaced by the head of the next document, and how alike they are."""
    rows = with_next(docs, keep).withColumn("n_chars", F.length("text")).withColumn("half", F.expr("n_chars div 2"))
    edited = F.expr("concat(substring(text, 1, n_chars - cast(half as int)), substring(coalesce(next.text, ''), 1, cast(half as int)))")
    rows = rows.withColumn("edited", edited).withColumn("edited_print", F.expr(anchors("edited", keep)))
    none = "coalesce(next.print, cast(array() as array<bigint>))"
    return rows.withColumn("other", F.expr(none)).selectExpr(
        "doc_id", "cast(n_chars as bigint) as n_chars", "sha2(edited, 256) as edited_sha256", f"{readable('print')} as fingerprint",
        f"{readable('edited_print')} as edited_fingerprint", f"{likeness('print', 'edited_print', keep)} as near_edited",
        f"{likeness('print', 'other', keep)} as near_next")


@query("op3_fingerprints")
def op3(spark, sf_dir):
    return compare_edits(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
