"""Secret scans: fixed patterns, and two character Markov models compared by their log-likelihood ratio."""
import math

from pyspark.sql import functions as F

from .common import literal_array, read_table, text_or_empty
from .registry import query

#: Fixed values of the contract, two groups each: what leads, and the value whose length counts.
PATTERNS = (("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 12),
            ("access", r"()(AKIA[A-Z0-9]++)", 18),
            ("hex", r"()([0-9a-f]{16,}+)", 16))
KINDS = ("assign", "access", "hex", "model")

#: Characters that the models tell apart; all others are one more.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1
#: Strings that the models judge: runs of at least so many of these characters.
CANDIDATE = r"()((?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+)"
#: Made random strings of each form.
MADE_STRINGS = 20_000
#: Mean log-likelihood ratio of a character from which a string counts as random.
THRESHOLD = 0.5


def _pieces(pattern):
    """The text cut in front of every match, with the two groups of the match marked."""
    return F.split(F.regexp_replace("plain_", pattern, "\x01$1\x02$2\x03"), "\x01")


def _spans(name, kind, least):
    """Spans of a pieces column: start and end in code points of the whole match, and its value."""
    return f"""aggregate(slice({name}, 2, size({name})), named_struct('at', length({name}[0]), 'out', cast(array() as
        array<struct<start:int,kind:int,stop:int,value:string>>)), (a, p) -> named_struct('at', a.at + length(p) - 2,
        'out', if(instr(p, '\\u0003') - instr(p, '\\u0002') - 1 >= {least}, array_append(a.out, named_struct('start', a.at, 'kind', {kind},
        'stop', a.at + instr(p, '\\u0003') - 2, 'value', substring(p, instr(p, '\\u0002') + 1, instr(p, '\\u0003') - instr(p, '\\u0002') - 1))), a.out))).out"""


def _with_spans(docs, patterns, first_kind=0):
    """``docs`` (with ``plain_``, the text free of the marks) plus one span column for each pattern."""
    for number, (kind, pattern, least) in enumerate(patterns):
        docs = docs.withColumn("pieces_", _pieces(pattern)).withColumn(f"{kind}_", F.expr(_spans("pieces_", first_kind + number, least))).drop("pieces_")
    return docs


def _plain(docs):
    """Marks that occur in the text itself become other characters, one for one, so that positions stay."""
    text = text_or_empty()
    return docs.withColumn("plain_", F.when(text.rlike("[\x01-\x03]"), F.translate(text, "\x01\x02\x03", "")).otherwise(text))


def labelled_samples(docs, made=MADE_STRINGS, seed=11):
    """Training strings ``(value, random)`` of all documents. Random: values of the fixed patterns, and strings made from digests.

    Ordinary: words and identifiers of at least 6 characters that no fixed pattern matches.
    """
    every = _with_spans(_plain(docs.select("text")), PATTERNS)
    values = every.select(F.explode(F.concat("assign_", "access_", "hex_")).alias("s")).select("s.value", F.lit(True).alias("random"))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("plain_", PATTERNS[0][1], " "), PATTERNS[1][1], " "), PATTERNS[2][1], " ")
    words = every.select(F.explode(F.regexp_extract_all(rest, F.lit(r"[A-Za-z0-9+/_=-]{6,}"), F.lit(0))).alias("value"), F.lit(False).alias("random"))
    digests = docs.sparkSession.range(made).selectExpr(f"sha2(concat('sample', id, '-', {seed}), 256) as digest")
    forms = digests.selectExpr("explode(array(left(digest, 40), base64(unhex(digest)), translate(base64(unhex(digest)), 'abcdefghijklmnopqrstuvwxyz', "
                               "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'))) as value", "true as random")
    return values.unionByName(words).unionByName(forms)


def train(samples):
    """Log-likelihood ratio of each pair of characters, random over ordinary, as a flat list of STATES x STATES.

    First-order Markov chains with one added count a pair. Strings, then their pairs, are counted in Spark; at most 2 x STATES² sums reach the driver.
    """
    place = f"cast(instr('{ALPHABET}', substring(pair, {{}}, 1)) as int)"
    strings = samples.where("length(value) >= 2").groupBy("random", "value").agg(F.count(F.lit(1)).alias("n"))
    pairs = strings.select("random", "n", F.explode(F.regexp_extract_all("value", F.lit("(?s)(?=(..))"), F.lit(1))).alias("pair"))
    pairs = pairs.selectExpr("random", "n", f"{place.format(1)} as a", f"{place.format(2)} as b").groupBy("random", "a", "b").agg(F.sum("n").alias("n"))
    counts = {random: [[1.0] * STATES for _ in range(STATES)] for random in (True, False)}
    for random, a, b, n in pairs.collect():
        counts[random][a][b] += n
    return [math.log(counts[True][a][b] / sum(counts[True][a])) - math.log(counts[False][a][b] / sum(counts[False][a]))
            for a in range(STATES) for b in range(STATES)]


def score(value, ratios):
    """Mean log-likelihood ratio of a string column, as SQL. Strings of under two characters score 0."""
    table = literal_array([f"{x:.6f}" for x in ratios], "double")
    return f"""aggregate(sequence(1, greatest(length({value}) - 1, 1)), 0D, (s, i) -> s + if(i < length({value}), get({table},
        instr('{ALPHABET}', substring({value}, i, 1)) * {STATES} + instr('{ALPHABET}', substring({value}, i + 1, 1))), 0D)) / greatest(length({value}) - 1, 1)"""


def scan(docs, ratios, threshold=THRESHOLD):
    """Every row of ``docs``, all its columns, plus ``spans``: (start, kind, stop, value) in code points, by start, then kind (of KINDS).

    Kinds 0 to 2 are the fixed patterns' matches, which all stay; kind 3 are further strings that the models call random and that touch no
    other span. A null text counts as empty. A column named ``spans`` is replaced. Rows are judged one by one; nothing is shuffled.
    """
    found = _with_spans(_plain(docs), PATTERNS)
    found = _with_spans(found.withColumn("base_", F.concat("assign_", "access_", "hex_")), (("cand", CANDIDATE, 20),), 3)
    extra = F.expr(f"filter(cand_, c -> not exists(base_, b -> b.start < c.stop and c.start < b.stop) and {score('c.value', ratios)} >= {threshold})")
    return found.withColumn("spans", F.array_sort(F.concat("base_", extra))).drop("plain_", "base_", "cand_", "assign_", "access_", "hex_")


def fit(docs, **bounds):
    return train(labelled_samples(docs, **bounds))


def redact(docs, ratios, threshold=THRESHOLD, mark="[SECRET]"):
    """``docs`` with every span, overlapping ones as one, replaced by a mark; n_chars follows where there is such a column. Texts without spans stay."""
    found = scan(docs.withColumnRenamed("spans", "kept_spans_"), ratios, threshold)
    cut = f"""aggregate(spans, named_struct('at', 0, 'out', ''), (a, s) -> named_struct('at', greatest(a.at, s.stop), 'out', if(s.start < a.at, a.out,
        concat(a.out, substring(text, a.at + 1, s.start - a.at), '{mark}'))), a -> concat(a.out, substring(text, a.at + 1, length(text))))"""
    out = found.withColumn("text", F.expr(f"if(size(spans) = 0, text, {cut})"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.expr("if(size(spans) = 0, n_chars, cast(length(text) as bigint))"))
    return out.drop("spans").withColumnRenamed("kept_spans_", "spans").select(docs.columns)


@query("op10_secret_scans")
def op10(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, fit(docs))
    line = "array_join(transform({}, s -> concat(element_at(array('" + "','".join(KINDS) + "'), s.kind + 1), ':', s.start, ':', s.stop)), ',')"
    count = "cast(size(filter(spans, s -> s.kind = {})) as bigint)"
    return found.selectExpr("doc_id", *[f"{count.format(i)} as n_{kind}" for i, kind in enumerate(KINDS)],
                            f"sha2({line.format('filter(spans, s -> s.kind < 3)')}, 256) as base_sha256", f"{line.format('spans')} as spans")
