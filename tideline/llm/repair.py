"""Repair of conversation structure: cheapest edits to the role order ``(s?(ua)+)?``, by bidirectional Dijkstra over the edit lattice."""
import heapq
from functools import lru_cache

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, read_table, stored
from .registry import query

#: Rows of a conversation whose lattice is searched at once; longer conversations are searched block by block, and paths are joined at the four states.
BLOCK = 256
BLANK = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
#: States of the role order: nothing yet, after s, after u, after a. Words of it end in the first or the last.
STATES, ENDS = range(4), (0, 3)
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: The state that the next user or assistant row leads to, and which of both it is.
_NEXT, _ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")


def _out(kinds, node):
    """Edges from a node: (cost, edit, node)."""
    i, state = node
    if i < len(kinds):
        kind = kinds[i]
        yield DELETE, "D", (i + 1, state)
        if kind != "x":
            more = UNFINISHED if kind.isupper() else 0
            if (state, kind.lower()) in _STEP:
                yield KEEP + more, "K", (i + 1, _STEP[state, kind.lower()])
            yield REROLE + more, "R", (i + 1, _NEXT[state])
    yield INSERT, "I", (i, _NEXT[state])


def _into(kinds, node):
    """Edges to a node: (cost, edit, node they come from)."""
    i, state = node
    if i:
        kind = kinds[i - 1]
        yield DELETE, "D", (i - 1, state)
        if kind != "x":
            more = UNFINISHED if kind.isupper() else 0
            for before in STATES:
                if _STEP.get((before, kind.lower())) == state:
                    yield KEEP + more, "K", (i - 1, before)
                if _NEXT[before] == state:
                    yield REROLE + more, "R", (i - 1, before)
    for before in STATES:
        if _NEXT[before] == state:
            yield INSERT, "I", (i, before)


@lru_cache(1 << 16)
def cheapest(kinds, start, ends):
    """``(cost, audit)`` of the cheapest edits of a block from state ``start`` to one of ``ends``, the ASCII-least audit of equal ones; None if there is no way.

    ``kinds`` has a letter a row: s, u, a or o (any other) by the role, upper case where the text is unfinished, x where the row must go. A label is
    cost and audit, so far from the start or still to the end. Audits of one node and cost never start one another (they use the same rows, and
    more inserts cost more), so the least audit of a node continues to the least audit behind it. Free edges use a row each, so nodes of equal cost
    are settled in order of rows. The search ends when the heaps' tops together exceed the best crossing; then every cheapest path has an edge
    from a node settled forwards to one settled backwards, or was settled forwards to its end.
    """
    if not kinds and start in ends:
        return 0, ""
    labels = [{(0, start): (0, "")}, {(len(kinds), state): (0, "") for state in ends}]
    heaps = [[(0, 0, node) for node in label] for label in labels]
    settled, best = [set(), set()], float("inf")
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        _, _, node = heapq.heappop(heaps[side])
        if node in settled[side]:
            continue
        settled[side].add(node)
        cost, audit = labels[side][node]
        for price, edit, other in (_into if side else _out)(kinds, node):
            label = (cost + price, edit + audit if side else audit + edit)
            if other not in labels[side] or label < labels[side][other]:
                labels[side][other] = label
                heapq.heappush(heaps[side], (label[0], len(kinds) - other[0] if side else other[0], other))
            if other in labels[1 - side]:
                best = min(best, label[0] + labels[1 - side][other][0])
    crossings = []
    for node in settled[0]:
        cost, audit = labels[0][node]
        if node[0] == len(kinds) and node[1] in ends and cost == best:
            crossings.append(audit)
        for price, edit, other in _out(kinds, node):
            if other in settled[1] and cost + price + labels[1][other][0] == best:
                crossings.append(audit + edit + labels[1][other][1])
    return (best, min(crossings)) if crossings else None


def join_blocks(tables):
    """``(cost, audit)`` of a whole conversation from its blocks' ``[(from, to, cost, audit)]``, in order."""
    best = {0: (0, "")}
    for paths in tables:
        after = {}
        for start, end, cost, audit in paths:
            if start in best:
                label = (best[start][0] + cost, best[start][1] + audit)
                after[end] = min(after.get(end, label), label)
        best = after
    return min(best[state] for state in ENDS if state in best)


def narrow(rows):
    """``conv_id, turn, role, digest, blank, unfinished`` and the text's row itself are told apart by 128 bits of SHA-256. Null role or text: one space."""
    spoken = F.rtrim("text", F.lit(BLANK))
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).withColumns({
        "digest": F.unhex(F.substring(F.sha2("text", 256), 1, 32)), "blank": spoken == "", "unfinished": ~F.right(spoken, F.lit(1)).isin(".", "!", "?")})


ORDER = ("turn", "role", "digest")


def place(rows):
    """The rows without texts, each with ``at``: numbers in order of conversation, turn (nulls first), role and digest. Ranges of a long conversation lie in several tasks."""
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest"]
    cut = narrow(rows).drop("text").withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys, "tie").sortWithinPartitions(*keys)
    return stored(cut.drop("tie").withColumn("at", F.monotonically_increasing_id()), "turns")


def find_faults(placed):
    """``placed`` with its first fault: blank, duplicate (an earlier row of the conversation has its role and text), truncated, or null."""
    first = placed.groupBy(F.col("conv_id").alias("conv"), F.col("role").alias("said"), F.col("digest").alias("what")).agg(F.min("at").alias("first_at"))
    same = F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("role") == F.col("said")) & (F.col("digest") == F.col("what"))
    fault = F.expr("case when blank then 'blank' when at > first_at then 'duplicate' when unfinished then 'truncated' end")
    return placed.join(first, same).select("conv_id", "at", "turn", "role", fault.alias("fault"))


_PATHS = "paths array<struct<from:int,to:int,cost:long,audit:string>>"
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


def audit(rows):
    """One row per conversation of ``rows`` (``conv_id, turn, role, text``): ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``.

    Rows go by turn (nulls first), then role, then a hash of the text. A null conv_id is a conversation of its own; null role and text count as one
    space; repeated rows are duplicates; empty tables give no rows; other columns are not looked at. Texts stay where they are: only hashes and flags are
    exchanged. Blocks of at most 256 rows are searched wherever they lie; then a conversation is one row a block. The audit is one string, which
    bounds a conversation to 2**31 edits.
    """
    bound_batches(rows.sparkSession)
    placed = place(rows)
    faults = find_faults(placed).withColumn("initial", F.expr("if(left(role, 1) in ('s', 'u', 'a'), left(role, 1), 'o')"))
    kind = F.expr("case when fault in ('blank', 'duplicate') then 'x' when fault = 'truncated' then upper(initial) else initial end")
    lines = F.array_sort(F.collect_list(F.struct("at", "turn", "initial", kind.alias("kind"))))
    blocks = faults.groupBy("conv_id", F.expr(f"at div {BLOCK}").alias("block")).agg(
        lines.alias("lines"), *(F.count_if(F.col("fault") == name).alias(name) for name in _COUNTS[:3]))
    blocks = blocks.withColumn("blocks", F.count("*").over(Window.partitionBy("conv_id")))
    shape = blocks.select("conv_id", "block", "blocks", *_COUNTS[:3], F.expr("array_join(lines.initial, '')").alias("initials"),
                          F.expr("array_join(lines.kind, '')").alias("kinds"), F.expr("lines.turn").alias("turns"))
    conv = placed.schema["conv_id"]
    searched = shape.mapInArrow(_search, T.StructType([conv, *T._parse_datatype_string(f"block long, {', '.join(f'{c} long' for c in _COUNTS)}, initials string, "
                                                                                       f"first_turn long, last_turn long, turns long, {_PATHS}").fields]))
    whole = searched.groupBy("conv_id").agg(*(F.sum(name).alias(name) for name in _COUNTS), F.array_sort(F.collect_list(F.struct(
        "block", "initials", "first_turn", "last_turn", "turns", "paths"))).alias("parts"))
    return whole.mapInArrow(_join, T.StructType([conv, *T._parse_datatype_string("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string").fields]))


def _illegal(initials):
    return sum(pair not in ("su", "ua", "au") for pair in map("".join, zip(initials, initials[1:])))  # noqa: B905


def _search(batches):
    """Blocks with their turns, illegal neighbours and cheapest paths: to the end if the block is all of the conversation, else between all states."""
    import pyarrow as pa
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            turns = [turn for turn in row["turns"] if turn is not None]
            kinds, initials = row["kinds"], row["initials"]
            if row["blocks"] == 1:
                paths = [(0, 0, *cheapest(kinds, 0, ENDS))]
            else:
                paths = [(a, b, *found) for a in STATES for b in STATES if (found := cheapest(kinds, a, (b,)))]
            out.append({"conv_id": row["conv_id"], "block": row["block"], **{name: row[name] for name in _COUNTS[:3]}, "illegal": _illegal(initials),
                        "initials": initials[0] + initials[-1], "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
                        "turns": len(set(turns)), "paths": [dict(zip(("from", "to", "cost", "audit"), path, strict=True)) for path in paths]})
        columns = [batch.schema.field("conv_id"), *(pa.field(name, pa.int64()) for name in ("block", *_COUNTS)), pa.field("initials", pa.string()),
                   *(pa.field(name, pa.int64()) for name in ("first_turn", "last_turn", "turns")),
                   pa.field("paths", pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))]
        yield pa.RecordBatch.from_pylist(out, pa.schema(columns))


def _join(batches):
    """Conversations from their blocks."""
    import pyarrow as pa
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            parts = row["parts"]
            cost, edits = join_blocks([[tuple(path.values()) for path in part["paths"]] for part in parts])
            dated = [part for part in parts if part["turns"]]
            turns = sum(part["turns"] for part in dated) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(dated, dated[1:]))  # noqa: B905
            gaps = dated[-1]["last_turn"] - dated[0]["first_turn"] + 1 - turns if dated else 0
            between = sum(_illegal(a["initials"][1] + b["initials"][0]) for a, b in zip(parts, parts[1:]))  # noqa: B905
            out.append((row["conv_id"], gaps, row["blank"], row["duplicate"], row["truncated"], row["illegal"] + between, cost, edits))
        columns = list(zip(*out, strict=True)) or [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field("conv_id").type), *(pa.array(c, pa.int64()) for c in columns[1:7]),
                                          pa.array(columns[7], pa.string())], ["conv_id", "gaps", *_COUNTS, "cost", "audit"])


def repaired(rows, audits):
    """The rows that the audits leave: ``conv_id, place, edit, role, text``, each conversation's rows in order and together inside a partition.

    ``place`` counts from 0; inserted rows have an empty text. One exchange takes all texts to their conversation; a task reads them in order and holds a batch
    and one audit at a time.
    """
    bound_batches(rows.sparkSession)
    texts = narrow(rows).select("conv_id", F.lit(1).alias("part"), *ORDER, "text", F.lit(None).cast("string").alias("audit"))
    kind = dict((field.name, field.dataType) for field in texts.schema.fields)
    heads = audits.select("conv_id", F.lit(0).alias("part"), *(F.lit(None).cast(kind[name]).alias(name) for name in (*ORDER, "text")), "audit")
    both = texts.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "part", *(F.col(name).asc_nulls_first() for name in ORDER))
    conv = texts.schema["conv_id"]
    return both.select("conv_id", "part", "role", "text", "audit").mapInArrow(_apply, T.StructType([
        conv, *T._parse_datatype_string("place long, edit string, role string, text string").fields]))


def _apply(batches):
    """Audits applied to the rows that follow them."""
    import pyarrow as pa
    edits, spot, state, count, conv, form = "", 0, 0, 0, None, None

    def inserts(out):
        nonlocal spot, state, count
        while spot < len(edits) and edits[spot] == "I":
            out.append((conv, count, "I", _ROLE[state], ""))
            spot, state, count = spot + 1, _NEXT[state], count + 1

    def packed(out):
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(columns[0], form), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.string()) for c in columns[2:])],
                                          ["conv_id", "place", "edit", "role", "text"])

    for batch in batches:
        out, form = [], batch.schema.field("conv_id").type
        for owner, part, role, text, audit in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if part == 0:
                inserts(out)
                edits, spot, state, count, conv = audit, 0, 0, 0, owner
                continue
            inserts(out)
            edit = edits[spot]
            spot += 1
            if edit == "K":
                state = _STEP[state, role[0]]
            elif edit == "R":
                role, state = _ROLE[state], _NEXT[state]
            if edit != "D":
                out.append((conv, count, edit, role, text))
                count += 1
        yield packed(out)
    if form is not None:
        out = []
        inserts(out)
        yield packed(out)


def digests(repaired_rows):
    """``conv_id, repaired_sha256``: SHA-256 of each conversation's lines ``role:text``, from rows that lie together in order."""
    conv = repaired_rows.schema["conv_id"]

    def run(batches):
        import hashlib

        import pyarrow as pa
        held, owner, form = None, None, None
        for batch in batches:
            out, form = [], batch.schema.field("conv_id").type
            for conv_id, place, role, text in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "place", "role", "text")), strict=True):
                if place == 0:
                    if held:
                        out.append((owner, held.hexdigest()))
                    held, owner = hashlib.sha256(), conv_id
                held.update((("\n" if place else "") + role + ":" + text).encode())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], form), pa.array([x for _, x in out], pa.string())], ["conv_id", "repaired_sha256"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([owner], form), pa.array([held.hexdigest()])], ["conv_id", "repaired_sha256"])

    return repaired_rows.mapInArrow(run, T.StructType([conv, T.StructField("repaired_sha256", T.StringType())]))


def damage(conversations):
    """Rows as the contract of op12 damages them, by the CRC-32 of ``conv_id:turn``."""
    key = F.concat_ws(":", *(F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn")))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                                F.pmod(F.crc32(key.cast("binary")), F.lit(20)).alias("h")).where("h <> 0")
    text = F.expr("case h when 1 then '' when 2 then translate(text, '.!?', '') else text end")
    return rows.select("conv_id", "turn", F.expr("if(h = 4, 'user', role)").alias("role"), text.alias("text"),
                       F.explode(F.expr("sequence(1, if(h = 3, 2, 1))")).alias("copy")).drop("copy")


@query("op12_conversation_repair")
def op12(spark, sf_dir):
    given = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = damage(given)
    audits = stored(audit(rows), "audits")
    lines = digests(repaired(rows, audits))
    every = given.select("conv_id").distinct()
    numbers = ("gaps", *_COUNTS, "cost")
    joined = every.alias("e").join(audits.alias("a"), F.expr("e.conv_id <=> a.conv_id"), "left").join(lines.alias("l"), F.expr("e.conv_id <=> l.conv_id"), "left")
    return joined.select("e.conv_id", *(F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in numbers),
                         F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
