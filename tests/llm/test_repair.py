"""Conversation repair against a brute-force version: all edits of short conversations, and a plain table of (row, state) for long ones."""
import hashlib
import itertools
import random
import re
import zlib

import pytest

from tideline.llm import queries, repair

SF = "/root/testdata/sf0.001"
ROLE_ORDER = re.compile(r"(s?(ua)+)?")


def every_edit(kinds, most_inserts=3):
    """Cheapest edits, least audit first, by trying all."""
    best = None
    letters = ["D" if k == "x" else "DKR" for k in kinds]
    for edits in itertools.product(*letters):
        for inserts in range(most_inserts + 1):
            for spots in itertools.combinations_with_replacement(range(len(kinds) + 1), inserts):
                cost = sum({"D": 4, "K": 0, "R": 3}[e] + 3 * (e != "D" and k.isupper()) for e, k in zip(edits, kinds, strict=True)) + 3 * inserts
                if best is not None and cost > best[0]:
                    continue
                slots = []
                for i in range(len(kinds) + 1):
                    slots += ["I"] * spots.count(i) + ([edits[i] + kinds[i].lower()] if i < len(kinds) else [])
                free = [s for s in slots if s[0] != "D"]
                for roles in itertools.product(*(s[1] if s[0] == "K" else "ua" for s in free)):
                    if ROLE_ORDER.fullmatch("".join(roles)):
                        label = (cost, "".join(s[0] for s in slots))
                        best = label if best is None else min(best, label)
    return best


def by_table(kinds):
    """The same by a forward table with whole audits."""
    step, nxt = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}, (2, 2, 3, 2)
    now = {0: (0, "")}

    def inserts(table):
        for _ in range(4):
            for s, (c, a) in list(table.items()):
                label = (c + 3, a + "I")
                table[nxt[s]] = min(table.get(nxt[s], label), label)
        return table

    for kind in kinds:
        now, out = inserts(now), {}
        for s, (c, a) in now.items():
            moves = [(s, c + 4, "D")]
            if kind != "x":
                more = 3 * kind.isupper()
                moves.append((nxt[s], c + 3 + more, "R"))
                if (s, kind.lower()) in step:
                    moves.append((step[s, kind.lower()], c + more, "K"))
            for to, cost, edit in moves:
                label = (cost, a + edit)
                out[to] = min(out.get(to, label), label)
        now = out
    now = inserts(now)
    return min(now[s] for s in (0, 3) if s in now)


def test_all_short_conversations():
    for n in range(4):
        for kinds in itertools.product("suaoUAx", repeat=n):
            assert repair.cheapest("".join(kinds), 0, repair.ENDS) == every_edit("".join(kinds)) == by_table(kinds)


@pytest.mark.parametrize("seed", range(4))
def test_longer_conversations_and_blocks(seed):
    rng = random.Random(seed)
    for _ in range(60):
        kinds = "".join(rng.choices("suaoSUAOx", weights=(1, 5, 5, 1, 1, 2, 2, 1, 2), k=rng.randint(1, 60)))
        want = by_table(kinds)
        assert repair.cheapest(kinds, 0, repair.ENDS) == want
        cuts = sorted(rng.sample(range(len(kinds) + 1), min(3, len(kinds))))
        parts = [kinds[a:b] for a, b in itertools.pairwise([0, *cuts, len(kinds)]) if a < b]
        tables = [[(a, b, *found) for a in repair.STATES for b in repair.STATES if (found := repair.cheapest(part, a, (b,)))] for part in parts]
        assert repair.join_blocks(tables) == want


def brute(rows):
    """Contract rows of undamaged ``rows`` ``(conv_id, turn, role, text)``, each conversation in order."""
    out = {}
    for conv in {row[0] for row in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()[:16]))
        seen, faults, kinds = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, ""
        for _, _, role, text in mine:
            spoken = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not spoken else "duplicate" if (role, text) in seen else "truncated" if spoken[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            kinds += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, edits = by_table(kinds)
        lines, state, i = [], "", 0
        for edit in edits:
            if edit == "I":
                lines.append(("assistant" if state == "u" else "user") + ":")
                state = "a" if state == "u" else "u"
                continue
            _, _, role, text = mine[i]
            i += 1
            if edit == "R":
                role = "assistant" if state == "u" else "user"
            if edit != "D":
                lines.append(f"{role}:{text}")
                state = role[0]
        out[conv] = (gaps, *faults.values(), illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        h = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (conv, turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
        out += [] if h == 0 else [row] * (2 if h == 3 else 1)
    return out


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def compare(spark, rows, sf_dir):
    want = brute(damaged(rows))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    out = queries.queries()["op12_conversation_repair"](spark, sf_dir).collect()
    assert sorted(((r.conv_id, *(r[n] for n in NAMES)) for r in out), key=repr) == sorted(((c, *want.get(c, empty)) for c in {r[0] for r in rows}), key=repr)


def test_query(spark):
    compare(spark, [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()], SF)


def test_edges_and_long_conversations(spark, tmp_path):
    rng = random.Random(5)
    rows = [(1, None, None, None), (1, None, "user", "a."), (1, 2, "user", None), (1, 2, "user", "a."), (2, 0, "", "x."), (2, 1, "tool", "y"), (3, None, "user", "n."),
            (None, 0, "user", "q?"), (None, 5, "assistant", "r!"), (None, 5, "assistant", "r!"), (4, 7, "assistant", "\t\n"), (5, 0, "system", "s."),
            (5, 1, "user", "u" * 200_000), (5, 3, "assistant", "A. \x0b")]
    rows += [(9, turn, rng.choice(["user", "assistant", "assistant", "system"]), f"{turn % 700}" + rng.choice(["", ".", "!"])) for turn in range(1500)]
    rows += [(100 + turn % 300, turn // 300, ("user", "assistant")[turn // 300 % 2], "hello there.") for turn in range(1200)]
    schema = "conv_id long, turn long, role string, text string, at long, digest string, fault string, audit string, block int"
    frame = spark.createDataFrame([row + (1, "d", "f", "x", 2) for row in rows], schema)
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    compare(spark, rows, str(tmp_path))
    assert repair.audit(frame.where("false")).count() == 0 and repair.repaired(frame.where("false"), repair.audit(frame.where("false"))).count() == 0
