"""Repaired conversations against a plain search over all rows of a conversation."""

import hashlib
import random
import re
import zlib

import pytest

from flowtide.llm import dialogue

NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
ASKED = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(turn is not None, turn or 0, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out)


def plain_repair(rows):
    """Cost, audit and repaired lines of the cheapest, then least audit, from the end of the rows to the front."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        shown = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated")
        seen.add((role, text))
    best = {q: (0, "", []) if q in ("", "a") else None for q in NEXT}
    for i in range(len(rows), -1, -1):
        now = {}
        if i == len(rows):
            now = dict(best)
        else:
            _, _, role, text = rows[i]
            for q in NEXT:
                extra = 5 if faults[i] == "truncated" else 0
                ways = [(2 + best[q][0], "D" + best[q][1], best[q][2])]
                if faults[i] in ("", "truncated"):
                    kept = NEXT[q].get(role[:1])
                    if kept:
                        c, a, lines = best[kept]
                        ways.append((c + extra, "K" + a, [f"{role}:{text}", *lines]))
                    c, a, lines = best[ASKED[q]]
                    ways.append((c + 1 + extra, "R" + a, [f"{NAMES[ASKED[q]]}:{text}", *lines]))
                now[q] = min(ways)
        for _ in range(4):
            for q in NEXT:
                if now[ASKED[q]] is not None:
                    c, a, lines = now[ASKED[q]]
                    way = (c + 5, "I" + a, [f"{NAMES[ASKED[q]]}:", *lines])
                    now[q] = way if now[q] is None else min(now[q], way)
        best = now
    return faults, best[""]


def plain_audits(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = plain_damage([r for r in rows if r[0] == conv])
        faults, (cost, audit, lines) = plain_repair(mine)
        turns = {t for known, t, _, _ in mine if known}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost,
            audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def audits_of(spark, rows, **how):
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, conv string, pos int, block int")
    return {r[0]: tuple(r)[1:] for r in dialogue.audits(table.repartition(3), **how).collect()}


def made(seed, n, conv):
    draw = random.Random(seed)
    texts = ["Yes.", "No!", "why?  \n", "and so on", "", " \t", None, "Yes.", "ok. \x0b"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "agent"]
    return [(conv, draw.choice([None, t, t, t, t + 3]), draw.choice(roles), draw.choice(texts) if draw.random() < 0.5 else f"Turn {draw.randrange(40)}.") for t in range(n)]


def test_small_tables_against_plain_search(spark):
    rows = [r for conv in range(120) for r in made(conv, conv % 13, conv)] + made(999, 9, None) + [(7777, 0, "user", "x")]
    assert audits_of(spark, rows) == plain_audits(rows)


@pytest.mark.parametrize("block_rows", [1, 2, 7])
def test_blocks_give_the_same_as_whole_conversations(spark, block_rows):
    rows = made(1, 60, 1) + made(2, 3, 2) + made(3, 17, None) + [(5, t, "user", "Same.") for t in range(20)]
    assert audits_of(spark, rows, block_rows=block_rows) == plain_audits(rows)


def test_given_conversations(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert {r[0]: tuple(r)[1:] for r in dialogue.audits(table).collect()} == plain_audits([tuple(r) for r in table.collect()])


def test_empty_long_and_dropped(spark):
    assert audits_of(spark, []) == {}
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "Gone."), (1, 0, "user", "long " * 100_000 + "."), (1, 1, "assistant", "Yes.")]
    found = audits_of(spark, rows)
    assert found == plain_audits(rows) and found[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_edits_hold_the_repaired_rows(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", 0), (1, 1, "user", "More.", 0), (1, 2, "assistant", "Yes.", 0), (1, 3, "user", "", 0)], "conv_id long, turn long, role string, text string, copy int")
    found = dialogue.repair(rows).edits().orderBy("block", "step").collect()
    assert [(r.edit, r.role, r.text) for r in found if r.edit != "D"] in ([("K", "user", "Hi."), ("K", "assistant", "Yes.")], [("K", "user", "More."), ("K", "assistant", "Yes.")])
    assert "".join(r.edit for r in found) == plain_repair([(True, r.turn, r.role, r.text) for r in rows.orderBy("turn").collect()])[1][1]
