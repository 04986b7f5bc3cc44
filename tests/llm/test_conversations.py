"""Conversation repair against a shortest-path search over whole audits."""

import hashlib
import heapq
import random
import re

import pytest
from hypothesis import given, settings, strategies as st

from vigil.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string"


def search(initials, faults):
    """Cheapest cost, then the least audit, by uniform-cost search over (cost, audit)."""
    goal, seen = len(initials), set()
    heap = [(0, "", 0, "")]
    while heap:
        cost, audit, row, tail = heapq.heappop(heap)
        if row == goal and re.fullmatch("(s?(ua)+)?", tail):
            return cost, audit
        # What may follow depends on the last initial, and on whether only a system turn is there.
        state = (row, tail[-1:], tail)if len(tail) < 2 else (row, tail[-1:])
        if state in seen:
            continue
        seen.add(state)
        legal = lambda x: re.fullmatch("s?(ua)*u?", tail + x)
        for x in "ua":
            if legal(x):
                heapq.heappush(heap, (cost + 2, audit + "I", row, tail + x))
        if row < goal:
            heapq.heappush(heap, (cost + 3, audit + "D", row + 1, tail))
            if faults[row] not in (c.BLANK, c.DUPLICATE):
                more = faults[row] == c.TRUNCATED
                for x in "ua":
                    if legal(x):
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", row + 1, tail + x))
                if initials[row] in "sua" and legal(initials[row]):
                    heapq.heappush(heap, (cost + more, audit + "K", row + 1, tail + initials[row]))
    raise AssertionError


def judged(rows):
    """Faults, gaps and repair of one conversation's rows, straight from the definition."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    faults, seen = [], set()
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append(c.BLANK if not solid else c.DUPLICATE if (role, text) in seen else c.SOUND if solid[-1] in ".!?" else c.TRUNCATED)
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    cost, audit = search([i or "?" for i in initials], faults)
    out, state, at = [], c.START, iter(rows)
    for edit in audit:
        _, role, text = (None, "", "") if edit == "I" else next(at)
        if edit != "D":
            role = role if edit == "K" else {"u": "user", "a": "assistant"}[c.wanted(state)]
            state = c.AFTER[role[:1], state]
            out.append(f"{role}:{text}")
    turns = [t for t, _, _ in rows if t is not None]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in (c.BLANK, c.DUPLICATE, c.TRUNCATED)),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suauau?"), st.sampled_from([0, 0, 0, 1, 2, 3])), max_size=9), st.sampled_from([1, 2, 3, 256]))
def test_cheapest_is_the_least_audit_whatever_the_block(rows, block):
    initials, faults = "".join(r[0] for r in rows), bytes(r[1] for r in rows)
    assert c.cheapest(initials, faults, block) == search(initials, faults)


def test_long_conversation_does_not_depend_on_blocks():
    draw = random.Random(4)
    initials, faults = "".join(draw.choice("suauaua?") for _ in range(1500)), bytes(draw.choice([0, 0, 0, 0, 1, 2, 3]) for _ in range(1500))
    found = c.cheapest(initials, faults)
    assert found == c.cheapest(initials, faults, 1500) == c.cheapest(initials, faults, 7) == search(initials, faults)


ODD = [
    (1, 0, "system", "Be brief."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello! \n"), (1, 4, "user", "Hi."), (1, 5, "assistant", "  "),
    (2, None, "user", "a"), (2, None, "user", "a"), (2, 3, None, "b."), (2, 3, "tool", None), (2, 9, "", "c?"), (None, 0, "assistant", "x."), (None, None, None, None),
    (3, 0, "system", "s."), (4, 0, "assistant", "é "), (5, 0, "user", "q?"), (5, 0, "user", "p?"), (5, 0, "assistant", "z."), (6, 7, "USER", "A."),
]


def many(seed=9):
    draw = random.Random(seed)
    return [(conv, t if draw.random() < 0.9 else draw.choice([None, t + 3]), draw.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]),
             draw.choice(["One.", "Two!", "three", " ", "", None, "Four? \t", "éà.", "x" * 50])) for conv in range(60) for t in range(draw.choice([1, 2, 4, 8]))]


@pytest.mark.parametrize("rows", [ODD, many(), [(1, t, draw, f"t{t % 90}.") for t, draw in enumerate(["user", "assistant", "user"] * 400)]], ids=["odd", "many", "hot"])
def test_summary_equals_brute_force(rows, spark):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'own' AS tie", "1 AS fault").repartition(4)
    got = {r[0]: tuple(r)[1:] for r in c.summary(df, df).collect()}
    want = {conv: judged([r[1:] for r in rows if r[0] == conv]) for conv in {r[0] for r in rows}}
    assert got == want


def test_repaired_rows_are_legal_and_named_by_their_edits(spark):
    rows = spark.createDataFrame(many(3), SCHEMA)
    report = c.judge(rows)
    found = c.repair(rows, report).collect()
    audits = {r["conv_id"]: r["audit"] for r in report.collect()}
    for conv, audit in audits.items():
        mine = sorted((r for r in found if r["conv_id"] == conv), key=lambda r: r["place"])
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][:1] for r in mine)) and [r["place"] for r in mine] == [*range(len(mine))]
        assert "".join(r["edit"] for r in mine) == audit.replace("D", "")


def test_conversations_without_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert c.summary(empty, empty).collect() == []
    some = spark.createDataFrame(ODD, SCHEMA)
    got = c.summary(some, empty).collect()
    assert len(got) == 7 and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in got)


def test_damage_follows_the_checksum(spark):
    import zlib

    rows = many(5)
    want = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            row = (conv, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            want += [row] * (2 if k == 3 else 1)
    got = [tuple(r)[:4] for r in c.damage(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
