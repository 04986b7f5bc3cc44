"""Repair of the structure of conversations: the cheapest edits that give a legal sequence of roles.

A legal sequence is empty or an optional system turn before pairs of user and assistant turns. Rows are kept,
given the role that the place asks for, deleted or inserted empty; see ``COSTS``. Blank rows and repetitions have to
be deleted, a truncated row that stays costs one more.

Method: the weight of a sequence of edits is one whole number. Its high digits are the cost; the
low digits, a fixed number of them, are the letters of the edits (the audit), the first in the
highest place, in their ASCII order from 1 to 4, with zeros behind the last. The least weight
over the graph of (row, state of the role automaton) is then the cheapest audit, and of equally cheap ones the
first in ASCII order; no other rule decides. The minimum is taken from the last row to the first: an edit in
front of others adds its cost, moves their digits down by one place and takes the first. A
conversation of more than ``BLOCK`` rows is decided in blocks, from the last to the first, so that the
numbers stay short: a block begins with the costs of what follows and zero digits. That changes
nothing, since no audit of a block is the beginning of another one, and the same audit leads to the same state. Two
inserts in a row are never cheapest: the pair can be left out, or the system turn that needs it deleted for 3.

Tasks read the rows of a conversation in order and hold 18 bytes a row until it ends (letters, faults and a
digest, no texts); texts are read in a second pass that follows the audits and holds one batch. One conversation is one
task's work, in a stream, since its audit is one value and its digest one hash over all its text.

Defined cases: null roles and texts count as one blank; a null turn comes first and has no part in the gaps; rows
of one turn come in the order of their role, then of the MD5 of their text; null ids are one conversation; repeated
rows are duplicates; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .exchange import stored

BLOCK = 256
#: Cost of each edit, and its letter's digit: D, I, K and R in ASCII order.
COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}
DIGITS = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTERS = {d: letter for letter, d in DIGITS.items()}
TRUNCATED_COST = 1
DIGIT_BITS = 3

#: States of the role automaton: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
ENDS = (START, ASSISTANT)
#: The state after a turn with this initial.
AFTER = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
ROLES = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = ("su", "ua", "au")

SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)

REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
REPAIRED = "conv_id long, place long, edit string, turn long, role string, text string"


def wanted(state: int) -> str:
    """The initial that a rerole or an insert gives in a state."""
    return "a" if state == USER else "u"


@lru_cache(maxsize=BLOCK + 1)
def _edges(rows: int) -> tuple[int, int, dict[tuple[str, int], list[list[tuple[int, int]]]], list[tuple[int, int]]]:
    """For blocks of ``rows``: bits of the low digits, the top digit's place, the edges (weight, next state) of a row by
    (initial, fault) and state, and the insert's edge by state."""
    low = DIGIT_BITS * (2 * rows + 1)
    top = low - DIGIT_BITS

    def weight(letter: str, more: int = 0) -> int:
        return (COSTS[letter] + more << low) + (DIGITS[letter] << top)

    table = {}
    for initial in "sua?":
        for fault in (SOUND, BLANK, DUPLICATE, TRUNCATED):
            more = TRUNCATED_COST if fault == TRUNCATED else 0
            out = []
            for state in STATES:
                edges = [(weight("D"), state)]
                if fault not in (BLANK, DUPLICATE):
                    edges.append((weight("R", more), AFTER[wanted(state), state]))
                    if (initial, state) in AFTER:
                        edges.append((weight("K", more), AFTER[initial, state]))
                out.append(edges)
            table[initial, fault] = out
    return low, top, table, [(weight("I"), AFTER[wanted(s), s]) for s in STATES]


def _block(initials: str, faults: bytes, ends: list[int]) -> list[int]:
    """The least weight from each state before the rows of a block, given the cost after it (-1: no way)."""
    low, _, table, inserts = _edges(len(initials))
    mask, never = (1 << low) - 1, 1 << (low + 64)

    def ahead(weight: int, rest: int) -> int:
        """The weight of an edit in front of others."""
        return weight + (rest & ~mask) + ((rest & mask) >> DIGIT_BITS)

    best = [never if cost < 0 else cost << low for cost in ends]
    for initial, fault in zip(reversed(initials), reversed(faults), strict=True):
        row = [min(ahead(w, best[to]) for w, to in edges) for edges in table[initial, fault]]
        best = [min(row[s], ahead(inserts[s][0], row[inserts[s][1]])) for s in STATES]
    return best


def _letters(weight: int, rows: int) -> str:
    low, top, _, _ = _edges(rows)
    out = []
    while digit := weight >> top & (1 << DIGIT_BITS) - 1:
        out.append(LETTERS[digit])
        weight = (weight & (1 << top) - 1) << DIGIT_BITS
    return "".join(out)


def follow(audit: str, initials: str, state: int = START) -> int:
    """The state after the edits of an audit."""
    row = 0
    for edit in audit:
        if edit == "K":
            state = AFTER[initials[row], state]
        elif edit in "RI":
            state = AFTER[wanted(state), state]
        row += edit != "I"
    return state


def cheapest(initials: str, faults: bytes, block: int = BLOCK) -> tuple[int, str]:
    """Cost and audit of a conversation from the rows' initials (other than s, u, a: ``?``) and faults."""
    # After the last row an insert may close a pair; that is decided like a block of its own.
    _, _, _, inserts = _edges(0)
    ends = [0 if s in ENDS else -1 for s in STATES]
    closing = [0 if s in ENDS else COSTS["I"] if inserts[s][1] in ENDS else -1 for s in STATES]
    cuts = [*range(0, len(initials), block), len(initials)]
    found: list[list[int]] = []
    after = closing
    for a, b in reversed(list(zip(cuts, cuts[1:], strict=False))):
        best = _block(initials[a:b], faults[a:b], after)
        low = _edges(b - a)[0]
        after = [w >> low if w < 1 << (low + 63) else -1 for w in best]
        found.append(best)
    state, audit = START, []
    for (a, b), best in zip(zip(cuts, cuts[1:], strict=False), reversed(found), strict=True):
        letters = _letters(best[state], b - a)
        state = follow(letters, initials[a:b], state)
        audit.append(letters)
    if ends[state] < 0:
        audit.append("I")
    return after[START], "".join(audit)


def prepared(rows: DataFrame) -> DataFrame:
    """Roles and texts without nulls, and the order of rows of one turn."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.md5(text).alias("tie"))


def _facts(rows: DataFrame) -> DataFrame:
    """What decides the edits, without the texts."""
    return prepared(rows).select(
        "conv_id", "turn", "role", "tie", F.unhex(F.md5(F.concat("role", F.lit(":"), "tie"))).alias("same"),
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), SOUND).otherwise(TRUNCATED).alias("fault"))


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.col("turn").asc_nulls_first(), "role", "tie")


class _Conversation:
    def __init__(self, conv: int | None) -> None:
        self.conv, self.initials, self.faults, self.same = conv, [], bytearray(), bytearray()
        self.low = self.high = self.turn = None
        self.turns = self.illegal = 0

    def add(self, turn: int | None, role: str, same: bytes, fault: int) -> None:
        initial = role[:1] if role[:1] in ("s", "u", "a") else "?"
        if self.initials and self.initials[-1] + initial not in LEGAL_PAIRS:
            self.illegal += 1
        self.initials.append(initial)
        self.faults.append(fault)
        self.same += same
        if turn is not None:
            self.turns += turn != self.turn
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn

    def report(self) -> tuple:
        same = np.frombuffer(self.same, "S16")
        first = np.zeros(len(same), bool)
        first[np.unique(same, return_index=True)[1]] = True
        faults = np.frombuffer(self.faults, np.uint8)
        faults = np.where((faults != BLANK) & ~first, DUPLICATE, faults).astype(np.uint8)
        cost, audit = cheapest("".join(self.initials), faults.tobytes())
        count = np.bincount(faults, minlength=4).tolist()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, count[BLANK], count[DUPLICATE], count[TRUNCATED], self.illegal, cost, audit


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], most: int = 4096, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded count and text."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= most or chars >= size:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, chars = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def _types(schema: str) -> tuple[list[str], list[pa.DataType]]:
    columns = [c.split() for c in schema.split(", ")]
    return [c[0] for c in columns], [pa.int64() if c[1] == "long" else pa.string() for c in columns]


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def run() -> Iterator[tuple]:
        at = None
        for conv, turn, role, same, fault in _rows(batches):
            if at is None or conv != at.conv:
                if at is not None:
                    yield at.report()
                at = _Conversation(conv)
            at.add(turn, role, same, fault)
        if at is not None:
            yield at.report()

    yield from _batches(run(), *_types(REPORT))


def judge(rows: DataFrame) -> DataFrame:
    """One row for each conversation: gaps in its turns, faults, illegal pairs, cost and audit of the repair."""
    ordered = _in_order(_facts(rows)).select("conv_id", "turn", "role", "same", "fault")
    return ordered.mapInArrow(_reports, REPORT)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follows each conversation's audit, which comes before its rows."""

    def run() -> Iterator[tuple]:
        for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
            audit, state, place = next(rows)[4], START, 0
            for edit in audit:
                _, turn, role, text, _ = (conv, None, "", "", None) if edit == "I" else next(rows)
                if edit == "D":
                    continue
                initial = role[:1] if edit == "K" else wanted(state)
                yield conv, place, edit, turn, role if edit == "K" else ROLES[initial], text
                state, place = AFTER[initial, state], place + 1

    yield from _batches(run(), *_types(REPAIRED))


def repair(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """The repaired rows in order, with the edit that made each; ``judged`` is that of the same rows.

    A partition holds whole conversations, their rows in order.
    """
    texts = prepared(rows).select("conv_id", F.lit(1).alias("after"), "turn", "role", "text", "tie", F.lit(None).cast("string").alias("audit"))
    none = F.lit(None).cast("string")
    audits = judged.select("conv_id", F.lit(0).alias("after"), F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("text"), none.alias("tie"), "audit")
    return _in_order(audits.unionAll(texts), "after").select("conv_id", "turn", "role", "text", "audit").mapInArrow(_edited, REPAIRED)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def run() -> Iterator[tuple]:
        for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
            digest = hashlib.sha256()
            for _, place, _, _, role, text in rows:
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            yield conv, digest.hexdigest()

    yield from _batches(run(), *_types("conv_id long, repaired_sha256 string"))


def digests(repaired: DataFrame) -> DataFrame:
    """SHA-256 of the ``role:text`` lines of each repaired conversation that has any; ``repaired`` as ``repair`` gives it."""
    return repaired.mapInArrow(_digests, "conv_id long, repaired_sha256 string")


def summary(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """For each id in ``conversations`` the judgement of its ``rows`` and the digest of their repair; zeros where it has none."""
    judged = stored(judge(rows), "judged")
    hashed = digests(repair(rows, judged))
    ids = conversations.select("conv_id").distinct()
    counts = [c.split()[0] for c in REPORT.split(", ")][1:-1]
    both = ids.join(judged.withColumnRenamed("conv_id", "_a"), F.col("conv_id").eqNullSafe(F.col("_a")) & F.col("audit").isNotNull(), "left")
    both = both.join(hashed.withColumnRenamed("conv_id", "_b"), F.col("conv_id").eqNullSafe(F.col("_b")) & F.col("repaired_sha256").isNotNull(), "left")
    return both.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damage(rows: DataFrame) -> DataFrame:
    """Faults for a test of the repair, drawn from the CRC-32 of ``conv_id:turn``: of 20 remainders 0 drops the row, 1 empties
    its text, 2 takes its sentence ends, 3 repeats it, 4 makes it a user turn. Nulls count as one blank."""
    blank = F.lit(" ")
    draw = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    drawn = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), draw.alias("draw")).where("draw <> 0")
    return drawn.select(
        "conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
