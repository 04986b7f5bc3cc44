"""Removal of lines that an earlier document already has, by alignment of document pairs.

Method: a document's lines become hashes. Two documents overlap if they share something rare,
which at most ``RARE`` documents have: a line, or a run of lines next to each other that holds ``min_chars``
characters and none too many (at either end, a line less holds too few). Each pair is aligned by patience diff:
lines that are unique in both are anchors, the longest run of anchors in the same order in both is kept, and blocks
grow from there by equal neighbours. The aligned common blocks of at least ``min_chars``
characters are deleted from the later document, the one with the larger id. Pairs are judged
on the input, not on what is left.

More frequent runs make no pairs: each is a common block by itself, and is deleted from all documents that have it
but the first. So nothing is lost that an alignment with any earlier document would delete: each line of an aligned
block lies in such a run inside the block, and the run is either rare, so the pair is aligned, or frequent.

Lines are the pieces between newlines, compared as they are; a line of white space is no
anchor and has no characters, but may lie inside a block. What is shuffled for the pairs are hashes of
lines and runs; texts are shuffled once, to meet their deletions.

Defined cases: a null or empty text has no lines and stays as it is; a null id orders last;
rows with one id are never compared with each other; repeated rows are treated alike and
repeat in the result; an empty table gives an empty result; further columns are carried along,
those named like an added column are replaced. Texts are used whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.text import let
from . import kit
from .columns import carried, restored
from .exchange import stored
from .kit import NO_ID

RARE = 8
MIN_CHARS = 40


def _ordered(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first number, that also rises in the second (patience sorting)."""
    tops: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for at, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        if pile == len(tops):
            tops.append(j)
            last.append(at)
        else:
            tops[pile], last[pile] = j, at
        back.append(last[pile - 1] if pile else -1)
    out, at = [], last[-1] if last else -1
    while at >= 0:
        out.append(pairs[at])
        at = back[at]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of equal places in ``a`` and ``b``, in order, by patience diff; None is never an anchor."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            found.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        here, there = Counter(a[i:i_end]), Counter(b[j:j_end])
        place = {b[y]: y for y in range(j, j_end)}
        unique = [(x, place[a[x]]) for x in range(i, i_end) if a[x] is not None and here[a[x]] == 1 and there.get(a[x]) == 1]
        anchors = _ordered(unique)
        if anchors:
            cuts = [(i - 1, j - 1), *anchors, (i_end, j_end)]
            found += anchors
            todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(cuts, cuts[1:], strict=False)]
    return sorted(found)


def common_lines(later: list, earlier: list, lengths: list[int], min_chars: int) -> list[int]:
    """Lines of ``later`` in aligned blocks that hold enough characters."""
    out: list[int] = []
    block: list[int] = []
    last = None
    for i, j in [*align(later, earlier), (-9, -9)]:
        if last != (i - 1, j - 1):
            if sum(lengths[x] for x in block) >= min_chars:
                out += block
            block = []
        block.append(i)
        last = (i, j)
    return out


def _align_batch(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [common_lines(x, y, n, min_chars) for x, y, n in zip(*(batch[c].to_pylist() for c in ("later", "earlier", "lengths")), strict=True)]
            yield pa.record_batch([batch["id"], batch["h"], pa.array(gone, pa.list_(pa.int32()))], ["id", "h", "gone"])

    return run


def _runs(min_chars: int):
    """What documents may share, by occurrence: short lines, and runs of ``min_chars`` characters that are minimal at one end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            seq, lengths = batch.column(names.index("seq")), batch.column(names.index("lengths"))
            offsets = np.asarray(seq.offsets) - seq.offsets[0].as_py()
            blank = np.asarray(seq.flatten().is_null())
            # Mixed values that are not 0: a 0 at the end of a run would not change its hash.
            line = kit.mix(np.asarray(seq.flatten().fill_null(0)).astype(np.int64).view(np.uint64)) | np.uint64(1)
            upto = np.concatenate([[0], np.cumsum(np.asarray(lengths.flatten()), dtype=np.int64)])
            doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            at, low, high = np.arange(len(line)), offsets[doc], offsets[doc + 1]
            ahead = np.searchsorted(upto, upto[:-1] + min_chars, "left")
            behind = np.searchsorted(upto, upto[1:] - min_chars, "right") - 1
            forth, back = ahead <= high, behind >= low
            short = ~blank & (upto[1:] - upto[:-1] < min_chars)
            # The same run from both ends once; a run of one line is that line.
            spans = np.unique(np.stack([np.concatenate([at[forth], behind[back], at[short]]), np.concatenate([ahead[forth], at[back] + 1, at[short] + 1])], 1), axis=0)
            start, end = spans[:, 0], spans[:, 1]
            key = kit.span(kit.prefix(line), start, end)
            chars = upto[end] - upto[start]
            owner = doc[start]
            order = np.lexsort((start, key, owner))
            first = np.zeros(len(order), bool)
            first[order[kit.runs(owner[order], key[order])]] = True
            yield pa.record_batch(
                [batch.column(names.index(c)).take(pa.array(owner)) for c in ("id", "h")]
                + [pa.array(key.view(np.int64)), pa.array((start - offsets[owner]).astype(np.int32)), pa.array((end - offsets[owner]).astype(np.int32)),
                   pa.array(chars >= min_chars), pa.array(first)], _RUNS)

    return run


_RUNS = ["id", "h", "key", "start", "end", "block", "first"]


def shared_runs(sequences: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Lines and runs that several rows have, with the number of those (``n``) and the first of them (``head``)."""
    held = sequences.select("id", "h", "seq", "lengths").mapInArrow(_runs(min_chars), "id long, h long, key long, start int, end int, block boolean, first boolean")
    counts = held.where("first").groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("id", "h")).alias("head")).where("n > 1")
    return stored(held.join(stored(counts, "shared-keys"), "key"), "shared-runs")


def overlapping(shared: DataFrame, rare: int = RARE) -> DataFrame:
    """Pairs of rows (``id, h`` the later, ``eid, eh`` the earlier) that share something rare."""
    few = shared.where(F.col("first") & (F.col("n") <= rare)).select("key", "id", "h")
    return few.join(few.selectExpr("key", "id AS eid", "h AS eh"), "key").where("id > eid").select("id", "h", "eid", "eh").distinct()


def frequent_blocks(shared: DataFrame, rare: int = RARE) -> DataFrame:
    """Lines (``gone``) of the frequent runs that an earlier row has."""
    return shared.where(F.col("block") & (F.col("n") > rare) & (F.col("id") > F.col("head.id"))).select("id", "h", F.sequence("start", F.col("end") - 1).alias("gone"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, rare: int = RARE) -> DataFrame:
    """The documents with ``text`` less its removed lines, and ``n_lines``, ``removed`` (line numbers from 0), ``n_removed``."""
    key = [F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")]
    pieces = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    sequences = stored(docs.select(
        *key, F.transform(pieces, lambda p: F.when(p.rlike("[^ \\t-\\r]"), F.xxhash64(p))).alias("seq"),
        F.transform(pieces, lambda p: F.when(p.rlike("[^ \\t-\\r]"), F.length(p)).otherwise(0)).alias("lengths")).where(F.col("id").isNotNull()), "lines").dropDuplicates(["id", "h"])
    shared = shared_runs(sequences, min_chars)
    pairs = overlapping(shared, rare)
    first = sequences.selectExpr("id AS eid", "h AS eh", "seq AS earlier")
    both = pairs.join(first, ["eid", "eh"]).join(sequences.withColumnRenamed("seq", "later"), ["id", "h"])
    found = both.select("id", "h", "later", "earlier", "lengths").mapInArrow(_align_batch(min_chars), "id long, h long, gone array<int>")
    found = found.unionAll(frequent_blocks(shared, rare))
    gone = found.select("id", "h", F.explode("gone").alias("line")).groupBy("id", "h").agg(F.sort_array(F.collect_set("line")).alias("removed"))
    core, added = ("doc_id", "text"), ("n_lines", "removed", "n_removed")
    kept = carried(docs, core, added).withColumns({"_id": key[0], "_h": key[1]})
    joined = kept.join(gone, (F.col("_id") == F.col("id")) & (F.col("_h") == F.col("h")), "left")
    left = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
    rest = let(F.split("text", "\n", -1), lambda lines: F.array_join(F.transform(left(lines), lambda i: F.get(lines, i)), "\n"))
    columns = restored(docs, core, added, text=F.when(F.col("removed").isNull(), F.col("text")).otherwise(rest))
    n_lines = F.when(F.length(F.coalesce("text", F.lit(""))) > 0, F.size(F.split("text", "\n", -1))).otherwise(0)
    return joined.select(*columns, n_lines.cast("long").alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
                         F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"))
