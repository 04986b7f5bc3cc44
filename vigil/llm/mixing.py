"""Interleaving of sources to target weights by proportionate-fair (Pfair) scheduling.

Method: each source's documents, in an order drawn from a hash of the id, form blocks of
``block_docs`` documents. With weight w (the weights of all sources adding up to 1), block k of
a source is released at floor(k / w) and due by ceil((k + 1) / w); in each slot the released
block with the earliest deadline runs. No deadline is missed, so up to any slot a source has
had its weight's share to within less than one block, until it runs out.

Weights are whole parts of a total, as wide as Python's integers in the schedule: given weights
are exact if ``slots`` parts or fewer have them, else rounded to ``slots`` parts (2 to the 40th:
the error stays under a block for that many slots). The schedule holds a row for each block and
is joined with the documents by source and block. Numbering a source's documents takes one
range shuffle; a source that holds a third of all documents spans many of its partitions.

All documents get a slot. Once a source has run out its slots stay empty and the others go on
at their pace. Weights are given or, if None, follow the square root of the sources' sizes.

Defined cases: a null source is a source of its own; sources without a weight come, at equal
weights, behind all that have one; a null id or text is carried along; repeated rows each get a
place; an empty table gives an empty result; further columns are carried along, those named like
an added one are replaced.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from fractions import Fraction
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .columns import carried, restored
from .exchange import partitions, stored

BLOCK_DOCS = 64
SLOTS = 1 << 40
ADDED = ("mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_place")


def _exact(weight: float) -> Fraction:
    """The short fraction that a float stands for (0.3, 1 / 3), or else its own value."""
    whole = Fraction(max(weight, 0))
    short = whole.limit_denominator(10**9)
    return short if abs(short - whole) * 10**15 <= whole else whole


def shares(weights: dict[str, float], slots: int) -> dict[str, int]:
    """Each source's weight in whole parts: exact if at most ``slots`` parts have them, else ``slots`` parts by largest remainders."""
    exact = {s: _exact(w) for s, w in weights.items()}
    total = sum(exact.values())
    if not total:
        return dict.fromkeys(weights, 0)
    parts = 1
    for w in exact.values():
        parts = math.lcm(parts, (w / total).denominator)
        if parts > slots:
            break
    else:
        return {s: int(w / total * parts) for s, w in exact.items()}
    exact = {s: w / total * slots for s, w in exact.items()}
    out = {s: math.floor(x) for s, x in exact.items()}
    order = sorted(weights, key=lambda s: (out[s] - exact[s], s))
    for s in order[: slots - sum(out.values())]:
        out[s] += 1
    return out


def _earliest(sources: Iterator[tuple[str, int, int]], total: int, base: int) -> Iterator[tuple[str, int, int, int, int]]:
    """As ``schedule``, for sources that all have parts, from slot ``base`` on."""
    head = next(sources, None)
    waiting: list[tuple[int, str, int, int, int]] = []
    ready: list[tuple[int, str, int, int, int, int]] = []
    slot = base
    while head or ready or waiting:
        if not head and not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, s, k, parts, blocks = heapq.heappop(waiting)
            heapq.heappush(ready, (base - (-(k + 1) * total // parts), s, k, parts, blocks, release))
        # First blocks are all released at the start; they stand in the order of their deadlines.
        if head and (not ready or base - (-total // head[1]) <= ready[0][0]):
            s, parts, blocks = head
            deadline, k, release, head = base - (-total // parts), 0, base, next(sources, None)
        else:
            deadline, s, k, parts, blocks, release = heapq.heappop(ready)
        yield s, k, slot, release, deadline
        if k + 1 < blocks:
            heapq.heappush(waiting, (base + (k + 1) * total // parts, s, k + 1, parts, blocks))
        slot += 1


def schedule(sources: Iterable[tuple[str, int, int]], total: int, idle: int) -> Iterator[tuple[str, int, int, int, int]]:
    """Source, block, slot, release and deadline of each block, earliest deadline first.

    ``sources`` are names, parts (of ``total``) and numbers of blocks, most parts first; the
    ``idle`` ones without parts come behind all others. Only sources that have begun and not
    ended are held.
    """
    base = 0
    for weighted, some in groupby(sources, lambda r: r[1] > 0):
        rows = some if weighted else ((s, 1, blocks) for s, _, blocks in some)
        for row in _earliest(rows, total if weighted else idle, base):
            yield row
        base = row[2] + 1


def cycle(share: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """One cycle: as many blocks of each source as it has parts."""
    return list(schedule(sorted(((s, n, n) for s, n in share.items() if n), key=lambda r: (-r[1], r[0])), sum(share.values()), 0))


SCHEDULE = "_source string, _block long, mix_slot long, mix_release long, mix_deadline long"
_SCHEDULE = [c.split()[0] for c in SCHEDULE.split(", ")]


def _scheduled(total: int, idle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = schedule((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), total, idle)
        while got := list(islice(rows, 1 << 14)):
            yield pa.record_batch([pa.array(c) for c in zip(*got, strict=True)], _SCHEDULE)

    return run


def source_key() -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, block_docs: int = BLOCK_DOCS, slots: int = SLOTS) -> DataFrame:
    """The documents with their block's number in its source, slot, release and deadline, and their place in the block."""
    spark = docs.sparkSession
    core, order = ("doc_id", "source"), ["_source", "_draw", "doc_id"]
    dealt = carried(docs, core, ADDED).select("*", source_key().alias("_source"), F.xxhash64("doc_id").alias("_draw"))
    dealt = dealt.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    dealt = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "dealt").withColumn("_part", F.shiftright("_at", 33))
    # A row for each source a partition holds: the partition's first place and the documents before it.
    held = dealt.groupBy("_part", "_source").agg(F.count("*").alias("n"), F.min("_at").alias("low"))
    held = stored(held.select("_part", "_source", "n", (F.sum("n").over(Window.partitionBy("_source").orderBy("_part")) - F.col("n") - F.col("low")).alias("shift")), "held")
    sizes = held.groupBy("_source").agg(F.sum("n").alias("n"))
    if weights is None:
        parts = F.floor(F.sqrt("n") * (1 << 20)).cast("long")
    else:
        named = {"null" if s is None else f"={s}": w for s, w in weights.items()}
        names = spark.createDataFrame([(s,) for s in named], "_source string")
        # At most the sources that the caller named.
        share = shares({r["_source"]: named[r["_source"]] for r in sizes.join(names, "_source").select("_source").collect()}, slots)
        given = spark.createDataFrame(list(share.items()), "_source string, given long")
        sizes, parts = sizes.join(given, "_source", "left"), F.coalesce("given", F.lit(0))
    sources = stored(sizes.select("_source", parts.alias("parts"), F.expr(f"(n + {block_docs - 1}) div {block_docs}").alias("blocks")), "sources")
    sums = sources.agg(F.sum(F.col("parts").cast("decimal(38,0)")), F.count_if(F.col("parts") == 0)).first()
    # One row for each source.
    ranked = sources.repartition(1).sortWithinPartitions(F.desc("parts"), "_source")
    table = stored(ranked.mapInArrow(_scheduled(int(sums[0] or 0), sums[1]), SCHEDULE), "schedule")
    placed = dealt.join(held.select("_part", "_source", "shift"), ["_part", "_source"]).withColumn("_rank", F.col("_at") + F.col("shift"))
    joined = placed.withColumn("_block", F.expr(f"_rank div {block_docs}")).join(table, ["_source", "_block"])
    return joined.select(*restored(docs, core, ADDED), F.col("_block").alias("mix_block"), "mix_slot", "mix_release", "mix_deadline",
                         F.expr(f"_rank % {block_docs}").alias("mix_place"))
