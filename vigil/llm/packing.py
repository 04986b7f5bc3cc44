"""Packing of documents into training sequences along a space-filling curve.

Method: a document's subword ids are hashed into ``HASHED`` counters, and a fixed random
projection takes the vector of their shares to ``DIMS`` coordinates. Scaled by the corpus-wide
mean and spread of each coordinate, they give a Hilbert key. Documents are range-sorted by
that key and form one stream of ids along the curve, cut every ``length`` ids: neighbours on
the curve, documents of like content, share sequences, and only the last sequence is padded.

With ``scheduled`` the stream follows the source schedule of ``mixing.py``: the documents of
``TURN_SLOTS`` consecutive slots form a turn, turns come in order, and the curve orders the
documents of a turn. So up to the end of any turn each source has had its weight's share to
within less than a block of documents, until a source runs out. The schedule follows from ids
and sources, so it is worked out from those and does not depend on how files are read.

The ids are written once. The order is worked out on (turn, key, row, number of ids) alone: a range
shuffle, running sums inside its partitions, and the sum of the partitions before. Documents
with equal keys, such as copies, are spread by row, so no partition has to hold them all.

Defined cases: a null or empty text is its end id alone; a null id is carried along; repeated
rows are packed each; a text longer than a sequence is cut; an empty table gives an empty
result; other columns are ignored. Texts are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import exchange as X, kit, mixing
from .subwords import encoder

HASHED = 512
DIMS = 4
BITS = 12
END = 2
#: Slots of the source schedule whose documents the curve orders among themselves.
TURN_SLOTS = 16


def projection(vocabulary: int) -> np.ndarray:
    """The coordinates that one occurrence of each id adds: its counter's row of a random matrix of signs."""
    counter = (kit.mix(np.arange(vocabulary, dtype=np.uint64) + np.uint64(17)) % np.uint64(HASHED)).astype(np.int64)
    return np.random.default_rng(5).choice([-1.0, 1.0], (HASHED, DIMS))[counter]


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell coordinates, below ``2 ** bits`` each."""
    x = [cells[:, d].astype(np.int64) for d in range(cells.shape[1])]
    n = len(x)
    # Undo the curve's turns from the top bit down (Skilling, 2004).
    bit = 1 << (bits - 1)
    while bit > 1:
        for d in range(n):
            turned = (x[d] & bit) > 0
            swap = np.where(turned, 0, (x[0] ^ x[d]) & (bit - 1))
            x[0] ^= np.where(turned, bit - 1, swap)
            x[d] ^= swap
        bit >>= 1
    for d in range(1, n):
        x[d] ^= x[d - 1]
    flip, bit = np.zeros_like(x[0]), 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where((x[-1] & bit) > 0, bit - 1, 0)
        bit >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(n):
            key = key << 1 | ((x[d] ^ flip) >> b & 1)
    return key


_IDS = "doc_id long, source string, ids binary, n long, " + ", ".join(f"c{d} double" for d in range(DIMS))


def narrow(tokenizer: str, end: int) -> str:
    """The type in which ids are written and shuffled: two bytes if the vocabulary allows."""
    return "<u2" if max(encoder(tokenizer).size, end + 1) <= 1 << 16 else "<u4"


def tokenized(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """``doc_id``, ``source`` (null without such a column), all ids with ``end`` behind them as little-endian bytes (of type ``narrow``), their number, and the coordinates."""
    kind = np.dtype(narrow(tokenizer, end))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        table = projection(max(words.size, end + 1))
        for batch in batches:
            data, offsets = kit.texts(batch["text"])
            for a, b in kit.slices(offsets, 2 << 20):
                ids, at = words.encode(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
                docs_here = b - a
                ids = np.insert(ids, at[1:], np.uint32(end))
                at = at + np.arange(docs_here + 1)
                n = np.diff(at)
                # Every document has its end id, so no run is empty.
                coordinates = [np.add.reduceat(table[ids, d], at[:-1]) / n for d in range(DIMS)]
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), docs_here, [None, pa.py_buffer(kind.itemsize * at), pa.py_buffer(ids.astype(kind))])
                yield pa.record_batch([batch["doc_id"].slice(a, docs_here), batch["source"].slice(a, docs_here), raw.cast(pa.binary()), pa.array(n), *map(pa.array, coordinates)],
                                      ["doc_id", "source", "ids", "n", *(f"c{d}" for d in range(DIMS))])

    source = F.col("source") if "source" in docs.columns else F.lit(None)
    return docs.select("doc_id", source.cast("string").alias("source"), "text").mapInArrow(run, _IDS)


def _keys(mean: list[float], spread: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = 1 << BITS
            cells = np.stack([np.clip(((batch[f"c{d}"].to_numpy() - mean[d]) / spread[d] + 4) / 8 * side, 0, side - 1) for d in range(DIMS)], 1)
            yield pa.record_batch([batch["row"], batch["n"], batch["turn"], pa.array(hilbert_keys(cells.astype(np.int64), BITS))], ["row", "n", "turn", "key"])

    return run


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch["n"].to_numpy()
        ends = total + np.cumsum(n)
        yield pa.record_batch([batch["row"], batch["key"], batch["n"], pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n)], ["row", "key", "n", "part", "before"])
        total = int(ends[-1]) if len(n) else total


def _cut(length: int, kind: str):
    wide = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = batch["at"].to_numpy(), batch["n"].to_numpy()
            pieces = np.where(n > 0, (at + n - 1) // length - at // length + 1, 0)
            row = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = at[row] // length + nth
            start = np.maximum(sequence * length, at[row]) - at[row]
            size = np.minimum((sequence + 1) * length, at[row] + n[row]) - at[row] - start
            ids = batch["ids"]
            cut = [np.frombuffer(ids[int(r)].as_buffer(), kind, int(m), wide * int(s)).astype("<u4").tobytes() for r, s, m in zip(row, start, size, strict=True)]
            yield pa.record_batch([batch["doc_id"].take(pa.array(row)), pa.array(start), pa.array(size), pa.array(cut, pa.binary()),
                                   pa.array(n[row]), pa.array(sequence), pa.array((at[row] + start) % length), batch["key"].take(pa.array(row))],
                                  ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "key"])

    return run


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, key long"


def pack(docs: DataFrame, tokenizer: str, length: int = 4096, end: int = END, scheduled: bool = False) -> DataFrame:
    """One row for each piece of a document in a sequence, with its ids as 32-bit little-endian bytes.

    ``scheduled`` has the sequences follow the source schedule.
    """
    parts = X.partitions(docs.sparkSession)
    tokens = X.stored(tokenized(docs, tokenizer, end).withColumn("row", F.monotonically_increasing_id()), "tokens")
    moments = tokens.agg(*[f(f"c{d}") for d in range(DIMS) for f in (F.avg, F.stddev_pop)]).first()
    mean, spread = [moments[2 * d] or 0.0 for d in range(DIMS)], [moments[2 * d + 1] or 1.0 for d in range(DIMS)]
    placed, turn = tokens.drop("ids"), F.lit(0)
    if scheduled:
        placed, turn = mixing.mix_sources(placed), F.expr(f"mix_slot div {TURN_SLOTS}")
    placed = placed.select("row", "n", turn.cast("long").alias("turn"), *[f"c{d}" for d in range(DIMS)])
    keyed = placed.mapInArrow(_keys(mean, spread), "row long, n long, turn long, key long")
    ordered = keyed.repartitionByRange(parts, "turn", "key", "row").sortWithinPartitions("turn", "key", "row")
    ordered = X.stored(ordered.mapInArrow(_running, "row long, key long, n long, part int, before long"), "order")
    # One row for each partition of the order.
    sums = ordered.groupBy("part").agg(F.sum("n").alias("m"))
    base = sums.select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("base"))
    places = ordered.join(base, "part").select("row", "key", (F.col("base") + F.col("before")).alias("at"))
    return tokens.select("row", "doc_id", "ids", "n").join(places, "row").select("doc_id", "ids", "n", "at", "key").mapInArrow(_cut(length, narrow(tokenizer, end)), PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed ids of each sequence in order; a sequence holds a bounded number of ids."""
    joined = F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    return pieces.groupBy("sequence_id").agg(F.aggregate(joined, F.lit(bytearray()), lambda whole, part: F.concat(whole, part)).alias("ids"), F.sum("length").alias("length"))
