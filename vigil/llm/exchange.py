"""Questions that groups of documents put to the whole corpus, and their answers.

Documents are dealt out by a hash of their id, one or a few buckets a shuffle partition. A bucket reduces
what it asks to distinct sorted keys before anything is shuffled, so a key that a third of
all documents share costs one entry a bucket, never one a document. Keys are dealt out by
value; the task that holds a key sees one entry a bucket and answers each bucket in the
order in which it asked. The bucket computes the same keys again and reads the answers.

The texts are shuffled once: each step reads the same exchange, which Spark reuses within
one plan. All steps are plain shuffles, so a lost executor is recomputed from its inputs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from . import kit

PACKED = "bucket int, part int, blob binary"
_PACKED = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("blob", pa.binary())])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, f"llm-{label}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(docs: DataFrame, *columns: str, per_part: int = 1) -> DataFrame:
    """The columns of ``docs`` and a bucket, ``per_part`` buckets a partition. The first column is the id.

    More buckets take less memory each; there is an answer for each bucket and partition.
    """
    parts = partitions(docs.sparkSession)
    bucket = F.pmod(F.xxhash64(columns[0]), F.lit(parts * per_part)).cast("int")
    rows = docs.select(bucket.alias("bucket"), *columns)
    return rows.repartitionById(parts, "bucket") if per_part == 1 else rows.repartition(parts, "bucket")


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The partition of each 64-bit key; it grows with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def kept_bits(parts: int) -> np.uint64:
    """How far to shift a key that only pre-selects: 40 bits stay beside the partition's."""
    return np.uint64(max(0, 64 - 40 - int(parts).bit_length()))


def by_part(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """Slices of sorted keys, one for each partition that has any."""
    if len(keys):
        part = part_of(keys, parts)
        at = [*kit.runs(part), len(keys)]
        for a, b in zip(at, at[1:], strict=False):
            yield int(part[a]), slice(a, b)


def packed(bucket: int, rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table([pa.array([bucket] * len(rows), pa.int32()), pa.array([p for p, _ in rows], pa.int32()),
                     pa.array([b for _, b in rows], pa.binary())], schema=_PACKED)


def ask(buckets: DataFrame, question: Callable[[pa.Table], list[tuple[int, bytes]]]) -> DataFrame:
    """For each bucket the packed keys for each partition."""

    def run(table: pa.Table) -> pa.Table:
        return packed(table["bucket"][0].as_py(), question(table))

    return buckets.groupBy("bucket").applyInArrow(run, PACKED)


def answer(asked: DataFrame, combine: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """``combine`` gets all that was asked of a partition and gives an answer to each, in that order."""
    parts = partitions(asked.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            table = pa.Table.from_batches(got)
            replies = combine(table["blob"].to_pylist())
            for at in range(0, table.num_rows, 512):
                rows = table.slice(at, 512)
                yield from pa.table([rows["bucket"], rows["part"], pa.chunked_array([pa.array(replies[at: at + 512], pa.binary())])],
                                    schema=_PACKED).to_batches()

    return asked.repartitionById(parts, "part").mapInArrow(run, PACKED)


def with_answers(buckets: DataFrame, answers: DataFrame, use: Callable[[pa.Table, dict[int, bytes]], pa.Table], schema: str, per_part: int = 1) -> DataFrame:
    """``use`` gets a bucket's documents and the answers by partition; ``per_part`` is that of ``buckets``."""

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            raise ValueError("an answer for a bucket without documents")
        return use(table, dict(zip(replies["part"].to_pylist(), replies["blob"].to_pylist(), strict=True)))

    parts = partitions(buckets.sparkSession)
    answers = answers.repartitionById(parts, "bucket") if per_part == 1 else answers.repartition(parts, "bucket")
    return buckets.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(run, schema)


def joined(blobs: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """All packed arrays, column by column, and where each blob's rows begin (one more at the end)."""
    each = [kit.unpack(b) for b in blobs]
    each = [[kit.ungaps(e[0]), *e[1:]] for e in each]
    first = np.concatenate([[0], np.cumsum([len(e[0]) for e in each])])
    return [np.concatenate(c) for c in zip(*each, strict=True)], first


def bits(flags: np.ndarray, first: np.ndarray) -> list[bytes]:
    """One bit for each key, for each blob."""
    return [np.packbits(flags[a:b]).tobytes() for a, b in zip(first, first[1:], strict=False)]


def read_bits(replies: dict[int, bytes], keys: np.ndarray, parts: int) -> np.ndarray:
    out = np.zeros(len(keys), bool)
    for part, at in by_part(keys, parts):
        out[at] = np.unpackbits(np.frombuffer(replies[part], np.uint8), count=at.stop - at.start)
    return out
