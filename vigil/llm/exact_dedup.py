"""Exact duplicates through an extendible-hash index on shared files.

Method: texts are normalised (runs of blanks become one space) and hashed to 64 bits. A task first
puts equal texts of the same stretch of rows together (by their bytes), so that a text that a third
of all rows have gives one entry a stretch. The entries, without texts, fill the buckets of an
index by the leading bits of their hash. The index is written to the shared folder, a folder for
each depth. A bucket with more than ``capacity`` entries is overfull: the directory doubles, one
more bit tells its entries apart, and only those are written again, into the two halves; a bucket
in which all hashes are equal is not split but chained. The tasks that own a range of hashes then
read their buckets in order; entries with the same hash form a chain, and only for chains are
texts fetched and their bytes compared, so that a collision of hashes joins nothing.

Memory: a stretch holds at most 32 MB of texts (one longer text is a stretch of its own) or 65536 rows; an owner streams
through its range and holds the distinct texts of one chain and the ids of its entries. The index holds no
texts; one text of each entry is shuffled once, to meet the list of chained entries. Steps are shuffles and
tables in the shared folder.

Defined cases: a null text counts as empty, and empty texts equal each other; the row with the smallest
id stays, a null id after all others; of rows that repeat the id the first as read stays; an empty table gives an
empty result; further columns are carried along, those named like an added one are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import scratch_path
from . import kit
from .columns import carried, restored
from .exchange import partitions, stored

CAPACITY = 4096
STRETCH_BYTES = 32 << 20
STRETCH_ROWS = 1 << 16
BITS = 64
BLANKS = r"[\x20\x09-\x0D]+"
CORE = ("doc_id", "text")
ADDED = ("keep_id", "group_size", "kept", "text_sha256")

_ADDRESSED = "_row long, _entry long, _least long, _least_row long, _n long"
_CHAINED = "entry long, key long, least long, least_row long, n long"
_RESULT = "entry long, keep_id long, keep_row long, group_size long"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def _stretches(batches: Iterator[pa.RecordBatch], n_bytes: int, n_rows: int) -> Iterator[pa.Table]:
    """Consecutive rows of about that size."""
    held, size, rows = [], 0, 0
    for batch in batches:
        data, offsets = kit.texts(batch.column(batch.schema.names.index("_norm")))
        for begin, end in kit.slices(offsets, n_bytes):
            for at in range(begin, end, n_rows):
                part = batch.slice(at, min(at + n_rows, end) - at)
                weight = int(offsets[at + part.num_rows] - offsets[at])
                if held and (size + weight > n_bytes or rows + part.num_rows > n_rows):
                    yield pa.Table.from_batches(held)
                    held, size, rows = [], 0, 0
                held.append(part)
                size, rows = size + weight, rows + part.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _with_entries(n_bytes: int, n_rows: int):
    """Numbers the rows and points each to the first row of its stretch that has the same text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for table in _stretches(batches, n_bytes, n_rows):
            first: dict[bytes, int] = {}
            texts = table["_norm"].cast(pa.large_binary()).to_pylist()
            entry = [first.setdefault(t, i) for i, t in enumerate(texts)]
            least: dict[int, tuple[int, int]] = {}
            count = [0] * len(texts)
            for i, (e, doc) in enumerate(zip(entry, kit.ids(table["doc_id"]).tolist(), strict=True)):
                count[e] += 1
                least[e] = min(least.get(e, (doc, i)), (doc, i))
            added = [
                [row + i for i in range(len(texts))], [row + e for e in entry], [least[e][0] for e in entry],
                [row + least[e][1] for e in entry], [count[e] for e in entry],
            ]
            row += len(texts)
            table = table.drop_columns(["_norm"])
            for name, values in zip(_ADDRESSED.replace(" long", "").split(", "), added, strict=True):
                table = table.append_column(name, pa.array(values, pa.int64()))
            yield from table.to_batches()

    return run


def addressed(docs: DataFrame, key: Callable[[Column], Column] = F.xxhash64, stretch_bytes: int = STRETCH_BYTES, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """The documents with hash and digest of the normalised text, and the entry they belong to, written once."""
    norm = carried(docs, CORE, ADDED).withColumn("_norm", normalised(F.col("text")))
    hashed = norm.withColumns({"_key": key(F.col("_norm")).cast("long"), "_sha256": F.sha2("_norm", 256)})
    schema = hashed.drop("_norm").withColumns({c.split()[0]: F.lit(0).cast("long") for c in _ADDRESSED.split(", ")}).schema
    return stored(hashed.mapInArrow(_with_entries(stretch_bytes, stretch_rows), schema), "texts")


def bucket_of(key: str, depth: int) -> Column:
    """The leading bits of a hash."""
    return F.shiftrightunsigned(key, BITS - depth) if depth else F.lit(0).cast("long")


def owner_of(bucket: str, depth: int, owners: int) -> Column:
    """The task that owns a bucket: owners hold consecutive ranges of hashes."""
    lead = F.shiftright(bucket, depth - 31) if depth > 31 else F.shiftleft(bucket, 31 - depth)
    return F.shiftright(lead * owners, 31).cast("int")


class Index:
    """Buckets on shared files: ``entries`` (a folder for each depth) and ``directory`` (a row for each bucket)."""

    def __init__(self, entries: DataFrame, directory: DataFrame, depth: int) -> None:
        self.entries, self.directory, self.depth = entries, directory, depth


def build_index(entries: DataFrame, capacity: int = CAPACITY) -> Index:
    """Fill the buckets, doubling the directory while one is overfull. ``entries`` has a long ``key``."""
    spark = entries.sparkSession
    owners, path = partitions(spark), scratch_path(spark, "llm-index")
    depth = max(0, math.ceil(math.log2(max(entries.count(), 1) / capacity)))
    pending, columns = entries, entries.columns
    while True:
        pending = pending.select(*columns, bucket_of("key", depth).alias("bucket"))
        dealt = pending.withColumn("owner", owner_of("bucket", depth, owners))
        dealt.repartitionById(owners, "owner").sortWithinPartitions("key").write.parquet(f"{path}/entries/depth={depth}")
        placed = spark.read.schema(dealt.schema).parquet(f"{path}/entries/depth={depth}")
        fill = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        over = (F.col("n") > capacity) & (F.col("low") != F.col("high"))
        fill.select("bucket", "n", over.alias("split")).write.parquet(f"{path}/directory/depth={depth}")
        split = spark.read.parquet(f"{path}/directory/depth={depth}").where("split").select("bucket")
        if split.isEmpty():
            break
        pending = placed.join(split, "bucket", "left_semi")
        depth += 1
    directory = spark.read.parquet(f"{path}/directory").where("NOT split").select("bucket", F.col("depth").cast("int"), "n")
    found = spark.read.schema(dealt.withColumn("depth", F.lit(0)).schema).parquet(f"{path}/entries")
    return Index(found.join(directory.select("bucket", "depth"), ["bucket", "depth"], "left_semi"), directory, depth)


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of rows sorted by ``key``, cut only between different keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.names.index(key)).to_numpy()
        last = int((keys != keys[-1]).nonzero()[0][-1]) + 1 if keys[0] != keys[-1] else 0
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        elif held and held[-1].column(held[-1].schema.names.index(key))[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries that share their hash with another."""
    for table in _runs(batches, "key"):
        keys = table["key"].to_numpy()
        sizes = np.diff([*kit.runs(keys), len(keys)])
        yield from table.filter(pa.array(np.repeat(sizes > 1, sizes))).to_batches()


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of entries with equal bytes, chain by chain; rows come sorted by hash."""

    def groups(chain: list[list]) -> Iterator[tuple[int, int, int, int]]:
        for _, entries, keep, size in chain:
            for entry in entries:
                yield entry, *keep, size

    def out(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], _RESULT.replace(" long", "").split(", "))

    done: list[tuple[int, int, int, int]] = []
    chain: list[list] = []
    at = None
    for batch in batches:
        names = batch.schema.names
        texts = batch.column(names.index("norm"))
        rows = zip(*(batch.column(names.index(c.split()[0])).to_pylist() for c in _CHAINED.split(", ")), strict=True)
        for i, (entry, key, least, least_row, n) in enumerate(rows):
            if key != at:
                done += groups(chain)
                chain, at = [], key
            text = texts[i].as_buffer()
            for group in chain:
                if group[0].equals(text):
                    group[1].append(entry)
                    group[2], group[3] = min(group[2], (least, least_row)), group[3] + n
                    break
            else:
                # A copy of its own, so that the batch it came in can be let go.
                chain.append([pa.py_buffer(text.to_pybytes()), [entry], (least, least_row), n])
        if len(done) >= 1 << 14:
            yield out(done)
            done = []
    done += groups(chain)
    yield out(done)


def equal_texts(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """For each entry of ``addressed`` rows that has equals in other stretches: who stays, and the size of the group."""
    owners = partitions(rows.sparkSession)
    heads = rows.where("_row = _entry")
    entries = heads.select(F.col("_entry").alias("entry"), F.col("_key").alias("key"), F.col("_least").alias("least"), F.col("_least_row").alias("least_row"), F.col("_n").alias("n"))
    index = build_index(entries, capacity)
    in_order = index.entries.select("entry", "key", "least", "least_row", "n", "owner").repartitionById(owners, "owner").sortWithinPartitions("key", "entry")
    chained = stored(in_order.mapInArrow(_chained, f"{_CHAINED}, owner int"), "chained")
    texts = heads.select(F.col("_entry").alias("entry"), normalised(F.col("text")).alias("norm"))
    # A plan of one kind at every size: a broadcast of the chained entries would end where they outgrow it.
    fetched = chained.join(texts.hint("merge"), "entry").repartitionById(owners, "owner").sortWithinPartitions("key", "entry")
    return stored(fetched.mapInArrow(_compared, _RESULT), "equal")


def group_equal(docs: DataFrame, key: Callable[[Column], Column] = F.xxhash64, capacity: int = CAPACITY, stretch_bytes: int = STRETCH_BYTES,
                stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """The documents with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of the normalised text.

    ``key`` gives the 64-bit hash; any function of the text will do, a poor one costs comparisons only.
    """
    rows = addressed(docs, key, stretch_bytes, stretch_rows)
    found = equal_texts(rows, capacity)
    joined = rows.join(found, rows["_entry"] == found["entry"], "left")
    keep = F.coalesce("keep_id", "_least")
    return joined.select(
        *restored(docs, CORE, ADDED), F.when(keep != kit.NO_ID, keep).alias("keep_id"), F.coalesce("group_size", "_n").alias("group_size"),
        (F.coalesce("keep_row", "_least_row") == F.col("_row")).alias("kept"), F.col("_sha256").alias("text_sha256"))


def dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows that stay, with their columns as they were."""
    return group_equal(docs, **options).where("kept").select(*[F.col(f"`{c}`") for c in docs.columns if c not in ADDED])
