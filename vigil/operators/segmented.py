"""Ordered per-key computations that survive a key holding a third of all rows.

A plain ``Window.partitionBy(key)`` sends a whole key to one task.  Here the history of
a hot key is cut into segments (time slots), the window runs inside (key, segment), and
only one summary row per segment is windowed by key; its result is joined back.  Keys
of ordinary size stay in one segment, so for them the summary is a single row.
``slot`` must rise with the order columns, so (slot, order) is the order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ids import as_instant
from ..session import scratch_path


HOT_ROWS = 1_000_000
#: Hot keys that are sent to every task; a longer list is joined.
LISTED_KEYS = 10_000


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows; None if there are none.

    Counting reads the key columns only and combines map-side; at most
    ``rows / hot_rows`` keys come out of it.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    hot = sizes.where(F.col("_size") > hot_rows).select(*keys)
    listed = hot.limit(LISTED_KEYS + 1).collect()
    if not listed:
        return None
    return hot if len(listed) > LISTED_KEYS else F.broadcast(df.sparkSession.createDataFrame(listed, hot.schema))


def segmented(df: DataFrame, keys: Sequence[str], slot: Column, hot: DataFrame) -> DataFrame:
    """Add ``_seg``: the slot for hot keys, null for the others.

    The rows are written to the shared folder once, since what follows reads them twice: for
    the rows and for the edges of segments.
    """
    marked = join_on_keys(df, hot.withColumn("_hot", F.lit(True)), keys, "left").withColumn("_seg", F.when(F.col("_hot"), slot)).drop("_hot")
    return written_once(marked, "segments")


def written_once(df: DataFrame, label: str) -> DataFrame:
    """Rows that several branches of a plan read, through a table in the shared folder."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def time_slot(ts: Column, seconds: int = 3600) -> Column:
    """Segment of a timestamp: its slot number since the epoch."""
    return F.floor(F.unix_micros(as_instant(ts)) / F.lit(seconds * 1_000_000)).cast("bigint")


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equality on all keys in which two nulls are equal."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe equi join that keeps the left key columns."""
    renamed = right.select(*[right[c].alias(f"_r_{c}") if c in keys else right[c] for c in right.columns])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    joined = left.join(renamed, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


def with_neighbours(
    df: DataFrame, keys: Sequence[str], slot: Column, order: Sequence[str], column: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``prev_<column>`` and ``next_<column>`` in key order."""
    hot = hot_keys(df, keys, hot_rows)
    if hot is None:
        whole = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({f"prev_{column}": F.lag(column).over(whole), f"next_{column}": F.lead(column).over(whole)})
    df = segmented(df, keys, slot, hot)
    cells = F.struct(*[F.col(c) for c in order], F.col(column).alias("_value"))
    inner = Window.partitionBy(*keys, "_seg").orderBy(*order)
    rows = df.withColumn("_cell", cells).withColumn("_p", F.lag("_cell").over(inner)).withColumn("_n", F.lead("_cell").over(inner))
    outer = Window.partitionBy(*keys).orderBy("_seg")
    edges = (
        df.groupBy(*keys, "_seg").agg(F.min(cells).alias("_first"), F.max(cells).alias("_last"))
        .withColumn("_before", F.lag("_last").over(outer))
        .withColumn("_after", F.lead("_first").over(outer))
        .drop("_first", "_last")
    )
    return (
        join_on_keys(rows, edges, [*keys, "_seg"])
        .withColumn(f"prev_{column}", F.coalesce("_p", "_before")["_value"])
        .withColumn(f"next_{column}", F.coalesce("_n", "_after")["_value"])
        .drop("_seg", "_cell", "_p", "_n", "_before", "_after")
    )


def with_row_number(
    df: DataFrame, keys: Sequence[str], slot: Column, order: Sequence[str], name: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add the 1-based position inside the key."""
    hot = hot_keys(df, keys, hot_rows)
    if hot is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    df = segmented(df, keys, slot, hot)
    rows = df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_seg").orderBy(*order)).cast("bigint"))
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, "_seg").agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .drop("_size")
    )
    return (
        join_on_keys(rows, offsets, [*keys, "_seg"])
        .withColumn(name, F.col("_at") + F.col("_offset"))
        .drop("_seg", "_at", "_offset")
    )
