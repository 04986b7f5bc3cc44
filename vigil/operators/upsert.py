"""Merging batches into stored tables, expressed as plain joins and unions.

Parquet has no MERGE: every function returns the new content of a table (or of
the partitions it touches) for a dynamic partition overwrite.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .segmented import join_on_keys


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    return _extreme(df, keys, order, F.min)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key."""
    return _extreme(df, keys, order, F.max)


def _extreme(df: DataFrame, keys: Sequence[str], order: Sequence[str], which) -> DataFrame:
    """The row of each key with the least or greatest order columns.

    Only key and first order column are aggregated, by hash and map-side; no row is sorted for
    that. The rows that have the extreme are joined back, and the few that tie are settled by
    the other order columns.
    """
    best = df.groupBy(*keys).agg(which(order[0]).alias("_best"))
    tied = join_on_keys(df, best, keys).where(F.col(order[0]).eqNullSafe(F.col("_best"))).drop("_best")
    last = [F.col(c).desc() if which is F.max else F.col(c).asc() for c in order[1:] or order]
    return tied.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*last))).where("_nth = 1").select(*df.columns)


def new_rows(stored: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of a batch that a conflict-tolerant insert would add: first per key, unknown keys only."""
    return join_on_keys(first_per_key(batch, keys, order), stored.select(*keys), keys, "left_anti")


def insert_if_absent(stored: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return stored.unionByName(new_rows(stored, batch, keys, order))


def add_counts(stored: DataFrame, batch: DataFrame, keys: Sequence[str], *counts: str) -> DataFrame:
    """Additive upsert: old plus new per key."""
    counts = counts or ("count",)
    both = stored.select(*keys, *counts).unionByName(batch.select(*keys, *counts))
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])


def without(rows: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``gone``."""
    return join_on_keys(rows, gone.select(*keys), keys, "left_anti")


def update_matching(rows: DataFrame, matches: DataFrame, keys: Sequence[str], **values: Column) -> DataFrame:
    """Set columns on the rows whose key occurs in ``matches``."""
    flagged = join_on_keys(rows, matches.select(*keys).distinct().withColumn("_hit", F.lit(True)), keys, "left")
    for name, value in values.items():
        flagged = flagged.withColumn(name, F.when(F.col("_hit"), value).otherwise(F.col(name)))
    return flagged.drop("_hit")
