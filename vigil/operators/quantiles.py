"""Exact discrete percentiles per group without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .segmented import join_on_keys


#: A task ranks at most so many values of a cell.
MOST = 1_000_000
PARTS = 1 << 16
LEVELS = 1
TOTALS = ("timed", "rows", "total", "lowest", "highest")


def _cell(value: Column) -> Column:
    """Coarse cell of a value, rising with it: about 1 % wide on a log scale; infinite values have the outermost ones."""
    return (F.signum(value) * F.least(F.floor(F.log1p(F.abs(value)) * F.lit(128)), F.lit(100_000))).cast("int")


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value) -> n.  Map-side combined; a hot group spreads over its values."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")).withColumn("_cell", _cell(F.col(value)))


def group_heads(counts: DataFrame, keys: Sequence[str], value: str, percents: Mapping[str, int]) -> DataFrame:
    """One row per group and percentile, from ``value_counts`` output.

    Holds the group's totals (rows, timed rows, sum, min, max) and the cell in which
    the percentile falls.  A group has at most a few thousand cells, whatever its size.
    Ranks are whole numbers: the smallest value whose cumulative share reaches the
    percentile.
    """
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = counts.groupBy(*keys, "_cell").agg(
        F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_values"), F.sum(F.col(value) * F.col("n")).alias("_sum"), F.min(value).alias("_min"), F.max(value).alias("_max")
    ).withColumn("_in", F.when(F.col("_cell").isNotNull(), F.col("_n")).otherwise(F.lit(0)))
    cells = cells.select(
        *keys, "_cell", "_in", F.sum("_in").over(upto).alias("_upto"),
        F.sum("_in").over(whole).alias("timed"), F.sum("_n").over(whole).alias("rows"), F.sum("_sum").over(whole).alias("total"),
        F.min("_min").over(whole).alias("lowest"), F.max("_max").over(whole).alias("highest"), "_values", F.col("_min").alias("_low"), F.col("_max").alias("_high"),
    )
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(pct).alias("pct")) for name, pct in percents.items()])
    ranked = cells.withColumn("_want", F.explode(wanted)).withColumn("_rank", F.expr("greatest(1, (timed * _want.pct + 99) div 100)"))
    here = (F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_in") < F.col("_rank")) & F.col("_cell").isNotNull()
    # A group without any value keeps one row, on its null cell.
    return ranked.where(here | (F.col("timed") == 0)).select(
        *keys, "_cell", F.col("_want.name").alias("_name"), *TOTALS, "_values", "_low", "_high",
        F.when(F.col("timed") == 0, F.lit(1)).otherwise(F.col("_rank") - F.col("_upto") + F.col("_in")).alias("_local"),
    )


def refine_heads(counts: DataFrame, heads: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Heads with the part of their cell in which the percentile falls.

    A cell is cut between its least and greatest value into ``PARTS`` equal parts; what is ordered is one row for each part.
    """
    width = (F.col("_high") - F.col("_low")) / F.lit(PARTS)
    part = F.least(F.lit(PARTS - 1), F.floor(F.try_divide(F.col(value) - F.col("_low"), width))).cast("int")
    inside = in_heads(counts, heads, keys, value).withColumn("_part", part)
    made = {*keys, "_cell", "_name", "_values", "_low", "_high"}
    parts = inside.groupBy(*keys, "_cell", "_name", "_part").agg(
        F.sum("n").alias("_in"), F.count(F.lit(1)).alias("_values"), F.min(value).alias("_low"), F.max(value).alias("_high"),
        *[F.max(c).alias(c) for c in heads.columns if c not in made],
    )
    upto = Window.partitionBy(*keys, "_cell", "_name").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    found = parts.withColumn("_upto", F.sum("_in").over(upto)).where((F.col("_upto") >= F.col("_local")) & (F.col("_upto") - F.col("_in") < F.col("_local")))
    return found.withColumn("_local", F.col("_local") - F.col("_upto") + F.col("_in")).select(*heads.columns)


def in_heads(counts: DataFrame, heads: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Values that lie in the cell of a head and between its bounds."""
    rows = join_on_keys(counts, heads, [*keys, "_cell"])
    return rows.where(F.col("_low").isNull() | F.col(value).between(F.col("_low"), F.col("_high")))


def resolve_heads(counts: DataFrame, heads: DataFrame, keys: Sequence[str], value: str, most: int = MOST, levels: int = LEVELS) -> DataFrame:
    """Heads with the exact percentile in ``value``: only values of the wanted cells are ranked.

    A cell with more than ``most`` different values is cut again before, up to ``levels`` times. It begins 1 % wide and gets ``PARTS`` times
    narrower each time: one level leaves values that agree to seven digits, three a single double. Where no cell is that large,
    the levels have empty inputs, which adaptive execution takes out of the plan.
    """
    done, left = [], heads
    for _ in range(levels):
        done.append(left.where(F.coalesce("_values", F.lit(0)) <= most))
        left = refine_heads(counts, left.where(F.col("_values") > most), keys, value)
    heads = reduce(DataFrame.unionByName, [*done, left])
    inside = Window.partitionBy(*keys, "_cell", "_name").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        in_heads(counts, heads, keys, value)
        .withColumn("_seen", F.sum("n").over(inside))
        .where((F.col("_seen") >= F.col("_local")) & (F.col("_seen") - F.col("n") < F.col("_local")))
        .drop("_seen", "_local", "_cell", "n", "_values", "_low", "_high")
    )


def exact_percentiles(
    counts: DataFrame, keys: Sequence[str], value: str, percents: Mapping[str, int], totals: Sequence[str] = (), most: int = MOST, levels: int = LEVELS
) -> DataFrame:
    """(keys, group totals asked for, one column per percentile)."""
    found = resolve_heads(counts, group_heads(counts, keys, value, percents), keys, value, most, levels)
    return found.groupBy(*keys).agg(
        *[F.first(t).alias(t) for t in totals],
        *[F.max(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in percents],
    )
