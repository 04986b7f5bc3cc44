"""Most frequent values per group from summaries that add up over days.

A summary of a group (an issue and a tag key, say) holds the ``size`` values that may be most frequent, each with
bounds of its count (``low``, ``high``), and ``rest``: no value that it leaves out has occurred more often.
Where several summaries become one, a value that one of them leaves out may have up to its ``rest`` there, so its ``high``
grows by that. The bounds always hold; they meet while no summary has left anything out.

Groups may be as large as they like: values are counted and cut to ``size`` before a group comes together.
Null keys and values are keys and values like others; equal counts are ordered by value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .segmented import join_on_keys

SIZE = 64


def _cut(bounds: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Summaries from rows (keys, value, low, high, unseen), where ``unseen`` bounds the values that have no row."""
    order = Window.partitionBy(*keys).orderBy(F.col("high").desc(), F.col("value").asc_nulls_first())
    # The limit works before the shuffle, so a group sends a few rows of each task. The first one left out bounds the rest.
    ranked = bounds.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= size + 1)
    held = F.col("_nth") <= size
    return ranked.groupBy(*keys).agg(
        F.collect_list(F.when(held, F.struct("value", "low", "high"))).alias("kept"),
        F.max(F.when(held, F.col("unseen")).otherwise(F.greatest("unseen", "high"))).alias("rest"),
    )


def summarize(counts: DataFrame, keys: Sequence[str], value: str, count: str = "count", size: int = SIZE) -> DataFrame:
    """(keys, kept, rest) of rows that hold a value's count or part of it."""
    summed = counts.groupBy(*keys, F.col(value).alias("value")).agg(F.sum(count).cast("bigint").alias("low"))
    return _cut(summed.select("*", F.col("low").alias("high"), F.lit(0).cast("bigint").alias("unseen")), keys, size)


def bounds(summaries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, value, low, high, unseen) over all summaries of a group."""
    rests = summaries.groupBy(*keys).agg(F.sum("rest").alias("unseen"))
    each = summaries.select(*keys, "rest", F.explode("kept").alias("_k")).select(*keys, "rest", "_k.*")
    found = each.groupBy(*keys, "value").agg(F.sum("low").alias("low"), F.sum("high").alias("_high"), F.sum("rest").alias("_known"))
    return join_on_keys(found, rests, keys).select(*keys, "value", "low", (F.col("_high") + F.col("unseen") - F.col("_known")).alias("high"), "unseen")


def merge(summaries: DataFrame, keys: Sequence[str], size: int = SIZE) -> DataFrame:
    """One summary for each group, from those of several days, projects or earlier merges."""
    return _cut(bounds(summaries, keys), keys, size)


def top(summaries: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The ``n`` values of each group with the highest ``low``, as ``nth``, and ``decided``: whether these are the most frequent ones for certain.

    Decided groups have no other value whose ``high`` comes up to a chosen ``low``, and their order and counts are exact.
    """
    found = bounds(summaries, keys)
    group = Window.partitionBy(*keys)
    order = group.orderBy(F.col("low").desc(), F.col("value").asc_nulls_first())
    found = found.withColumn("nth", F.row_number().over(order))
    chosen = F.col("nth") <= n
    least, exact = F.min(F.when(chosen, F.col("low"))).over(group), F.min(F.when(chosen, F.col("low") == F.col("high"))).over(group)
    # Values without a row are below the bound, or there are none; others may tie if their count is known too.
    other = F.max(F.when(~chosen, F.when(F.col("low") == F.col("high"), F.col("high") - 1).otherwise(F.col("high")))).over(group)
    safe = exact & ((F.col("unseen") == 0) | ((F.col("unseen") < least) & (F.count(F.lit(1)).over(group) >= n))) & (F.coalesce(other, F.lit(-1)) < least)
    return found.withColumn("decided", safe).where(chosen).select(*keys, "value", "low", "high", "nth", "decided")


def exact_top(summaries: DataFrame, counts: DataFrame, keys: Sequence[str], value: str, n: int, count: str = "count") -> DataFrame:
    """(keys, value, count, nth, decided): the most frequent values of every group.

    Groups that the summaries decide come from them; stored counts are read for the others only.
    """
    found = top(summaries, keys, n)
    sure = found.where("decided").select(*keys, "value", F.col("low").alias("count"), "nth", "decided")
    open_ = found.where(~F.col("decided")).select(*keys).distinct()
    summed = join_on_keys(counts, open_, keys, "left_semi").groupBy(*keys, F.col(value).alias("value")).agg(F.sum(count).cast("bigint").alias("count"))
    order = Window.partitionBy(*keys).orderBy(F.col("count").desc(), F.col("value").asc_nulls_first())
    rest = summed.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)
    return sure.unionByName(rest.withColumn("decided", F.lit(False)))
