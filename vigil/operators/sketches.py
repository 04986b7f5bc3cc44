"""Rollups whose percentiles and distinct counts add up over hours, days, runs and projects.

A rollup row carries two sketches as binary columns: the durations (KLL) and the transaction
ids (theta). Rows of any hours, projects or runs are merged by aggregating them, so a day, a
project or an hour that two runs wrote parts of is read from the rollups alone.

Errors. A percentile is exact for up to ``k`` durations; beyond that the rank of the value lies within
``rank_error(k)`` of the one asked for in 99 of 100 cases. A distinct count is exact below
2 ** ``lg_entries`` transactions; beyond that the standard error is 2 ** (-lg_entries / 2).
A row takes at most some 3 ``k`` values and 2 ** ``lg_entries`` hashes, and no more than it has spans.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .spans import GROUP_KEYS

K = 200
LG_ENTRIES = 12
KEYS = ("organization_id", "project_id", "transaction_name", *GROUP_KEYS, "hour_bucket")
SUMS = ("count", "timed", "sum_duration")
PERCENTS = {"p50": 50, "p95": 95}


def rank_error(k: int = K) -> float:
    """Distance of ranks, as a share of all values, that a KLL sketch keeps to with 99 % confidence."""
    return 2.296 / k**0.9723


def sketch_rollup(spans: DataFrame, k: int = K, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """Per hour and span group: counts, sum, extremes and both sketches. Tasks sketch their own rows first."""
    spans = spans.withColumn("hour_bucket", F.date_trunc("hour", "timestamp").cast("timestamp_ntz"))
    duration = F.col("duration").cast("double")
    return spans.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("count"), F.count(duration).alias("timed"), F.coalesce(F.sum(duration), F.lit(0.0)).alias("sum_duration"),
        F.min(duration).alias("min_duration"), F.max(duration).alias("max_duration"),
        F.kll_sketch_agg_double(duration, k).alias("durations"), F.theta_sketch_agg("transaction_id", lg_entries).alias("transactions"))


def merge_rollups(rollups: DataFrame, keys: Sequence[str] | Mapping[str, Column], k: int = K, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """Rollup rows put together by ``keys`` (names, or expressions by name); the result can be merged again."""
    by = [c.alias(n) for n, c in keys.items()] if isinstance(keys, Mapping) else list(keys)
    return rollups.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in SUMS], F.min("min_duration").alias("min_duration"), F.max("max_duration").alias("max_duration"),
        F.kll_merge_agg_double("durations", k).alias("durations"), F.theta_union_agg("transactions", lg_entries).alias("transactions"))


def read_rollups(merged: DataFrame, percents: Mapping[str, int] = PERCENTS) -> DataFrame:
    """The figures of rollup rows: mean, percentiles and distinct transactions instead of the sketches.

    A percentile is the smallest duration whose share of smaller or equal ones reaches it; null without durations.
    """
    ranks = F.array(*[F.lit(p / 100.0) for p in percents.values()])
    values = F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_double("durations", ranks))
    read = merged.withColumn("_values", values)
    return read.select(
        *[c for c in merged.columns if c not in ("durations", "transactions")], F.try_divide("sum_duration", "timed").alias("avg_duration"),
        *[F.get("_values", F.lit(i)).alias(name) for i, name in enumerate(percents)], F.theta_sketch_estimate("transactions").alias("transaction_count"))


def rank_within(rollups: DataFrame, value: Column) -> Column:
    """The share of durations that are at most ``value``, from a rollup row's sketch."""
    return F.when(F.col("timed") > 0, F.kll_sketch_get_rank_double("durations", value))


def distinct_trend(rollups: DataFrame, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """Daily totals; ``transaction_count`` adds up the groups' and hours' counts, ``distinct_transactions`` counts each once."""
    day = F.date_trunc("day", "hour_bucket").cast("timestamp_ntz").alias("date")
    return rollups.groupBy(day).agg(
        F.sum("count").alias("count"), F.sum(F.theta_sketch_estimate("transactions")).alias("transaction_count"),
        F.theta_sketch_estimate(F.theta_union_agg("transactions", lg_entries)).alias("distinct_transactions"), F.sum("sum_duration").alias("total_time"),
    ).withColumn("avg_duration", F.coalesce(F.try_divide("total_time", "count"), F.lit(0.0)))
