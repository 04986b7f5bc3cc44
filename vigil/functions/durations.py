"""Durations and their 50-bucket log histogram."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .ids import as_instant

# 50 exponential buckets from 1 ms to 60 000 ms.
BUCKETS = 50
LOWEST_MS = 1.0
HIGHEST_MS = 60_000.0
BOUNDARIES = [LOWEST_MS * (HIGHEST_MS / LOWEST_MS) ** (i / BUCKETS) for i in range(BUCKETS + 1)]
MIDPOINTS = [(BOUNDARIES[i] + BOUNDARIES[i + 1]) / 2.0 for i in range(BUCKETS)]


def _lookup(values: list[float]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two timestamps, never negative, 0 when either is missing."""
    micros = F.unix_micros(as_instant(end)) - F.unix_micros(as_instant(start))
    return F.coalesce(F.greatest(F.lit(0.0), micros / F.lit(1000.0)), F.lit(0.0))


def duration_bucket(ms: Column) -> Column:
    """Bucket 0..49 of a duration, exact on the boundaries.

    The logarithm only proposes a bucket (it may be off by one through rounding);
    two comparisons with the boundary table settle it.  No per-row array scan.
    """
    edges = _lookup(BOUNDARIES)
    inside = F.when((ms > LOWEST_MS) & (ms < HIGHEST_MS), ms)
    guess = F.floor(F.log(inside) * F.lit(BUCKETS / math.log(HIGHEST_MS))).cast("int")
    guess = F.greatest(F.lit(0), F.least(guess, F.lit(BUCKETS - 1)))
    exact = (
        F.when(inside < F.get(edges, guess), guess - 1)
        .when(inside >= F.get(edges, guess + 1), guess + 1)
        .otherwise(guess)
    )
    return (
        F.when(ms <= LOWEST_MS, F.lit(0))
        .when(ms >= HIGHEST_MS, F.lit(BUCKETS - 1))
        .otherwise(F.greatest(F.lit(0), F.least(exact, F.lit(BUCKETS - 1))))
    )


def bucket_midpoint(bucket: Column) -> Column:
    return F.get(_lookup(MIDPOINTS), bucket)


def dense_histogram(entries: Column) -> Column:
    """``array<struct<bucket,n>>`` (one entry per used bucket) to a 50-slot array."""
    counts = F.map_from_entries(entries)
    return F.transform(
        F.sequence(F.lit(0), F.lit(BUCKETS - 1)),
        lambda i: F.coalesce(F.try_element_at(counts, i), F.lit(0)).cast("bigint"),
    )


def merge_histograms(left: Column, right: Column) -> Column:
    zero = F.array_repeat(F.lit(0).cast("bigint"), BUCKETS)
    return F.zip_with(F.coalesce(left, zero), F.coalesce(right, zero), lambda a, b: a + b)


def histogram_percentile(histogram: Column, pct: float) -> Column:
    """Mid-point of the bucket in which the percentile falls; null when empty.

    The rank is ``ceil(total * pct / 100)`` over the array's own total.
    """
    total = F.aggregate(histogram, F.lit(0).cast("bigint"), lambda acc, n: acc + n)
    rank = F.ceil(total * F.lit(float(pct)) / F.lit(100.0))
    start = F.struct(
        F.lit(0).cast("bigint").alias("seen"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("hit")
    )

    def step(acc: Column, n: Column) -> Column:
        seen = acc["seen"] + n
        hit = F.when(acc["hit"].isNull() & (n > 0) & (seen >= rank), acc["at"]).otherwise(acc["hit"])
        return F.struct(seen.alias("seen"), (acc["at"] + 1).alias("at"), hit.alias("hit"))

    return F.when(total > 0, bucket_midpoint(F.aggregate(histogram, start, step)["hit"]))
