"""Point-in-interval joins: by key, or by blocks where a key has many intervals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .segmented import hot_keys, join_on_keys

#: Intervals of one key that each of its points is compared with.
FEW = 100
STEP = 4  # bits per level: blocks grow by a factor of 16
LEVELS = 16


def interval_blocks(intervals: DataFrame, low: str, high: str) -> DataFrame:
    """Cut [low, high) into aligned blocks of 16^level: at most 30 per level, without overlap."""
    level = F.col("_level")
    size = f"shiftleft(1L, _level * {STEP})"
    rows = intervals.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 2))))
    rows = rows.withColumn("_lo", F.expr(f"(`{low}` + {size} - 1) div {size}")).withColumn("_hi", F.expr(f"`{high}` div {size}"))
    rows = rows.withColumn("_lo_up", F.expr("(_lo + 15) div 16")).withColumn("_hi_up", F.expr("_hi div 16"))
    nothing = F.array().cast("array<bigint>")

    def blocks(a, b):
        return F.when(a < b, F.sequence(a, b - 1)).otherwise(nothing)

    lo, hi = F.col("_lo"), F.col("_hi")
    covered = (F.col("_lo_up") < F.col("_hi_up")) & (level < LEVELS - 2)
    left = blocks(lo, F.least(hi, F.col("_lo_up") * 16))
    right = blocks(F.greatest(lo, F.col("_hi_up") * 16), hi)
    chosen = F.when(covered, F.concat(left, right)).otherwise(blocks(lo, hi))
    return rows.withColumn("_block", F.explode(chosen)).drop("_lo", "_hi", "_lo_up", "_hi_up")


def interval_join(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, low: str, high: str, how: str = "inner", few: int = FEW
) -> DataFrame:
    """Join of points with the intervals [low, high) that contain them, inner or left.

    A point is compared with all intervals of its key as long as these are ``few``; such a key
    goes to one task. Keys with more intervals, or with many points, are joined by blocks.
    """
    intervals = intervals.dropna(subset=list(keys))
    crowded = [k for k in (hot_keys(intervals, keys, few), hot_keys(points, keys)) if k is not None]
    if not crowded:
        return _join_by_key(points, intervals, keys, point, low, high, how)
    apart = reduce(DataFrame.union, crowded).distinct()
    chosen = join_on_keys(points, apart, keys, "left_semi")
    inside = _join_by_blocks(chosen, join_on_keys(intervals, apart, keys, "left_semi"), keys, point, low, high)
    if how == "left":
        missed = chosen.join(inside.select(*keys, point).distinct(), [*keys, point], "left_anti")
        inside = inside.unionByName(missed, allowMissingColumns=True)
    rest = _join_by_key(join_on_keys(points, apart, keys, "left_anti"), join_on_keys(intervals, apart, keys, "left_anti"), keys, point, low, high, how)
    return rest.unionByName(inside)


def _join_by_key(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, low: str, high: str, how: str) -> DataFrame:
    own = intervals.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [points[k] == own[f"_r_{k}"] for k in keys])
    return points.join(own, same & (points[point] >= own[low]) & (points[point] < own[high]), how).drop(*[f"_r_{k}" for k in keys])


def _join_by_blocks(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, low: str, high: str) -> DataFrame:
    """Inner join in which no pair is tried that does not match.

    An interval becomes a few aligned blocks, a point looks once per block size, so
    the join is on equality.  Values must not be negative.
    """
    blocks = interval_blocks(intervals, low, high)
    # A key's points are looked up at the block sizes its intervals use (15 at most).
    levels = blocks.groupBy(*keys).agg(F.collect_set("_level").alias("_levels"))
    probes = points.join(levels, list(keys)).withColumn("_level", F.explode("_levels")).drop("_levels").withColumn(
        "_block", F.expr(f"shiftright(`{point}`, _level * {STEP})")
    )
    return probes.join(blocks, [*keys, "_level", "_block"]).drop("_level", "_block")
