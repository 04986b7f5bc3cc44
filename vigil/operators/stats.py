"""Time series over hourly count tables, and a few global figures."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from ..functions.timeparam import moment

INTERVALS = {"1m": timedelta(minutes=1), "1h": timedelta(hours=1), "1d": timedelta(days=1)}


def series(spark, start: datetime, end: datetime, interval: str, max_points: int | None = None) -> DataFrame:
    """Grid of time points, both ends included; ``max_points`` rejects a longer one."""
    step = INTERVALS[interval]
    if max_points is not None and (end - start) / step > max_points:
        raise ValueError("too many intervals")
    width = int(step.total_seconds())
    points = F.explode(F.sequence(moment(start), moment(end), F.expr(f"INTERVAL '{width}' SECOND")))
    return spark.range(1).select(points.alias("ts"))


def floor_hours(start: datetime, end: datetime) -> tuple[datetime, datetime]:
    """Query bounds: the start's hour and the hour after the end."""
    hour = dict(minute=0, second=0, microsecond=0)
    return start.replace(**hour), (end + timedelta(hours=1)).replace(**hour)


def counts_over_time(
    hourly: DataFrame, project_ids: list[int], start: datetime, end: datetime, interval: str = "1h", *, exact_hours: bool = True
) -> DataFrame:
    """Counts of the chosen projects at every grid point.

    Compatible mode (``exact_hours``): a point always covers one hour whatever the
    interval, a point at which only other projects counted is left out, and a point
    without any count stays with a null.  The corrected mode covers the whole
    interval and fills every point with zero or more.

    Counts are put on their grid points before the join, which is then on equality.
    """
    start, end = floor_hours(start, end)
    width = int(INTERVALS[interval].total_seconds())
    chosen = F.col("project_id").isin(*project_ids)
    seconds = F.unix_seconds(F.col("date").cast("timestamp"))
    origin = F.unix_seconds(moment(start).cast("timestamp"))
    scoped = hourly.where((F.col("date") > moment(start - timedelta(hours=1))) & (F.col("date") < moment(end + timedelta(days=1))))
    totals = scoped.groupBy("date").agg(F.sum(F.when(chosen, F.col("count"))).alias("n"))
    if not exact_hours:
        totals = totals.where(F.col("date") >= moment(start))
        point = origin + F.floor((seconds - origin) / width) * width
        grouped = totals.groupBy(F.timestamp_seconds(point).cast("timestamp_ntz").alias("ts")).agg(F.sum("n").alias("total"))
        return series(hourly.sparkSession, start, end, interval).join(grouped, "ts", "left").select("ts", F.coalesce("total", F.lit(0)).alias("total"))
    # Grid points g with g <= date < g + 1 hour.
    low = F.floor((seconds - origin - 3600) / width) + 1
    high = F.floor((seconds - origin) / width)
    steps = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    on_grid = totals.withColumn("k", F.explode(steps)).groupBy(
        F.timestamp_seconds(origin + F.col("k") * width).cast("timestamp_ntz").alias("ts")
    ).agg(F.sum("n").alias("total"), F.lit(True).alias("_seen"))
    return series(hourly.sparkSession, start, end, interval).join(on_grid, "ts", "left").where(
        F.col("_seen").isNull() | F.col("total").isNotNull()
    ).select("ts", "total")


def global_counts(organizations: DataFrame, projects: DataFrame) -> DataFrame:
    """Joined-row count (an organisation counts once per project) next to the corrected one."""
    rows = organizations.join(projects.select(F.col("organization_id").alias("_org"), "project_id"), F.col("organization_id") == F.col("_org"), "left")
    return rows.agg(
        F.count("organization_id").alias("org_count"), F.count("project_id").alias("project_count"),
        F.countDistinct("organization_id").alias("distinct_org_count"),
    )
