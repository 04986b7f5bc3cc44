"""Uptime checks: state with flap damping, change log, latest checks, heartbeats."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.timeparam import micros, moment, utc
from .segmented import HOT_ROWS, hot_keys, join_on_keys, segmented, time_slot
from .upsert import latest_per_key

ORDER = ["start_check", "check_id"]
SLOT = 60  # seconds per segment of a monitor's history


def replay_states(
    checks: DataFrame, monitors: DataFrame, carry: DataFrame | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Official state after every check of every monitor.

    Down is confirmed after ``confirmation_threshold`` failing checks in a row, up
    at once.  ``changed`` marks flips (the first confirmed state is one).  The rows are
    sorted once.  Where monitors are hot, their history is cut into minutes; what one segment
    hands to the next (open failure run, last confirmed state) is computed on one row per segment.

    ``carry`` (monitor_id, state, consecutive_down) continues an earlier replay.
    """
    hot = hot_keys(checks, ["monitor_id"], hot_rows)
    rows = checks if hot is None else segmented(checks, ["monitor_id"], time_slot(F.col("start_check"), SLOT), hot)
    rows = rows.join(monitors.select("monitor_id", "confirmation_threshold"), "monitor_id", "left")
    if carry is None:
        rows = rows.withColumn("_state0", F.lit(None).cast("boolean")).withColumn("_down0", F.lit(0))
    else:
        start = carry.select("monitor_id", F.col("state").alias("_state0"), F.col("consecutive_down").alias("_down0"))
        rows = rows.join(start, "monitor_id", "left")
    rows = rows.withColumn(
        "_need", F.greatest(F.lit(1), F.coalesce("confirmation_threshold", F.lit(1)))
    )
    key = ["monitor_id"] if hot is None else ["monitor_id", "_seg"]
    inside = Window.partitionBy(*key).orderBy(*ORDER)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_ups", F.sum(F.col("is_up").cast("int")).over(upto))
    # Failures never get fewer, so the most that any earlier success has seen are those before the last success.
    rows = rows.withColumn("_fails", F.sum((~F.col("is_up")).cast("int")).over(upto))
    rows = rows.withColumn("_run", F.col("_fails") - F.coalesce(F.max(F.when(F.col("is_up"), F.col("_fails"))).over(upto), F.lit(0)))
    if hot is None:
        rows = rows.withColumns({"_carried": F.coalesce("_down0", F.lit(0)), "_entry": F.col("_state0")})
    else:
        rows = join_on_keys(rows, _handed_on(rows, key), key)

    run = F.col("_run") + F.when(F.col("_ups") == 0, F.col("_carried")).otherwise(F.lit(0))
    rows = rows.withColumn("_down", F.when(F.col("is_up"), F.lit(0)).otherwise(run))
    confirmed = F.when(F.col("is_up"), F.lit(True)).when(F.col("_down") >= F.col("_need"), F.lit(False))
    rows = rows.withColumn("_state", F.last(confirmed, ignorenulls=True).over(upto)).withColumn(
        "_previous", F.lag("_state").over(inside)
    )
    state, previous = F.coalesce("_state", "_entry"), F.coalesce("_previous", "_entry")
    return rows.select(
        *[c for c in checks.columns],
        F.least("_down", "_need").cast("int").alias("consecutive_down"),
        state.alias("state"),
        (state.isNotNull() & (previous.isNull() | (previous != state))).alias("changed"),
    )


def _handed_on(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row per segment: the failure run and the state it begins with."""
    # Ups, the failure run still open at its end, then what it passes on.
    by_segment = Window.partitionBy("monitor_id").orderBy("_seg")
    earlier = by_segment.rowsBetween(Window.unboundedPreceding, -1)
    open_run = F.max_by(F.when(F.col("is_up"), 0).otherwise(F.col("_run")), F.struct(*ORDER))
    segments = rows.groupBy(*key).agg(
        F.max("_ups").alias("_seg_ups"), open_run.alias("_open"), F.max("_need").alias("_seg_need"),
        F.max("_state0").alias("_first_state"), F.max("_down0").alias("_first_down"),
    ).withColumn("_island", F.sum((F.col("_seg_ups") > 0).cast("int")).over(by_segment))
    in_island = Window.partitionBy("monitor_id", "_island").orderBy("_seg").rowsBetween(Window.unboundedPreceding, 0)
    no_up_yet = F.coalesce(F.lag("_island").over(by_segment), F.lit(0)) == 0
    segments = segments.withColumn("_open_upto", F.sum("_open").over(in_island)).withColumn(
        "_carried", F.coalesce(F.lag("_open_upto").over(by_segment), F.lit(0))
        + F.when(no_up_yet, F.coalesce("_first_down", F.lit(0))).otherwise(F.lit(0))
    )
    run_at_end = F.col("_open") + F.when(F.col("_seg_ups") == 0, F.col("_carried")).otherwise(F.lit(0))
    at_end = F.when(run_at_end >= F.col("_seg_need"), F.lit(False)).when(F.col("_seg_ups") > 0, F.lit(True))
    return segments.withColumn("_at_end", at_end).withColumn(
        "_entry", F.coalesce(F.last("_at_end", ignorenulls=True).over(earlier), "_first_state")
    ).select(*key, "_carried", "_entry")


def last_states(states: DataFrame) -> DataFrame:
    """State of each monitor after its newest check - what the next replay continues from."""
    return latest_per_key(states.select("monitor_id", *ORDER, "state", "consecutive_down"), ["monitor_id"], ORDER).select("monitor_id", "state", "consecutive_down")


def change_log(states: DataFrame) -> DataFrame:
    return states.where(F.col("changed"))


def latest_checks(checks: DataFrame, limit: int = 60) -> DataFrame:
    """The newest ``limit`` checks per monitor; the cut happens before the shuffle too."""
    w = Window.partitionBy("monitor_id").orderBy(F.col("start_check").desc(), F.col("check_id").desc())
    return checks.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def heartbeat_state(monitors: DataFrame, checks: DataFrame, now: datetime, stored: DataFrame | None = None) -> DataFrame:
    """Up when a check arrived within the monitor's own interval before ``now``.

    Only checks of the longest interval are read; ``stored`` (monitor_id, last_check) has the last
    check of monitors that have been silent for longer.
    """
    longest = monitors.agg(F.max("interval_seconds")).first()[0] or 0
    since = now - timedelta(seconds=longest)
    recent = checks.where(F.col("start_check") >= moment(since))
    if "date" in checks.columns:
        recent = recent.where(F.col("date") >= F.lit(utc(since).date()))
    seen = recent.select("monitor_id", F.col("start_check").alias("last_check"))
    if stored is not None:
        seen = seen.unionByName(stored.select("monitor_id", "last_check"))
    last = seen.groupBy("monitor_id").agg(F.max("last_check").alias("last_check"))
    since = F.lit(micros(now)) - F.col("interval_seconds") * F.lit(1_000_000)
    return monitors.join(last, "monitor_id", "left").withColumn(
        "is_up", F.coalesce(F.unix_micros(F.col("last_check").cast("timestamp")) >= since, F.lit(False))
    )


def hourly_checks(checks: DataFrame) -> DataFrame:
    """Checks per organisation and hour; up heartbeats are never stored, so none are counted."""
    counted = checks
    if "monitor_type" in checks.columns:
        counted = checks.where((F.col("monitor_type") != "heartbeat") | ~F.col("is_up"))
    return counted.groupBy("organization_id", F.date_trunc("hour", "start_check").cast("timestamp_ntz").alias("date")).agg(
        F.count(F.lit(1)).alias("count")
    )
