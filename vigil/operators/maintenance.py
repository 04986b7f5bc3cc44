"""Retention, cascading deletes, orphan detection, tier resolution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.ids import uuid7_from_timestamp
from ..functions.timeparam import moment
from .ranges import interval_join
from .upsert import first_per_key, without

# Days kept.
RETENTION_DAYS = {"events": 90, "transactions": 90, "logs": 90, "uptime": 90, "rollups": 90, "spans_raw": 30, "staging": 3, "files": 90}
HOT_DAYS = {"logs": 7, "events": 30}
ISSUE_BUFFER_DAYS = 7
ORPHAN_HOURS = 24
FUTURE_SKEW = timedelta(hours=1)


def keep_days(rows: DataFrame, date_column: str, days: int, now: datetime) -> DataFrame:
    """Rows of day partitions whose day begins at or after ``now`` minus ``days``."""
    return rows.where(F.to_timestamp_ntz(F.col(date_column).cast("string")) >= moment(now - timedelta(days=days)))


def keep_periods(rows: DataFrame, time_column: str, days: int, now: datetime, *, weekly: bool = False) -> DataFrame:
    """Rows of whole periods (days or Monday weeks) that are not entirely past retention."""
    start = F.to_date(F.date_trunc("week" if weekly else "day", time_column))
    threshold = F.to_date(moment(now - timedelta(days=days)))
    return rows.where(F.date_add(start, 7 if weekly else 1) >= threshold)


def acceptable_spans(spans: DataFrame, now: datetime, days: int = RETENTION_DAYS["spans_raw"]) -> DataFrame:
    """Flag spans worth keeping: with a time, not past raw retention, not far in the future."""
    ts = F.col("timestamp")
    ok = ts.isNotNull() & (ts >= moment(now - timedelta(days=days))) & (ts <= moment(now + FUTURE_SKEW))
    return spans.withColumn("kept", F.coalesce(ok, F.lit(False)))


def recent_transactions(rows: DataFrame, column: str, now: datetime, days: int = RETENTION_DAYS["transactions"]) -> DataFrame:
    ts = F.col(column)
    return rows.where((ts >= moment(now - timedelta(days=days))) & (ts <= moment(now + FUTURE_SKEW)))


def dedupe_by_tier(rows: DataFrame, period: list[str], tier: str) -> DataFrame:
    """Rows of the newest tier that covers their period (the highest number wins)."""
    top = rows.groupBy(*period).agg(F.max(tier).alias("_top"))
    return rows.join(top, period).where(F.col(tier) == F.col("_top")).drop("_top")


def stale_issues(issues: DataFrame, now: datetime) -> DataFrame:
    limit = RETENTION_DAYS["events"] + ISSUE_BUFFER_DAYS
    return issues.where(F.col("last_seen") < moment(now - timedelta(days=limit)))


def cascade_delete(tables: Mapping[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of the removed keys; each result is written on its own."""
    keys = gone.select(key).distinct()
    return {name: without(rows, keys, [key]) for name, rows in tables.items()}


def purge(rows: DataFrame, *, organization_id: int | None = None, project_id: int | None = None) -> DataFrame:
    if organization_id is not None:
        rows = rows.where(F.col("organization_id") != organization_id)
    if project_id is not None:
        rows = rows.where(F.col("project_id") != project_id)
    return rows


def old_blobs(blobs: DataFrame, files: DataFrame, now: datetime, days: int = RETENTION_DAYS["files"]) -> DataFrame:
    """Blobs past retention that no recent file uses."""
    cutoff = moment(now - timedelta(days=days))
    recent = files.where(F.col("created") >= cutoff)
    return without(blobs.where(F.col("created") < cutoff), recent, ["blob_id"])


def orphan_blobs(blobs: DataFrame, files: DataFrame, now: datetime) -> DataFrame:
    """Blobs older than a day that no file uses at all."""
    return without(blobs.where(F.col("created") < moment(now - timedelta(hours=ORPHAN_HOURS))), files, ["blob_id"])


def touch(bundles: DataFrame, used: DataFrame, now: datetime) -> DataFrame:
    """Set ``last_used`` of used bundles, but only when it is more than a day old."""
    hit = used.select("bundle_id").distinct().withColumn("_used", F.lit(True))
    old = F.col("last_used") < moment(now - timedelta(days=1))
    return bundles.join(hit, "bundle_id", "left").withColumn(
        "last_used", F.when(F.coalesce("_used", F.lit(False)) & old, moment(now)).otherwise(F.col("last_used"))
    ).drop("_used")


def import_events(archive: DataFrame, issues: DataFrame, projects: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """Archived events with a new time-ordered id; the old id becomes ``event_id``."""
    if start is not None:
        archive = archive.where(F.col("received") >= moment(start))
    if end is not None:
        archive = archive.where(F.col("received") < moment(end))
    owners = issues.select("issue_id", "project_id").join(projects.select("project_id", "organization_id"), "project_id")
    rows = archive.join(owners.select("issue_id", "organization_id"), "issue_id")
    minted = rows.withColumn("event_id", F.col("id")).withColumn("id", uuid7_from_timestamp(F.col("received"), F.col("event_id")))
    return first_per_key(minted, ["id"], ["event_id"])


def frames_with_modules(frames: DataFrame, modules: DataFrame, order: Sequence[str] = ("module_order",)) -> DataFrame:
    """Module of each frame address: base <= address < end, first in module order, else null."""
    points = frames.select("dump_id", "address").distinct()
    own = modules.select("dump_id", "base", "end", *dict.fromkeys(["module", *(c for c in order if c != "base")]))
    rank = F.when(F.col("base").isNotNull(), F.struct(*order)) if len(order) > 1 else F.col(order[0])
    inside = interval_join(points, own, ["dump_id"], "address", "base", "end", "left")
    return inside.groupBy("dump_id", "address").agg(F.min_by(F.struct("module", "base"), rank).alias("_m")).select(
        "dump_id", "address", F.col("_m.module").alias("module"), F.col("_m.base").alias("base")
    )


def match_bundles(frames: DataFrame, images: DataFrame, bundles: DataFrame) -> DataFrame:
    """Source bundle of every minified frame (event_id, organization_id, release, frame_at, abs_path).

    In bundle order, a bundle matches by debug id of the frame's image or by file
    name (its own or that of its code file); same organisation, and same release or
    a debug id known to the event.
    """
    name = F.element_at(F.split(F.col("abs_path"), "/"), -1)
    by_name = images.groupBy(F.col("event_id").alias("_event"), F.element_at(F.split("code_file", "/"), -1).alias("_file")).agg(
        F.max("debug_id").alias("frame_debug_id")
    )
    f = frames.withColumn("file", name)
    f = f.join(by_name, (f["event_id"] == by_name["_event"]) & (f["file"] == by_name["_file"]), "left").drop("_event", "_file")
    b = bundles.select(
        F.col("organization_id").alias("_org"), F.col("release").alias("_release"), "bundle_id",
        F.col("debug_id").alias("_debug"), "file_name", F.element_at(F.split("code_file", "/"), -1).alias("_code"),
    )
    # Only the first bundle counts, so a frame meets one for its debug id and one for its file name, however many there are.
    ids = b.groupBy("_org", "_debug").agg(F.min("bundle_id").alias("_by_id"))
    names = b.select("_org", "_release", "bundle_id", F.explode(F.array_distinct(F.array_compact(F.array("file_name", "_code")))).alias("_name"))
    names = names.groupBy("_org", "_release", "_name").agg(F.min("bundle_id").alias("_by_file"))
    columns = [f[c] for c in dict.fromkeys(["event_id", "frame_at", *f.columns])]
    hits = f.join(ids, (f["organization_id"] == ids["_org"]) & (f["frame_debug_id"] == ids["_debug"]), "left").select(*columns, "_by_id")
    hits = hits.join(
        names, (hits["organization_id"] == names["_org"]) & (hits["release"] == names["_release"]) & (hits["file"] == names["_name"]), "left"
    )
    first = F.min(F.least("_by_id", "_by_file")).over(Window.partitionBy("event_id", "frame_at"))
    known = F.col("event_id").isNotNull() & F.col("frame_at").isNotNull()
    return hits.withColumn("bundle_id", F.when(known, first)).drop("_org", "_release", "_name", "_by_id", "_by_file")


def archived_days(rows: DataFrame, time_column: str) -> DataFrame:
    """(organisation, day) pairs present in a table."""
    return rows.select("organization_id", F.to_date(time_column).alias("date")).distinct()

