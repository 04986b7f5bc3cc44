"""Structured logs: ingest projection, search, hourly statistics, resources, tiers."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from uuid import UUID

from pyspark.sql import DataFrame, functions as F

from ..functions.ids import hash_bucket, uuid7_from_timestamp, uuid7_moment
from ..functions.levels import LOG_LABELS, level_filter, log_level
from ..functions.otel import attribute_field, extra_attributes, span_id_to_long, trace_id, within_drift
from ..functions.text import like_literal
from ..functions.timeparam import moment, utc

RESOURCE_TYPES = ("service", "environment", "host")
HOT_DAYS = 7


def log_rows(items: DataFrame, now: datetime) -> DataFrame:
    """Decoded log items to log rows: clock guard, id, level, trace context, attributes.

    Items carry organization_id, project_id, timestamp (null means ``now``), level,
    body, trace_id, span_id, severity_number, service, environment, host,
    attributes (map) and a ``source_key`` that makes the minted id repeatable.
    """
    attrs = F.col("attributes")
    at = F.coalesce("timestamp", moment(now))
    return items.withColumn("timestamp", at).where(within_drift(F.col("timestamp"), moment(now))).select(
        uuid7_from_timestamp(F.col("timestamp"), F.col("source_key")).alias("id"), "timestamp",
        "organization_id", "project_id", trace_id(F.col("trace_id")).alias("trace_id"),
        span_id_to_long(F.col("span_id")).alias("span_id"), log_level(F.col("level")).cast("smallint").alias("level"),
        F.coalesce(
            F.col("severity_number"), attribute_field(F.lit(""), attrs, "severity_number").try_cast("int")
        ).cast("smallint").alias("severity_number"),
        F.coalesce("body", F.lit("")).alias("body"),
        *[attribute_field(F.col(f), attrs, f).alias(f) for f in RESOURCE_TYPES],
        F.to_json(extra_attributes(attrs)).alias("data"),
    )


def search_logs(
    logs: DataFrame, *, organization_id: int | None = None, start: datetime | None = None, end: datetime | None = None,
    project_ids: list[int] | None = None, levels: Iterable[str] | None = None, service: str | None = None,
    environment: str | None = None, host: str | None = None, trace: str | None = None, query: str | None = None,
    before=None, id_column: str = "id",
) -> DataFrame:
    """All log filters; each is optional.  ``query`` is matched literally, ignoring case."""
    if organization_id is not None:
        logs = logs.where(F.col("organization_id") == organization_id)
    if start is not None:
        logs = logs.where(F.col("timestamp") >= moment(start))
    if end is not None:
        logs = logs.where(F.col("timestamp") < moment(end))
    if project_ids:
        logs = logs.where(F.col("project_id").isin(*project_ids))
    if wanted := level_filter(levels):
        logs = logs.where(F.col("level").isin(*wanted))
    for column, value in (("service", service), ("environment", environment), ("host", host)):
        if value:
            logs = logs.where(F.col(column) == value)
    if trace:
        try:
            logs = logs.where(F.col("trace_id") == str(UUID(trace)))
        except ValueError:
            logs = logs.where(F.lit(False))
    if query:
        logs = logs.where(F.col("body").ilike(f"%{like_literal(query)}%"))
    if before is not None:
        logs = logs.where(F.col(id_column) < F.lit(before))
    return logs


def hourly_stats(logs: DataFrame) -> DataFrame:
    """Counts per hour, project, level and name buckets."""
    return logs.groupBy(
        F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("date"), "project_id", "organization_id", "level",
        hash_bucket(F.col("service")).alias("service_bucket"), hash_bucket(F.col("environment")).alias("environment_bucket"),
    ).agg(F.count(F.lit(1)).alias("count"))


def stats_series(
    stats: DataFrame, *, organization_id: int | None = None, start: datetime | None = None, end: datetime | None = None,
    project_ids: list[int] | None = None, levels: Iterable[str] | None = None,
    service_buckets: list[int] | None = None, environment_buckets: list[int] | None = None,
) -> DataFrame:
    """One row per observed hour, one zero-filled column per level."""
    if organization_id is not None:
        stats = stats.where(F.col("organization_id") == organization_id)
    if start is not None:
        stats = stats.where(F.col("date") >= moment(start))
    if end is not None:
        stats = stats.where(F.col("date") < moment(end))
    for column, values in (
        ("project_id", project_ids), ("level", level_filter(levels)),
        ("service_bucket", service_buckets), ("environment_bucket", environment_buckets),
    ):
        if values:
            stats = stats.where(F.col(column).isin(*values))
    return stats.groupBy(F.col("date").alias("hour")).agg(
        *[F.coalesce(F.sum(F.when(F.col("level") == n, F.col("count"))), F.lit(0)).alias(label) for n, label in LOG_LABELS.items()]
    )


def resources(logs: DataFrame) -> DataFrame:
    """Distinct (org, name, type) with first and last sighting; empty names are skipped."""
    long = logs.select("organization_id", "timestamp", *RESOURCE_TYPES).unpivot(
        ["organization_id", "timestamp"], list(RESOURCE_TYPES), "type", "name"
    )
    return long.where(F.col("name") != "").groupBy("organization_id", "name", "type").agg(
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")
    )


def latest_resources(found: DataFrame, limit: int = 100) -> DataFrame:
    return found.orderBy(F.col("last_seen").desc(), "organization_id", "type", "name").limit(limit)


def combined_page(
    hot: DataFrame, cold: DataFrame, *, cutoff: datetime, limit: int, start: datetime, end: datetime,
    before=None, id_column: str = "id", **filters,
) -> DataFrame:
    """Newest rows of the hot and the cold table as one page.

    Each tier gets only its own side of the cutoff, so both filters reach the scans
    and no row counts twice; a tier outside the time range is not read at all, nor is
    the hot one once the cursor has reached the cold range.
    """
    parts = []
    reached = uuid7_moment(before) if isinstance(before, str) else None
    if end > cutoff and (reached is None or reached > utc(cutoff) or start >= cutoff):
        parts.append(search_logs(hot, start=max(start, cutoff), end=end, before=before, id_column=id_column, **filters))
    if start < cutoff:
        parts.append(search_logs(cold, start=start, end=min(end, cutoff), before=before, id_column=id_column, **filters))
    if not parts:
        return hot.limit(0)
    merged = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return merged.orderBy(F.col(id_column).desc()).limit(limit)


def bounded_count(rows: DataFrame, most: int = 1000) -> DataFrame:
    """Hit count that stops at ``most``."""
    return rows.limit(most).agg(F.count(F.lit(1)).alias("hits"))
