"""Alert rules over issue events, and the tables notifications are made of."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.timeparam import micros, moment, utc
from .upsert import without

# Tags a notification shows, in order, with their labels.
TAG_LABELS = {"environment": "Environment", "server_name": "Server Name", "release": "Release"}
STANDARD_TAGS = tuple(TAG_LABELS)


def evaluate_alerts(
    rules: DataFrame, events: DataFrame, now: datetime, *, sent: DataFrame | None = None, touched: DataFrame | None = None, weight: str | None = None
) -> DataFrame:
    """(alert, issue) pairs with at least ``quantity`` events in the rule's trailing window.

    Windows are whole minutes long, so events are first counted per issue and age in
    minutes; the rules then meet those counts instead of the events. ``weight`` names a column of
    events that stand for several.
    """
    active = rules.where(F.col("quantity").isNotNull() & F.col("timespan_minutes").isNotNull())
    if touched is not None:
        events = events.join(touched.select("issue_id").distinct(), "issue_id", "left_semi")
    # The longest window of all bounds what is scanned, that of the project what is counted.
    widest = active.agg(F.max("timespan_minutes")).first()[0] or 0
    since = now - timedelta(minutes=widest)
    events = events.where(F.col("received") >= moment(since))
    if "date" in events.columns:
        events = events.where(F.col("date") >= F.lit(utc(since).date()))
    longest = active.groupBy("project_id").agg(F.max("timespan_minutes").alias("_longest"))
    age = F.ceil((F.lit(micros(now)) - F.unix_micros(F.col("received").cast("timestamp"))) / F.lit(60_000_000))
    aged = (
        events.select("project_id", "issue_id", age.alias("age"), (F.lit(1) if weight is None else F.col(weight)).alias("_n")).join(longest, "project_id")
        .where(F.col("age") <= F.col("_longest"))
        .groupBy("project_id", "issue_id", "age").agg(F.sum("_n").alias("n"))
    )
    hits = (
        aged.join(active, "project_id").where(F.col("age") <= F.col("timespan_minutes"))
        .groupBy("alert_id", "issue_id", "quantity").agg(F.sum("n").alias("num_events"))
        .where(F.col("num_events") >= F.col("quantity")).drop("quantity")
    )
    return hits if sent is None else without(hits, sent, ["alert_id", "issue_id"])


def notification_tags(tags: DataFrame, keys: tuple[str, ...] = STANDARD_TAGS) -> DataFrame:
    """One value per issue and key, the most frequent one, in key order."""
    names = list(dict.fromkeys(keys))
    totals = tags.where(F.col("tag_key").isin(*names)).groupBy("issue_id", "tag_key", "tag_value").agg(F.sum("count").alias("n"))
    best = totals.groupBy("issue_id", "tag_key").agg(F.max_by("tag_value", F.struct("n", "tag_value")).alias("tag_value"))
    position = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("tag_key")).cast("int")
    labels = F.create_map(*[F.lit(x) for pair in TAG_LABELS.items() for x in pair])
    key = F.col("tag_key")
    capitalized = F.concat(F.upper(F.substring(key, 1, 1)), F.lower(F.substring(key, 2, 255)))
    return best.withColumn("position", position).withColumn("label", F.coalesce(F.try_element_at(labels, key), capitalized))


def notification_summary(notification_issues: DataFrame, limit: int | None = None) -> DataFrame:
    """Per notification: issue count and a row for each issue, or the first ``limit``."""
    w = Window.partitionBy("notification_id").orderBy("issue_id")
    shown = notification_issues.withColumn("position", F.row_number().over(w))
    shown = shown if limit is None else shown.where(F.col("position") <= limit)
    counts = notification_issues.groupBy("notification_id").agg(F.count(F.lit(1)).alias("issue_count"))
    return shown.join(counts, "notification_id")
