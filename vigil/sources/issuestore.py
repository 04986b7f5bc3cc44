"""Issues by (project, hash) in a keyed store: batches of events add to them, new ones get the next number of their project."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.issues import EVENT_KEYS, SLOT
from ..operators.segmented import join_on_keys, time_slot, with_row_number, written_once
from .keyedstore import BUCKETS, KeyedStore
from .tablelog import Conflict

SCHEMA = (
    "project_id int, hash string, count bigint, first_seen timestamp_ntz, last_seen timestamp_ntz, titled_at timestamp_ntz, title string, "
    "released_at timestamp_ntz, last_release string, short_id bigint"
)
RULES = {
    "count": "sum", "first_seen": "min", "last_seen": "max", "titled_at": "min", "title": "first titled_at",
    "released_at": "max", "last_release": "last released_at", "short_id": "min",
}
TRIES = 20


def create(spark: SparkSession, path: str, buckets: int = BUCKETS) -> KeyedStore:
    return KeyedStore.create(spark, path, SCHEMA, EVENT_KEYS, RULES, buckets)


def changes(events: DataFrame) -> DataFrame:
    """What each event adds to its issue."""
    at = F.col("received")
    return events.select(
        *EVENT_KEYS, F.lit(1).cast("bigint").alias("count"), at.alias("first_seen"), at.alias("last_seen"),
        F.when(F.col("title").isNotNull(), at).alias("titled_at"), "title",
        F.when(F.col("release").isNotNull(), at).alias("released_at"), F.col("release").alias("last_release"), F.lit(None).cast("bigint").alias("short_id"),
    )


def group_into(store: KeyedStore, events: DataFrame, now: datetime, run_id: str) -> int:
    """Add a batch of events; the version it is in.

    Counts and times of known issues add up beside any other writer. The numbers of new issues depend on what the project has, so
    a batch that brings new issues to a project that got others meanwhile is numbered again.
    """
    if (there := store.committed(run_id)) is not None:
        return there
    batch = written_once(store.merged(changes(events)), "batch-issues")
    for _ in range(TRIES):
        version = store.latest()
        # Issues are few beside events; numbering reads the new ones several times.
        fresh = written_once(join_on_keys(batch.drop("short_id"), store.read(version, batch), EVENT_KEYS, "left_anti"), "new-issues")
        numbered = with_row_number(fresh, ["project_id"], time_slot(F.col("first_seen"), SLOT), ["first_seen", "hash"], "short_id")
        top = store.pieces(version).groupBy("project_id").agg(F.max("short_id").alias("_top"))
        numbered = join_on_keys(numbered, top, ["project_id"], "left").select(
            *EVENT_KEYS, (F.col("short_id") + F.coalesce("_top", F.lit(0))).alias("short_id"))
        try:
            return store.commit(
                join_on_keys(batch.drop("short_id"), numbered, EVENT_KEYS, "left"), now, run_id, read=version, scope=["project_id"], where="short_id IS NOT NULL")
        except Conflict:
            continue
    raise Conflict(f"run {run_id} met other writers {TRIES} times")
