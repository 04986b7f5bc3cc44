"""Structured Streaming jobs.

Every job is a function of a streaming DataFrame and a target path below the shared
folder.  ``foreachBatch`` jobs write what a batch adds under ``batch_id=<n>`` and
overwrite it when the batch is retried, so a lost driver or executor never counts
twice; readers fold the pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import suppress
from datetime import UTC, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.timeparam import moment, slot, utc
from ..operators import alerts, issues, logs, uptime
from ..operators.segmented import join_on_keys, time_slot, with_row_number, written_once
from ..operators.upsert import first_per_key, update_matching
from ..sources import issuestore
from ..sources.keyedstore import KeyedStore
from ..sources.keyindex import FAN, KeyIndex
from ..sources.storage import drop_folders, exists
from ..sources.tablelog import Conflict

TAG_KEYS = ("issue_id", "organization_id", "tag_key", "tag_value")
LOG_KEYS = ("project_id", "organization_id", "level", "service_bucket", "environment_bucket")
CHECK_KEYS = ("organization_id",)

LATENESS = timedelta(minutes=20)
#: Batches between two snapshots of counters.
SNAPSHOT_EVERY = 100


def start(writer, checkpoint: str, *, once: bool = True, every: str = "60 seconds") -> StreamingQuery:
    """Start a prepared writer: drain what is there (``once``) or run for ever."""
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def file_stream(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    reader = spark.readStream.schema(schema)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.parquet(path)


def piece(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


# -- dedupe and sealing -------------------------------------------------------------

def deduplicate(events: DataFrame, path: str, time: str = "ts", key: str = "event_id"):
    """First occurrence of every event id, whenever it comes.

    What has been written is the table of known ids, by day of event time: a batch meets the
    days it has events of, so no event is late and none is dropped but a duplicate. A retried
    batch is compared with earlier batches only.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        first = first_per_key(batch, [key], [time]).withColumn("date", F.to_date(time))
        known = earlier_pieces(batch.sparkSession, path, batch_id)
        if known is not None:
            days = first.select("date").distinct()
            known = known.select(key, "date").join(days, "date", "left_semi")
            first = join_on_keys(first, known, [key, "date"], "left_anti")
        first.write.mode("overwrite").partitionBy("date").parquet(piece(path, batch_id))

    return events.writeStream.foreachBatch(write)


def earlier_pieces(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """What batches before ``batch_id`` wrote; None for the first."""
    if not exists(spark, path):
        return None
    return spark.read.parquet(path).where(F.col("batch_id") < batch_id)


def deduplicate_by_index(events: DataFrame, path: str, index: str, time: str = "ts", key: str = "event_id", fan: int = FAN):
    """As ``deduplicate``, with the known ids in a key index: a batch lists and opens a bounded number of its runs.

    An id is known whatever its event time is. Rows without an id are all kept.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ids = KeyIndex(spark, index, "date date", fan=fan)
        ids.merge(batch_id)
        named = batch.withColumn("date", F.to_date(time)).withColumn("_key", F.col(key).cast("string"))
        first = first_per_key(named.where("_key IS NOT NULL"), ["_key"], [time])
        known = ids.known(first.select(F.col("_key").alias("key")), batch_id)
        fresh = first.join(known.select(F.col("key").alias("_key")), "_key", "left_anti").select(*named.columns)
        out = piece(path, batch_id)
        fresh.unionByName(named.where("_key IS NULL")).drop("_key").write.mode("overwrite").partitionBy("date").parquet(out)
        if any(n.startswith("date=") for n in folder_names(spark, out)):
            written = spark.read.schema(T.StructType([*events.schema.fields, T.StructField("date", T.DateType())])).parquet(out)
            ids.add(written.select(F.col(key).cast("string").alias("key"), "date"), batch_id)
        else:
            ids.add(spark.createDataFrame([], "key string, date date"), batch_id)

    return events.writeStream.foreachBatch(write)


def seal_hours(spans: DataFrame, path: str, keys: list[str], lateness: timedelta = LATENESS):
    """Hourly totals of spans; those that come after their hour's seal go to ``rejected``.

    The clock is the newest event time of earlier batches, or a wall time that ``seal_idle`` noted after one
    of them. An hour is sealed once the clock is ``lateness`` past its end, so what ``sealed_hours`` has
    read never changes.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        edge = sealed_until(spark, path, lateness, batch_id)
        hour = slot("hour", F.col("timestamp"))
        late = F.lit(False) if edge is None else F.coalesce(hour + F.expr("INTERVAL 1 HOUR") <= moment(edge), F.lit(False))
        reason = F.when(F.col("timestamp").isNull(), "missing").when(late, "late")
        judged = batch.withColumn("hour_bucket", hour).withColumn("reason", reason).persist()
        judged.where("reason IS NOT NULL").drop("hour_bucket").write.mode("overwrite").parquet(piece(f"{path}/rejected", batch_id))
        good = judged.where("reason IS NULL")
        good.groupBy("hour_bucket", *keys).agg(F.count(F.lit(1)).alias("count"), F.sum("duration").alias("sum_duration")).write.mode("overwrite").parquet(piece(f"{path}/totals", batch_id))
        good.agg(F.max("timestamp").alias("newest")).write.mode("overwrite").parquet(piece(f"{path}/clock", batch_id))
        judged.unpersist()

    return spans.writeStream.foreachBatch(write)


def sealed_until(spark: SparkSession, path: str, lateness: timedelta = LATENESS, batch_id: int | None = None) -> datetime | None:
    """Hours that end by this time are sealed, by the events of all batches or of those before ``batch_id``."""
    shape, times = "newest timestamp_ntz, batch_id bigint", []
    for place in ("clock", "idle"):
        if exists(spark, f"{path}/{place}"):
            clock = spark.read.schema(shape).parquet(f"{path}/{place}")
            times.append((clock if batch_id is None else clock.where(F.col("batch_id") < batch_id)).agg(F.max("newest")).first()[0])
    newest = max((t for t in times if t is not None), default=None)
    return None if newest is None else newest - lateness


def seal_idle(spark: SparkSession, path: str, now: datetime) -> None:
    """Note the wall time while the stream of ``seal_hours`` has nothing to read, so that its open hours get sealed.

    Called between two drains, or by ``IdleSealer`` while a stream waits. The note counts for the batches after those that are
    done: a batch that is tried again judges its rows as it did before.
    """
    done = max((int(n[9:]) for n in folder_names(spark, f"{path}/clock") if n.startswith("batch_id=")), default=-1)
    note = spark.range(1).select(F.lit(utc(now).replace(tzinfo=None)).cast("timestamp_ntz").alias("newest"))
    note.write.mode("overwrite").parquet(piece(f"{path}/idle", done))


class IdleSealer(StreamingQueryListener):
    """Notes the wall time whenever a running query reports that it is idle; ``clock`` gives the time."""

    def __init__(self, spark: SparkSession, path: str, query_id: str | None = None, clock: Callable[[], datetime] = lambda: datetime.now(UTC)) -> None:
        super().__init__()
        self.session, self.path, self.query_id, self.clock = spark, path, query_id, clock

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        if self.query_id is None or str(event.id) == self.query_id:
            seal_idle(self.session, self.path, self.clock())

    def onQueryTerminated(self, event) -> None:
        pass


def sealed_hours(spark: SparkSession, path: str, keys: list[str], lateness: timedelta = LATENESS) -> DataFrame:
    """Totals of the hours that are complete."""
    edge = sealed_until(spark, path, lateness)
    totals = spark.read.parquet(f"{path}/totals")
    done = totals.where(F.lit(False) if edge is None else F.col("hour_bucket") + F.expr("INTERVAL 1 HOUR") <= moment(edge))
    return done.groupBy("hour_bucket", *keys).agg(F.sum("count").alias("count"), F.sum("sum_duration").alias("sum_duration"))


def append_files(rows: DataFrame, path: str, partitions: list[str]):
    """Exactly-once file sink."""
    return rows.writeStream.format("parquet").option("path", path).option("compression", "zstd").partitionBy(*partitions).outputMode("append")


# -- foreachBatch jobs -----------------------------------------------------------------

def in_pieces(rows: DataFrame, path: str, build: Callable[[DataFrame], DataFrame]):
    """Write ``build(batch)`` under the batch's own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        build(batch).write.mode("overwrite").parquet(piece(path, batch_id))

    return rows.writeStream.foreachBatch(write)


def hourly_counters(events: DataFrame, path: str, *keys: str, time: str = "received", snapshot_every: int = SNAPSHOT_EVERY):
    """Additive hour counters of events."""
    return counters(events, path, lambda batch: issues.hourly_counts(batch, *keys, time=time), keys, snapshot_every)


def tag_counters(tagged: DataFrame, path: str, snapshot_every: int = SNAPSHOT_EVERY):
    """Daily counts of issue tags (rows of ``tag_rows``)."""
    return counters(tagged, path, issues.daily_tag_counts, TAG_KEYS, snapshot_every)


def log_counters(levelled: DataFrame, path: str, snapshot_every: int = SNAPSHOT_EVERY):
    """Hourly counts of logs by level, service and environment bucket."""
    return counters(levelled, path, logs.hourly_stats, LOG_KEYS, snapshot_every)


def check_counters(checks: DataFrame, path: str, snapshot_every: int = SNAPSHOT_EVERY):
    """Hourly uptime checks per organisation."""
    return counters(checks, path, uptime.hourly_checks, CHECK_KEYS, snapshot_every)


def counters(rows: DataFrame, path: str, build: Callable[[DataFrame], DataFrame], keys: Sequence[str], snapshot_every: int = SNAPSHOT_EVERY):
    """Additive counters (``keys``, ``date``, ``count``); every so many batches the pieces are folded and removed."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        build(batch).write.mode("overwrite").parquet(piece(path, batch_id))
        if (batch_id + 1) % snapshot_every == 0:
            snapshot_counters(spark, path, batch_id, *keys)
            drop_covered(spark, path)

    return rows.writeStream.foreachBatch(write)


def drop_covered(spark: SparkSession, path: str) -> int:
    """Remove pieces that the newest complete snapshot covers, and older snapshots; the number of folders removed."""
    upto, snapshot = newest_snapshot(spark, path)
    if snapshot is None:
        return 0
    numbered = lambda root, mark: ((int(n[len(mark):]), f"{root}/{n}") for n in folder_names(spark, root) if n.startswith(mark))
    covered = [folder for n, folder in numbered(path, "batch_id=") if n <= upto]
    covered += [folder for n, folder in numbered(f"{path}-snapshots", "upto=") if n < upto]
    return drop_folders(spark, covered)


def read_counters(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """Totals: the newest snapshot plus the pieces written after it."""
    upto, snapshot = newest_snapshot(spark, path)
    names = [n for n in folder_names(spark, path) if n.startswith("batch_id=") and int(n[9:]) > upto]
    parts = [spark.read.parquet(*(f"{path}/{n}" for n in names)).select(*keys, "date", "count")] if names else []
    parts += [] if snapshot is None else [snapshot.select(*keys, "date", "count")]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys, "date").agg(F.sum("count").alias("count"))


def snapshot_counters(spark: SparkSession, path: str, upto: int, *keys: str, since: datetime | None = None) -> None:
    """Fold all pieces up to a batch into one snapshot, which readers then start from, without what is older than ``since``.

    A run that dies half way leaves a snapshot without its success mark, which nobody reads;
    pieces may be removed (``drop_covered``) once it is there.
    """
    before, snapshot = newest_snapshot(spark, path)
    pieces = spark.read.parquet(path).where(F.col("batch_id").between(before + 1, upto)).select(*keys, "date", "count")
    if snapshot is not None:
        pieces = pieces.unionByName(snapshot.select(*keys, "date", "count"))
    if since is not None:
        pieces = pieces.where(F.col("date") >= moment(since))
    folded = pieces.groupBy(*keys, "date").agg(F.sum("count").alias("count"))
    folded.write.mode("overwrite").parquet(f"{path}-snapshots/upto={upto}")


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder: batches since the last snapshot, or snapshots."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []


def newest_snapshot(spark: SparkSession, path: str) -> tuple[int, DataFrame | None]:
    done = [int(n[5:]) for n in folder_names(spark, f"{path}-snapshots") if n.startswith("upto=") and exists(spark, f"{path}-snapshots/{n}/_SUCCESS")]
    if not done:
        return -1, None
    return max(done), spark.read.parquet(f"{path}-snapshots/upto={max(done)}")


def split_good_bad(rows: DataFrame, path: str, reason):
    """Good rows to ``good``, the others with their reason to ``rejected`` - never lost, never fatal."""

    def write(batch: DataFrame, batch_id: int) -> None:
        judged = batch.withColumn("reason", reason).persist()
        judged.where("reason IS NULL").drop("reason").write.mode("overwrite").parquet(piece(f"{path}/good", batch_id))
        judged.where("reason IS NOT NULL").write.mode("overwrite").parquet(piece(f"{path}/rejected", batch_id))
        judged.unpersist()

    return rows.writeStream.foreachBatch(write)


def monitor_states(checks: DataFrame, monitors: DataFrame, path: str):
    """Continue every monitor's state from batch to batch and write the checks' outcomes.

    The state after batch n is a table of one row per monitor in ``state/batch_id=n``;
    batch n starts from the newest state before n.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        carry = latest_before(spark, f"{path}/state", batch_id)
        outcomes = piece(f"{path}/outcomes", batch_id)
        uptime.replay_states(batch, monitors, carry).write.mode("overwrite").parquet(outcomes)
        after = uptime.last_states(spark.read.parquet(outcomes))
        if carry is not None:
            after = after.unionByName(carry.join(after.select("monitor_id"), "monitor_id", "left_anti"))
        after.write.mode("overwrite").parquet(piece(f"{path}/state", batch_id))

    return checks.writeStream.foreachBatch(write)


def latest_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """The newest complete version of a table written by an earlier batch; versions before it are removed."""
    numbers = sorted(int(n[9:]) for n in folder_names(spark, path) if n.startswith("batch_id="))
    done = [n for n in numbers if n < batch_id and exists(spark, f"{piece(path, n)}/_SUCCESS")]
    if not done:
        return None
    drop_folders(spark, [piece(path, n) for n in numbers if n < done[-1]])
    return spark.read.parquet(piece(path, done[-1]))


def read_earlier(spark: SparkSession, path: str, batch_id: int, schema: str) -> DataFrame:
    """All pieces written by batches before ``batch_id`` (empty for the first)."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if batch_id == 0 or not fs.exists(fs_path):
        return spark.createDataFrame([], schema)
    stored = spark.read.schema(f"{schema}, batch_id bigint").parquet(path)
    return stored.where(F.col("batch_id") < batch_id).drop("batch_id")


def alerting(events: DataFrame, rules: DataFrame, history: str, path: str, clock: Callable[[int], datetime]):
    """After each batch evaluate the rules for the issues it touched, and note what is new.

    ``history`` collects the events (pieces per batch and day); ``clock`` gives the
    evaluation time.  Only the days of the longest rule window are read back; the rules are
    read anew for each batch, so one that is added later counts its whole window.
    """
    pair = "alert_id bigint, issue_id string, num_events bigint"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        columns = batch.select("project_id", "issue_id", "received")
        columns.withColumn("date", F.to_date("received")).write.mode("overwrite").partitionBy("date").parquet(piece(history, batch_id))
        longest = rules.agg(F.max("timespan_minutes")).first()[0] or 0
        horizon = (utc(clock(batch_id)) - timedelta(minutes=longest)).date()
        seen = spark.read.parquet(history).where((F.col("batch_id") <= batch_id) & (F.col("date") >= F.lit(horizon)))
        sent = read_earlier(spark, path, batch_id, pair)
        hits = alerts.evaluate_alerts(rules, seen, clock(batch_id), sent=sent, touched=columns)
        hits.select(F.col("alert_id").cast("bigint").alias("alert_id"), "issue_id", "num_events").write.mode("overwrite").parquet(piece(path, batch_id))

    return events.writeStream.foreachBatch(write)


SLOT_KEYS = ("project_id", "issue_id")
SENT_KEYS = ("alert_id", "issue_id")


def fold_before(spark: SparkSession, path: str, batch_id: int, keys: Sequence[str], every: int, since: datetime | None = None) -> DataFrame | None:
    """Counters as of the batches before one; every so many batches they are folded first, without what is older than ``since``.

    What a batch reads ends before itself, so one that is tried again reads what it read before.
    """
    if batch_id and batch_id % every == 0 and newest_snapshot(spark, path)[0] < batch_id - 1:
        snapshot_counters(spark, path, batch_id - 1, *keys, since=since)
        drop_covered(spark, path)
    upto, snapshot = newest_snapshot(spark, path)
    names = [n for n in folder_names(spark, path) if n.startswith("batch_id=") and upto < int(n[9:]) < batch_id]
    parts = [spark.read.parquet(*(f"{path}/{n}" for n in names)).select(*keys, "date", "count")] if names else []
    parts += [] if snapshot is None else [snapshot.select(*keys, "date", "count")]
    return reduce(DataFrame.unionByName, parts) if parts else None


def alerting_by_slots(events: DataFrame, rules: DataFrame, slots: str, sent: str, clock: Callable[[int], datetime], *,
                      keep: timedelta = timedelta(days=31), fold_every: int = SNAPSHOT_EVERY):
    """As ``alerting``, from counts per issue and minute instead of the events; the clock is cut to the minute.

    A batch adds its counts to ``slots`` and its alerts to ``sent``, both folded every ``fold_every`` batches.
    Minutes older than ``keep`` go with a fold, so no rule's window may be longer. A rule that is added later
    counts its whole window.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, now = batch.sparkSession, utc(clock(batch_id)).replace(second=0, microsecond=0)
        longest = rules.agg(F.max("timespan_minutes")).first()[0] or 0
        if timedelta(minutes=longest) > keep:
            raise ValueError(f"a rule's window of {longest} minutes is longer than what is kept")
        minute = F.date_trunc("minute", "received").cast("timestamp_ntz").alias("date")
        here = piece(slots, batch_id)
        batch.where("received IS NOT NULL").groupBy(*SLOT_KEYS, minute).agg(F.count(F.lit(1)).alias("count")).write.mode("overwrite").parquet(here)
        mine = spark.read.parquet(here)
        before = fold_before(spark, slots, batch_id, SLOT_KEYS, fold_every, now - keep)
        counts = mine if before is None else mine.unionByName(before)
        told = fold_before(spark, sent, batch_id, SENT_KEYS, fold_every)
        hits = alerts.evaluate_alerts(
            rules, counts.withColumnRenamed("date", "received"), now, sent=told, touched=mine.select("issue_id"), weight="count")
        found = hits.select(F.col("alert_id").cast("bigint").alias("alert_id"), "issue_id", F.lit(now.replace(tzinfo=None)).cast("timestamp_ntz").alias("date"), F.col("num_events").alias("count"))
        found.write.mode("overwrite").parquet(piece(sent, batch_id))

    return events.writeStream.foreachBatch(write)


def group_events(events: DataFrame, path: str):
    """Issue changes per batch: one small row per (project, hash), folded by ``fold_issues``."""

    def build(batch: DataFrame) -> DataFrame:
        extra = batch.groupBy(*issues.EVENT_KEYS).agg(
            F.min("release").alias("release_min"), F.max("release").alias("release_max"), F.min("event_id").alias("_e")
        ).drop("_e")
        return join_on_keys(issues.group_batch(batch), extra, issues.EVENT_KEYS)

    return in_pieces(events, path, build)


def group_into_store(events: DataFrame, path: str, name: str, clock: Callable[[int], datetime], fold_every: int = SNAPSHOT_EVERY):
    """Grouping into the keyed store at ``path``, beside other writers; a batch that is tried again is known by its run.

    ``name`` tells the streams that write to one store apart. Every ``fold_every`` batches the buckets that have deltas get a
    new base; a fold that meets another one leaves it to that.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        store = KeyedStore(batch.sparkSession, path)
        issuestore.group_into(store, batch, clock(batch_id), f"{name}-{batch_id}")
        if (batch_id + 1) % fold_every == 0:
            with suppress(Conflict):
                store.fold(clock(batch_id))

    return events.writeStream.foreachBatch(write)


def reopened_by(folded: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored resolved issues that the folded events reopen.

    A release other than the resolving one occurred iff the smallest or largest differs.
    """
    state = stored.select(*issues.EVENT_KEYS, "status", "resolved_in_release")
    other = (F.col("release_min") != F.col("resolved_in_release")) | (F.col("release_max") != F.col("resolved_in_release"))
    hit = (F.col("status") == issues.RESOLVED) & (F.col("resolved_in_release").isNull() | F.coalesce(other, F.lit(False)))
    return join_on_keys(folded, state, issues.EVENT_KEYS).where(hit)


def fold_notifications(deltas: DataFrame, stored: DataFrame, links: DataFrame) -> DataFrame:
    """Notification links without the notifications of issues that the deltas reopen."""
    releases = deltas.groupBy(*issues.EVENT_KEYS).agg(F.min("release_min").alias("release_min"), F.max("release_max").alias("release_max"))
    named = stored.select(*issues.EVENT_KEYS, F.col("issue_id"))
    gone = join_on_keys(reopened_by(releases, stored), named, issues.EVENT_KEYS).select("issue_id")
    return issues.drop_notifications(links, gone)


def fold_issues(deltas: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Issues from the change rows of all batches (``batch_id`` column), on top of a stored table.

    Counts add, the first event names the issue, the newest batch that brought a
    release sets the last release.
    """
    earliest = F.struct("first_seen", "batch_id")
    first = lambda c: F.min_by(c, earliest).alias(c)
    folded = deltas.groupBy(*issues.EVENT_KEYS).agg(
        F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        first("title"), first("culprit"), first("type"), first("level"), first("organization_id"), first("first_release"),
        F.max_by("last_release", F.when(F.col("last_release").isNotNull(), F.col("batch_id"))).alias("last_release"),
        F.min("release_min").alias("release_min"), F.max("release_max").alias("release_max"),
    ).withColumn("issue_id", issues.issue_key(F.col("project_id"), F.col("hash")))
    if stored is None:
        return folded.drop("release_min", "release_max")
    reopened = reopened_by(folded, stored)
    added = folded.select("issue_id", F.col("count").alias("added"), "last_seen", "last_release")
    known = issues.apply_rollup(stored, added)
    known = update_matching(known, reopened, ["issue_id"], status=F.lit(issues.UNRESOLVED), resolved_in_release=F.lit(None).cast("string"))
    fresh = join_on_keys(folded.drop("release_min", "release_max"), stored, issues.EVENT_KEYS, "left_anti")
    fresh = fresh.withColumn("status", F.lit(issues.UNRESOLVED)).withColumn("resolved_in_release", F.lit(None).cast("string"))
    columns = [*issues.EVENT_KEYS, "issue_id", "title", "count", "first_seen", "last_seen", "last_release", "status", "resolved_in_release"]
    if "short_id" in stored.columns:
        # New issues go on where their project's numbers end.
        fresh = with_row_number(written_once(fresh, "fresh"), ["project_id"], time_slot(F.col("first_seen"), issues.SLOT), ["first_seen", "hash"], "short_id")
        top = stored.groupBy("project_id").agg(F.max("short_id").alias("_top"))
        fresh = fresh.join(top, "project_id", "left").withColumn("short_id", F.col("short_id") + F.coalesce("_top", F.lit(0)))
        columns.append("short_id")
    return known.select(*columns).unionByName(fresh.select(*columns))
