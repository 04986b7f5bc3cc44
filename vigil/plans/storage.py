"""Storage-job queries: each writes below the shared folder and reads back what it wrote."""

from __future__ import annotations

import hashlib
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import functions as F

from ..functions.ids import uuid7_from_timestamp
from ..operators import spans as S
from ..sources import storage as W
from ..sources.keyindex import KeyIndex
from ..sources.tablelog import TableLog
from .registry import NOW, Tables, query


def archived_events(t: Tables, label: str) -> str:
    path = t.scratch(label)
    rows = t("issue_events").withColumn("id", uuid7_from_timestamp(F.col("received"), F.col("event_id")))
    W.archive(rows, path, "received", sort="id", lookups=True)
    return path


def per_day(df, *extra):
    return df.groupBy("organization_id", F.to_date("date").alias("date"), *extra).agg(F.count(F.lit(1)).alias("count"))


@query("s01_partitioned_scan", """
SELECT event_id, project_id, received FROM issue_events WHERE organization_id = 2 AND received >= TIMESTAMP '2024-01-09 06:00:00' AND received < TIMESTAMP '2024-01-21 00:00:00'""")
def partitioned_scan(t: Tables):
    table = t.spark.read.parquet(archived_events(t, "scan"))
    found = W.scan(table, "received", datetime(2024, 1, 9, 6), datetime(2024, 1, 21), organization_id=2)
    return found.select("event_id", "project_id", "received")


@query("s02_tolerant_scan", "SELECT organization_id, CAST(received AS DATE) AS date, count(*) AS count FROM issue_events GROUP BY ALL")
def tolerant_scan(t: Tables):
    """A broken file in the folder is skipped, everything else is read."""
    path = archived_events(t, "tolerant")
    schema = t.spark.read.parquet(path).schema
    t("region").select("r_name").write.mode("append").text(f"{path}/organization_id=1/date=2024-01-03/run_id=base/broken.parquet")
    return per_day(W.read_tolerant(t.spark, path, schema))


@query("s03_archive_logs", """
SELECT organization_id, CAST(timestamp AS DATE) AS date, count(*) AS count FROM logs WHERE organization_id IN (0, 2) GROUP BY ALL""")
def archive_logs(t: Tables):
    """Only eligible organisations; a second run finds nothing left to do."""
    path, eligible = t.scratch("logs"), t("organizations").where("NOT is_deleted AND scrub_ip").select(F.col("organization_id").cast("int").alias("organization_id"))
    rows = t("logs")
    W.archive(rows, path, "timestamp", sort="log_id", eligible=eligible)
    again = W.unarchived(rows.join(eligible, "organization_id", "left_semi"), t.spark.read.parquet(path), "timestamp")
    W.archive(again, path, "timestamp", sort="log_id")
    return per_day(t.spark.read.parquet(path))


@query("s04_archive_events", """
SELECT event_id, title FROM issue_events WHERE event_id = (SELECT min(event_id) FROM issue_events WHERE organization_id = 1 AND CAST(received AS DATE) = DATE '2024-01-15')""")
def archive_events(t: Tables):
    """Small row groups and a bloom filter on the id: one event by its id."""
    table = t.spark.read.parquet(archived_events(t, "events"))
    one_day = table.where((F.col("organization_id") == 1) & (F.col("date") == F.lit(date(2024, 1, 15))))
    wanted = one_day.agg(F.min_by("id", "event_id").alias("id"))
    return one_day.join(wanted, "id").select("event_id", "title")


STAGED = "CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN timestamp + INTERVAL 60 DAY ELSE timestamp END"
PROMOTED = f"""
staged AS (SELECT span_id, organization_id, timestamp AS inserted, {STAGED} AS timestamp FROM spans WHERE timestamp < TIMESTAMP '2024-01-31 11:55:00'),
judged AS (SELECT *, coalesce(timestamp >= TIMESTAMP '2024-01-01 12:00:00' AND timestamp <= TIMESTAMP '2024-01-31 13:00:00', FALSE) AS kept FROM staged)"""


def staged(t: Tables):
    rows = S.describe_spans(t("spans"))
    return rows.withColumn("inserted", F.col("timestamp")).withColumn("timestamp", F.expr(STAGED.replace("INTERVAL 60 DAY", "INTERVAL '60' DAY")))


@query("s05_promote_spans", f"""
WITH {PROMOTED}
SELECT count(*) AS consumed, count(*) FILTER (WHERE kept) AS kept, count(*) FILTER (WHERE NOT kept) AS dropped FROM judged""")
def promote_spans(t: Tables):
    return W.promote_spans(staged(t), t.scratch("spans"), NOW + timedelta(hours=12))


@query("s05_promote_twice", f"""
WITH {PROMOTED}
SELECT organization_id, CAST(timestamp AS DATE) AS date, count(*) AS count FROM judged WHERE kept GROUP BY ALL""")
def promote_twice(t: Tables):
    """Every day is promoted in two runs, and the second is tried again: no span is lost or doubled."""
    path, rows, now = t.scratch("spans-twice"), staged(t), NOW + timedelta(hours=12)
    for run, odd in (("first", 0), ("second", 1), ("second", 1)):
        W.promote_spans(rows.where(F.col("event_id") % 2 == odd), path, now, run_id=run)
    return per_day(W.current(t.spark, path))


@query("s05_left_in_staging", """
SELECT span_id FROM spans WHERE timestamp >= TIMESTAMP '2024-01-31 11:55:00' OR event_id % 2 = 1""")
def left_in_staging(t: Tables):
    """Exactly what a run wrote, kept or rejected, leaves staging."""
    path, rows = t.scratch("spans-left"), staged(t)
    W.promote_spans(rows.where("event_id % 2 = 0"), path, NOW + timedelta(hours=12), run_id="first")
    return W.unpromoted(rows, path).select("span_id")


@query("s06_compact_hours", f"""
WITH {PROMOTED}
SELECT organization_id, CAST(timestamp AS DATE) AS date, CAST(hour(timestamp) AS INT) AS hour, count(*) AS count FROM judged WHERE kept GROUP BY ALL""")
def compact_hours(t: Tables):
    """All days of all organisations are compacted, twice; their files change, their rows do not."""
    path, rows, now = t.scratch("compact-source"), staged(t), NOW + timedelta(hours=12)
    for run, rest in (("a", 0), ("b", 1), ("c", 2)):
        W.promote_spans(rows.where(F.col("event_id") % 3 == rest), path, now, run_id=run)
    for _ in range(2):
        W.compact_days(t.spark, path, now, run_id="days")
    W.drop_compacted(t.spark, path)
    return per_day(W.current(t.spark, path).withColumn("hour", F.hour("timestamp")), "hour")


@query("s06_seal_all_hours", f"""
WITH {PROMOTED},
early AS (SELECT organization_id, date_trunc('hour', timestamp) AS hour, count(*) AS count FROM judged WHERE kept AND span_id NOT IN (SELECT span_id FROM spans WHERE event_id % 5 = 0) GROUP BY ALL),
late AS (SELECT j.organization_id, date_trunc('hour', j.timestamp) AS hour, count(*) AS count FROM judged j WHERE j.kept AND j.span_id IN (SELECT span_id FROM spans WHERE event_id % 5 = 0)
 GROUP BY ALL),
done AS (SELECT organization_id, hour, count FROM early WHERE hour + INTERVAL 1 HOUR < TIMESTAMP '2024-01-31 11:40:00')
SELECT 'sealed' AS kind, organization_id, hour, CAST(count AS BIGINT) AS count FROM done
UNION ALL SELECT 'sealed' AS kind, l.organization_id, l.hour, CAST(l.count AS BIGINT) AS count FROM late l LEFT JOIN early e ON e.organization_id = l.organization_id AND e.hour = l.hour
 WHERE e.hour IS NULL AND l.hour + INTERVAL 1 HOUR < TIMESTAMP '2024-01-31 11:40:00'
UNION ALL SELECT 'late' AS kind, l.organization_id, l.hour, CAST(l.count AS BIGINT) AS count FROM late l JOIN done d ON d.organization_id = l.organization_id AND d.hour = l.hour""")
def seal_all_hours(t: Tables):
    """Every sealed hour is rolled once; spans that come after the seal are rejected, those of an unknown hour make a new one."""
    path, rollups, rows, now = t.scratch("seal"), t.scratch("seal-rollups"), staged(t), NOW + timedelta(hours=12)
    roll = lambda spans: S.hourly_rollup(spans, exact=False)
    W.promote_spans(rows.where("event_id % 5 <> 0"), path, now, run_id="first")
    for _ in range(2):
        closed = W.seal_hours(t.spark, path, rollups, now, roll, run_id="first")
    W.promote_spans(rows.where("event_id % 5 = 0"), path, now, run_id="second", closed=closed)
    W.seal_hours(t.spark, path, rollups, now, roll, run_id="second")
    hours = t.spark.read.parquet(rollups).groupBy("organization_id", F.col("hour_bucket").alias("hour")).agg(F.sum("count").alias("count"))
    late = t.spark.read.parquet(f"{path}-rejected").where("reason = 'late'").groupBy("organization_id", W.hour_of("timestamp").alias("hour")).agg(F.count(F.lit(1)).alias("count"))
    return hours.select(F.lit("sealed").alias("kind"), "*").unionByName(late.select(F.lit("late").alias("kind"), "*"))


@query("s06_sealed_hours", """
SELECT span_id, timestamp FROM spans WHERE date_trunc('hour', timestamp) + INTERVAL 1 HOUR < TIMESTAMP '2024-01-20 12:30:00' - INTERVAL 20 MINUTE""")
def sealed_hours(t: Tables):
    return W.sealed(t("spans"), datetime(2024, 1, 20, 12, 30)).select("span_id", "timestamp")


@query("s08_read_by_tier", """
SELECT span_id, CASE WHEN CAST(timestamp AS DATE) < DATE '2024-01-10' THEN 'day' WHEN hour(timestamp) < 12 THEN 'hour' ELSE 'chunk' END AS tier FROM spans""")
def read_by_tier(t: Tables):
    """Stale chunk and hour copies exist next to the newer tier; each row is read once."""
    rows = t("spans").select(
        "span_id", "organization_id", F.to_date("timestamp").alias("date"), F.hour("timestamp").alias("hour")
    )
    edge = F.lit(date(2024, 1, 10))
    # Every organisation-hour of the first days has a day file, of the mornings an hour file.
    days = rows.where(F.col("date") < edge).withColumn("tier", F.lit("day"))
    hours = rows.where((F.col("date") < edge) | (F.col("hour") < 12)).withColumn("tier", F.lit("hour"))
    chunks = rows.withColumn("tier", F.lit("chunk"))
    return W.read_by_tier(chunks, hours, days).select("span_id", "tier")


@query("s09_rewrite_excluding_project", """
SELECT organization_id, CAST(received AS DATE) AS date, project_id, count(*) AS count FROM issue_events WHERE NOT (organization_id = 0 AND project_id = 3) GROUP BY ALL""")
def rewrite_excluding_project(t: Tables):
    path = archived_events(t, "rewrite-source")
    W.rewrite_excluding(t.spark, path, 0, project_id=3)
    return per_day(t.spark.read.parquet(path), "project_id")


@query("s09_rewrite_excluding_issues", """
SELECT organization_id, CAST(received AS DATE) AS date, count(*) AS count FROM issue_events e
WHERE NOT (organization_id = 2 AND EXISTS (SELECT 1 FROM issues i WHERE i.issue_id = e.issue_id AND i.status = 0)) GROUP BY ALL""")
def rewrite_excluding_issues(t: Tables):
    path = archived_events(t, "rewrite-issues")
    W.rewrite_excluding(t.spark, path, 2, gone=t("issues").where("status = 0"))
    return per_day(t.spark.read.parquet(path))


@query("s10_purge_organization", """
SELECT 'events' AS dataset, organization_id, count(*) AS count FROM issue_events WHERE organization_id <> 1 GROUP BY organization_id
UNION ALL SELECT 'logs' AS dataset, organization_id, count(*) AS count FROM logs WHERE organization_id <> 1 GROUP BY organization_id""")
def purge_organization(t: Tables):
    events, logs = archived_events(t, "purge-events"), t.scratch("purge-logs")
    W.archive(t("logs"), logs, "timestamp", sort="log_id")
    W.purge_organization(t.spark, [events, logs], 1)
    parts = [
        t.spark.read.parquet(path).groupBy("organization_id").agg(F.count(F.lit(1)).alias("count")).select(F.lit(name).alias("dataset"), "*")
        for name, path in (("events", events), ("logs", logs))
    ]
    return parts[0].unionByName(parts[1])


@query("s11_expire_days", """
SELECT organization_id, CAST(received AS DATE) AS date, count(*) AS count FROM issue_events WHERE CAST(CAST(received AS DATE) AS TIMESTAMP) >= <<now>> - INTERVAL 12 DAY GROUP BY ALL""")
def expire_days(t: Tables):
    path = archived_events(t, "expire")
    W.expire(t.spark, path, 12, NOW)
    return per_day(t.spark.read.parquet(path))


@query("s13_archive_then_expire", """
SELECT CASE WHEN timestamp >= TIMESTAMP '2024-01-24 00:00:00' THEN 'hot' ELSE 'cold' END AS tier, organization_id, CAST(timestamp AS DATE) AS date, count(*) AS count
FROM logs WHERE CAST(CAST(timestamp AS DATE) AS TIMESTAMP) >= <<now>> - INTERVAL 25 DAY GROUP BY ALL""")
def archive_then_expire(t: Tables):
    path = t.scratch("archive-expire")
    hot, _ = W.archive_then_expire(t.spark, t("logs"), path, "timestamp", sort="log_id", hot_days=7, days=25, now=NOW)
    cold = per_day(t.spark.read.parquet(path)).select(F.lit("cold").alias("tier"), "*")
    return cold.unionByName(per_day(hot.withColumn("date", F.to_date("timestamp"))).select(F.lit("hot").alias("tier"), "*"))


@query("s13_archive_late_rows", """
WITH cold AS (SELECT organization_id, CAST(timestamp AS DATE) AS date, count(*) AS count FROM logs WHERE timestamp < TIMESTAMP '2024-01-24 00:00:00' GROUP BY ALL),
runs AS (SELECT log_id % 3 = 0 AS late, count(*) AS n FROM logs WHERE timestamp < TIMESTAMP '2024-01-24 00:00:00' GROUP BY ALL)
SELECT 'cold' AS tier, organization_id, date, count FROM cold
UNION ALL SELECT 'hot' AS tier, organization_id, CAST(timestamp AS DATE) AS date, count(*) AS count FROM logs WHERE timestamp >= TIMESTAMP '2024-01-24 00:00:00' AND log_id % 3 = 0 GROUP BY ALL
UNION ALL SELECT CASE WHEN late THEN 'archived late' ELSE 'archived first' END AS tier, 0 AS organization_id, DATE '2024-01-31' AS date, n AS count FROM runs""")
def archive_late_rows(t: Tables):
    """Rows of archived days that come later join them; a retry changes nothing."""
    path, logs, reports = t.scratch("archive-late"), t("logs"), {}
    for run, rows in (("first", "log_id % 3 <> 0"), ("late", "log_id % 3 = 0"), ("late", "log_id % 3 = 0")):
        hot, reports[run] = W.archive_then_expire(t.spark, logs.where(rows), path, "timestamp", sort="log_id", hot_days=7, days=90, now=NOW, run_id=run)
    told = t.spark.createDataFrame([(f"archived {run}", 0, NOW.date(), r["archived"]) for run, r in reports.items()], "tier string, organization_id int, date date, count bigint")
    cold = per_day(t.spark.read.parquet(path)).select(F.lit("cold").alias("tier"), "*")
    warm = per_day(hot.withColumn("date", F.to_date("timestamp"))).select(F.lit("hot").alias("tier"), "*")
    return cold.unionByName(warm).unionByName(told)


@query("u05_concatenate_rollups", """
SELECT organization_id, CAST(hour_bucket AS DATE) AS date, count(*) AS rollups, CAST(sum(count) AS BIGINT) AS spans FROM (
 SELECT organization_id, project_id, transaction_name, op, date_trunc('hour', timestamp) AS hour_bucket, count(*) AS count FROM (SELECT *, <<describe>> AS description FROM spans) d
 GROUP BY organization_id, project_id, transaction_name, op, description, date_trunc('hour', timestamp)) r GROUP BY ALL""")
def concatenate_rollups(t: Tables):
    """A day's rollups are its hours' rows put together, not aggregated again."""
    path = t.scratch("rollups")
    rolled = S.hourly_rollup(S.describe_spans(t("spans")), exact=False)
    W.archive(rolled, path, "hour_bucket", sort="hour_bucket")
    days = t.scratch("rollup-days")
    W.archive(t.spark.read.parquet(path).drop("date"), days, "hour_bucket", sort="transaction_name")
    return t.spark.read.parquet(days).groupBy("organization_id", "date").agg(
        F.count(F.lit(1)).alias("rollups"), F.sum("count").alias("spans")
    )


# -- deletes and retention after compaction -------------------------------------------------

def compacted_events(t: Tables, label: str) -> str:
    """Issue events archived by two runs whose days are compacted; the runs' folders are gone."""
    path, rows = t.scratch(label), t("issue_events")
    for run, odd in (("first", 0), ("second", 1)):
        W.archive(rows.where(F.col("event_id") % 2 == odd), path, "received", sort="event_id", run_id=run)
    W.compact_days(t.spark, path, NOW + timedelta(days=2), run_id="days", sort="event_id")
    W.drop_compacted(t.spark, path)
    return path


@query("s09_after_compaction", """
SELECT organization_id, CAST(received AS DATE) AS date, project_id, count(*) AS count FROM issue_events e WHERE NOT (organization_id = 0 AND project_id = 3)
 AND NOT (organization_id = 2 AND EXISTS (SELECT 1 FROM issues i WHERE i.issue_id = e.issue_id AND i.status = 0)) GROUP BY ALL""")
def rewrite_after_compaction(t: Tables):
    path = compacted_events(t, "rewrite-compacted")
    W.rewrite_excluding(t.spark, path, 0, project_id=3)
    W.rewrite_excluding(t.spark, path, 2, gone=t("issues").where("status = 0"))
    return per_day(W.current(t.spark, path), "project_id")


@query("s10_after_compaction", "SELECT organization_id, CAST(received AS DATE) AS date, count(*) AS count FROM issue_events WHERE organization_id <> 1 GROUP BY ALL")
def purge_after_compaction(t: Tables):
    path = compacted_events(t, "purge-compacted")
    W.purge_organization(t.spark, [path], 1)
    return per_day(W.current(t.spark, path))


@query("s11_after_compaction", """
SELECT organization_id, CAST(received AS DATE) AS date, count(*) AS count FROM issue_events WHERE CAST(CAST(received AS DATE) AS TIMESTAMP) >= <<now>> - INTERVAL 12 DAY GROUP BY ALL""")
def expire_after_compaction(t: Tables):
    path = compacted_events(t, "expire-compacted")
    W.expire(t.spark, path, 12, NOW)
    return per_day(W.current(t.spark, path))


# -- the table log --------------------------------------------------------------------------

def event_log(t: Tables, label: str, parts: int = 3) -> TableLog:
    """Issue events in a table log, appended by several runs."""
    rows = t("issue_events")
    log = TableLog.create(t.spark, t.scratch(label), rows.schema, "received", "event_id")
    for part in range(parts):
        log.append(rows.where(F.col("event_id") % parts == part), NOW, run_id=f"run-{part}")
    return log


@query("s06_log_compaction", """
SELECT organization_id, CAST(received AS DATE) AS date, project_id, count(*) AS count, CAST(sum(event_id) AS BIGINT) AS ids FROM issue_events GROUP BY ALL""")
def log_compaction(t: Tables):
    """A retried run and two compactions change files, not rows."""
    log = event_log(t, "log-compaction")
    log.append(t("issue_events").where("event_id % 3 = 1"), NOW, run_id="run-1")
    for _ in range(2):
        log.compact(NOW + timedelta(days=2))
    log.vacuum(NOW + timedelta(days=4000), NOW)
    return log.scan().groupBy("organization_id", "date", "project_id").agg(F.count(F.lit(1)).alias("count"), F.sum("event_id").alias("ids"))


@query("s08_log_versions", """
SELECT v.version, organization_id, count(*) AS count FROM issue_events, (VALUES (1), (2), (4)) v(version)
WHERE (v.version = 1 AND event_id % 3 = 0) OR (v.version = 2 AND event_id % 3 < 2) OR (v.version = 4 AND project_id <> 3) GROUP BY ALL""")
def log_versions(t: Tables):
    """Old versions stay readable beside deletes and compactions."""
    log = event_log(t, "log-versions")
    for organization in range(3):
        log.delete(organization, NOW, project_id=3)
        if organization == 0:
            log.compact(NOW + timedelta(days=2))
    state = {1: 1, 2: 2, 4: log.latest()}
    parts = [log.scan(version=at).groupBy("organization_id").agg(F.count(F.lit(1)).alias("count")).select(F.lit(v).alias("version"), "*") for v, at in state.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s09_log_deletes", """
SELECT organization_id, project_id, CAST(received AS DATE) AS date, count(*) AS count FROM issue_events e WHERE event_id % 3 = 2
 OR NOT ((organization_id = 0 AND project_id = 3) OR (organization_id = 2 AND EXISTS (SELECT 1 FROM issues i WHERE i.issue_id = e.issue_id AND i.status = 0))) GROUP BY ALL""")
def log_deletes(t: Tables):
    """Records hide a project and a set of issues; rows that come later stay, before and after the files are rewritten."""
    rows = t("issue_events")
    log = TableLog.create(t.spark, t.scratch("log-deletes-late"), rows.schema, "received", "event_id")
    for part in range(3):
        if part == 2:
            log.delete(0, NOW, project_id=3)
            log.delete(2, NOW, issues=t("issues").where("status = 0"))
            log.compact(NOW + timedelta(days=2))
        log.append(rows.where(F.col("event_id") % 3 == part), NOW)
    return log.scan().groupBy("organization_id", "project_id", "date").agg(F.count(F.lit(1)).alias("count"))


@query("s10_log_purge", "SELECT organization_id, count(*) AS count FROM issue_events WHERE organization_id <> 1 OR event_id % 50 = 0 GROUP BY ALL")
def log_purge(t: Tables):
    """An organisation goes by its files; what it sends afterwards is kept."""
    log = event_log(t, "log-purge", parts=2)
    log.compact(NOW + timedelta(days=2))
    log.purge_organization(1, NOW)
    log.append(t("issue_events").where("organization_id = 1 AND event_id % 50 = 0"), NOW, run_id="afterwards")
    return log.scan().groupBy("organization_id").agg(F.count(F.lit(1)).alias("count"))


@query("s11_log_retention", """
SELECT organization_id, CAST(received AS DATE) AS date, count(*) AS count FROM issue_events WHERE CAST(CAST(received AS DATE) AS TIMESTAMP) >= <<now>> - INTERVAL 12 DAY
 AND received < TIMESTAMP '2024-01-28 06:00:00' GROUP BY ALL""")
def log_retention(t: Tables):
    log = event_log(t, "log-retention", parts=2)
    log.compact(NOW + timedelta(days=2))
    log.expire(12, NOW)
    return per_day(log.scan(end=datetime(2024, 1, 28, 6)))


# -- the key index --------------------------------------------------------------------------

@query("p09_uuid4_lookup", """
SELECT event_id, project_id, received FROM issue_events WHERE event_id IN (17, (SELECT CAST(floor(max(event_id) / 2) AS BIGINT) FROM issue_events))""")
def uuid4_lookup(t: Tables):
    """Client ids say nothing of their day: the index names organisation and day, and the scan opens that folder."""
    path, index = t.scratch("client-ids"), KeyIndex(t.spark, t.scratch("client-id-index"), "organization_id int, date date", fan=3)
    rows = t("issue_events").withColumn("id", F.md5(F.concat(F.lit("c"), F.col("event_id").cast("string"))))
    W.archive(rows, path, "received", sort="id", lookups=True)
    for batch in range(4):
        index.merge(batch)
        index.add(rows.where(F.col("event_id") % 4 == batch).select(F.col("id").alias("key"), "organization_id", F.to_date("received").alias("date")), batch)
    middle = t("issue_events").agg(F.max("event_id")).first()[0] // 2
    parts = []
    for event in sorted({17, middle}):
        uid = hashlib.md5(f"c{event}".encode()).hexdigest()
        for place in index.lookup(uid).collect():
            day = (F.col("organization_id") == place["organization_id"]) & (F.col("date") == F.lit(place["date"]))
            parts.append(t.spark.read.parquet(path).where(day & (F.col("id") == uid)).select("event_id", "project_id", "received"))
    return reduce(lambda a, b: a.unionByName(b), parts)
