"""Streaming jobs run over the tables until their input is drained."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ..operators.maintenance import acceptable_spans
from ..functions.timeparam import moment
from ..sources import issuestore, telemetry_json as J
from ..streaming import heartbeats, jobs
from .issues import BATCHED_SQL, issue_rows
from .logs import LEVELLED, levelled
from .monitoring import REPLAY_SQL, STATE_COLUMNS, checks as ordered_checks
from .registry import NOW, Tables, query


def source(t: Tables, rows: DataFrame, label: str) -> str:
    path = t.scratch(f"{label}-in")
    rows.write.parquet(path)
    return path


def drain(t: Tables, label: str, slices: list[DataFrame], make) -> None:
    """Feed the slices one after the other, restarting the job from its checkpoint each time."""
    path, checkpoint = t.scratch(f"{label}-in"), t.scratch(f"{label}-checkpoint")
    for part in slices:
        part.write.mode("append").parquet(path)
        stream = jobs.file_stream(t.spark, path, part.schema)
        jobs.start(make(stream), checkpoint).awaitTermination()


def by_half(rows: DataFrame, time: str, at: str) -> list[DataFrame]:
    edge = F.lit(at).cast("timestamp_ntz")
    return [rows.where(F.col(time) < edge), rows.where(F.col(time) >= edge)]


@query("st01_stream_dedupe", "SELECT event_id, event_type FROM events")
def stream_dedupe(t: Tables):
    """Every event arrives twice in one batch."""
    out, events = t.scratch("dedupe"), t("events").select("event_id", "ts", "event_type")
    drain(t, "dedupe", [events.unionByName(events)], lambda s: jobs.deduplicate(s, out))
    return t.spark.read.parquet(out).select("event_id", "event_type")


@query("st01_late_events", "SELECT event_id, event_type FROM events")
def stream_late_events(t: Tables):
    """The newer half comes first, the older one days later, a third of the newer ones again with it."""
    out, events = t.scratch("dedupe-late"), t("events").select("event_id", "ts", "event_type")
    older, newer = by_half(events, "ts", "2024-01-10")
    drain(t, "dedupe-late", [newer, older.unionByName(newer.where("event_id % 3 = 0")), older], lambda s: jobs.deduplicate(s, out))
    return t.spark.read.parquet(out).select("event_id", "event_type")


@query("st01_indexed_dedupe", "SELECT event_id, event_type FROM events")
def stream_indexed_dedupe(t: Tables):
    """As the late events, in six drains, with the known ids in an index whose runs are merged by twos."""
    out, index, events = t.scratch("dedupe-indexed"), t.scratch("dedupe-index"), t("events").select("event_id", "ts", "event_type")
    older, newer = by_half(events, "ts", "2024-01-10")
    again = newer.where("event_id % 3 = 0")
    drain(t, "dedupe-indexed", [newer, older.unionByName(again), older.limit(0).unionByName(again), again, older.where("event_id % 5 = 0"), again],
          lambda s: jobs.deduplicate_by_index(s, out, index, fan=2))
    return t.spark.read.parquet(out).select("event_id", "event_type")


SEALED_SQL = """SELECT date_trunc('hour', timestamp) AS hour_bucket, organization_id, op, count(*) AS count, round(sum(duration), 6) AS sum_duration FROM {source}
WHERE date_trunc('hour', timestamp) + INTERVAL 1 HOUR <= (SELECT max(timestamp) FROM spans) - INTERVAL 20 MINUTE GROUP BY ALL"""


@query("st02_sealed_hours", SEALED_SQL.format(source="spans"))
def stream_sealed_hours(t: Tables):
    out, keys, spans = t.scratch("sealed"), ["organization_id", "op"], t("spans").select("timestamp", "organization_id", "op", "duration")
    drain(t, "sealed", [spans], lambda s: jobs.seal_hours(s, out, keys))
    hours = jobs.sealed_hours(t.spark, out, keys)
    return hours.select("hour_bucket", *keys, F.col("count"), F.round("sum_duration", 6).alias("sum_duration")).withColumn("count", F.col("count").cast("bigint"))


@query("st02_late_spans", """
WITH early AS (SELECT * FROM spans WHERE event_id % 4 <> 0), edge AS (SELECT max(timestamp) - INTERVAL 20 MINUTE AS stop FROM early)
SELECT date_trunc('hour', timestamp) + INTERVAL 1 HOUR <= (SELECT stop FROM edge) AS late, event_id % 4 = 0 AS second, count(*) AS count FROM spans GROUP BY ALL""")
def stream_late_spans(t: Tables):
    """A quarter of all spans comes after the others: those of sealed hours are rejected, none vanishes."""
    out, spans = t.scratch("sealed-late"), t("spans").select("event_id", "timestamp", "duration")
    drain(t, "sealed-late", [spans.where("event_id % 4 <> 0"), spans.where("event_id % 4 = 0")], lambda s: jobs.seal_hours(s, out, ["event_id"]))
    edge = jobs.sealed_until(t.spark, out, batch_id=1)
    totals = t.spark.read.parquet(f"{out}/totals").select((F.col("hour_bucket") + F.expr("INTERVAL 1 HOUR") <= moment(edge)).alias("late"), "event_id", "count")
    rejected = t.spark.read.parquet(f"{out}/rejected").where("reason = 'late'").select(F.lit(True).alias("late"), "event_id", F.lit(1).cast("bigint").alias("count"))
    return totals.unionByName(rejected).groupBy("late", (F.col("event_id") % 4 == 0).alias("second")).agg(F.sum("count").alias("count"))


@query("st02_idle_source", """
WITH edge AS (SELECT max(timestamp) AS newest FROM spans)
SELECT date_trunc('hour', timestamp) AS hour_bucket, organization_id, op, count(*) AS count, round(sum(duration), 6) AS sum_duration,
 date_trunc('hour', timestamp) + INTERVAL 1 HOUR > (SELECT newest FROM edge) - INTERVAL 20 MINUTE AS by_clock FROM spans GROUP BY ALL""")
def stream_idle_source(t: Tables):
    """A source that has fallen silent: the hours that its newest event leaves open are sealed by the clock, in a drain without rows."""
    out, keys, spans = t.scratch("idle"), ["organization_id", "op"], t("spans").select("timestamp", "organization_id", "op", "duration")
    drain(t, "idle", [spans], lambda s: jobs.seal_hours(s, out, keys))
    before = jobs.sealed_until(t.spark, out)
    jobs.seal_idle(t.spark, out, datetime(2024, 3, 1))
    hours = jobs.sealed_hours(t.spark, out, keys)
    return hours.select("hour_bucket", *keys, F.col("count").cast("bigint").alias("count"), F.round("sum_duration", 6).alias("sum_duration"),
                        (F.col("hour_bucket") + F.expr("INTERVAL 1 HOUR") > moment(before)).alias("by_clock"))


@query("st03_hour_counters", "SELECT project_id, organization_id, date, CAST(count AS BIGINT) AS count FROM project_hourly")
def stream_hour_counters(t: Tables):
    out, keys = t.scratch("counters"), ["project_id", "organization_id"]
    events = t("issue_events").select(*keys, "received")
    drain(t, "counters", by_half(events, "received", "2024-01-16"), lambda s: jobs.hourly_counters(s, out, *keys))
    return jobs.read_counters(t.spark, out, *keys)


def in_parts(rows: DataFrame, key: str, n: int = 3) -> list[DataFrame]:
    return [rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


@query("st03_tag_counters", "SELECT issue_id, organization_id, tag_key, tag_value, CAST(date AS TIMESTAMP) AS date, CAST(count AS BIGINT) AS count FROM issue_tags")
def stream_tag_counters(t: Tables):
    """Daily tag counts, folded into a snapshot after the second of three batches."""
    out, tagged = t.scratch("tag-counters"), t("event_tags").select("event_id", "issue_id", "organization_id", "received", "tag_key", "tag_value")
    drain(t, "tag-counters", in_parts(tagged, "event_id"), lambda s: jobs.tag_counters(s, out, snapshot_every=2))
    return jobs.read_counters(t.spark, out, *jobs.TAG_KEYS)


@query("st03_log_stats", f"""
WITH {LEVELLED}
SELECT date_trunc('hour', timestamp) AS date, project_id, organization_id, level, <<hash_bucket(service)>> AS service_bucket,
 <<hash_bucket(environment)>> AS environment_bucket, CAST(count(*) AS BIGINT) AS count FROM levelled GROUP BY ALL""")
def stream_log_stats(t: Tables):
    out, rows = t.scratch("log-counters"), levelled(t)
    drain(t, "log-counters", in_parts(rows, "log_id"), lambda s: jobs.log_counters(s, out, snapshot_every=1))
    return jobs.read_counters(t.spark, out, *jobs.LOG_KEYS)


@query("st03_uptime", "SELECT organization_id, date_trunc('hour', start_check) AS date, CAST(count(*) AS BIGINT) AS count FROM monitor_checks GROUP BY ALL")
def stream_uptime(t: Tables):
    out, checks = t.scratch("check-counters"), t("monitor_checks")
    drain(t, "check-counters", in_parts(checks, "monitor_id"), lambda s: jobs.check_counters(s, out))
    return jobs.read_counters(t.spark, out, *jobs.CHECK_KEYS)


@query("st04_monitor_states", f"WITH {REPLAY_SQL} SELECT * FROM states")
def stream_monitor_states(t: Tables):
    out, checks, monitors = t.scratch("states"), ordered_checks(t), t("monitors")
    drain(t, "states", by_half(checks, "start_check", "1998-06-01"), lambda s: jobs.monitor_states(s, monitors, out))
    return t.spark.read.parquet(f"{out}/outcomes").select(*STATE_COLUMNS)


BEATS = """
c AS (SELECT CAST(user_id % 40 AS BIGINT) AS monitor_id, ts, ((user_id % 40) % 5 + 1) * INTERVAL 6 HOUR AS step FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
g AS (SELECT *, lag(ts) OVER w AS earlier, lead(ts) OVER w AS later FROM c WINDOW w AS (PARTITION BY monitor_id ORDER BY ts)),
flips AS (SELECT monitor_id, ts AS "at", TRUE AS is_up FROM g WHERE earlier IS NULL OR earlier + step < ts
 UNION ALL SELECT monitor_id, ts + step AS "at", FALSE AS is_up FROM g WHERE later > ts + step OR (later IS NULL AND ts + step <= (SELECT max(ts) FROM c) - INTERVAL 5 MINUTE))"""


def beating(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Events as the check-ins of 40 monitors with intervals of 6 to 30 hours."""
    monitors = t.spark.range(40).select(F.col("id").alias("monitor_id"), ((F.col("id") % 5 + 1) * 6 * 3600).alias("interval_seconds"))
    return t("events").select((F.col("user_id") % 40).alias("monitor_id"), F.col("ts").cast("timestamp").alias("start_check")), monitors


@query("st04_silent_heartbeats", f"WITH {BEATS} SELECT monitor_id, CAST(\"at\" AS TIMESTAMP) AS \"at\", is_up FROM flips")
def stream_silent_heartbeats(t: Tables):
    """Monitors go down because nothing comes; the job goes on from its checkpoint twice."""
    out, (checks, monitors) = t.scratch("heartbeats"), beating(t)
    edges = [F.lit(f"2024-01-{d}").cast("timestamp") for d in ("12", "20")]
    at = F.col("start_check")
    drain(t, "heartbeats", [checks.where(at < edges[0]), checks.where((at >= edges[0]) & (at < edges[1])), checks.where(at >= edges[1])],
          lambda s: jobs.append_files(heartbeats.heartbeat_flips(s, monitors), out, []))
    return t.spark.read.parquet(out).select("monitor_id", "at", "is_up")


@query("j16_stream_presence", f"""
WITH {BEATS}
SELECT m.monitor_id, CAST(max(f."at") AS TIMESTAMP) AS since, coalesce(arg_max(f.is_up, f."at"), FALSE) AS is_up
FROM (SELECT unnest(range(40)) AS monitor_id) m LEFT JOIN flips f ON f.monitor_id = m.monitor_id GROUP BY m.monitor_id""")
def stream_presence(t: Tables):
    """The monitors' state after the flips of one drain."""
    out, (checks, monitors) = t.scratch("presence"), beating(t)
    drain(t, "presence", [checks], lambda s: jobs.append_files(heartbeats.heartbeat_flips(s, monitors), out, []))
    return heartbeats.current_heartbeats(t.spark.read.parquet(out), monitors).select("monitor_id", "since", "is_up")


def _hits(start: str, end: str) -> str:
    return f"""SELECT r.alert_id, e.issue_id, count(*) AS num_events FROM alert_rules r JOIN issue_events e ON e.project_id = r.project_id
 AND e.received >= TIMESTAMP '{start}' AND e.received < TIMESTAMP '{end}' GROUP BY r.alert_id, e.issue_id, r.quantity HAVING count(*) >= r.quantity"""


@query("st05_stream_alerts", f"""
WITH a AS ({_hits('2024-01-09 00:00:00', '2024-01-16 00:00:00')}), b AS ({_hits('2024-01-24 00:00:00', '2024-02-01 00:00:00')})
SELECT CAST(alert_id AS BIGINT) AS alert_id, issue_id, num_events, 0 AS batch FROM a
UNION ALL SELECT CAST(alert_id AS BIGINT) AS alert_id, issue_id, num_events, 1 AS batch FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.alert_id = b.alert_id AND a.issue_id = b.issue_id)""")
def stream_alerts(t: Tables):
    """Rules are checked after each batch; an alert is raised once per issue."""
    out, history = t.scratch("alerts"), t.scratch("alert-history")
    events = t("issue_events").select("project_id", "issue_id", "received")
    rules = t("alert_rules").withColumn("project_id", F.col("project_id").cast("int"))
    clock = [datetime(2024, 1, 16), datetime(2024, 1, 31)]
    drain(t, "alerts", by_half(events, "received", "2024-01-16"), lambda s: jobs.alerting(s, rules, history, out, clock.__getitem__))
    return t.spark.read.parquet(out).withColumnRenamed("batch_id", "batch")


@query("st05_alerts_by_slots", f"""
WITH a AS ({_hits('2024-01-09 00:00:00', '2024-01-16 00:00:00')}), b AS ({_hits('2024-01-24 00:00:00', '2024-02-01 00:00:00')})
SELECT CAST(alert_id AS BIGINT) AS alert_id, issue_id, num_events, 0 AS batch FROM a
UNION ALL SELECT CAST(alert_id AS BIGINT) AS alert_id, issue_id, num_events, 1 AS batch FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.alert_id = b.alert_id AND a.issue_id = b.issue_id)""")
def stream_alerts_by_slots(t: Tables):
    """The same alerts from counts per minute; no event is read twice."""
    slots, sent = t.scratch("alert-slots"), t.scratch("alert-sent")
    events = t("issue_events").select("project_id", "issue_id", "received")
    rules = t("alert_rules").withColumn("project_id", F.col("project_id").cast("int"))
    clock = [datetime(2024, 1, 16, 0, 0, 30), datetime(2024, 1, 31)]
    drain(t, "alert-slots", by_half(events, "received", "2024-01-16"), lambda s: jobs.alerting_by_slots(s, rules, slots, sent, clock.__getitem__))
    return t.spark.read.parquet(sent).select("alert_id", "issue_id", F.col("count").alias("num_events"), F.col("batch_id").alias("batch"))



GARBAGE = "CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN timestamp + INTERVAL '60' DAY ELSE timestamp END"


@query("st06_rejected_spans", f"""
WITH x AS (SELECT span_id, {GARBAGE} AS ts FROM spans)
SELECT CASE WHEN ts IS NULL THEN 'missing' WHEN ts >= TIMESTAMP '2024-01-01 12:00:00' AND ts <= TIMESTAMP '2024-01-31 13:00:00' THEN 'good' ELSE 'range' END AS reason, count(*) AS count FROM x GROUP BY 1""")
def stream_rejected_spans(t: Tables):
    out = t.scratch("guard")
    spans = t("spans").select("event_id", "span_id", "timestamp").withColumn("timestamp", F.expr(GARBAGE)).drop("event_id")
    now = datetime(2024, 1, 31, 12)

    def guarded(stream):
        judged = acceptable_spans(stream, now)
        reason = F.when(F.col("timestamp").isNull(), "missing").when(~F.col("kept"), "range")
        return jobs.split_good_bad(judged, out, reason)

    drain(t, "guard", [spans], guarded)
    good = t.spark.read.parquet(f"{out}/good").select(F.lit("good").alias("reason"))
    bad = t.spark.read.parquet(f"{out}/rejected").select("reason")
    return good.unionByName(bad).groupBy("reason").agg(F.count(F.lit(1)).alias("count"))


@query("st07_span_sink", "SELECT organization_id, CAST(timestamp AS DATE) AS date, CAST(hour(timestamp) AS INT) AS hour, count(*) AS count FROM spans GROUP BY ALL")
def stream_span_sink(t: Tables):
    """Exactly-once file sink; the second run finds nothing new."""
    out, spans = t.scratch("span-sink"), t("spans").select("organization_id", "span_id", "timestamp", "duration")

    def sink(stream):
        return jobs.append_files(stream.withColumn("date", F.to_date("timestamp")), out, ["organization_id", "date"])

    drain(t, "span-sink", [*by_half(spans, "timestamp", "2024-01-16"), spans.limit(0)], sink)
    return t.spark.read.parquet(out).groupBy("organization_id", "date", F.hour("timestamp").alias("hour")).agg(F.count(F.lit(1)).alias("count"))


@query("st08_stream_grouping", """
WITH old AS (SELECT project_id, hash, count(*) AS n FROM issue_events WHERE culprit <> 'app.mod3' GROUP BY project_id, hash),
s AS (SELECT issue_id, project_id, hash, title, count, first_seen, last_seen, last_release, status, resolved_in_release FROM issues),
hits AS (SELECT DISTINCT s.issue_id FROM s JOIN old o ON o.project_id = s.project_id AND o.hash = s.hash JOIN issue_events e ON e.issue_id = s.issue_id
 WHERE s.status = 1 AND (s.resolved_in_release IS NULL OR (e.release IS NOT NULL AND e.release <> s.resolved_in_release)))
SELECT s.issue_id, s.title, CASE WHEN o.hash IS NULL THEN s.count ELSE 2 * s.count END AS count, s.first_seen, s.last_seen, l.last_release,
 CASE WHEN o.hash IS NULL OR h.issue_id IS NOT NULL THEN 0 ELSE s.status END AS status FROM s
LEFT JOIN (SELECT issue_id, arg_max(release, struct_pack(a := received, b := event_id)) FILTER (WHERE release IS NOT NULL) AS last_release FROM issue_events GROUP BY issue_id) l ON l.issue_id = s.issue_id
LEFT JOIN old o ON o.project_id = s.project_id AND o.hash = s.hash LEFT JOIN hits h ON h.issue_id = s.issue_id""")
def stream_grouping(t: Tables):
    """Replay all events onto stored issues that lack one module: known ones grow and reopen, others appear."""
    out, events = t.scratch("grouping"), t("issue_events").drop("issue_id")
    drain(t, "grouping", by_half(events, "received", "2024-01-16"), lambda s: jobs.group_events(s, out))
    stored = t("issues").where("culprit <> 'app.mod3'")
    folded = jobs.fold_issues(t.spark.read.parquet(out), stored)
    return folded.select("issue_id", "title", "count", "first_seen", "last_seen", "last_release", "status")


@query("st08_short_ids_and_notifications", """
WITH stored AS (SELECT issue_id, project_id, hash, status, resolved_in_release, count AS short_id FROM issues WHERE culprit <> 'app.mod3'),
fresh AS (SELECT issue_id, project_id, row_number() OVER (PARTITION BY project_id ORDER BY first_seen, hash) AS n FROM issues WHERE culprit = 'app.mod3'),
top AS (SELECT project_id, max(short_id) AS top FROM stored GROUP BY project_id),
links AS (SELECT event_id // 10 AS notification_id, issue_id FROM issue_events GROUP BY ALL),
hits AS (SELECT DISTINCT s.issue_id FROM stored s JOIN issue_events e ON e.issue_id = s.issue_id WHERE s.status = 1 AND (s.resolved_in_release IS NULL OR (e.release IS NOT NULL AND e.release <> s.resolved_in_release)))
SELECT 'issue' AS kind, issue_id, CAST(short_id AS BIGINT) AS number FROM stored
UNION ALL SELECT 'issue' AS kind, f.issue_id, CAST(f.n + coalesce(t.top, 0) AS BIGINT) AS number FROM fresh f LEFT JOIN top t ON t.project_id = f.project_id
UNION ALL SELECT 'link' AS kind, issue_id, notification_id AS number FROM links WHERE notification_id NOT IN (SELECT notification_id FROM links WHERE issue_id IN (SELECT issue_id FROM hits))""")
def stream_short_ids(t: Tables):
    """New issues get the next numbers of their project, reopened ones lose their notifications."""
    out, events = t.scratch("short-ids"), t("issue_events").drop("issue_id")
    drain(t, "short-ids", by_half(events, "received", "2024-01-16"), lambda s: jobs.group_events(s, out))
    stored, deltas = t("issues").where("culprit <> 'app.mod3'").withColumn("short_id", F.col("count")), t.spark.read.parquet(out)
    links = t("issue_events").select(F.expr("event_id div 10").alias("notification_id"), "issue_id").distinct()
    folded = jobs.fold_issues(deltas, stored).select(F.lit("issue").alias("kind"), "issue_id", F.col("short_id").alias("number"))
    kept = jobs.fold_notifications(deltas, stored, links)
    return folded.unionByName(kept.select(F.lit("link").alias("kind"), "issue_id", F.col("notification_id").alias("number")))


@query("st08_grouping_store", BATCHED_SQL)
def stream_grouping_store(t: Tables):
    """Three drains into the keyed store of issues, which is folded after each second batch."""
    store, events = issuestore.create(t.spark, t.scratch("issue-stream"), 8), t("issue_events").drop("issue_id")
    first, rest = by_half(events, "received", "2024-01-08")
    drain(t, "issue-stream", [first, *by_half(rest, "received", "2024-01-16")], lambda s: jobs.group_into_store(s, store.path, "replay", lambda _: NOW, 2))
    return issue_rows(store)


@query("st09_poison_records", """
SELECT event_id % 13 = 0 AS broken, count(*) AS count FROM events GROUP BY 1""")
def stream_poison_records(t: Tables):
    """A malformed line goes to the rejected table, its batch goes on."""
    out = t.scratch("poison")
    doc = F.to_json(F.struct(F.lit("event").alias("type"), (F.col("user_id") % 5).cast("int").alias("project_id"), F.col("props").alias("payload")))
    lines = t("events").select(F.when(F.col("event_id") % 13 == 0, F.substring(doc, 1, 25)).otherwise(doc).alias("value"))

    def isolate(stream):
        parsed = F.from_json("value", J._ddl(J.ENVELOPE), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
        broken = parsed.isNull() | parsed["_bad"].isNotNull()
        return jobs.split_good_bad(stream, out, F.when(broken, F.lit("malformed")))

    drain(t, "poison", [lines], isolate)
    good = t.spark.read.parquet(f"{out}/good").select(F.lit(False).alias("broken"))
    return good.unionByName(t.spark.read.parquet(f"{out}/rejected").select(F.lit(True).alias("broken"))).groupBy("broken").agg(F.count(F.lit(1)).alias("count"))
