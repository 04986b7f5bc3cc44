"""Uptime, alert, time-series and notification queries."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ..functions.timeparam import moment, slot
from ..operators import alerts as A, issues as I, stats as T, uptime as M
from ..operators.upsert import without
from .registry import NOW, Tables, query

ORDERED = "(PARTITION BY monitor_id ORDER BY start_check, check_id, response_time, is_up)"


def checks(t: Tables):
    """Checks in a total order (ids repeat in the source, so a number is added)."""
    return t.sql(CHECKS_SQL.replace("FROM monitor_checks", "FROM {monitor_checks}"))


CHECKS_SQL = ("SELECT monitor_id, organization_id, start_check, is_up, response_time,"
              " check_id * 100 + row_number() OVER (PARTITION BY monitor_id, start_check, check_id ORDER BY response_time, is_up) AS check_id FROM monitor_checks")

REPLAY_SQL = f"""
checks AS ({CHECKS_SQL}),
a AS (SELECT c.*, greatest(1, m.confirmation_threshold) AS need, sum(CAST(is_up AS INT)) OVER (PARTITION BY c.monitor_id ORDER BY start_check, check_id) AS ups
 FROM checks c LEFT JOIN monitors m ON m.monitor_id = c.monitor_id),
b AS (SELECT *, sum(1 - CAST(is_up AS INT)) OVER (PARTITION BY monitor_id, ups ORDER BY start_check, check_id) AS run FROM a),
c AS (SELECT *, CASE WHEN is_up THEN TRUE WHEN run >= need THEN FALSE END AS confirmed FROM b),
d AS (SELECT *, last_value(confirmed IGNORE NULLS) OVER (PARTITION BY monitor_id ORDER BY start_check, check_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM c),
e AS (SELECT *, lag(state) OVER (PARTITION BY monitor_id ORDER BY start_check, check_id) AS previous FROM d),
states AS (SELECT monitor_id, start_check, check_id, is_up, CAST(CASE WHEN is_up THEN 0 ELSE least(run, need) END AS INT) AS consecutive_down, state,
 state IS NOT NULL AND (previous IS NULL OR previous <> state) AS changed FROM e)"""
STATE_COLUMNS = ["monitor_id", "start_check", "check_id", "is_up", "consecutive_down", "state", "changed"]


@query("w05_flap_damping", f"WITH {REPLAY_SQL} SELECT * FROM states")
def flap_damping(t: Tables):
    return M.replay_states(checks(t), t("monitors")).select(*STATE_COLUMNS)


@query("w06_change_log", f"WITH {REPLAY_SQL} SELECT monitor_id, start_check, check_id, state FROM states WHERE changed")
def change_log(t: Tables):
    return M.change_log(M.replay_states(checks(t), t("monitors"))).select("monitor_id", "start_check", "check_id", "state")


@query("j05_w03_latest_checks", f"""
WITH checks AS ({CHECKS_SQL})
SELECT monitor_id, check_id, start_check, is_up, position FROM (
 SELECT *, CAST(row_number() OVER (PARTITION BY monitor_id ORDER BY start_check DESC, check_id DESC) AS INT) AS position FROM checks) x WHERE position <= 60""")
def latest_checks(t: Tables):
    return M.latest_checks(checks(t)).select("monitor_id", "check_id", "start_check", "is_up", "position")


@query("j16_heartbeats", """
SELECT m.monitor_id, m.interval_seconds, max(c.start_check) AS last_check,
 coalesce(max(c.start_check) >= TIMESTAMP '2001-10-28 00:02:00' - to_seconds(m.interval_seconds), FALSE) AS is_up
FROM monitors m LEFT JOIN monitor_checks c ON c.monitor_id = m.monitor_id GROUP BY m.monitor_id, m.interval_seconds""")
def heartbeats(t: Tables):
    now, checks = datetime(2001, 10, 28, 0, 2), t("monitor_checks")
    # What earlier runs have stored: the last check of each monitor up to five minutes before.
    stored = checks.where(F.col("start_check") < moment(now - timedelta(minutes=5))).groupBy("monitor_id").agg(F.max("start_check").alias("last_check"))
    seen = M.heartbeat_state(t("monitors"), checks, now, stored)
    return seen.select("monitor_id", "interval_seconds", "last_check", "is_up")


@query("a21_hourly_checks", """
SELECT organization_id, date_trunc('hour', start_check) AS date, count(*) AS count FROM monitor_checks WHERE monitor_id % 4 <> 0 OR NOT is_up GROUP BY ALL""")
def hourly_checks(t: Tables):
    kind = F.when(F.col("monitor_id") % 4 == 0, "heartbeat").otherwise("ping")
    return M.hourly_checks(t("monitor_checks").withColumn("monitor_type", kind))


# -- alerts --------------------------------------------------------------------------

HITS_SQL = """
hits AS (SELECT r.alert_id, e.issue_id, count(*) AS num_events FROM alert_rules r JOIN issue_events e ON e.project_id = r.project_id
 AND e.received >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY r.alert_id, e.issue_id, r.quantity HAVING count(*) >= r.quantity)"""


@query("a20_evaluate_alerts", f"WITH {HITS_SQL} SELECT alert_id, issue_id, num_events FROM hits")
def evaluate_alerts(t: Tables):
    return A.evaluate_alerts(rules(t), t("issue_events"), NOW)


def rules(t: Tables):
    return t("alert_rules").withColumn("project_id", F.col("project_id").cast("int"))


@query("a20_alerts_of_touched_issues", f"""
WITH {HITS_SQL},
touched AS (SELECT DISTINCT issue_id FROM issue_events WHERE received >= TIMESTAMP '2024-01-30 12:00:00')
SELECT alert_id, issue_id, num_events FROM hits WHERE issue_id IN (SELECT issue_id FROM touched)""")
def alerts_of_touched_issues(t: Tables):
    events = t("issue_events")
    touched = events.where(F.col("received") >= F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))
    return A.evaluate_alerts(rules(t), events, NOW, touched=touched)


SENT_SQL = "sent AS (SELECT DISTINCT CAST(project_id AS INT) AS alert_id, issue_id FROM issue_events WHERE level = 4)"


@query("j09_unsent_alerts", f"""
WITH {HITS_SQL}, {SENT_SQL}
SELECT alert_id, issue_id, num_events FROM hits h WHERE NOT EXISTS (SELECT 1 FROM sent s WHERE s.alert_id = h.alert_id AND s.issue_id = h.issue_id)""")
def unsent_alerts(t: Tables):
    events = t("issue_events")
    sent = events.where("level = 4").select(F.col("project_id").alias("alert_id"), "issue_id").distinct()
    return without(A.evaluate_alerts(rules(t), events, NOW), sent, ["alert_id", "issue_id"])


@query("n01_notification_tags", """
WITH n AS (SELECT issue_id, tag_key, tag_value, sum(count) AS n FROM issue_tags WHERE tag_key IN ('environment', 'server_name', 'release', 'user.id') GROUP BY issue_id, tag_key, tag_value),
best AS (SELECT *, row_number() OVER (PARTITION BY issue_id, tag_key ORDER BY n DESC, tag_value DESC) AS rn FROM n)
SELECT issue_id, tag_key, tag_value, CASE tag_key WHEN 'environment' THEN 1 WHEN 'server_name' THEN 2 WHEN 'release' THEN 3 ELSE 4 END AS position,
 CASE tag_key WHEN 'environment' THEN 'Environment' WHEN 'server_name' THEN 'Server Name' WHEN 'release' THEN 'Release' ELSE 'User.id' END AS label FROM best WHERE rn = 1""")
def notification_tags(t: Tables):
    return A.notification_tags(t("issue_tags"), (*A.STANDARD_TAGS, "user.id", "release"))


@query("n02_notification_summary", f"""
WITH {HITS_SQL}
SELECT notification_id, issue_id, position, issue_count FROM (SELECT alert_id AS notification_id, issue_id,
 CAST(row_number() OVER (PARTITION BY alert_id ORDER BY issue_id) AS INT) AS position, count(*) OVER (PARTITION BY alert_id) AS issue_count FROM hits) x""")
def notification_summary(t: Tables):
    hits = A.evaluate_alerts(rules(t), t("issue_events"), NOW)
    return A.notification_summary(hits.select(F.col("alert_id").alias("notification_id"), "issue_id"))


# -- time series ---------------------------------------------------------------------

COMPAT_SQL = """
SELECT g.ts, CAST(sum(s.count) AS BIGINT) AS total FROM (SELECT unnest(generate_series({start}, {end}, {step})) AS ts) g
LEFT JOIN project_hourly s ON s.date >= g.ts AND s.date < g.ts + INTERVAL 1 HOUR
WHERE s.project_id IN (1, 2) OR s.project_id IS NULL GROUP BY g.ts"""


@query("a17_stats_by_hour", COMPAT_SQL.format(start="TIMESTAMP '2024-01-05 07:00:00'", end="TIMESTAMP '2024-01-12 10:00:00'", step="INTERVAL 1 HOUR"))
def stats_by_hour(t: Tables):
    return T.counts_over_time(t("project_hourly"), [1, 2], datetime(2024, 1, 5, 7, 45), datetime(2024, 1, 12, 9, 15), "1h")


@query("j04_stats_by_day", COMPAT_SQL.format(start="TIMESTAMP '2024-01-02 03:00:00'", end="TIMESTAMP '2024-01-30 03:00:00'", step="INTERVAL 1 DAY"))
def stats_by_day(t: Tables):
    return T.counts_over_time(t("project_hourly"), [1, 2], datetime(2024, 1, 2, 3, 45), datetime(2024, 1, 30, 2, 15), "1d")


@query("j04_stats_by_minute", COMPAT_SQL.format(start="TIMESTAMP '2024-01-05 07:00:00'", end="TIMESTAMP '2024-01-05 17:00:00'", step="INTERVAL 1 MINUTE"))
def stats_by_minute(t: Tables):
    return T.counts_over_time(t("project_hourly"), [1, 2], datetime(2024, 1, 5, 7, 0), datetime(2024, 1, 5, 16, 30), "1m")


@query("a17_stats_corrected", """
SELECT g.ts, CAST(coalesce(sum(s.count) FILTER (WHERE s.project_id IN (1, 2)), 0) AS BIGINT) AS total
FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-02 03:00:00', TIMESTAMP '2024-01-30 03:00:00', INTERVAL 1 DAY)) AS ts) g
LEFT JOIN project_hourly s ON s.date >= g.ts AND s.date < g.ts + INTERVAL 1 DAY GROUP BY g.ts""")
def stats_corrected(t: Tables):
    return T.counts_over_time(t("project_hourly"), [1, 2], datetime(2024, 1, 2, 3), datetime(2024, 1, 30, 2, 15), "1d", exact_hours=False)


@query("a23_global_counts", """
SELECT count(o.organization_id) AS org_count, count(p.project_id) AS project_count, count(DISTINCT o.organization_id) AS distinct_org_count
FROM organizations o LEFT JOIN projects p ON p.organization_id = o.organization_id""")
def global_counts(t: Tables):
    return T.global_counts(t("organizations"), t("projects"))


@query("f28_truncate_time", """
SELECT event_id, date_trunc('hour', ts) AS hour, date_trunc('day', ts) AS day FROM events""")
def truncate_time(t: Tables):
    return t("events").select("event_id", slot("hour", F.col("ts")).alias("hour"), slot("day", F.col("ts")).alias("day"))


@query("m10_stale_issues", """
SELECT issue_id, last_seen FROM issues WHERE last_seen >= TIMESTAMP '2024-05-05 20:00:00' - INTERVAL 97 DAY""")
def stale_issues(t: Tables):
    from ..operators.maintenance import stale_issues as stale

    issues = t("issues")
    gone = stale(issues, datetime(2024, 5, 5, 20))
    return without(issues, gone, ["issue_id"]).select("issue_id", "last_seen")


@query("m09_cascade_delete", """
WITH gone AS (SELECT issue_id FROM issues WHERE status = 2)
SELECT 'events' AS dataset, count(*) AS left_over FROM issue_events WHERE issue_id NOT IN (SELECT issue_id FROM gone)
UNION ALL SELECT 'hourly', count(*) FROM issue_hourly WHERE issue_id NOT IN (SELECT issue_id FROM gone)
UNION ALL SELECT 'tags', count(*) FROM issue_tags WHERE issue_id NOT IN (SELECT issue_id FROM gone)
UNION ALL SELECT 'issues', count(*) FROM issues WHERE issue_id NOT IN (SELECT issue_id FROM gone)""")
def cascade_delete(t: Tables):
    from ..operators.maintenance import cascade_delete as cascade

    issues = t("issues")
    names = {"events": t("issue_events"), "hourly": t("issue_hourly"), "tags": t("issue_tags"), "issues": issues}
    kept = cascade(names, issues.where(F.col("status") == I.IGNORED), "issue_id")
    counted = [df.agg(F.count(F.lit(1)).alias("left_over")).select(F.lit(n).alias("dataset"), "left_over") for n, df in kept.items()]
    out = counted[0]
    for part in counted[1:]:
        out = out.unionByName(part)
    return out
