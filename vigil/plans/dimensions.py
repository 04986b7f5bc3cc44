"""Release, environment, project, team and file queries, and retention of tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import flags
from ..operators import dimensions as D, maintenance as M, upsert as U
from .registry import NOW, Tables, query

SPLIT = "TIMESTAMP '2024-01-16 00:00:00'"


def halves(t: Tables):
    events, at = t("issue_events"), F.lit("2024-01-16").cast("timestamp_ntz")
    return events.where(F.col("received") < at), events.where(F.col("received") >= at)


@query("m03_new_releases", f"""
WITH old AS (SELECT DISTINCT organization_id, release FROM issue_events WHERE received < {SPLIT} AND release IS NOT NULL)
SELECT organization_id, release AS version, min(received) AS created FROM issue_events e WHERE received >= {SPLIT} AND release IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM old o WHERE o.organization_id = e.organization_id AND o.release = e.release) GROUP BY organization_id, release""")
def new_releases(t: Tables):
    old, new = halves(t)
    stored = old.where("release IS NOT NULL").select("organization_id", F.col("release").alias("version")).distinct()
    return D.new_dimension_rows(new, stored, "release", "version")


@query("m03_new_links", f"""
SELECT DISTINCT organization_id, project_id, release AS version FROM issue_events e WHERE received >= {SPLIT} AND release IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM issue_events o WHERE o.received < {SPLIT} AND o.organization_id = e.organization_id AND o.project_id = e.project_id AND o.release = e.release)""")
def new_links(t: Tables):
    old, new = halves(t)
    stored = old.where("release IS NOT NULL").select("organization_id", "project_id", F.col("release").alias("version")).distinct()
    return D.new_links(new, stored, "release", "version")


@query("m03_new_environments", """
SELECT organization_id, repeat(environment || tag_user, 60) AS name, min(received) AS created FROM issue_events WHERE coalesce(environment, '') <> '' GROUP BY 1, 2""")
def new_environments(t: Tables):
    events = t("issue_events").withColumn("environment", F.when(F.coalesce("environment", F.lit("")) != "", F.repeat(F.concat("environment", "tag_user"), 60)))
    return D.new_dimension_rows(events, t("environments"), "environment", "name")


@query("m04_first_event", """
SELECT p.project_id, CASE WHEN p.is_deleted THEN TIMESTAMP '2020-01-01 00:00:00' ELSE min(e.received) END AS first_event
FROM projects p LEFT JOIN issue_events e ON e.project_id = p.project_id GROUP BY p.project_id, p.is_deleted""")
def first_event(t: Tables):
    projects = t("projects").withColumn("first_event", F.when(F.col("is_deleted"), F.lit("2020-01-01").cast("timestamp_ntz")))
    return D.stamp_first_event(projects, t("issue_events")).select("project_id", "first_event")


@query("w07_latest_release", """
SELECT project_id, version FROM (SELECT l.project_id, l.version, row_number() OVER (PARTITION BY l.project_id ORDER BY r.created DESC, l.version DESC) AS n
 FROM release_projects l JOIN releases r ON r.organization_id = l.organization_id AND r.version = l.version) x WHERE n = 1""")
def latest_release(t: Tables):
    return D.latest_release(t("releases"), t("release_projects"))


@query("j03_project_context", """
SELECT p.project_id, e.name AS environment, l.version, p.project_id IN (SELECT project_id FROM issue_events WHERE level = 2) AS has_difs
FROM projects p JOIN (SELECT DISTINCT project_id, version FROM release_projects) l ON l.project_id = p.project_id
LEFT JOIN (SELECT DISTINCT CASE WHEN project_id = 1 THEN -1 ELSE project_id END AS project_id, name FROM environment_projects) e ON e.project_id = p.project_id
WHERE l.version IN (SELECT release FROM issue_events WHERE received >= TIMESTAMP '2024-01-20 00:00:00') AND (e.name IS NULL OR e.name = 'prod')""")
def project_context(t: Tables):
    """Project 1 has no environment, one of no project has its own; the batch asks for production only."""
    events = t("issue_events")
    wanted = events.where(F.col("received") >= F.lit("2024-01-20").cast("timestamp_ntz")).select(
        "release", F.when(F.col("environment") == "prod", F.col("environment")).alias("environment")
    )
    links = t("environment_projects").withColumn("project_id", F.when(F.col("project_id") == 1, -1).otherwise(F.col("project_id")))
    return D.project_context(t("projects"), t("release_projects"), links, events.where("level = 2"), wanted)


@query("p11_soft_delete", """
SELECT p.project_id, p.slug FROM projects p JOIN organizations o ON o.organization_id = p.organization_id WHERE NOT p.is_deleted AND NOT o.is_deleted""")
def soft_delete(t: Tables):
    return D.live_projects(t("projects"), t("organizations")).select("project_id", "slug")


@query("p12_visibility", """
SELECT 'visible' AS visibility, organization_id, name FROM environments e WHERE EXISTS (SELECT 1 FROM environment_projects l WHERE l.organization_id = e.organization_id AND l.name = e.name AND NOT is_hidden)
UNION ALL SELECT 'hidden' AS visibility, organization_id, name FROM environments e WHERE EXISTS (SELECT 1 FROM environment_projects l WHERE l.organization_id = e.organization_id AND l.name = e.name AND is_hidden)
UNION ALL SELECT 'all' AS visibility, organization_id, name FROM environments""")
def visibility(t: Tables):
    def shown(which):
        return D.visible_environments(t("environments"), t("environment_projects"), which).select(F.lit(which).alias("visibility"), "organization_id", "name")

    return shown("visible").unionByName(shown("hidden")).unionByName(shown("all"))


@query("p13_release_filter", """
SELECT organization_id, version, created FROM releases r WHERE EXISTS (SELECT 1 FROM release_projects l WHERE l.organization_id = r.organization_id AND l.version = r.version AND l.project_id IN (1, 4))""")
def release_filter(t: Tables):
    return D.releases_of(t("releases"), t("release_projects"), [1, 4]).select("organization_id", "version", "created")


@query("p14_bit_flags", """
SELECT event_id, (event_id & 6) <> 0 AS any_set, event_id | 5 AS with_bits, xor(event_id, 3) AS toggled, event_id & ~CAST(6 AS BIGINT) AS cleared FROM events""")
def bit_flags(t: Tables):
    f = F.col("event_id")
    return t("events").select(
        "event_id", flags.any_bit(f, 6).alias("any_set"), flags.set_bits(f, 5).alias("with_bits"),
        flags.toggle_bits(f, 3).alias("toggled"), flags.clear_bits(f, 6).alias("cleared"),
    )


@query("m15_deploy_counters", """
WITH d AS (SELECT organization_id, release AS version, count(*) AS n FROM issue_events WHERE environment = 'prod' AND release IS NOT NULL GROUP BY ALL),
c AS (SELECT organization_id, release AS version, count(*) AS n FROM issue_events WHERE level > 2 AND release IS NOT NULL GROUP BY ALL)
SELECT r.organization_id, r.version, coalesce(d.n, 0) AS deploy_count, coalesce(c.n, 0) AS commit_count, coalesce(c.n, 0) AS stored_commits
FROM releases r LEFT JOIN d ON d.organization_id = r.organization_id AND d.version = r.version LEFT JOIN c ON c.organization_id = r.organization_id AND c.version = r.version""")
def deploy_counters(t: Tables):
    events = t("issue_events").withColumnRenamed("release", "version")
    return D.deploy_counters(t("releases"), events.where("environment = 'prod'"), events.where("level > 2"))


@query("m11_release_cleanup", """
WITH gone AS (SELECT organization_id, version FROM releases WHERE created < TIMESTAMP '2025-01-15 00:00:00' - INTERVAL 365 DAY)
SELECT i.issue_id, CASE WHEN f.version IS NULL THEN i.first_release END AS first_release, CASE WHEN l.version IS NULL THEN i.last_release END AS last_release,
 CASE WHEN s.version IS NULL THEN i.resolved_in_release END AS resolved_in_release
FROM issues i LEFT JOIN gone f ON f.organization_id = i.organization_id AND f.version = i.first_release
LEFT JOIN gone l ON l.organization_id = i.organization_id AND l.version = i.last_release
LEFT JOIN gone s ON s.organization_id = i.organization_id AND s.version = i.resolved_in_release""")
def release_cleanup(t: Tables):
    gone = D.old_releases(t("releases"), datetime(2025, 1, 15))
    cleared = D.clear_release(t("issues"), gone, "first_release", "last_release", "resolved_in_release")
    return cleared.select("issue_id", "first_release", "last_release", "resolved_in_release")


@query("m11_release_links", """
SELECT l.organization_id, l.project_id, l.version FROM release_projects l JOIN releases r ON r.organization_id = l.organization_id AND r.version = l.version
WHERE r.created >= TIMESTAMP '2025-01-15 00:00:00' - INTERVAL 365 DAY""")
def release_links(t: Tables):
    gone = D.old_releases(t("releases"), datetime(2025, 1, 15))
    return U.without(t("release_projects"), gone, ["organization_id", "version"])


# -- people ----------------------------------------------------------------------------

@query("j07_teams", """
SELECT t.team_id, t.slug, count(m.user_id) AS member_count, coalesce(bool_or(m.user_id = 30), FALSE) AS is_member FROM teams t LEFT JOIN members m ON m.team_id = t.team_id GROUP BY t.team_id, t.slug""")
def teams(t: Tables):
    return D.teams_for(t("teams"), t("members"), 30).select("team_id", "slug", "member_count", "is_member")


@query("j08_actor_role", """
SELECT o.organization_id, o.slug, min(m.role) AS actor_role FROM organizations o JOIN members m ON m.organization_id = o.organization_id WHERE NOT o.is_deleted AND m.user_id = 30 GROUP BY o.organization_id, o.slug""")
def actor_role(t: Tables):
    return D.organizations_with_role(t("organizations"), t("members"), 30).select("organization_id", "slug", "actor_role")


@query("j10_recipients", """
WITH notified AS (SELECT DISTINCT CAST(level AS BIGINT) * 10 + project_id AS notification_id, project_id FROM issue_events),
prefs AS (SELECT o_custkey AS user_id, CAST(o_custkey % 5 AS INT) AS project_id, min(CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END) AS status FROM orders GROUP BY ALL)
SELECT DISTINCT n.notification_id, m.user_id FROM notified n JOIN teams x ON x.organization_id = n.project_id JOIN members m ON m.team_id = x.team_id
LEFT JOIN prefs p ON p.user_id = m.user_id AND p.project_id = n.project_id
WHERE NOT (coalesce(p.status = 0, FALSE) OR (p.user_id IS NULL AND NOT m.subscribe_by_default))""")
def recipients(t: Tables):
    notified = t("issue_events").select((F.col("level").cast("bigint") * 10 + F.col("project_id")).alias("notification_id"), "project_id").distinct()
    prefs = t("orders").select(
        F.col("o_custkey").alias("user_id"), (F.col("o_custkey") % 5).cast("int").alias("project_id"),
        F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("status"),
    )
    links = t("teams").select(F.col("organization_id").cast("int").alias("project_id"), "team_id")
    return D.recipients(notified, links, t("members"), prefs)


# -- files and modules -------------------------------------------------------------------

BLOBS = "SELECT p_partkey AS blob_id, TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '1' HOUR * CAST(p_partkey % 4000 AS INT) AS created FROM {part}"
FILES = """SELECT CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN l_partkey ELSE -l_partkey END AS blob_id,
 TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '1' HOUR * CAST(l_quantity * 90 AS INT) AS created FROM {lineitem}"""


@query("j12_old_and_orphan_blobs", f"""
WITH blobs AS ({BLOBS.replace("{part}", "part")}), files AS ({FILES.replace("{lineitem}", "lineitem")})
SELECT 'old' AS reason, blob_id FROM blobs b WHERE created < <<now>> - INTERVAL 90 DAY AND NOT EXISTS (SELECT 1 FROM files f WHERE f.blob_id = b.blob_id AND f.created >= <<now>> - INTERVAL 90 DAY)
UNION ALL SELECT 'orphan' AS reason, blob_id FROM blobs b WHERE created < <<now>> - INTERVAL 24 HOUR AND NOT EXISTS (SELECT 1 FROM files f WHERE f.blob_id = b.blob_id)""")
def unused_blobs(t: Tables):
    blobs, files = t.sql(BLOBS), t.sql(FILES)
    old = M.old_blobs(blobs, files, NOW).select(F.lit("old").alias("reason"), "blob_id")
    return old.unionByName(M.orphan_blobs(blobs, files, NOW).select(F.lit("orphan").alias("reason"), "blob_id"))


BUNDLES = "SELECT p_partkey AS bundle_id, TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '1' HOUR * CAST(p_size * 40 AS INT) AS last_used FROM {part}"


@query("m14_bundles", f"""
WITH b AS ({BUNDLES.replace("{part}", "part")}),
touched AS (SELECT bundle_id, CASE WHEN bundle_id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AND last_used < <<now>> - INTERVAL 1 DAY THEN <<now>> ELSE last_used END AS last_used FROM b)
SELECT * FROM touched WHERE last_used >= <<now>> - INTERVAL 60 DAY""")
def bundles(t: Tables):
    """Touch the bundles in use, then drop those not used for long."""
    used = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("bundle_id"))
    touched = M.touch(t.sql(BUNDLES), used, NOW)
    return touched.where(F.col("last_used") >= F.lit("2023-12-02").cast("timestamp_ntz"))


FRAMES = "SELECT l_orderkey AS dump_id, l_partkey * 16 + l_suppkey % 16 AS address FROM {lineitem} GROUP BY l_orderkey, l_partkey * 16 + l_suppkey % 16"
MODULES = """SELECT CASE WHEN l_linestatus = 'O' THEN l_orderkey ELSE -l_orderkey END AS dump_id, l_suppkey * 100 + l_linenumber AS module_order, 'mod' || CAST(l_suppkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS module,
 (l_partkey - l_linenumber) * 16 AS base, (l_partkey + CAST(l_quantity AS BIGINT)) * 16 AS end FROM {lineitem}"""


@query("j18_address_modules", f"""
WITH frames AS ({FRAMES.replace("{lineitem}", "lineitem")}), modules AS ({MODULES.replace("{lineitem}", "lineitem").replace("AS end", 'AS "end"')}),
hits AS (SELECT f.dump_id, f.address, m.module, m.base, row_number() OVER (PARTITION BY f.dump_id, f.address ORDER BY m.module_order, m.base, m.module) AS n
 FROM frames f LEFT JOIN modules m ON m.dump_id = f.dump_id AND f.address >= m.base AND f.address < m."end")
SELECT dump_id, address, module, base FROM hits WHERE n = 1""")
def address_modules(t: Tables):
    return M.frames_with_modules(t.sql(FRAMES), t.sql(MODULES), ["module_order", "base", "module"])


BUNDLE_FRAMES = """SELECT l_orderkey AS event_id, CAST(l_suppkey % 3 AS INT) AS organization_id, 'r' || CAST(l_orderkey % 4 AS STRING) AS release,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS frame_at,
 'https://cdn.example.com/js/app' || CAST(l_partkey % 40 AS STRING) || '.min.js' AS abs_path FROM {lineitem}"""
IMAGES = """SELECT CASE WHEN o_orderstatus <> 'O' THEN o_orderkey ELSE -o_orderkey END AS event_id, '/build/app' || CAST(o_custkey % 40 AS STRING) || '.min.js' AS code_file, md5(CAST(o_custkey % 60 AS STRING)) AS debug_id
 FROM {orders}"""
SOURCE_BUNDLES = """SELECT CAST(s_suppkey % 3 AS INT) AS organization_id, 'r' || CAST(s_suppkey % 4 AS STRING) AS release, s_suppkey AS bundle_id,
 CASE WHEN s_suppkey % 2 = 0 THEN md5(CAST(s_suppkey % 60 AS STRING)) END AS debug_id, 'app' || CAST(s_suppkey % 50 AS STRING) || '.min.js' AS file_name,
 CASE WHEN s_suppkey % 5 = 0 THEN 'dist/app' || CAST(s_suppkey % 35 AS STRING) || '.min.js' END AS code_file FROM {supplier}"""


@query("j15_bundle_match", f"""
WITH f AS ({BUNDLE_FRAMES.replace("{lineitem}", "lineitem")}), i AS ({IMAGES.replace("{orders}", "orders")}), b AS ({SOURCE_BUNDLES.replace("{supplier}", "supplier")}),
g AS (SELECT f.*, split_part(abs_path, '/', -1) AS file, i.debug_id FROM f LEFT JOIN i ON i.event_id = f.event_id AND split_part(i.code_file, '/', -1) = split_part(f.abs_path, '/', -1)),
hits AS (SELECT g.event_id, g.frame_at, min(b.bundle_id) AS bundle_id FROM g JOIN b ON b.organization_id = g.organization_id
 AND (b.debug_id = g.debug_id OR (b.release = g.release AND (b.file_name = g.file OR split_part(b.code_file, '/', -1) = g.file))) GROUP BY g.event_id, g.frame_at)
SELECT g.event_id, CAST(g.frame_at AS INT) AS frame_at, g.file, h.bundle_id FROM g LEFT JOIN hits h ON h.event_id = g.event_id AND h.frame_at = g.frame_at""")
def bundle_match(t: Tables):
    return M.match_bundles(t.sql(BUNDLE_FRAMES), t.sql(IMAGES), t.sql(SOURCE_BUNDLES)).select("event_id", "frame_at", "file", "bundle_id")


# -- retention ---------------------------------------------------------------------------

@query("s11_retention_by_day", """
SELECT event_id, date FROM (SELECT event_id, CAST(ts AS DATE) AS date FROM events) x WHERE CAST(date AS TIMESTAMP) >= <<now>> - INTERVAL 20 DAY""")
def retention_by_day(t: Tables):
    rows = t("events").select("event_id", F.to_date("ts").alias("date"))
    return M.keep_days(rows, "date", 20, NOW)


@query("s12_retention_by_week", """
SELECT issue_id, date, count FROM issue_hourly WHERE date_trunc('week', date) + INTERVAL 7 DAY >= DATE '2024-01-31' - INTERVAL 14 DAY""")
def retention_by_week(t: Tables):
    return M.keep_periods(t("issue_hourly"), "date", 14, NOW, weekly=True).select("issue_id", "date", "count")


@query("s08_tier_dedupe", """
WITH x AS (SELECT span_id, organization_id, date_trunc('hour', timestamp) AS hour, CAST(event_id % 3 AS INT) AS tier FROM spans)
SELECT span_id, organization_id, hour, tier FROM (SELECT *, max(tier) OVER (PARTITION BY organization_id, hour) AS top FROM x) y WHERE tier = top""")
def tier_dedupe(t: Tables):
    rows = t("spans").select("span_id", "organization_id", F.date_trunc("hour", "timestamp").alias("hour"), (F.col("event_id") % 3).cast("int").alias("tier"))
    return M.dedupe_by_tier(rows, ["organization_id", "hour"], "tier")


@query("m13_organization_delete", """
SELECT 'spans' AS dataset, count(*) AS left_over FROM spans WHERE organization_id <> 1
UNION ALL SELECT 'logs', count(*) FROM logs WHERE organization_id <> 1
UNION ALL SELECT 'events', count(*) FROM issue_events WHERE organization_id <> 1 AND project_id <> 2
UNION ALL SELECT 'transactions', count(*) FROM transactions WHERE organization_id <> 1""")
def organization_delete(t: Tables):
    kept = {
        "spans": M.purge(t("spans"), organization_id=1), "logs": M.purge(t("logs"), organization_id=1),
        "events": M.purge(t("issue_events"), organization_id=1, project_id=2), "transactions": M.purge(t("transactions"), organization_id=1),
    }
    parts = [df.agg(F.count(F.lit(1)).alias("left_over")).select(F.lit(n).alias("dataset"), "left_over") for n, df in kept.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("u03_unpromoted_rows", """
SELECT span_id, timestamp FROM spans WHERE timestamp >= TIMESTAMP '2024-01-20 00:00:00'""")
def unpromoted_rows(t: Tables):
    spans = t("spans").select("span_id", "timestamp")
    promoted = spans.where(F.col("timestamp") < F.lit("2024-01-20").cast("timestamp_ntz"))
    return U.without(spans, promoted, ["span_id"])


@query("s17_import_events", """
SELECT <<uuid7(e.received; e.k)>> AS id, e.k AS event_id, p.organization_id, e.received
FROM (SELECT *, md5(CAST(event_id AS VARCHAR)) AS k FROM issue_events) e JOIN issues i ON i.issue_id = e.issue_id JOIN projects p ON p.project_id = i.project_id
WHERE e.received >= TIMESTAMP '2024-01-03 00:00:00' AND e.received < TIMESTAMP '2024-01-27 00:00:00'""")
def import_events(t: Tables):
    archive = t("issue_events").select(F.md5(F.col("event_id").cast("string")).alias("id"), "issue_id", "received")
    found = M.import_events(archive, t("issues"), t("projects"), datetime(2024, 1, 3), datetime(2024, 1, 27))
    return found.select("id", "event_id", "organization_id", "received")
