"""Issue queries: grouping, counters, search, reading."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ..functions import ids as K
from ..functions.levels import ISSUE_STATUSES
from ..functions.text import grouping_hash
from ..functions.timeparam import moment, resolve_time
from ..operators import heavy as H, issues as I, upsert as U
from ..operators.segmented import join_on_keys, written_once
from ..sources import issuestore
from ..sources.keyedstore import KeyedStore
from .registry import NOW, Tables, query

SPLIT = "2024-01-16 00:00:00"


def halves(t: Tables):
    events, at = t("issue_events"), F.lit(SPLIT).cast("timestamp_ntz")
    return events.where(F.col("received") < at), events.where(F.col("received") >= at)


def known_hashes(t: Tables):
    """Stored hashes with the state of their issue; those of project 4 are others than its events have."""
    other = F.when(F.col("project_id") == 4, F.concat(F.lit("other-"), "hash")).otherwise(F.col("hash"))
    return t("issues").select("project_id", other.alias("hash"), "issue_id", "status", "resolved_in_release")


@query("f06_grouping_hash", """
SELECT event_id, md5(title || culprit || '1') AS by_default,
 CASE WHEN event_id % 3 = 0 THEN md5('a' || title || culprit || '1' || '') WHEN event_id % 3 = 1 THEN md5('grp-' || CAST(user_id % 7 AS VARCHAR)) ELSE md5(title || culprit || '1') END AS by_fingerprint
FROM issue_events JOIN events USING (event_id)""")
def grouping_hashes(t: Tables):
    fingerprint = (
        F.when(F.col("event_id") % 3 == 0, F.array(F.lit("a"), F.lit("{{ default }}"), F.lit(None).cast("string")))
        .when(F.col("event_id") % 3 == 1, F.array(F.lit("grp-"), F.regexp_extract("culprit", r"(\d+)$", 1)))
        .otherwise(F.array().cast("array<string>"))
    )
    title, culprit, kind = F.col("title"), F.col("culprit"), F.col("type")
    return t("issue_events").select(
        "event_id", grouping_hash(title, culprit, kind).alias("by_default"), grouping_hash(title, culprit, kind, fingerprint).alias("by_fingerprint")
    )


@query("j01_hash_lookup", """
SELECT e.event_id, e.project_id, i.issue_id, i.status, i.resolved_in_release FROM issue_events e
JOIN issues i ON e.project_id = i.project_id AND e.hash = CASE WHEN i.project_id = 4 THEN 'other-' || i.hash ELSE i.hash END""")
def hash_lookup(t: Tables):
    events = t("issue_events").drop("issue_id")
    return join_on_keys(events, known_hashes(t), I.EVENT_KEYS).select("event_id", "project_id", "issue_id", "status", "resolved_in_release")


@query("m01_group_events", f"""
WITH batch AS (SELECT * FROM issue_events WHERE received >= TIMESTAMP '{SPLIT}'),
stored AS (SELECT project_id, hash, count(*) AS old_count FROM issue_events WHERE received < TIMESTAMP '{SPLIT}' AND user_id_mod <> 3 GROUP BY project_id, hash),
g AS (SELECT project_id, hash, count(*) AS count, min(received) AS first_seen, max(received) AS last_seen, arg_min(title, event_id) AS title,
 min(received) AS f FROM batch GROUP BY project_id, hash)
SELECT g.project_id, g.hash, CAST(g.project_id AS VARCHAR) || '-' || g.hash AS issue_id, g.title, g.first_seen, g.last_seen, g.count,
 0 AS status, 100 + row_number() OVER (PARTITION BY g.project_id ORDER BY g.first_seen, g.hash) AS short_id
FROM g LEFT JOIN stored s ON g.project_id = s.project_id AND g.hash = s.hash WHERE s.hash IS NULL""".replace(
    "user_id_mod <> 3", "culprit <> 'app.mod3'"))
def group_events(t: Tables):
    """Groups of the second half that the first half (without one module) has not seen."""
    old, new = halves(t)
    hashes = old.where(F.col("culprit") != "app.mod3").select(*I.EVENT_KEYS).distinct()
    counters = t("issue_events").select("project_id").distinct().withColumn("short_id", F.lit(100).cast("bigint"))
    found = I.new_issues(I.group_batch(new), hashes, counters)
    return found.select("project_id", "hash", "issue_id", "title", "first_seen", "last_seen", "count", "status", "short_id")


@query("w04_short_ids", """
SELECT project_id, issue_id, row_number() OVER (PARTITION BY project_id ORDER BY first_seen, hash) AS short_id FROM issues""")
def short_ids(t: Tables):
    groups = I.group_batch(t("issue_events"))
    none = groups.limit(0).select(*I.EVENT_KEYS)
    return I.new_issues(groups, none).select("project_id", "issue_id", "short_id")


@query("m02_reopen", """
WITH hits AS (SELECT DISTINCT i.issue_id FROM issues i JOIN issue_events e ON e.project_id = i.project_id AND e.hash = i.hash
 WHERE i.status = 1 AND e.received >= TIMESTAMP '2024-01-16 00:00:00' AND (i.resolved_in_release IS NULL OR (e.release IS NOT NULL AND e.release <> i.resolved_in_release)))
SELECT i.issue_id, CASE WHEN h.issue_id IS NULL THEN i.status ELSE 0 END AS status, CASE WHEN h.issue_id IS NULL THEN i.resolved_in_release END AS resolved_in_release
FROM issues i LEFT JOIN hits h ON i.issue_id = h.issue_id""")
def reopen(t: Tables):
    _, new = halves(t)
    issues = t("issues")
    state = issues.select("project_id", "hash", "issue_id", "status", "resolved_in_release")
    hits = I.issues_to_reopen(I.link_events(new.drop("issue_id"), state))
    return I.reopen(issues, hits).select("issue_id", "status", "resolved_in_release")


@query("m02_drop_notifications", """
WITH links AS (SELECT event_id // 10 AS notification_id, issue_id FROM issue_events GROUP BY ALL),
reopened AS (SELECT issue_id FROM issues WHERE status = 1 AND project_id = 2)
SELECT notification_id, issue_id FROM links WHERE notification_id NOT IN (SELECT notification_id FROM links WHERE issue_id IN (SELECT issue_id FROM reopened))""")
def drop_notifications(t: Tables):
    links = t("issue_events").select(F.expr("event_id div 10").alias("notification_id"), "issue_id").distinct()
    gone = t("issues").where((F.col("status") == 1) & (F.col("project_id") == 2)).select("issue_id")
    return I.drop_notifications(links, gone)


@query("a09_project_hourly", """
SELECT project_id, organization_id, date, count, 'error' AS category FROM project_hourly
UNION ALL SELECT project_id, organization_id, date, count, 'transaction' AS category FROM transaction_hourly""")
def project_hourly(t: Tables):
    errors = I.hourly_counts(t("issue_events"), "project_id", "organization_id").withColumn("category", F.lit("error"))
    txns = I.hourly_counts(t("transactions"), "project_id", "organization_id").withColumn("category", F.lit("transaction"))
    return errors.unionByName(txns)


@query("a10_issue_hourly", "SELECT issue_id, organization_id, date, count FROM issue_hourly")
def issue_hourly(t: Tables):
    return I.hourly_counts(t("issue_events"), "issue_id", "organization_id")


@query("a11_issue_tag_counts", "SELECT date, issue_id, organization_id, tag_key, tag_value, count FROM issue_tags")
def issue_tag_counts(t: Tables):
    tags = F.map_filter(
        F.create_map(F.lit("environ\u0000ment"), "environment", F.lit("release"), "release", F.lit("user.id"), F.concat("tag_user", F.lit("\u0000"))),
        lambda k, v: v.isNotNull(),
    )
    return I.daily_tag_counts(I.tag_rows(t("issue_events").withColumn("tags", tags)))


@query("a12_issue_rollup", """
SELECT issue_id, count, last_seen, last_release FROM (SELECT issue_id, count(*) AS count, max(received) AS last_seen,
 arg_max(release, struct_pack(a := received, b := event_id)) FILTER (WHERE release IS NOT NULL) AS last_release FROM issue_events GROUP BY issue_id) x""")
def issue_rollup(t: Tables):
    """Rollup of the first half, then the second half's updates on top."""
    old, new = halves(t)
    every = t("issue_events").select("issue_id").distinct()
    base = every.join(I.rollup_updates(old), "issue_id", "left").select(
        "issue_id", F.coalesce("added", F.lit(0)).alias("count"), "last_seen", "last_release"
    )
    return I.apply_rollup(base, I.rollup_updates(new)).select("issue_id", "count", "last_seen", "last_release")


@query("m05_additive_upsert", "SELECT project_id, organization_id, date, CAST(count AS BIGINT) AS count FROM project_hourly")
def additive_upsert(t: Tables):
    old, new = (I.hourly_counts(h, "project_id", "organization_id") for h in halves(t))
    return U.add_counts(old, new, ["project_id", "organization_id", "date"])


@query("m05_delta_counters", "SELECT project_id, organization_id, date, CAST(count AS BIGINT) AS count FROM project_hourly")
def delta_counters(t: Tables):
    """Four batches of events as deltas, folded after the second; nothing stored is read to add one."""
    keys = ["project_id", "organization_id", "date"]
    store = KeyedStore.create(t.spark, t.scratch("delta-counters"), "project_id int, organization_id int, date timestamp_ntz, count bigint", keys, {"count": "sum"}, 8)
    for k in range(4):
        batch = t("issue_events").where(F.col("event_id") % 4 == k)
        store.commit(I.hourly_counts(batch, "project_id", "organization_id"), NOW, f"batch-{k}")
        if k == 1:
            store.fold(NOW)
    return store.read()


#: Issues by batches that end at two times: numbers go on from batch to batch.
BATCHED_SQL = """
WITH b AS (SELECT *, CASE WHEN received < TIMESTAMP '2024-01-08 00:00:00' THEN 0 WHEN received < TIMESTAMP '2024-01-16 00:00:00' THEN 1 ELSE 2 END AS batch FROM issue_events),
g AS (SELECT project_id, hash, count(*) AS count, min(received) AS first_seen, max(received) AS last_seen, min(batch) AS batch,
 arg_min(title, struct_pack(a := received, b := title)) AS title,
 arg_max(release, struct_pack(a := received, b := release)) FILTER (WHERE release IS NOT NULL) AS last_release FROM b GROUP BY project_id, hash)
SELECT project_id, hash, title, count, first_seen, last_seen, last_release, row_number() OVER (PARTITION BY project_id ORDER BY batch, first_seen, hash) AS short_id FROM g"""


def issue_rows(store: KeyedStore):
    return store.read().select("project_id", "hash", "title", "count", "first_seen", "last_seen", "last_release", "short_id")


@query("m01_grouping_store", BATCHED_SQL)
def grouping_store(t: Tables):
    """Three batches into the keyed store of issues, each tried twice, with a fold between."""
    store = issuestore.create(t.spark, t.scratch("issue-store"), 8)
    old, new = halves(t)
    early = F.col("received") < F.lit("2024-01-08 00:00:00").cast("timestamp_ntz")
    for k, batch in enumerate([old.where(early), old.where(~early), new]):
        for _ in range(2):
            issuestore.group_into(store, batch, NOW, f"batch-{k}")
        if k == 1:
            store.fold(NOW)
    return issue_rows(store)


@query("s14_conflict_tolerant_append", """
SELECT event_id, event_type, user_id FROM events""")
def conflict_tolerant_append(t: Tables):
    """A batch with repeated and already stored ids adds only the unknown ones."""
    events = t("events").select("event_id", "event_type", "user_id")
    stored = events.where(F.col("event_type") == "click")
    again = events.withColumn("event_type", F.concat("event_type", F.lit("~late")))
    return U.insert_if_absent(stored, events.unionByName(again), ["event_id"], ["event_type"])


# -- search --------------------------------------------------------------------------

FOUND = ["issue_id", "project_id", "status", "level", "count"]


@query("p03_issue_search", """
SELECT issue_id, project_id, status, level, count FROM issues i WHERE NOT is_deleted AND status = 0 AND level = 3
 AND EXISTS (SELECT 1 FROM issue_tags g WHERE g.issue_id = i.issue_id AND tag_key = 'release')
 AND EXISTS (SELECT 1 FROM issue_tags g WHERE g.issue_id = i.issue_id AND tag_key = 'environment' AND tag_value = 'prod')
 AND EXISTS (SELECT 1 FROM issue_tags g WHERE g.issue_id = i.issue_id AND tag_key = 'user.id' AND tag_value IN ('user2'))""")
def issue_search(t: Tables):
    found = I.find_issues(t("issues"), t("issue_tags"), query='is:unresolved level:warning has:release environment:"prod" user.id:user2')
    return found.select(*FOUND)


@query("p03_issue_text_search", """
SELECT issue_id, project_id, status, level, count FROM issues WHERE NOT is_deleted AND status = 0
 AND len(list_filter(regexp_extract_all(lower(title), '[\\p{L}\\p{N}_]+'), lambda w: w IN ('click', 'module'))) = 2""")
def issue_text_search(t: Tables):
    issues = t("issues").withColumn("terms", I.terms(F.col("title")))
    return I.find_issues(issues, t("issue_tags"), query="is:unresolved Click in the MODULE").select(*FOUND)


@query("p04_environment_filter", """
SELECT issue_id, project_id, status, level, count FROM issues i WHERE NOT is_deleted
 AND EXISTS (SELECT 1 FROM issue_tags g WHERE g.issue_id = i.issue_id AND tag_key = 'environment' AND tag_value IN ('staging', 'qa'))""")
def environment_filter(t: Tables):
    return I.find_issues(t("issues"), t("issue_tags"), environments=["staging", "qa"]).select(*FOUND)


@query("p05_issue_ranges", """
SELECT issue_id, project_id, status, level, count FROM issues
WHERE project_id IN (0, 1, 2) AND first_seen >= TIMESTAMP '2024-01-01 06:00:00' AND first_seen <= TIMESTAMP '2024-01-20 00:00:00'""")
def issue_ranges(t: Tables):
    found = I.find_issues(
        t("issues"), t("issue_tags"), projects=[0, 1, 2], first_seen_from=datetime(2024, 1, 1, 6), first_seen_to=datetime(2024, 1, 20), hide_deleted=False
    )
    return found.select(*FOUND)


@query("p06_relative_time", """
SELECT event_id, received FROM issue_events WHERE received >= <<now>> - INTERVAL 9 DAY AND received <= <<now>> - INTERVAL 36 HOUR""")
def relative_time(t: Tables):
    start, end = resolve_time("now - 9d", NOW), resolve_time("now-36h", NOW)
    return t("issue_events").where(F.col("received").between(moment(start), moment(end))).select("event_id", "received")


@query("p18_wildcard_title", """
SELECT issue_id, title FROM issues WHERE NOT is_deleted AND title ILIKE '%cli%module _%'""")
def wildcard_title(t: Tables):
    issues = t("issues").withColumn("terms", I.terms(F.col("title")))
    return I.find_issues(issues, t("issue_tags"), query="CLI*module _").select("issue_id", "title")


def minted(t: Tables):
    """Events with a time-ordered id and, for most, a client id."""
    events = t("issue_events")
    return events.select(
        K.uuid7_from_timestamp(F.col("received"), F.col("event_id")).alias("id"),
        F.md5(F.concat(F.lit("c"), F.col("event_id").cast("string"))).alias("client_id"), "event_id", "received", "issue_id",
    ).withColumn("date", F.to_date("received"))


@query("p09_point_lookup", """
SELECT event_id, 'own' AS by_id FROM issue_events WHERE event_id = (SELECT CAST(floor(max(event_id) / 2) AS BIGINT) FROM issue_events)
UNION ALL SELECT event_id, 'client' AS by_id FROM issue_events WHERE event_id = 17""")
def point_lookup(t: Tables):
    """A time-ordered id leads to its day; a client id is looked for within 90 days."""
    rows = minted(t)
    wanted = rows.where(F.col("event_id") == F.floor(t("issue_events").agg(F.max("event_id")).scalar() / 2)).select("id").first()["id"]
    own, client = I.find_event(rows, F.lit(wanted), NOW), I.find_event(rows, F.md5(F.lit("c17")), NOW)
    return own.select("event_id", F.lit("own").alias("by_id")).unionByName(client.select("event_id", F.lit("client").alias("by_id")))


@query("p10_time_range_by_id", """
SELECT event_id, received FROM issue_events WHERE received >= TIMESTAMP '2024-01-05 06:00:00' AND received < TIMESTAMP '2024-01-19 18:30:00'""")
def time_range_by_id(t: Tables):
    return minted(t).where(K.uuid7_range(datetime(2024, 1, 5, 6), datetime(2024, 1, 19, 18, 30), F.col("id"))).select("event_id", "received")


@query("f01_uuid7", "SELECT event_id, <<uuid7(ts; event_id)>> AS id FROM events")
def uuid7(t: Tables):
    return t("events").select("event_id", K.uuid7_from_timestamp(F.col("ts"), F.col("event_id")).alias("id"))


@query("f02_uuid7_timestamp", "SELECT event_id, date_trunc('milliseconds', ts) AS at, NULL::TIMESTAMP AS other FROM events")
def uuid7_timestamps(t: Tables):
    uid = K.uuid7_from_timestamp(F.col("ts"), F.col("event_id"))
    return t("events").select("event_id", K.uuid7_timestamp(uid).alias("at"), K.uuid7_timestamp(F.regexp_replace(uid, "-7", "-4")).alias("other"))


@query("f03_uuid7_bounds", """
SELECT date_trunc('day', ts) AS day, count(*) AS inside FROM events WHERE ts >= TIMESTAMP '2024-01-08 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00' GROUP BY 1""")
def uuid7_bounds(t: Tables):
    """Both kinds of bound: smallest id of the start, largest id of the millisecond before the end."""
    rows = t("events").withColumn("id", K.uuid7_from_timestamp(F.col("ts"), F.col("event_id")))
    last = K.uuid7_bound(datetime(2024, 1, 12) - timedelta(milliseconds=1), last=True)
    rows = rows.where((F.col("id") >= K.uuid7_bound(datetime(2024, 1, 8))) & (F.col("id") <= last))
    return rows.groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("inside"))


@query("f04_is_uuid7", "SELECT event_id, event_id % 2 = 0 AS is_v7 FROM events")
def is_uuid7(t: Tables):
    minted_id = K.uuid7_from_timestamp(F.col("ts"), F.col("event_id"))
    other = F.concat(F.substring(minted_id, 1, 14), F.lit("4"), F.substring(minted_id, 16, 30))
    return t("events").select("event_id", K.is_uuid7(F.when(F.col("event_id") % 2 == 0, minted_id).otherwise(other)).alias("is_v7"))


# -- reading -------------------------------------------------------------------------

@query("w01_latest_event", """
SELECT issue_id, event_id, received, title FROM (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY received DESC, event_id DESC) AS n FROM issue_events) x WHERE n = 1""")
def latest_event(t: Tables):
    return I.latest_events(t("issue_events").select("issue_id", "event_id", "received", "title"))


@query("j06_w02_event_neighbours", """
SELECT event_id, issue_id, lag(event_id) OVER w AS prev_event_id, lead(event_id) OVER w AS next_event_id
FROM issue_events WINDOW w AS (PARTITION BY issue_id ORDER BY received, event_id)""")
def event_neighbours(t: Tables):
    events = t("issue_events").select("event_id", "issue_id", "received")
    return I.event_neighbours(events).select("event_id", "issue_id", "prev_event_id", "next_event_id")


@query("j06_project_neighbours", """
SELECT event_id, project_id, lag(event_id) OVER w AS prev_event_id, lead(event_id) OVER w AS next_event_id
FROM issue_events WINDOW w AS (PARTITION BY project_id ORDER BY received, event_id)""")
def project_neighbours(t: Tables):
    events = t("issue_events").select("event_id", "project_id", "received")
    return I.event_neighbours(events, "project_id").select("event_id", "project_id", "prev_event_id", "next_event_id")


@query("j13_latest_event_per_hash", """
SELECT i.project_id, i.hash, max(e.event_id) AS latest_event_id FROM (SELECT project_id, hash FROM issues) i
LEFT JOIN (SELECT *, first_value(event_id) OVER (PARTITION BY project_id, hash ORDER BY received DESC, event_id DESC) AS newest FROM issue_events) e
 ON e.project_id = i.project_id AND e.hash = i.hash AND e.event_id = e.newest GROUP BY i.project_id, i.hash""")
def latest_event_per_hash(t: Tables):
    events = t("issue_events").withColumn("hashes", F.array("hash", F.md5("title")))
    return I.latest_event_per_hash(t("issues").select("project_id", "hash"), events)


@query("j14_child_counts", """
SELECT i.issue_id, i.count, coalesce(c.n, 0) AS num_comments, coalesce(r.n, 0) AS num_reports FROM issues i
LEFT JOIN (SELECT issue_id, count(*) AS n FROM issue_events WHERE environment = 'prod' GROUP BY issue_id) c ON c.issue_id = i.issue_id
LEFT JOIN (SELECT issue_id, count(*) AS n FROM issue_events WHERE release IS NULL GROUP BY issue_id) r ON r.issue_id = i.issue_id""")
def child_counts(t: Tables):
    events = t("issue_events")
    out = I.with_child_counts(t("issues"), num_comments=events.where("environment = 'prod'"), num_reports=events.where("release IS NULL"))
    return out.select("issue_id", "count", "num_comments", "num_reports")


PAIRS_SQL = """
WITH n AS (SELECT issue_id, epoch({slot})::BIGINT AS epoch, CAST(sum(count) AS BIGINT) AS n FROM issue_hourly WHERE date >= {since} GROUP BY issue_id, epoch({slot})::BIGINT)
SELECT issue_id, string_agg(CAST(epoch AS VARCHAR) || ':' || CAST(n AS VARCHAR), ',' ORDER BY epoch) AS pairs FROM n GROUP BY issue_id"""


def _pairs_text(df):
    text = F.transform("pairs", lambda p: F.concat(p["epoch"].cast("string"), F.lit(":"), p["n"].cast("string")))
    return df.select("issue_id", F.array_join(text, ",").alias("pairs"))


@query("a18_issue_stats_24h", PAIRS_SQL.format(slot="date", since="TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOUR"))
def issue_stats_24h(t: Tables):
    return _pairs_text(I.stats_24h(t("issue_hourly"), datetime(2024, 1, 30, 12)))


@query("a18_issue_stats_14d", PAIRS_SQL.format(slot="date_trunc('day', date)", since="<<now>> - INTERVAL 14 DAY"))
def issue_stats_14d(t: Tables):
    return _pairs_text(I.stats_14d(t("issue_hourly"), NOW))


@query("a19_tag_breakdown", """
WITH v AS (SELECT issue_id, tag_key, tag_value, CAST(sum(count) AS BIGINT) AS value_count FROM issue_tags GROUP BY issue_id, tag_key, tag_value)
SELECT *, count(*) OVER (PARTITION BY issue_id, tag_key) AS unique_values, CAST(sum(value_count) OVER (PARTITION BY issue_id, tag_key) AS BIGINT) AS total_values FROM v""")
def tag_breakdown(t: Tables):
    return I.tag_breakdown(t("issue_tags"))


@query("a19_top_values_incremental", """
WITH v AS (SELECT issue_id, tag_key, tag_value, CAST(sum(count) AS BIGINT) AS value_count FROM issue_tags GROUP BY issue_id, tag_key, tag_value)
SELECT issue_id, tag_key, tag_value, value_count, row_number() OVER (PARTITION BY issue_id, tag_key ORDER BY value_count DESC, tag_value) AS nth
FROM v QUALIFY nth <= 3""")
def top_values_incremental(t: Tables):
    """Summaries of each day, merged by week as they would be stored, then the top three; what they leave open is counted."""
    keys, tags = ["issue_id", "tag_key"], t("issue_tags")
    daily = written_once(H.summarize(tags, [*keys, "date"], "tag_value", size=16), "daily-values")
    week = F.date_trunc("week", "date").cast("timestamp_ntz")
    weekly = written_once(H.merge(daily.withColumn("week", week), [*keys, "week"], size=16), "weekly-values")
    found = H.exact_top(weekly, tags, keys, "tag_value", 3)
    return found.select(*keys, F.col("value").alias("tag_value"), F.col("count").alias("value_count"), "nth")


@query("l03_issue_sort", """
SELECT issue_id, count, last_seen FROM issues ORDER BY count DESC, issue_id LIMIT 20""")
def issue_sort(t: Tables):
    return I.sort_issues(t("issues"), "-count", 20).select("issue_id", "count", "last_seen")


@query("l04_priority", """
SELECT issue_id, round(log10(count) + epoch_us(last_seen) / 1e6 / 300000.0, 6) AS priority FROM issues ORDER BY log10(count) + epoch_us(last_seen) / 1e6 / 300000.0 DESC, issue_id LIMIT 30""")
def priority(t: Tables):
    top = I.sort_issues(t("issues"), "-priority", 30)
    return top.select("issue_id", F.round(I.priority(F.col("count"), F.col("last_seen")), 6).alias("priority"))


@query("l07_hash_list", "SELECT hash, project_id, issue_id FROM issues ORDER BY hash, project_id LIMIT 40")
def hash_list(t: Tables):
    return I.hash_list(t("issues").select("hash", "project_id", "issue_id"), 40)


@query("u04_distinct_tags", """
SELECT DISTINCT 'key' AS kind, tag_key AS name FROM event_tags UNION ALL SELECT DISTINCT 'value' AS kind, tag_value AS name FROM event_tags""")
def distinct_tags(t: Tables):
    return I.distinct_tags(t("event_tags"))


@query("f13_search_terms", """
WITH words AS (SELECT DISTINCT issue_id, unnest(regexp_extract_all(lower(title || ' ' || culprit || ' the error by user ' || tag_user), '[\\p{L}\\p{N}_]+')) AS term FROM issue_events),
kept AS (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY term) AS pos FROM words WHERE term NOT IN ('the', 'by', 'in'))
SELECT issue_id, string_agg(term, ' ' ORDER BY term) AS terms FROM kept GROUP BY issue_id""")
def search_terms(t: Tables):
    text = F.concat_ws(" ", "title", "culprit", F.lit("the error by user"), "tag_user")
    found = I.issue_terms(t("issue_events").withColumn("text", text), "text")
    return found.select("issue_id", F.array_join("terms", " ").alias("terms"))


# Fixed values, written out so that the check does not follow a mistake in the package's list.
STOPS = """'i', 'me', 'my', 'myself', 'we', 'our', 'ours', 'ourselves', 'you', 'your', 'yours', 'yourself', 'yourselves', 'he', 'him', 'his', 'himself', 'she',
 'her', 'hers', 'herself', 'it', 'its', 'itself', 'they', 'them', 'their', 'theirs', 'themselves', 'what', 'which', 'who', 'whom', 'this', 'that',
 'these', 'those', 'am', 'is', 'are', 'was', 'were', 'be', 'been', 'being', 'have', 'has', 'had', 'having', 'do', 'does', 'did', 'doing', 'a', 'an',
 'the', 'and', 'but', 'if', 'or', 'because', 'as', 'until', 'while', 'of', 'at', 'by', 'for', 'with', 'about', 'against', 'between', 'into', 'through',
 'during', 'before', 'after', 'above', 'below', 'to', 'from', 'up', 'down', 'in', 'out', 'on', 'off', 'over', 'under', 'again', 'further', 'then',
 'once', 'here', 'there', 'when', 'where', 'why', 'how', 'all', 'any', 'both', 'each', 'few', 'more', 'most', 'other', 'some', 'such', 'no', 'nor',
 'not', 'only', 'own', 'same', 'so', 'than', 'too', 'very', 's', 't', 'can', 'will', 'just', 'don', 'should', 'now'"""


@query("f13_append_terms", """
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM documents UNION ALL SELECT doc_id, 'zzz' FROM documents UNION ALL SELECT doc_id, 'aaa' FROM documents),
uniq AS (SELECT DISTINCT doc_id, term FROM words WHERE term IN ('aaa', 'zzz') OR term NOT IN ({stops})),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY term) AS pos FROM uniq)
SELECT doc_id, md5(string_agg(term, ' ' ORDER BY term)) AS terms, count(*) AS n FROM kept GROUP BY doc_id""".replace("{stops}", STOPS))
def append_terms(t: Tables):
    old = F.array(F.lit("zzz"), F.lit("aaa"))
    terms = I.append_terms(old, F.col("text"))
    return t("documents").select("doc_id", F.md5(F.array_join(terms, " ")).alias("terms"), F.size(terms).cast("bigint").alias("n"))


# -- bulk changes ----------------------------------------------------------------------

@query("m06_bulk_status", """
SELECT issue_id, CASE WHEN project_id IN (1, 3) AND NOT is_deleted THEN 2 ELSE status END AS status FROM issues""")
def bulk_status(t: Tables):
    issues = t("issues")
    chosen = I.find_issues(issues, t("issue_tags"), projects=[1, 3])
    ignored = next(n for n, label in ISSUE_STATUSES.items() if label == "ignored")
    return I.set_status(issues, chosen, ignored).select("issue_id", "status")


REQUEST = "CASE CAST('0x' || substr(hash, 1, 1) AS INT) % 5 WHEN 0 THEN 'user:' || CAST(project_id * 5 + organization_id AS VARCHAR) WHEN 1 THEN 'team:team-' || CAST(organization_id AS VARCHAR) WHEN 2 THEN 'u' || CAST(project_id * 5 + organization_id AS VARCHAR) || '@example.com' WHEN 3 THEN '' ELSE 'nobody@example.com' END"


@query("m07_bulk_assign", f"""
WITH asked AS (SELECT issue_id, organization_id, {REQUEST} AS a FROM issues),
p AS (SELECT a.issue_id, a.a, min(m.user_id) AS u FROM asked a LEFT JOIN members m ON m.organization_id = a.organization_id
 AND (a.a = 'user:' || CAST(m.user_id AS VARCHAR) OR a.a = m.email) GROUP BY ALL),
g AS (SELECT a.issue_id, min(x.team_id) AS team FROM asked a LEFT JOIN teams x ON x.organization_id = a.organization_id AND a.a = 'team:' || x.slug GROUP BY a.issue_id)
SELECT p.issue_id, CASE WHEN p.u IS NOT NULL OR g.team IS NOT NULL OR p.a = '' THEN p.u ELSE 7 END AS assigned_user,
 CAST(CASE WHEN p.u IS NOT NULL OR g.team IS NOT NULL OR p.a = '' THEN g.team END AS BIGINT) AS assigned_team
FROM p JOIN g ON p.issue_id = g.issue_id""")
def bulk_assign(t: Tables):
    issues = t("issues").withColumn("assigned_user", F.lit(7).cast("bigint")).withColumn("assigned_team", F.lit(None).cast("bigint"))
    spark_request = REQUEST.replace("CAST('0x' || substr(hash, 1, 1) AS INT)", "CAST(conv(substr(hash, 1, 1), 16, 10) AS INT)").replace("VARCHAR", "STRING")
    requests = issues.select("issue_id", F.expr(spark_request).alias("assigned_to"))
    return I.assign(issues, requests, t("members"), t("teams")).select("issue_id", "assigned_user", "assigned_team")


MAPPING_SQL = "mapping AS (SELECT issue_id AS source_id, max(issue_id) OVER (PARTITION BY project_id) AS target_id FROM issues WHERE status = 2)"


def mapping(t: Tables):
    chosen = t("issues").where(F.col("status") == 2)
    targets = chosen.groupBy("project_id").agg(F.max("issue_id").alias("target_id"))
    return chosen.join(targets, "project_id").select(F.col("issue_id").alias("source_id"), "target_id")


@query("m08_merge_issues", f"""
WITH {MAPPING_SQL},
moved AS (SELECT target_id, CAST(sum(count) AS BIGINT) AS n FROM mapping JOIN issues ON issue_id = source_id WHERE source_id <> target_id GROUP BY target_id)
SELECT i.issue_id, i.count + coalesce(m.n, 0) AS count, i.is_deleted OR coalesce(s.source_id <> s.target_id, FALSE) AS is_deleted
FROM issues i LEFT JOIN moved m ON m.target_id = i.issue_id LEFT JOIN mapping s ON s.source_id = i.issue_id""")
def merge_issues(t: Tables):
    return I.merge_issues(t("issues"), mapping(t)).select("issue_id", "count", "is_deleted")


@query("m08_move_events", f"""
WITH {MAPPING_SQL}
SELECT e.event_id, coalesce(m.target_id, e.issue_id) AS issue_id FROM issue_events e LEFT JOIN mapping m ON m.source_id = e.issue_id""")
def move_events(t: Tables):
    return I.repoint(t("issue_events").select("event_id", "issue_id"), mapping(t))


@query("f45_issue_view", """
SELECT i.issue_id, i.title, i.culprit, p.slug AS project_slug, 'error' AS type,
 CASE i.level WHEN 2 THEN 'info' WHEN 3 THEN 'warning' WHEN 4 THEN 'error' END AS level,
 CASE i.level WHEN 2 THEN '#4b60b4' WHEN 3 THEN '#e9b949' ELSE '#e52b50' END AS colour,
 CASE i.status WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'ignored' END AS status,
 upper(p.slug) || '-' || upper(CASE WHEN i.count >= 1024 THEN substr('0123456789ABCDEFGHIJKLMNOPQRSTUV', CAST(i.count // 1024 AS INT) + 1, 1) ELSE '' END ||
  CASE WHEN i.count >= 32 THEN substr('0123456789ABCDEFGHIJKLMNOPQRSTUV', CAST(i.count // 32 % 32 AS INT) + 1, 1) ELSE '' END ||
  substr('0123456789ABCDEFGHIJKLMNOPQRSTUV', CAST(i.count % 32 AS INT) + 1, 1)) AS short_id,
 CASE WHEN i.status = 1 THEN i.resolved_in_release END AS in_release, 'user' AS assignee_type, CAST(i.project_id AS VARCHAR) AS assignee_id,
 CAST(i.count AS VARCHAR) AS count, i.first_release, i.last_release
FROM issues i LEFT JOIN projects p ON p.project_id = i.project_id""")
def issue_view(t: Tables):
    issues = t("issues").withColumn("short_id", F.col("count")).withColumn("assigned_user", F.col("project_id")).withColumn(
        "assigned_team", F.lit(None).cast("bigint")
    )
    return I.issue_view(issues, t("projects"))


REF = "md5('c' || CAST(event_id AS VARCHAR))"


@query("j11_user_reports", f"""
WITH raw AS (SELECT doc_id AS report_key, CAST(doc_id % 5 AS INT) AS project_id, CAST(doc_id % 5 % 3 AS INT) AS organization_id,
 CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 10 = 1 THEN 'broken' ELSE md5('c' || CAST(doc_id // 2 * 2 + 600 AS VARCHAR)) END AS event_ref FROM documents),
valid AS (SELECT report_key, project_id, organization_id, event_ref <> '' AS given,
 CASE WHEN event_ref <> '' THEN event_ref ELSE md5(CAST(project_id AS VARCHAR) || ':' || CAST(report_key AS VARCHAR)) END AS event_ref FROM raw WHERE event_ref <> 'broken'),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, event_ref ORDER BY report_key) AS n FROM valid) v WHERE n = 1),
recent AS (SELECT organization_id, {REF} AS event_ref, issue_id FROM issue_events WHERE received >= <<now>> - INTERVAL 7 DAY)
SELECT k.report_key, k.project_id, k.event_ref, r.issue_id FROM kept k LEFT JOIN recent r
 ON k.given AND k.organization_id = r.organization_id AND k.event_ref = r.event_ref""")
def user_reports(t: Tables):
    key = F.col("doc_id")
    ref = F.when(key % 10 == 0, F.lit("")).when(key % 10 == 1, F.lit("broken")).otherwise(
        F.md5(F.concat(F.lit("c"), (F.floor(key / 2) * 2 + 600).cast("string")))
    )
    reports = t("documents").select(
        key.alias("report_key"), (key % 5).cast("int").alias("project_id"), (key % 5 % 3).cast("int").alias("organization_id"), ref.alias("event_ref")
    )
    events = t("issue_events").select("organization_id", "received", "issue_id", F.md5(F.concat(F.lit("c"), F.col("event_id").cast("string"))).alias("event_ref"))
    return I.link_reports(reports, events, NOW).select("report_key", "project_id", "event_ref", "issue_id")
