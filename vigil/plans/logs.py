"""Log queries."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ..functions import levels as V, otel as O
from ..functions.ids import hash_bucket, uuid7_bound, uuid7_from_timestamp
from ..operators import logs as L, paging
from .registry import NOW, Tables, query

LEVELLED = "levelled AS (SELECT *, <<level>> AS level FROM logs)"
COLUMNS = ["log_id", "timestamp", "level", "service", "body"]


def levelled(t: Tables):
    return t("logs").withColumn("level", V.log_level(F.col("level_name")))


@query("p01_log_search", f"""
WITH {LEVELLED}
SELECT log_id, timestamp, level, service, body FROM levelled WHERE organization_id = 1 AND project_id IN (1, 2, 3, 4)
 AND timestamp >= TIMESTAMP '2024-01-04 00:00:00' AND timestamp < TIMESTAMP '2024-01-28 00:00:00'
 AND level IN (3, 4, 2) AND environment = 'prod' AND lower(body) LIKE '%100\\% done\\_%' ESCAPE '\\'""")
def log_search(t: Tables):
    return L.search_logs(
        levelled(t), organization_id=1, project_ids=[1, 2, 3, 4], start=datetime(2024, 1, 4), end=datetime(2024, 1, 28),
        levels=["warning", "ERROR", "info", "nonsense"], environment="prod", query="100% DONE_",
    ).select(*COLUMNS)


@query("p01_log_search_wildcards_are_literal", f"""
WITH {LEVELLED}
SELECT 'plain' AS kind, count(*) AS hits FROM levelled WHERE contains(lower(body), '{{"k": 5')
UNION ALL SELECT 'wildcard' AS kind, count(*) AS hits FROM levelled WHERE contains(body, '_}}')""")
def literal_search(t: Tables):
    rows = levelled(t)
    parts = [
        L.search_logs(rows, query=text).agg(F.count(F.lit(1)).alias("hits")).select(F.lit(kind).alias("kind"), "hits")
        for kind, text in (("plain", '{"K": 5'), ("wildcard", "_}"))
    ]
    return parts[0].unionByName(parts[1])


@query("p02_level_filter", f"""
WITH {LEVELLED}
SELECT 'known' AS wanted, level, count(*) AS count FROM levelled WHERE level IN (3, 4) GROUP BY level
UNION ALL SELECT 'unknown' AS wanted, level, count(*) AS count FROM levelled GROUP BY level""")
def level_filters(t: Tables):
    def counted(label, names):
        found = L.search_logs(levelled(t), levels=names)
        return found.groupBy("level").agg(F.count(F.lit(1)).alias("count")).select(F.lit(label).alias("wanted"), "level", "count")

    return counted("known", ["Warning", "ERROR", "bogus"]).unionByName(counted("unknown", ["bogus", "nope"]))


SERVER = "CASE event_id % 5 WHEN 0 THEN {0} + INTERVAL 1 DAY WHEN 1 THEN {0} + INTERVAL 2 DAY WHEN 2 THEN {0} - INTERVAL 23 HOUR ELSE {0} END"


@query("p15_drift_guard", f"""
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN server ELSE ts END AS timestamp FROM (
 SELECT event_id, ts, {SERVER.format('ts')} AS server FROM events) x
WHERE event_id % 7 = 0 OR abs(epoch_us(ts) - epoch_us(server)) <= 86400000000""")
def drift_guard(t: Tables):
    rows = t("events").withColumn("server", F.expr(SERVER.format("ts")))
    client = F.coalesce(F.when(F.col("event_id") % 7 != 0, F.col("ts")), F.col("server"))
    return rows.select("event_id", client.alias("timestamp"), "server").where(
        O.within_drift(F.col("timestamp"), F.col("server"))
    ).drop("server")


@query("a13_hourly_log_stats", f"""
WITH {LEVELLED}
SELECT date_trunc('hour', timestamp) AS date, project_id, organization_id, level, <<hash_bucket(service)>> AS service_bucket,
 <<hash_bucket(environment)>> AS environment_bucket, count(*) AS count FROM levelled GROUP BY ALL""")
def hourly_log_stats(t: Tables):
    return L.hourly_stats(levelled(t))


@query("a14_log_stats_series", f"""
WITH {LEVELLED}
SELECT date_trunc('hour', timestamp) AS hour, count(*) FILTER (WHERE level = 0) AS trace, count(*) FILTER (WHERE level = 1) AS debug,
 count(*) FILTER (WHERE level = 2) AS info, count(*) FILTER (WHERE level = 3) AS warn, count(*) FILTER (WHERE level = 4) AS error,
 count(*) FILTER (WHERE level = 5) AS fatal
FROM levelled WHERE organization_id = 2 AND timestamp >= TIMESTAMP '2024-01-10 00:00:00' AND timestamp < TIMESTAMP '2024-01-30 00:00:00'
 AND project_id IN (0, 1, 2) AND environment = 'prod' GROUP BY date_trunc('hour', timestamp)""")
def log_stats_series(t: Tables):
    import hashlib

    bucket = hashlib.md5(b"prod").digest()[0]
    return L.stats_series(
        L.hourly_stats(levelled(t)), organization_id=2, start=datetime(2024, 1, 10), end=datetime(2024, 1, 30),
        project_ids=[0, 1, 2], environment_buckets=[bucket],
    )


@query("a22_log_resources", """
SELECT organization_id, name, type, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM (
 SELECT organization_id, timestamp, service AS name, 'service' AS type FROM logs
 UNION ALL SELECT organization_id, timestamp, environment AS name, 'environment' AS type FROM logs
 UNION ALL SELECT organization_id, timestamp, host AS name, 'host' AS type FROM logs) x
WHERE name <> '' GROUP BY organization_id, name, type""")
def log_resources(t: Tables):
    return L.resources(t("logs"))


@query("l06_latest_resources", """
SELECT organization_id, name, type, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM (
 SELECT organization_id, timestamp, service AS name, 'service' AS type FROM logs
 UNION ALL SELECT organization_id, timestamp, environment AS name, 'environment' AS type FROM logs
 UNION ALL SELECT organization_id, timestamp, host AS name, 'host' AS type FROM logs) x
WHERE name <> '' GROUP BY organization_id, name, type ORDER BY last_seen DESC, organization_id, type, name LIMIT 100""")
def latest_resources(t: Tables):
    return L.latest_resources(L.resources(t("logs")))


@query("a24_bounded_count", f"""
WITH {LEVELLED}
SELECT least(count(*), 300) AS hits FROM levelled WHERE level = 4 AND timestamp >= TIMESTAMP '2024-01-02 00:00:00'""")
def bounded_count(t: Tables):
    found = L.search_logs(levelled(t), levels=["error"], start=datetime(2024, 1, 2))
    return L.bounded_count(found, 300)


@query("a25_staged_organizations", """
SELECT DISTINCT organization_id FROM logs WHERE timestamp < TIMESTAMP '2024-01-15 00:00:00'""")
def staged_organizations(t: Tables):
    return L.search_logs(t("logs"), end=datetime(2024, 1, 15)).select("organization_id").distinct()


@query("u01_hot_and_cold_page", f"""
WITH {LEVELLED}
SELECT log_id, timestamp, level, service, body FROM levelled WHERE organization_id = 1 AND level = 4
 AND timestamp >= TIMESTAMP '2024-01-03 00:00:00' AND timestamp < TIMESTAMP '2024-01-30 00:00:00' ORDER BY log_id DESC LIMIT 200""")
def hot_and_cold(t: Tables):
    """Both tiers hold overlapping copies; every row counts once."""
    rows = levelled(t)
    cutoff = NOW - timedelta(days=L.HOT_DAYS)
    hot = rows.where(F.col("timestamp") >= F.lit("2024-01-20").cast("timestamp_ntz"))
    cold = rows.where(F.col("timestamp") < F.lit("2024-01-27").cast("timestamp_ntz"))
    page = L.combined_page(
        hot, cold, cutoff=cutoff, limit=200, start=datetime(2024, 1, 3), end=datetime(2024, 1, 30),
        id_column="log_id", organization_id=1, levels=["error"],
    )
    return page.select(*COLUMNS)


@query("u01_page_after_cursor", f"""
WITH {LEVELLED}
SELECT log_id, timestamp, level, service, body FROM levelled WHERE timestamp < TIMESTAMP '2024-01-14 06:00:00' AND timestamp >= TIMESTAMP '2024-01-03 00:00:00' ORDER BY log_id DESC LIMIT 80""")
def page_after_cursor(t: Tables):
    """A cursor in the cold range: the hot table is not read any more."""
    rows = levelled(t).withColumn("id", uuid7_from_timestamp(F.col("timestamp"), F.col("log_id")))
    page = L.combined_page(
        rows, rows, cutoff=NOW - timedelta(days=L.HOT_DAYS), limit=80, start=datetime(2024, 1, 3), end=datetime(2024, 1, 30),
        before=uuid7_bound(datetime(2024, 1, 14, 6)),
    )
    return page.select(*COLUMNS)


@query("l01_log_page", """
SELECT log_id, timestamp, body FROM logs WHERE log_id < 700 ORDER BY log_id DESC LIMIT 51""")
def log_page(t: Tables):
    return paging.newest_first(t("logs"), "log_id", before=700, limit=50).select("log_id", "timestamp", "body")


@query("l02_cursor_page", """
WITH forward AS (SELECT 'forward' AS direction, log_id, timestamp FROM logs WHERE timestamp < TIMESTAMP '2024-01-20 00:00:00' ORDER BY timestamp DESC, log_id DESC LIMIT 30),
 back AS (SELECT 'back' AS direction, log_id, timestamp FROM logs WHERE timestamp > TIMESTAMP '2024-01-20 00:00:00' ORDER BY timestamp, log_id LIMIT 30)
SELECT * FROM forward UNION ALL SELECT * FROM back""")
def cursor_page(t: Tables):
    rows, at = t("logs").select("log_id", "timestamp"), F.lit("2024-01-20").cast("timestamp_ntz")
    forward = paging.page(rows, "-timestamp", position=at, limit=30, tiebreak=("log_id",))
    back = paging.page(rows, "-timestamp", position=at, reverse=True, limit=30, tiebreak=("log_id",))
    return forward.select(F.lit("forward").alias("direction"), "*").unionByName(back.select(F.lit("back").alias("direction"), "*"))


# -- log fields ----------------------------------------------------------------------

@query("f05_hash_bucket", """
SELECT log_id, <<hash_bucket(service)>> AS service_bucket, <<hash_bucket(host)>> AS host_bucket FROM logs""")
def hash_buckets(t: Tables):
    return t("logs").select("log_id", hash_bucket(F.col("service")).alias("service_bucket"), hash_bucket(F.col("host")).alias("host_bucket"))


HEX16 = "substr(md5(CAST(event_id AS STRING)), 1, 16)"
SPAN_TEXT = f"CASE event_id % 6 WHEN 0 THEN 'xyz' WHEN 1 THEN '0x' || {HEX16} WHEN 2 THEN substr({HEX16}, 1, 8) || '-' || substr({HEX16}, 9, 8) WHEN 3 THEN 'ffffffffffffffff' ELSE {HEX16} END"


@query("f22_span_id", f"""
WITH texts AS (SELECT event_id, {SPAN_TEXT} AS raw FROM events),
cleaned AS (SELECT event_id, replace(replace(raw, '-', ''), '0x', '') AS d FROM texts),
numbers AS (SELECT event_id, CASE WHEN regexp_full_match(d, '[0-9a-fA-F]{{1,16}}') THEN CAST('0x' || d AS HUGEINT) END AS u FROM cleaned)
SELECT event_id, CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS span_id,
 lpad(lower(to_hex(CAST(u AS UBIGINT))), 16, '0') AS shown FROM numbers""")
def span_ids(t: Tables):
    number = O.span_id_to_long(F.expr(SPAN_TEXT))
    return t("events").select("event_id", number.alias("span_id"), O.span_id_to_hex(number).alias("shown"))


TRACE_TEXT = ("CASE event_id % 6 WHEN 0 THEN '00000000000000000000000000000000' WHEN 1 THEN 'not-a-trace' WHEN 2 THEN upper(md5(CAST(event_id AS STRING)))"
              " WHEN 3 THEN NULL ELSE md5(CAST(event_id AS STRING)) END")


@query("f23_trace_id", f"""
SELECT event_id, CASE WHEN event_id % 6 IN (2, 4, 5) THEN substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) END AS trace_id
FROM (SELECT event_id, md5(CAST(event_id AS STRING)) AS m FROM events) x""")
def trace_ids(t: Tables):
    return t("events").select("event_id", O.trace_id(F.expr(TRACE_TEXT)).alias("trace_id"))


@query("f24_level_number", "SELECT log_id, level_name, <<level>> AS level FROM logs")
def level_numbers(t: Tables):
    return t("logs").select("log_id", "level_name", V.log_level(F.col("level_name")).alias("level"))


@query("f25_severity_level", """
SELECT event_id, CASE WHEN event_id % 30 BETWEEN 1 AND 4 THEN 'trace' WHEN event_id % 30 BETWEEN 5 AND 8 THEN 'debug'
 WHEN event_id % 30 BETWEEN 9 AND 12 THEN 'info' WHEN event_id % 30 BETWEEN 13 AND 16 THEN 'warn' WHEN event_id % 30 BETWEEN 17 AND 20 THEN 'error'
 WHEN event_id % 30 BETWEEN 21 AND 24 THEN 'fatal' WHEN event_id % 30 < 28 THEN event_type ELSE 'info' END AS level FROM events""")
def severity_levels(t: Tables):
    number = F.when(F.col("event_id") % 30 != 26, F.col("event_id") % 30)
    text = F.when(F.col("event_id") % 30 < 28, F.upper("event_type"))
    return t("events").select("event_id", V.severity_level(number, text).alias("level"))


ITEM_ATTRIBUTES = """map_concat(
 CASE WHEN event_id % 3 = 0 THEN map('sentry.service', event_type) ELSE map('service.name', 'fallback') END,
 map('deployment.environment.name', 'attr-env', 'sentry.message.template', 'x', 'custom', CAST(user_id AS STRING)),
 CASE WHEN event_id % 4 = 0 THEN map('host.name', '') ELSE map('host.name', 'h' || CAST(user_id % 9 AS STRING), 'sentry.severity_number', '13') END)"""


@query("f27_log_attributes", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'own' WHEN event_id % 3 = 0 THEN event_type ELSE 'fallback' END AS service, 'attr-env' AS environment,
 CASE WHEN event_id % 4 = 0 THEN '' ELSE 'h' || CAST(user_id % 9 AS VARCHAR) END AS host, CASE WHEN event_id % 4 = 0 THEN '' ELSE '13' END AS severity,
 '{"custom":"' || CAST(user_id AS VARCHAR) || '"}' AS data FROM events""")
def log_attributes(t: Tables):
    rows = t("events").withColumn("attributes", F.expr(ITEM_ATTRIBUTES))
    own = F.when(F.col("event_id") % 2 == 0, F.lit("own"))
    attrs, none = F.col("attributes"), F.lit(None).cast("string")
    return rows.select(
        "event_id", O.attribute_field(own, attrs, "service").alias("service"), O.attribute_field(none, attrs, "environment").alias("environment"),
        O.attribute_field(none, attrs, "host").alias("host"), O.attribute_field(none, attrs, "severity_number").alias("severity"),
        F.to_json(O.extra_attributes(attrs)).alias("data"),
    )


@query("f26_log_ingest", """
WITH items AS (SELECT *, CASE WHEN event_id % 9 = 0 THEN TIMESTAMP '2024-01-16 00:00:00' ELSE ts END AS seen FROM events)
SELECT <<uuid7(seen; event_id)>> AS id, seen AS timestamp, CAST(user_id % 3 AS INT) AS organization_id,
 CASE event_type WHEN 'error' THEN 4 ELSE 2 END AS level, CASE WHEN event_id % 2 = 0 THEN 9 ELSE 13 END AS severity_number, event_type AS body, 'svc' AS service
FROM items WHERE abs(epoch_us(seen) - epoch_us(TIMESTAMP '2024-01-16 00:00:00')) <= 86400000000""")
def log_ingest(t: Tables):
    """Whole ingest projection: clock guard, minted id, level, severity, attributes."""
    items = t("events").select(
        (F.col("user_id") % 3).cast("int").alias("organization_id"), (F.col("user_id") % 5).cast("int").alias("project_id"),
        F.when(F.col("event_id") % 9 != 0, F.col("ts")).alias("timestamp"), F.upper("event_type").alias("level"),
        F.col("event_type").alias("body"), F.lit("bad").alias("trace_id"), F.lit("ff").alias("span_id"),
        F.when(F.col("event_id") % 2 == 0, F.lit(9)).alias("severity_number"), F.lit("svc").alias("service"),
        F.lit(None).cast("string").alias("environment"), F.lit(None).cast("string").alias("host"),
        F.create_map(F.lit("sentry.severity_number"), F.lit("13")).alias("attributes"), F.col("event_id").alias("source_key"),
    )
    rows = L.log_rows(items, datetime(2024, 1, 16))
    return rows.select(
        "id", "timestamp", "organization_id", F.col("level").cast("int").alias("level"),
        F.col("severity_number").cast("int").alias("severity_number"), "body", "service",
    )
