"""Domain tables (spans, logs, issues, checks ...) derived from the star-schema tables.

Every statement below is plain SQL that Spark and DuckDB read alike, so the same
text is the Spark input of a job and the first CTE of its check query.  Curly
names refer to a base table or to another derived table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

DERIVED = {
    "spans": """
SELECT event_id, CAST(user_id % 3 AS INT) AS organization_id, CAST(user_id % 5 AS INT) AS project_id,
 '/page/' || CAST(CAST(FLOOR(event_id / 64) AS BIGINT) % 4 AS STRING) AS transaction_name,
 's' || CAST(event_id AS STRING) AS span_id,
 't' || CAST(CAST(FLOOR(event_id / 64) AS BIGINT) AS STRING) AS transaction_id,
 CASE WHEN event_id % 16 = 0 THEN 'db.redis' WHEN event_id % 2 = 0 THEN 'db.sql'
      WHEN event_id % 3 = 0 THEN 'http.client' ELSE 'view.render' END AS op,
 CASE WHEN event_id % 16 = 0 THEN 'GET key ' || CAST(user_id AS STRING)
      WHEN event_id % 2 = 0 THEN 'SELECT * FROM ' || event_type || ' WHERE id = ' || CAST(user_id AS STRING)
           || ' AND name = ''u' || CAST(user_id AS STRING) || ''' AND k IN (1, 2, ' || CAST(event_id AS STRING) || ')'
      WHEN event_id % 3 = 0 THEN 'https://h/api/' || CAST(user_id AS STRING) || '/' || event_type || '?q=' || CAST(event_id AS STRING)
      WHEN event_id % 35 = 1 THEN NULL
      ELSE event_type END AS raw_description,
 value AS duration, ts AS timestamp FROM {events}""",
    "transactions": """
SELECT o_orderkey AS transaction_key, CAST(o_custkey % 5 AS INT) AS project_id, CAST(o_custkey % 3 AS INT) AS organization_id,
 '/order/' || o_orderpriority AS transaction, 'http.server' AS op,
 CASE WHEN o_orderkey % 2 = 0 THEN 'GET' ELSE 'POST' END AS method,
 CASE o_orderstatus WHEN 'F' THEN 'internal_error' WHEN 'P' THEN 'cancelled' ELSE 'ok' END AS trace_status,
 o_totalprice / 10 AS duration_ms, o_orderdate AS received FROM {orders}""",
    "issue_events": """
SELECT *, CAST(project_id AS STRING) || '-' || hash AS issue_id FROM (
SELECT *, md5(title || culprit || CAST(type AS STRING)) AS hash FROM (
SELECT event_id, CAST(user_id % 5 AS INT) AS project_id, CAST(user_id % 5 % 3 AS INT) AS organization_id, ts AS received,
 event_type || ' in module ' || CAST(user_id % 7 AS STRING) AS title, 'app.mod' || CAST(user_id % 7 AS STRING) AS culprit, 1 AS type,
 CASE event_type WHEN 'error' THEN 4 WHEN 'view' THEN 2 ELSE 3 END AS level,
 CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'r' || CAST(CAST(FLOOR(event_id / 200) AS BIGINT) AS STRING) END AS release,
 CASE WHEN user_id % 2 = 0 THEN 'prod' ELSE 'staging' END AS environment, 'user' || CAST(user_id AS STRING) AS tag_user FROM {events}) a) b""",
    "issues": """
SELECT issue_id, project_id, min(organization_id) AS organization_id, min(hash) AS hash, min(title) AS title, min(culprit) AS culprit,
 min(type) AS type, max(level) AS level, min(received) AS first_seen, max(received) AS last_seen, count(*) AS count,
 CAST(count(*) % 3 AS INT) AS status, CASE WHEN count(*) % 3 = 1 AND count(*) % 2 = 0 THEN max(release) END AS resolved_in_release,
 min(release) AS first_release, max(release) AS last_release, count(*) % 11 = 0 AS is_deleted
FROM {issue_events} GROUP BY issue_id, project_id""",
    "event_tags": """
SELECT event_id, issue_id, project_id, organization_id, received, 'environment' AS tag_key, environment AS tag_value FROM {issue_events}
UNION ALL SELECT event_id, issue_id, project_id, organization_id, received, 'release' AS tag_key, release AS tag_value FROM {issue_events} WHERE release IS NOT NULL
UNION ALL SELECT event_id, issue_id, project_id, organization_id, received, 'user.id' AS tag_key, tag_user AS tag_value FROM {issue_events}""",
    "issue_tags": """
SELECT issue_id, project_id, organization_id, date_trunc('day', received) AS date, tag_key, tag_value, count(*) AS count
FROM {event_tags} GROUP BY issue_id, project_id, organization_id, date_trunc('day', received), tag_key, tag_value""",
    "issue_hourly": """
SELECT issue_id, organization_id, date_trunc('hour', received) AS date, count(*) AS count
FROM {issue_events} GROUP BY issue_id, organization_id, date_trunc('hour', received)""",
    "project_hourly": """
SELECT project_id, organization_id, date_trunc('hour', received) AS date, count(*) AS count
FROM {issue_events} GROUP BY project_id, organization_id, date_trunc('hour', received)""",
    "transaction_hourly": """
SELECT project_id, organization_id, date_trunc('hour', received) AS date, count(*) AS count
FROM {transactions} GROUP BY project_id, organization_id, date_trunc('hour', received)""",
    "logs": """
SELECT event_id AS log_id, CAST(user_id % 5 AS INT) AS project_id, CAST(user_id % 3 AS INT) AS organization_id, ts AS timestamp,
 CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'warning' WHEN 'click' THEN 'debug' WHEN 'view' THEN 'bogus' ELSE 'info' END AS level_name,
 event_type || ' 100% done_' || props AS body,
 CASE WHEN user_id % 4 = 0 THEN '' ELSE 'svc-' || CAST(user_id % 4 AS STRING) END AS service,
 CASE WHEN user_id % 2 = 0 THEN 'prod' ELSE 'staging' END AS environment, 'host-' || CAST(user_id AS STRING) AS host FROM {events}""",
    "monitor_checks": """
SELECT l_suppkey AS monitor_id, CAST(l_suppkey % 3 AS INT) AS organization_id, l_shipdate AS start_check,
 l_orderkey * 10 + l_linenumber AS check_id, l_returnflag <> 'R' AS is_up, CAST(l_quantity AS INT) AS response_time FROM {lineitem}""",
    "monitors": """
SELECT s_suppkey AS monitor_id, CAST(s_suppkey % 3 AS INT) AS organization_id, CAST(1 + s_suppkey % 3 AS INT) AS confirmation_threshold,
 CAST(60 * (1 + s_suppkey % 5) AS INT) AS interval_seconds FROM {supplier}""",
    "alert_rules": """
SELECT r_regionkey AS project_id, r_regionkey AS alert_id, 3 + r_regionkey AS quantity, 10080 AS timespan_minutes FROM {region}""",
    "releases": """
SELECT organization_id, release AS version, min(received) AS created, count(*) AS events
FROM {issue_events} WHERE release IS NOT NULL GROUP BY organization_id, release""",
    "release_projects": """
SELECT DISTINCT organization_id, project_id, release AS version FROM {issue_events} WHERE release IS NOT NULL""",
    "environments": """
SELECT DISTINCT organization_id, environment AS name FROM {issue_events}""",
    "environment_projects": """
SELECT organization_id, project_id, environment AS name, min(event_id) % 2 = 0 AS is_hidden
FROM {issue_events} GROUP BY organization_id, project_id, environment""",
    "organizations": """
SELECT r_regionkey AS organization_id, lower(r_name) AS slug, r_regionkey % 4 = 3 AS is_deleted,
 r_regionkey % 2 = 0 AS scrub_ip, CAST(r_regionkey * 5 AS INT) AS throttle_rate FROM {region}""",
    "projects": """
SELECT n_nationkey AS project_id, lower(n_name) AS slug, n_regionkey AS organization_id, n_nationkey % 3 = 0 AS scrub_ip,
 n_nationkey % 7 = 2 AS is_deleted FROM {nation}""",
    "teams": """
SELECT n_nationkey AS team_id, n_regionkey AS organization_id, 'team-' || CAST(n_nationkey AS STRING) AS slug FROM {nation}""",
    "members": """
SELECT c_custkey AS user_id, c_nationkey AS team_id, c_nationkey % 5 AS organization_id,
 CAST(c_custkey % 4 AS INT) AS role, 'u' || CAST(c_custkey AS STRING) || '@example.com' AS email,
 c_custkey % 3 <> 0 AS subscribe_by_default FROM {customer}""",
    "org_usage": """
SELECT organization_id, 'issue_event_count' AS category, date, count FROM {project_hourly}
UNION ALL SELECT organization_id, 'transaction_count' AS category, date, count FROM {transaction_hourly}
UNION ALL SELECT organization_id, 'log_count' AS category, date_trunc('hour', timestamp) AS date, count(*) AS count
 FROM {logs} GROUP BY organization_id, date_trunc('hour', timestamp)
UNION ALL SELECT organization_id, 'uptime_check_event_count' AS category, date_trunc('hour', start_check) AS date, count(*) AS count
 FROM {monitor_checks} GROUP BY organization_id, date_trunc('hour', start_check)
UNION ALL SELECT CAST(p_partkey % 3 AS INT) AS organization_id, 'file_bytes' AS category, TIMESTAMP '2024-01-10 00:00:00' AS date,
 CAST(round(sum(p_retailprice * 1000)) AS BIGINT) AS count FROM {part} GROUP BY CAST(p_partkey % 3 AS INT)""",
}

_NAME = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table straight from Parquet, or a derived domain table."""
    if name in BASE_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = DERIVED[name]
    inputs = {ref: table(spark, sf_dir, ref) for ref in set(_NAME.findall(text))}
    return _as_plain_timestamps(spark.sql(text, **inputs))


def spread(df: DataFrame) -> DataFrame:
    """Give a small input at least one partition per core before heavy per-row work.

    An input with that many splits (anything large) is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if splits >= cores else df.repartition(cores)


def _as_plain_timestamps(df: DataFrame) -> DataFrame:
    # date_trunc gives a zoned timestamp in Spark; the tables keep plain ones (UTC).
    return df.select(
        *[df[c].cast("timestamp_ntz").alias(c) if t == "timestamp" else df[c] for c, t in df.dtypes]
    )


def with_tables(sql: str) -> str:
    """Prefix a check query with one CTE per derived table it mentions, in order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in DERIVED:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(DERIVED[name].replace("{" + name + "}", ""))
                if name not in needed:
                    needed.append(name)

    visit(sql)
    ctes = [f"{name} AS ({_NAME.sub(lambda m: m.group(1), DERIVED[name])})" for name in needed]
    if not ctes:
        return sql
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
