"""Span and transaction queries."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ..functions import durations as D, text as X
from ..functions.levels import is_error_status
from ..operators import maintenance, spans as S
from .registry import Tables, query, r6

START, END = datetime(2024, 1, 3), datetime(2024, 1, 29, 12)
RANGE = "timestamp >= TIMESTAMP '2024-01-03 00:00:00' AND timestamp < TIMESTAMP '2024-01-29 12:00:00'"

GROUPS_SQL = """
WITH described AS (SELECT *, <<describe>> AS description FROM spans)
SELECT op, coalesce(description, '') AS description, count(*) AS count, round(avg(duration), 6) AS avg_duration,
 round(percentile_disc(0.95) WITHIN GROUP (ORDER BY duration), 6) AS p95_duration, round(sum(duration), 6) AS total_time
FROM described WHERE {where} GROUP BY op, description ORDER BY {order}, op, description LIMIT {limit}
"""


def _rounded(df):
    return df.select("op", "description", "count", *r6("avg_duration", "p95_duration", "total_time"))


@query("a01_transaction_span_groups", GROUPS_SQL.format(
    where=f"organization_id = 1 AND transaction_name = '/page/2' AND {RANGE}", order="total_time DESC", limit=50))
def transaction_span_groups(t: Tables):
    spans = S.span_filter(t("spans"), start=START, end=END, organization_id=1, transaction="/page/2")
    return _rounded(S.span_groups(S.describe_spans(spans)))


@query("a02_span_groups", GROUPS_SQL.format(where=RANGE, order="total_time DESC", limit=50))
def span_groups(t: Tables):
    return _rounded(S.span_groups(S.describe_spans(S.span_filter(t("spans"), start=START, end=END))))


@query("a02_span_groups_by_count", GROUPS_SQL.format(
    where=f"op LIKE 'db%' AND project_id IN (1, 2, 3) AND {RANGE}", order="count ASC", limit=100))
def span_groups_by_count(t: Tables):
    spans = S.span_filter(t("spans"), start=START, end=END, project_ids=[1, 2, 3], op_prefix="db")
    return _rounded(S.span_groups(S.describe_spans(spans), sort="count", limit=100))


@query("a03_repeated_queries", f"""
WITH described AS (SELECT *, <<describe>> AS description FROM spans), grouped AS (
SELECT transaction_name, op, description, count(*) AS total_spans, count(DISTINCT transaction_id) AS transaction_count,
 count(*) * 1.0 / count(DISTINCT transaction_id) AS ratio, avg(duration) AS avg_duration, sum(duration) AS total_time
FROM described WHERE op LIKE 'db%' AND {RANGE} GROUP BY transaction_name, op, description)
SELECT transaction_name, op, description, total_spans, transaction_count, CAST(round(ratio, 1) AS DOUBLE) AS spans_per_txn,
 round(avg_duration, 6) AS avg_duration, round(total_time, 6) AS total_time
FROM grouped WHERE ratio > 1.5 ORDER BY spans_per_txn DESC, transaction_name, op, description LIMIT 50""")
def repeated_queries(t: Tables):
    spans = S.describe_spans(S.span_filter(t("spans"), start=START, end=END, op_prefix="db"))
    found = S.repeated_queries(spans, threshold=1.5)
    return found.select(
        "transaction_name", "op", "description", "total_spans", "transaction_count", "spans_per_txn", *r6("avg_duration", "total_time")
    )


ROLLUP_SQL = """
SELECT organization_id, project_id, transaction_name, op, description, date_trunc('hour', timestamp) AS hour_bucket, count(*) AS count,
 sum(duration) AS sum_duration, min(duration) AS min_duration, max(duration) AS max_duration,
 percentile_disc(0.5) WITHIN GROUP (ORDER BY duration) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY duration) AS p95,
 count(DISTINCT transaction_id) AS transaction_count
FROM (SELECT *, <<describe>> AS description FROM spans) d
GROUP BY organization_id, project_id, transaction_name, op, description, date_trunc('hour', timestamp)"""


@query("a04_daily_trend", f"""
WITH rollup AS ({ROLLUP_SQL})
SELECT date_trunc('day', hour_bucket) AS date, CAST(sum(count) AS BIGINT) AS count, CAST(sum(transaction_count) AS BIGINT) AS transaction_count,
 round(sum(sum_duration) / nullif(sum(count), 0), 6) AS avg_duration, round(sum(sum_duration), 6) AS total_time
FROM rollup WHERE transaction_name = '/page/1' AND project_id IN (0, 1, 2, 3)
 AND hour_bucket >= TIMESTAMP '2024-01-03 00:00:00' AND hour_bucket < TIMESTAMP '2024-01-29 12:00:00'
GROUP BY date_trunc('day', hour_bucket)""")
def daily_trend(t: Tables):
    spans = S.span_filter(t("spans"), start=START, end=END, project_ids=[0, 1, 2, 3], transaction="/page/1")
    trend = S.daily_trend(S.hourly_rollup(S.describe_spans(spans), exact=False))
    return trend.select("date", "count", "transaction_count", *r6("avg_duration", "total_time"))


@query("a05_hourly_rollup", f"""
SELECT organization_id, project_id, transaction_name, op, description, hour_bucket, count, round(sum_duration, 6) AS sum_duration,
 round(min_duration, 6) AS min_duration, round(max_duration, 6) AS max_duration, transaction_count, round(p50, 6) AS p50, round(p95, 6) AS p95
FROM ({ROLLUP_SQL}) r""")
def hourly_rollup(t: Tables):
    rolled = S.hourly_rollup(S.describe_spans(t("spans")))
    return rolled.select(
        "organization_id", "project_id", "transaction_name", "op", "description", "hour_bucket", "count",
        *r6("sum_duration", "min_duration", "max_duration"), "transaction_count", *r6("p50", "p95"),
    )


@query("s07_hour_rollup_sketch", f"""
SELECT organization_id, project_id, transaction_name, op, description, hour_bucket, count, round(sum_duration, 6) AS sum_duration,
 round(min_duration, 6) AS min_duration, round(max_duration, 6) AS max_duration, transaction_count
FROM ({ROLLUP_SQL}) r""")
def hour_rollup_sketch(t: Tables):
    """The production rollup: percentiles by sketch (within 0.1 %), compared without them."""
    rolled = S.hourly_rollup(S.describe_spans(t("spans")), exact=False)
    return rolled.select(
        "organization_id", "project_id", "transaction_name", "op", "description", "hour_bucket", "count",
        *r6("sum_duration", "min_duration", "max_duration"), "transaction_count",
    )


# -- transaction groups --------------------------------------------------------------

STATS_SQL = """
buckets AS (SELECT project_id, transaction, op, method, organization_id, <<bucket(duration_ms)>> AS bucket, count(*) AS n,
 sum(CASE WHEN trace_status IN ('internal_error', 'unavailable', 'deadline_exceeded', 'unimplemented', 'permission_denied',
  'unauthenticated', 'resource_exhausted', 'data_loss', 'aborted', 'failed_precondition', 'out_of_range', 'unknown') THEN 1 ELSE 0 END) AS errors,
 sum(duration_ms) AS total, min(received) AS first_seen, max(received) AS last_seen
 FROM transactions GROUP BY ALL),
cumulative AS (SELECT *, sum(n) OVER (PARTITION BY project_id, transaction, op, method, organization_id ORDER BY bucket) AS upto,
 sum(n) OVER (PARTITION BY project_id, transaction, op, method, organization_id) AS everything FROM buckets),
grouped AS (SELECT project_id, transaction, op, method, organization_id, CAST(sum(n) AS BIGINT) AS count, CAST(sum(errors) AS BIGINT) AS error_count,
 sum(total) AS total_duration, min(first_seen) AS first_seen, max(last_seen) AS last_seen,
 min(bucket) FILTER (WHERE upto >= ceil(everything * 50 / 100.0)) AS b50, min(bucket) FILTER (WHERE upto >= ceil(everything * 95 / 100.0)) AS b95
 FROM cumulative GROUP BY project_id, transaction, op, method, organization_id)"""


@query("a06_transaction_groups", f"""
WITH {STATS_SQL}
SELECT project_id, transaction, op, method, organization_id, count, error_count, round(total_duration / count, 8) AS avg_duration,
 round((<<mids>>)[b50 + 1], 6) AS p50, round((<<mids>>)[b95 + 1], 6) AS p95, first_seen, last_seen FROM grouped""")
def transaction_groups(t: Tables):
    """Incremental: two halves of the history, merged, equal the whole."""
    rows = t("transactions")
    old = S.transaction_stats(rows.where(F.col("received") < F.lit("1998-01-01").cast("timestamp_ntz")))
    new = S.transaction_stats(rows.where(F.col("received") >= F.lit("1998-01-01").cast("timestamp_ntz")))
    groups = S.transaction_groups(S.merge_transaction_stats(old, new))
    return groups.select(
        *S.TXN_KEYS, "count", "error_count", F.round("avg_duration", 8).alias("avg_duration"), *r6("p50", "p95"), "first_seen", "last_seen"
    )


@query("a07_error_transactions", """
SELECT trace_status, count(*) AS count, CAST(sum(CASE WHEN trace_status IN ('internal_error', 'unavailable', 'deadline_exceeded',
 'unimplemented', 'permission_denied', 'unauthenticated', 'resource_exhausted', 'data_loss', 'aborted', 'failed_precondition',
 'out_of_range', 'unknown') THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM transactions GROUP BY trace_status""")
def error_transactions(t: Tables):
    return t("transactions").groupBy("trace_status").agg(
        F.count(F.lit(1)).alias("count"), F.count_if(is_error_status(F.col("trace_status"))).alias("errors")
    )


@query("a08_error_rate_throughput", f"""
WITH {STATS_SQL}
SELECT project_id, transaction, op, method, organization_id, CASE WHEN count > 0 THEN round(100.0 * error_count / count, 2) ELSE 0.0 END AS error_rate,
 CASE WHEN epoch(last_seen) - epoch(first_seen) > 0 THEN round(count / (epoch(last_seen) - epoch(first_seen)) * 60.0, 2) END AS throughput
FROM grouped""")
def error_rate_throughput(t: Tables):
    groups = S.transaction_groups(S.transaction_stats(t("transactions")))
    return groups.select(*S.TXN_KEYS, "error_rate", "throughput")


@query("a26_w08_histogram_percentiles", """
WITH buckets AS (SELECT op, <<bucket(duration)>> AS bucket, count(*) AS n FROM spans GROUP BY ALL),
cumulative AS (SELECT *, sum(n) OVER (PARTITION BY op ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY op) AS everything FROM buckets)
SELECT op, CAST(max(everything) AS BIGINT) AS count,
 round((<<mids>>)[min(bucket) FILTER (WHERE upto >= ceil(everything * 50 / 100.0)) + 1], 6) AS p50,
 round((<<mids>>)[min(bucket) FILTER (WHERE upto >= ceil(everything * 95 / 100.0)) + 1], 6) AS p95,
 round((<<mids>>)[min(bucket) FILTER (WHERE upto >= ceil(everything * 100 / 100.0)) + 1], 6) AS p100
FROM cumulative GROUP BY op""")
def histogram_percentiles(t: Tables):
    per_bucket = t("spans").groupBy("op", D.duration_bucket(F.col("duration")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    merged = per_bucket.groupBy("op").agg(
        F.sum("n").alias("count"), D.dense_histogram(F.collect_list(F.struct("bucket", "n"))).alias("histogram")
    )
    return merged.select(
        "op", "count", *[F.round(D.histogram_percentile(F.col("histogram"), p), 6).alias(f"p{p}") for p in (50, 95, 100)]
    )


@query("j02_transaction_group_lookup", """
WITH known AS (SELECT project_id, transaction, op, method, count(*) AS seen FROM transactions WHERE received < TIMESTAMP '1998-01-01 00:00:00'
 GROUP BY project_id, transaction, op, method)
SELECT t.transaction_key, t.project_id, t.method, k.seen FROM transactions t JOIN known k
 ON t.project_id = k.project_id AND t.transaction = k.transaction AND t.op = k.op AND t.method = k.method""")
def transaction_group_lookup(t: Tables):
    rows = t("transactions")
    known = rows.where(F.col("received") < F.lit("1998-01-01").cast("timestamp_ntz")).groupBy(*S.LOOKUP_KEYS).agg(F.count(F.lit(1)).alias("seen"))
    return S.link_transactions(rows, known).select("transaction_key", "project_id", "method", "seen")


@query("l05_transaction_group_sort", f"""
WITH {STATS_SQL}
SELECT project_id, transaction, op, method, organization_id, count, round(total_duration / count, 8) AS avg_duration, first_seen
FROM grouped ORDER BY first_seen DESC, project_id, transaction, op, method, organization_id LIMIT 25""")
def transaction_group_sort(t: Tables):
    groups = S.transaction_groups(S.transaction_stats(t("transactions")))
    page = S.find_transaction_groups(groups, sort="-created", limit=25)
    return page.select(*S.TXN_KEYS, "count", F.round("avg_duration", 8).alias("avg_duration"), "first_seen")


@query("p07_transaction_group_filter", f"""
WITH {STATS_SQL}
SELECT project_id, transaction, op, method, organization_id, count, last_seen FROM grouped
WHERE project_id IN (0, 2, 4) AND last_seen >= TIMESTAMP '2001-01-01 00:00:00' AND last_seen <= TIMESTAMP '2001-08-01 00:00:00'
 AND lower(transaction) LIKE '%urgent%'""")
def transaction_group_filter(t: Tables):
    groups = S.transaction_groups(S.transaction_stats(t("transactions")))
    found = S.find_transaction_groups(groups, project_ids=[0, 2, 4], start=datetime(2001, 1, 1), end=datetime(2001, 8, 1), query="UrGent")
    return found.select(*S.TXN_KEYS, "count", "last_seen")


@query("m12_transaction_group_retention", f"""
WITH {STATS_SQL}
SELECT project_id, transaction, op, method, organization_id, count FROM grouped WHERE last_seen >= TIMESTAMP '2001-07-15 00:00:00'""")
def transaction_group_retention(t: Tables):
    groups = S.transaction_stats(t("transactions"))
    kept = S.keep_transaction_groups(groups, datetime(2001, 7, 15) + timedelta(days=maintenance.RETENTION_DAYS["transactions"]))
    return kept.select(*S.TXN_KEYS, "count")


# -- filters and expressions ----------------------------------------------------------

@query("p08_span_filters", """
SELECT span_id, op, project_id, timestamp FROM spans WHERE op LIKE 'd_.r%' AND project_id IN (0, 3)
 AND timestamp >= TIMESTAMP '2024-01-05 00:00:00' AND timestamp < TIMESTAMP '2024-01-25 00:00:00'""")
def span_filters(t: Tables):
    spans = S.span_filter(
        t("spans"), start=datetime(2024, 1, 5), end=datetime(2024, 1, 25), project_ids=[0, 3], op_prefix="d_.r"
    )
    return spans.select("span_id", "op", "project_id", "timestamp")


@query("p16_transaction_freshness", """
SELECT transaction_key, received FROM transactions
WHERE received >= TIMESTAMP '1998-02-14 12:00:00' - INTERVAL 90 DAY AND received <= TIMESTAMP '1998-02-14 13:00:00'""")
def transaction_freshness(t: Tables):
    rows = maintenance.recent_transactions(t("transactions"), "received", datetime(1998, 2, 14, 12))
    return rows.select("transaction_key", "received")


NESTED = "transaction_id, span_id, op, description, duration, timestamp, transaction_name, organization_id, project_id"


@query("p19_f11_flatten_spans", """
SELECT 't' || CAST(event_id // 64 AS VARCHAR) AS transaction_id, span_id, op, <<describe>> AS description,
 CASE WHEN event_id % 10 = 0 THEN 0.0 ELSE round(greatest(0.0, round(duration * 1000) / 1000 - 20), 6) END AS duration,
 CASE WHEN event_id % 10 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE timestamp END AS timestamp, transaction_name
FROM spans""")
def flatten_spans(t: Tables):
    """Nest spans into transactions (64 each), then flatten them again."""
    spans = t("spans")
    started = F.when(F.col("event_id") % 10 != 0, F.col("timestamp").cast("timestamp"))
    ended = F.timestamp_micros(F.unix_micros(F.col("timestamp").cast("timestamp")) + F.round(F.col("duration") * 1000).cast("bigint") - 20_000)
    cell = F.struct(
        "event_id", "span_id", "op", F.col("raw_description").alias("description"),
        started.alias("start_timestamp"), ended.alias("timestamp"),
    )
    nested = spans.groupBy(F.col("transaction_id").alias("event_id"), F.col("transaction_name").alias("transaction")).agg(
        F.min("organization_id").alias("organization_id"), F.min("project_id").alias("project_id"), F.collect_list(cell).alias("spans")
    ).withColumn("start_timestamp", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    flat = S.flatten_transactions(nested)
    return flat.select("transaction_id", "span_id", "op", "description", F.round("duration", 6).alias("duration"), "timestamp", "transaction_name")


@query("f07_duration_bucket", """
SELECT bucket, count(*) AS n, min(ms) AS low, max(ms) AS high FROM (
 SELECT duration AS ms, <<bucket(duration)>> AS bucket FROM spans
 UNION ALL SELECT duration_ms AS ms, <<bucket(duration_ms)>> AS bucket FROM transactions) x GROUP BY bucket""")
def duration_buckets(t: Tables):
    ms = t("spans").select(F.col("duration").alias("ms")).unionByName(t("transactions").select(F.col("duration_ms").alias("ms")))
    return ms.groupBy(D.duration_bucket(F.col("ms")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ms").alias("low"), F.max("ms").alias("high")
    )


@query("f08_parameterize_sql", """
SELECT span_id, regexp_replace(regexp_replace(regexp_replace(raw_description, '''(?:[^''\\\\]|\\\\.)*''', '%s', 'g'),
 '\\b\\d+(?:\\.\\d+)?\\b', '%s', 'g'), '(?i)IN\\s*\\(\\s*(%s(?:\\s*,\\s*%s)*)\\s*\\)', 'IN (%s)', 'g') AS description FROM spans WHERE op LIKE 'db%'""")
def parameterize_sql(t: Tables):
    return t("spans").where(F.col("op").startswith("db")).select("span_id", X.parameterize_sql(F.col("raw_description")).alias("description"))


@query("f09_parameterize_url", """
WITH urls AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_replace(url, '\\?', '/' || md5(url) || '?')
 WHEN 1 THEN url || '/0d9f8b7a-1c2d-4E3f-8a9b-' || substr(md5(url), 1, 12) WHEN 2 THEN url || '/12/34/x56' ELSE url END AS url FROM pages),
a AS (SELECT page_id, regexp_replace(url, '(?s)[?#].*', '') AS u FROM urls),
b AS (SELECT page_id, regexp_replace(regexp_replace(u, '(?i)/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(/|$)', '/%s\\1', 'g'),
 '(?i)/[0-9a-f]{32,}(/|$)', '/%s\\1', 'g') AS u FROM a)
SELECT page_id, regexp_replace(regexp_replace(u, '/\\d+(/|$)', '/%s\\1', 'g'), '/\\d+(/|$)', '/%s\\1', 'g') AS description FROM b""")
def parameterize_url(t: Tables):
    pages, url = t("pages"), F.col("url")
    varied = (
        F.when(F.col("page_id") % 4 == 0, F.regexp_replace(url, F.lit(r"\?"), F.concat(F.lit("/"), F.md5(url), F.lit("?"))))
        .when(F.col("page_id") % 4 == 1, F.concat(url, F.lit("/0d9f8b7a-1c2d-4E3f-8a9b-"), F.substring(F.md5(url), 1, 12)))
        .when(F.col("page_id") % 4 == 2, F.concat(url, F.lit("/12/34/x56"))).otherwise(url)
    )
    return pages.select("page_id", X.parameterize_url(varied).alias("description"))


@query("f10_parameterize_description", "SELECT span_id, op, <<describe>> AS description FROM spans")
def parameterize_description(t: Tables):
    return S.describe_spans(t("spans")).select("span_id", "op", "description")
