"""Percentiles and distinct counts from stored rollups, checked against the spans they stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sketches as K, spans as S
from ..sources import storage as W
from .registry import Tables, query, r6

#: A sketch keeps to its rank error in 99 of 100 cases; twice the error in all but some of a million.
SLACK = 2 * K.rank_error()
#: Five standard errors of a distinct count.
DISTINCT_SLACK = 5 * 2 ** (-K.LG_ENTRIES / 2)


def stored_rollups(t: Tables, label: str):
    """Hourly rollups that two runs wrote, each of half of the spans of every hour."""
    path, spans = t.scratch(label), S.describe_spans(t("spans"))
    for run, odd in (("first", 0), ("second", 1)):
        W.archive(K.sketch_rollup(spans.where(F.col("event_id") % 2 == odd)), path, "hour_bucket", sort="hour_bucket", run_id=run)
    return W.current(t.spark, path)


def checked(read, spans, keys: list[str]):
    """Small groups' percentiles as they are; of others whether the ranks of the values lie within the bound."""
    counted = spans.where("duration IS NOT NULL").groupBy(*keys, "duration").agg(F.count(F.lit(1)).alias("n"))
    joined = counted.join(read.select(*keys, "p50", "p95"), keys)
    ranks = joined.groupBy(*keys).agg(F.sum("n").alias("_all"), *[
        F.sum(F.when(F.col("duration") < F.col(p), F.col("n")).otherwise(0)).alias(f"_{p}_below") for p in K.PERCENTS], *[
        F.sum(F.when(F.col("duration") <= F.col(p), F.col("n")).otherwise(0)).alias(f"_{p}_upto") for p in K.PERCENTS])
    within = [(F.col(f"_{p}_below") <= F.col("_all") * (v / 100 + SLACK)) & (F.col(f"_{p}_upto") >= F.col("_all") * (v / 100 - SLACK)) for p, v in K.PERCENTS.items()]
    exact = [F.round(F.when(F.col("timed") <= K.K, F.col(p)), 6).alias(p) for p in K.PERCENTS]
    return read.join(ranks, keys, "left").select(*keys, "count", "timed", *r6("sum_duration", "min_duration", "max_duration"), *exact,
                                                 F.coalesce(within[0] & within[1], F.lit(True)).alias("within"))


GRAINS = {"day": ["organization_id", "op", "date"], "project": ["organization_id", "project_id", "op"], "all": ["op"]}


def _grain_sql(name: str, keys: list[str]) -> str:
    shown = {k: k if k in keys else "NULL" for k in ("organization_id", "project_id", "date")}
    return f"""
SELECT '{name}' AS grain, CAST({shown['organization_id']} AS INT) AS organization_id, CAST({shown['project_id']} AS INT) AS project_id, CAST({shown['date']} AS DATE) AS date, op,
 count(*) AS count, count(duration) AS timed, round(coalesce(sum(duration), 0), 6) AS sum_duration, round(min(duration), 6) AS min_duration, round(max(duration), 6) AS max_duration,
 CASE WHEN count(duration) <= {K.K} THEN round(percentile_disc(0.5) WITHIN GROUP (ORDER BY duration), 6) END AS p50,
 CASE WHEN count(duration) <= {K.K} THEN round(percentile_disc(0.95) WITHIN GROUP (ORDER BY duration), 6) END AS p95, TRUE AS within
FROM (SELECT *, CAST(timestamp AS DATE) AS date FROM spans) s GROUP BY {', '.join(keys)}"""


@query("a05_merged_percentiles", "\nUNION ALL".join(_grain_sql(name, keys) for name, keys in GRAINS.items()))
def merged_percentiles(t: Tables):
    """Hours to days, days to projects and to everything: merged twice, read from rollups alone."""
    rollups = stored_rollups(t, "sketched")
    days = K.merge_rollups(rollups, {k: F.col(k) for k in ("organization_id", "project_id", "op", "date")})
    spans = t("spans").withColumn("date", F.to_date("timestamp"))
    parts = []
    for name, keys in GRAINS.items():
        found = checked(K.read_rollups(K.merge_rollups(days, keys)), spans, keys)
        parts.append(found.select(
            F.lit(name).alias("grain"), *[(F.col(k) if k in keys else F.lit(None)).cast(kind).alias(k) for k, kind in (("organization_id", "int"), ("project_id", "int"), ("date", "date"))],
            "op", "count", "timed", "sum_duration", "min_duration", "max_duration", "p50", "p95", "within"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("a04_distinct_trend", f"""
WITH described AS (SELECT *, <<describe>> AS description FROM spans),
hours AS (SELECT CAST(date_trunc('day', timestamp) AS TIMESTAMP) AS date, count(DISTINCT transaction_id) AS n FROM described
 GROUP BY organization_id, project_id, transaction_name, op, description, date_trunc('hour', timestamp), date_trunc('day', timestamp)),
added AS (SELECT date, CAST(sum(n) AS BIGINT) AS transaction_count FROM hours GROUP BY date),
days AS (SELECT CAST(date_trunc('day', timestamp) AS TIMESTAMP) AS date, count(*) AS count, count(DISTINCT transaction_id) AS d, round(sum(duration), 6) AS total_time FROM described GROUP BY 1)
SELECT d.date, d.count, a.transaction_count, CASE WHEN d.d < {2 ** K.LG_ENTRIES} THEN d.d END AS distinct_transactions, TRUE AS within, d.total_time FROM days d JOIN added a ON a.date = d.date""")
def distinct_trend(t: Tables):
    """Transactions of a day counted once, next to the sum of the groups' counts, which counts some several times."""
    path = t.scratch("sketched-days")
    W.archive(K.sketch_rollup(S.describe_spans(t("spans"))), path, "hour_bucket", sort="hour_bucket")
    trend = K.distinct_trend(W.current(t.spark, path))
    exact = t("spans").groupBy(F.date_trunc("day", "timestamp").cast("timestamp_ntz").alias("date")).agg(F.countDistinct("transaction_id").alias("_exact"))
    estimate = F.col("distinct_transactions")
    return trend.join(exact, "date").select(
        "date", "count", "transaction_count", F.when(F.col("_exact") < 2**K.LG_ENTRIES, estimate).alias("distinct_transactions"),
        (F.abs(estimate - F.col("_exact")) <= F.col("_exact") * DISTINCT_SLACK).alias("within"), *r6("total_time"))


@query("s07_hours_of_two_runs", """
WITH described AS (SELECT *, <<describe>> AS description FROM spans)
SELECT organization_id, project_id, transaction_name, op, description, date_trunc('hour', timestamp) AS hour_bucket, count(*) AS count, round(min(duration), 6) AS min_duration,
 round(max(duration), 6) AS max_duration, round(percentile_disc(0.5) WITHIN GROUP (ORDER BY duration), 6) AS p50,
 round(percentile_disc(0.95) WITHIN GROUP (ORDER BY duration), 6) AS p95, count(DISTINCT transaction_id) AS transaction_count
FROM described GROUP BY organization_id, project_id, transaction_name, op, description, date_trunc('hour', timestamp) HAVING count(duration) <= 200""")
def hours_of_two_runs(t: Tables):
    """Parts of an hour that different runs rolled up give the hour's own figures."""
    merged = K.read_rollups(K.merge_rollups(stored_rollups(t, "sketched-runs"), K.KEYS)).where(F.col("timed") <= K.K)
    return merged.select(*K.KEYS, "count", *r6("min_duration", "max_duration", "p50", "p95"), "transaction_count")
