"""Span analytics: flattening, groups, repeated queries, rollups, transaction groups."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import durations as D
from ..functions.levels import is_error_status
from ..functions.text import parameterize_description, strip_nul
from ..functions.timeparam import moment
from .maintenance import RETENTION_DAYS
from .quantiles import exact_percentiles, group_heads, resolve_heads, value_counts
from .segmented import join_on_keys

GROUP_KEYS = ["op", "description"]
LOOKUP_KEYS = ["project_id", "transaction", "op", "method"]
TXN_KEYS = ["project_id", "transaction", "op", "method", "organization_id"]
SORTS = ("total_time", "avg_duration", "count")


def describe_spans(spans: DataFrame) -> DataFrame:
    """Turn ``raw_description`` into the parameterised ``description``."""
    return spans.withColumn("description", parameterize_description(F.col("op"), F.col("raw_description"))).drop("raw_description")


def flatten_transactions(transactions: DataFrame, max_spans: int | None = None) -> DataFrame:
    """Transaction rows with a ``spans`` array to span rows; ``max_spans`` takes the first of each transaction only."""
    s, spans = F.col("span"), F.col("spans")
    return transactions.withColumn("span", F.explode(spans if max_spans is None else F.slice(spans, 1, max_spans))).select(
        "organization_id", "project_id",
        strip_nul(F.col("transaction")).alias("transaction_name"),
        s["span_id"].alias("span_id"),
        F.replace("event_id", F.lit("-"), F.lit("")).alias("transaction_id"),
        strip_nul(s["op"]).alias("op"),
        strip_nul(parameterize_description(s["op"], s["description"])).alias("description"),
        D.elapsed_ms(s["start_timestamp"], s["timestamp"]).alias("duration"),
        F.coalesce(s["start_timestamp"], F.col("start_timestamp")).alias("timestamp"),
    )


def span_filter(
    spans: DataFrame, *, start: datetime | None = None, end: datetime | None = None, organization_id: int | None = None,
    project_ids: list[int] | None = None, op_prefix: str | None = None, transaction: str | None = None,
) -> DataFrame:
    """Half-open time range plus optional filters; ``op_prefix`` is an unescaped LIKE prefix."""
    if start is not None:
        spans = spans.where(F.col("timestamp") >= moment(start))
    if end is not None:
        spans = spans.where(F.col("timestamp") < moment(end))
    if organization_id is not None:
        spans = spans.where(F.col("organization_id") == organization_id)
    if project_ids:
        spans = spans.where(F.col("project_id").isin(*project_ids))
    if op_prefix:
        spans = spans.where(F.col("op").like(op_prefix + "%"))
    if transaction is not None:
        spans = spans.where(F.col("transaction_name") == transaction)
    return spans


def span_groups(spans: DataFrame, *, sort: str = "-total_time", limit: int = 50) -> DataFrame:
    """Count, mean, p95 and total per (op, description), best ``limit`` groups.

    One shuffle counts equal durations; totals, ranking and p95 all read that result,
    and p95 is worked out for the groups that made the page only.
    """
    field, descending = sort.lstrip("-"), sort.startswith("-")
    if field not in SORTS:
        field, descending = "total_time", True
    counts = value_counts(spans, GROUP_KEYS, "duration")
    groups = group_heads(counts, GROUP_KEYS, "duration", {"p95": 95}).withColumnsRenamed(
        {"rows": "count", "total": "total_time"}
    ).withColumn("avg_duration", F.try_divide("total_time", "timed"))
    # Order by the rounded figure, so that float noise cannot reorder equal groups.
    rank = F.round(F.col(field), 6) if field != "count" else F.col("count")
    page = groups.orderBy(rank.desc() if descending else rank.asc(), "op", F.col("description").asc_nulls_first()).limit(limit)
    return resolve_heads(counts, page, GROUP_KEYS, "duration").select(
        "op", F.coalesce("description", F.lit("")).alias("description"), "count",
        F.coalesce("avg_duration", F.lit(0.0)).alias("avg_duration"),
        F.coalesce("duration", F.lit(0.0)).alias("p95_duration"),
        F.coalesce("total_time", F.lit(0.0)).alias("total_time"),
    )


def repeated_queries(spans: DataFrame, *, threshold: float = 5.0, limit: int = 50) -> DataFrame:
    """Span groups that repeat within a transaction more than ``threshold`` times on average.

    Spans are first counted per transaction, so the distinct count is a plain count.
    """
    keys = ["transaction_name", *GROUP_KEYS]
    per_txn = spans.groupBy(*keys, "transaction_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("duration").alias("t"), F.count("duration").alias("timed")
    )
    grouped = per_txn.groupBy(*keys).agg(
        F.sum("n").alias("total_spans"), F.count("transaction_id").alias("transaction_count"),
        F.sum("t").alias("total_time"), F.sum("timed").alias("timed"),
    )
    ratio = F.try_divide(F.col("total_spans").cast("double"), F.col("transaction_count"))
    return (
        grouped.withColumn("ratio", ratio).where(F.col("ratio") > threshold)
        .select(
            "transaction_name", "op", F.coalesce("description", F.lit("")).alias("description"),
            "total_spans", "transaction_count", F.round("ratio", 1).alias("spans_per_txn"),
            F.coalesce(F.try_divide("total_time", "timed"), F.lit(0.0)).alias("avg_duration"),
            F.coalesce("total_time", F.lit(0.0)).alias("total_time"),
        )
        .orderBy(F.col("spans_per_txn").desc(), "transaction_name", "op", "description")
        .limit(limit)
    )


def hourly_rollup(spans: DataFrame, *, exact: bool = True) -> DataFrame:
    """Per hour and span group: count, sum, min, max, p50, p95, distinct transactions."""
    keys = ["organization_id", "project_id", "transaction_name", *GROUP_KEYS, "hour_bucket"]
    spans = spans.withColumn("hour_bucket", F.date_trunc("hour", "timestamp").cast("timestamp_ntz"))
    zero = F.lit(0.0)
    if not exact:
        sketch = F.percentile_approx("duration", [0.5, 0.95], 1000)
        return spans.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("count"), F.coalesce(F.sum("duration"), zero).alias("sum_duration"),
            F.coalesce(F.min("duration"), zero).alias("min_duration"), F.coalesce(F.max("duration"), zero).alias("max_duration"),
            F.countDistinct("transaction_id").alias("transaction_count"), sketch.alias("q"),
        ).withColumn("p50", F.col("q")[0]).withColumn("p95", F.col("q")[1]).drop("q")
    transactions = spans.groupBy(*keys).agg(F.countDistinct("transaction_id").alias("transaction_count"))
    pct = exact_percentiles(
        value_counts(spans, keys, "duration"), keys, "duration", {"p50": 50, "p95": 95}, ("rows", "total", "lowest", "highest")
    )
    return join_on_keys(transactions, pct, keys).select(
        *keys, F.col("rows").alias("count"), F.coalesce("total", zero).alias("sum_duration"),
        F.coalesce("lowest", zero).alias("min_duration"), F.coalesce("highest", zero).alias("max_duration"),
        "transaction_count", F.coalesce("p50", zero).alias("p50"), F.coalesce("p95", zero).alias("p95"),
    )


def daily_trend(rollup: DataFrame) -> DataFrame:
    """Daily totals from hourly rollups; transaction counts add up (and may over-count)."""
    return (
        rollup.groupBy(F.date_trunc("day", "hour_bucket").cast("timestamp_ntz").alias("date"))
        .agg(
            F.sum("count").alias("count"), F.sum("transaction_count").alias("transaction_count"),
            F.sum("sum_duration").alias("total_time"),
        )
        .withColumn("avg_duration", F.coalesce(F.try_divide("total_time", "count"), F.lit(0.0)))
    )


# -- transaction groups ------------------------------------------------------------

def transaction_stats(transactions: DataFrame) -> DataFrame:
    """Batch totals per transaction group, with the 50-bucket duration histogram."""
    per_bucket = transactions.groupBy(*TXN_KEYS, D.duration_bucket(F.col("duration_ms")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("total"),
        F.count_if(is_error_status(F.col("trace_status"))).alias("errors"),
        F.min("received").alias("first"), F.max("received").alias("last"),
    )
    # At most 50 rows per group from here on.
    return per_bucket.groupBy(*TXN_KEYS).agg(
        F.sum("n").alias("count"), F.sum("errors").alias("error_count"), F.sum("total").alias("total_duration"),
        F.min("first").alias("first_seen"), F.max("last").alias("last_seen"),
        D.dense_histogram(F.collect_list(F.struct("bucket", "n"))).alias("duration_histogram"),
    )


def merge_transaction_stats(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Add a batch to stored totals: sums add, histograms add slot by slot."""
    s, b = stored.alias("s"), batch.alias("b")
    cond = " AND ".join(f"s.{k} <=> b.{k}" for k in TXN_KEYS)
    zero = F.lit(0)
    return s.join(b, F.expr(cond), "full").select(
        *[F.coalesce(F.col(f"s.{k}"), F.col(f"b.{k}")).alias(k) for k in TXN_KEYS],
        *[(F.coalesce(F.col(f"s.{c}"), zero) + F.coalesce(F.col(f"b.{c}"), zero)).alias(c)
          for c in ("count", "error_count", "total_duration")],
        F.least("s.first_seen", "b.first_seen").alias("first_seen"),
        F.greatest("s.last_seen", "b.last_seen").alias("last_seen"),
        D.merge_histograms(F.col("s.duration_histogram"), F.col("b.duration_histogram")).alias("duration_histogram"),
    )


def transaction_groups(stats: DataFrame) -> DataFrame:
    """Derived figures of a transaction group: mean, p50, p95, error rate, throughput."""
    return stats.withColumn(
        "avg_duration", F.when(F.col("count") > 0, F.col("total_duration") / F.col("count")).otherwise(F.lit(0.0))
    ).withColumn("p50", D.histogram_percentile(F.col("duration_histogram"), 50)).withColumn(
        "p95", D.histogram_percentile(F.col("duration_histogram"), 95)
    ).withColumn("error_rate", error_rate(F.col("error_count"), F.col("count"))).withColumn(
        "throughput", throughput(F.col("count"), F.col("first_seen"), F.col("last_seen"))
    )


def error_rate(errors: Column, count: Column) -> Column:
    return F.when(count > 0, F.round(F.lit(100.0) * errors / count, 2)).otherwise(F.lit(0.0))


def throughput(count: Column, first: Column, last: Column) -> Column:
    """Transactions per minute; null without a time span."""
    seconds = (F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / F.lit(1e6)
    return F.when((count > 0) & (seconds > 0), F.round(count / seconds * F.lit(60.0), 2))


def link_transactions(transactions: DataFrame, groups: DataFrame) -> DataFrame:
    """Transactions with the stored columns of their group; those of an unknown group are left out."""
    return join_on_keys(transactions, groups, LOOKUP_KEYS)


def keep_transaction_groups(groups: DataFrame, now: datetime, days: int = RETENTION_DAYS["transactions"]) -> DataFrame:
    """Groups seen within retention."""
    return groups.where(F.col("last_seen") >= moment(now - timedelta(days=days)))


def find_transaction_groups(
    groups: DataFrame, *, project_ids: list[int] | None = None, start: datetime | None = None,
    end: datetime | None = None, query: str | None = None, sort: str = "-avg_duration", limit: int | None = None,
) -> DataFrame:
    """Group list: project filter, inclusive last-seen range, case-insensitive text, sort."""
    if project_ids:
        groups = groups.where(F.col("project_id").isin(*project_ids))
    if start is not None:
        groups = groups.where(F.col("last_seen") >= moment(start))
    if end is not None:
        groups = groups.where(F.col("last_seen") <= moment(end))
    if query:
        groups = groups.where(F.lower("transaction").contains(query.lower()))
    if limit is None:
        return groups
    field = {"created": "first_seen"}.get(sort.lstrip("-"), sort.lstrip("-"))
    key = F.round(F.col(field), 6) if field == "avg_duration" else F.col(field)
    return groups.orderBy(key.desc() if sort.startswith("-") else key.asc(), *TXN_KEYS).limit(limit)
