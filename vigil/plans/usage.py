"""Usage, billing-window, throttling and overage queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions.text import retry_after
from ..functions.timeparam import moment
from ..operators import usage as B
from .registry import NOW, Tables, query

# A plan per organisation 0..2 (organisation 2 has none), derived from the regions.
PLANS_SQL = """
SELECT r_regionkey AS organization_id, CAST(CASE r_regionkey WHEN 0 THEN 2000 WHEN 1 THEN 500 END AS BIGINT) AS plan_events, r_regionkey = 3 AS no_throttle,
 r_regionkey = 1 AS metered, CAST(r_regionkey * 10 AS BIGINT) AS spend_cap_cents FROM {region} WHERE r_regionkey <> 2"""
PLANS_ORACLE = PLANS_SQL.replace("{region}", "region")

TOTALS = """
totals AS (SELECT organization_id, {columns},
 CAST(floor(coalesce(sum(count) FILTER (WHERE category = 'file_bytes'), 0) / 1000000) AS BIGINT) AS file_size
 FROM org_usage WHERE date >= TIMESTAMP '2024-01-01 00:00:00' AND date < TIMESTAMP '2024-01-31 00:00:00' GROUP BY organization_id),
billed AS (SELECT *, CAST(floor(0.0::DOUBLE + issue_event_count * 1.0::DOUBLE + transaction_count * 1.0::DOUBLE + log_count * 0.1::DOUBLE
 + uptime_check_event_count * 0.1::DOUBLE + file_size * 1.0::DOUBLE) AS BIGINT) AS total_event_count FROM totals)""".format(
    columns=", ".join(f"CAST(coalesce(sum(count) FILTER (WHERE category = '{c}'), 0) AS BIGINT) AS {c}" for c in B.COUNTED))


def windows(t: Tables):
    start, end = B.rolling_window(NOW)
    return t("organizations").select("organization_id", moment(start).alias("period_start"), moment(end).alias("period_end"))


def totals(t: Tables):
    return B.usage_totals(t("org_usage"), windows(t))


@query("a15_u02_usage_totals", f"WITH {TOTALS} SELECT * FROM billed")
def usage_totals(t: Tables):
    return totals(t)


@query("a16_daily_usage", """
WITH days AS (SELECT organization_id, CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day FROM organizations),
s AS (SELECT organization_id, CAST(date AS DATE) AS day, sum(count) FILTER (WHERE category = 'issue_event_count') AS e, sum(count) FILTER (WHERE category = 'transaction_count') AS x,
 sum(count) FILTER (WHERE category = 'log_count') AS l, sum(count) FILTER (WHERE category = 'uptime_check_event_count') AS u
 FROM org_usage WHERE date >= TIMESTAMP '2024-01-01 00:00:00' AND date < TIMESTAMP '2024-01-31 00:00:00' GROUP BY ALL)
SELECT d.organization_id, d.day, coalesce(e, 0) * 1.0::DOUBLE AS issue_event_count, coalesce(x, 0) * 1.0::DOUBLE AS transaction_count,
 round(coalesce(l, 0) * 0.1::DOUBLE, 6) AS log_count, round(coalesce(u, 0) * 0.1::DOUBLE, 6) AS uptime_check_event_count
FROM days d LEFT JOIN s ON s.organization_id = d.organization_id AND s.day = d.day""")
def daily_usage(t: Tables):
    series = B.daily_usage(t("org_usage"), windows(t), NOW)
    return series.select("organization_id", "day", *[F.round(c, 6).alias(c) for c in B.COUNTED])


@query("b08_usage_payload", f"""
WITH {TOTALS}
SELECT organization_id, total_event_count AS total, issue_event_count AS event_count, transaction_count AS transaction_event_count,
 round(uptime_check_event_count * 0.1::DOUBLE, 6) AS uptime_check_event_count, round(log_count * 0.1::DOUBLE, 6) AS log_event_count, file_size AS file_size_mb FROM billed""")
def usage_payload(t: Tables):
    out = B.usage_payload(totals(t))
    return out.withColumn("uptime_check_event_count", F.round("uptime_check_event_count", 6)).withColumn("log_event_count", F.round("log_event_count", 6))


# -- windows -------------------------------------------------------------------------

ACCOUNTS = """
SELECT c_custkey AS organization_id, TIMESTAMP '2020-01-01 10:00:00' + INTERVAL '1' DAY * CAST(c_custkey % 1500 AS INT) AS created,
 CASE WHEN c_custkey % 4 IN (1, 2) THEN TIMESTAMP '2024-01-29 08:00:00' - INTERVAL '1' DAY * CAST(c_custkey % 300 AS INT) END AS current_period_start,
 CASE WHEN c_custkey % 4 IN (1, 2) THEN TIMESTAMP '2024-02-28 08:00:00' END AS current_period_end,
 CASE WHEN c_custkey % 4 = 2 THEN TIMESTAMP '2024-01-20 08:00:00' END AS cycle_start,
 CASE WHEN c_custkey % 4 = 2 THEN TIMESTAMP '2024-02-20 08:00:00' END AS cycle_end FROM {customer}"""


def _windows_sql(ago: int) -> str:
    months = "((2024 - year(created)) * 12 + 1 - month(created))"
    index = f"(CASE WHEN created > <<now>> THEN 0 WHEN created + to_months(CAST({months} AS INT)) > <<now>> THEN {months} - 1 ELSE {months} END)"
    if ago:
        sub_start = (f"CASE WHEN cycle_start IS NULL THEN current_period_start - to_months({ago}) "
                     f"WHEN cycle_start - to_months({ago}) >= current_period_start THEN cycle_start - to_months({ago}) END")
        sub_end = f"coalesce(cycle_start, current_period_start) - to_months({ago - 1})"
    else:
        sub_start, sub_end = "coalesce(cycle_start, current_period_start)", "coalesce(cycle_end, current_period_end)"
    return f"""
WITH accounts AS ({ACCOUNTS.replace("{customer}", "customer")}),
w AS (SELECT organization_id, CASE WHEN current_period_start IS NOT NULL THEN {sub_start} ELSE created + to_months(CAST({index} - {ago} AS INT)) END AS period_start,
 CASE WHEN current_period_start IS NOT NULL THEN {sub_end} ELSE created + to_months(CAST({index} - {ago} + 1 AS INT)) END AS period_end FROM accounts)
SELECT * FROM w WHERE period_start IS NOT NULL"""


@query("b01_billing_windows", _windows_sql(0))
def billing_windows(t: Tables):
    return B.billing_windows(t.sql(ACCOUNTS), NOW)


@query("b01_previous_windows", _windows_sql(2))
def previous_windows(t: Tables):
    return B.billing_windows(t.sql(ACCOUNTS), NOW, periods_ago=2)


SUBSCRIPTIONS = """
SELECT o_orderkey AS subscription_id, o_custkey AS organization_id, CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'P' THEN 'trialing' ELSE 'canceled' END AS status,
 CAST(o_orderkey % 3 AS INT) * 1000 AS plan_events, o_orderdate AS created FROM {orders}"""


@query("w09_primary_subscription", f"""
SELECT organization_id, subscription_id, plan_events, created FROM (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY plan_events DESC, created DESC, subscription_id DESC) AS n
 FROM ({SUBSCRIPTIONS.replace("{orders}", "orders")}) s WHERE status IN ('active', 'past_due', 'trialing')) x WHERE n = 1""")
def primary_subscription(t: Tables):
    return B.primary_subscriptions(t.sql(SUBSCRIPTIONS)).select("organization_id", "subscription_id", "plan_events", "created")


# -- throttling ----------------------------------------------------------------------

@query("b02_throttle_rate", """
WITH x AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS usage, o_custkey * 100 AS start, CAST(100001 AS BIGINT) AS width FROM orders)
SELECT o_orderkey, CASE WHEN usage > start + width THEN 100 WHEN usage > start + width // 2 THEN 50 WHEN usage > start THEN 10 ELSE 0 END AS rate FROM x""")
def throttle_rate(t: Tables):
    rate = B.throttle_rate(F.floor("o_totalprice"), F.col("o_custkey") * 100, F.lit(100001))
    return t("orders").select("o_orderkey", rate.alias("rate"))


UNITS = """CASE WHEN spend_cap_cents <= 0 THEN 0 ELSE CAST(least(floor(spend_cap_cents / 100.0 / 0.00015), 400000) AS BIGINT) END"""


@query("b03_evaluate_throttle", f"""
WITH {TOTALS}, plans AS ({PLANS_ORACLE}),
x AS (SELECT b.organization_id, b.total_event_count AS usage, coalesce(plan_events, 1000) AS quota, coalesce(no_throttle, FALSE) AS free,
 CASE WHEN coalesce(metered, FALSE) THEN {UNITS} ELSE 0 END AS cap_units FROM billed b LEFT JOIN plans p ON p.organization_id = b.organization_id)
SELECT organization_id, usage, quota, CAST(cap_units AS BIGINT) AS cap_units, CASE WHEN free THEN 0 WHEN usage > quota + cap_units + quota THEN 100
 WHEN usage > quota + cap_units + quota // 2 THEN 50 WHEN usage > quota + cap_units THEN 10 ELSE 0 END AS throttle_rate,
 CAST(least(greatest(0, usage - quota), cap_units) AS BIGINT) AS billable_units FROM x""")
def evaluate_throttle(t: Tables):
    return B.evaluate_throttle(totals(t), t.sql(PLANS_SQL))


@query("b07_overage_status", f"""
WITH {TOTALS}, plans AS ({PLANS_ORACLE}),
x AS (SELECT b.organization_id, coalesce(metered, FALSE) AS enabled, plan_events IS NOT NULL AND NOT coalesce(no_throttle, FALSE) AS eligible,
 CAST({UNITS.replace('spend_cap_cents', 'coalesce(spend_cap_cents, 0)')} AS BIGINT) AS cap_units, coalesce(plan_events, 1000) AS quota, b.total_event_count AS usage
 FROM billed b LEFT JOIN plans p ON p.organization_id = b.organization_id),
y AS (SELECT *, greatest(0, usage - quota) AS overage_units FROM x)
SELECT *, CAST(CASE WHEN enabled THEN round(least(overage_units, cap_units) * 0.015) ELSE 0 END AS BIGINT) AS overage_cost_cents FROM y""")
def overage_status(t: Tables):
    return B.overage_status(totals(t), t.sql(PLANS_SQL))


@query("b04_overage_cost", """
WITH x AS (SELECT o_orderkey, CAST(floor(o_totalprice * 10) AS BIGINT) AS units FROM orders)
SELECT o_orderkey, units, CAST(round((least(units, 400000) * CAST(0.00015 AS DECIMAL(12, 8)) + greatest(0, least(units, 2000000) - 400000) * CAST(0.00010 AS DECIMAL(12, 8))
 + greatest(0, units - 2000000) * CAST(0.00008 AS DECIMAL(12, 8))) * 100, 0) AS BIGINT) AS cost_cents FROM x""")
def overage_cost(t: Tables):
    rows = t("orders").select("o_orderkey", F.floor(F.col("o_totalprice") * 10).alias("units"))
    return rows.withColumn("cost_cents", B.cost_cents(F.col("units")))


@query("b05_units_for_budget", """
WITH x AS (SELECT o_orderkey, CAST(floor(o_totalprice / 10) AS BIGINT) - 1000 AS cents FROM orders)
SELECT o_orderkey, cents, CASE WHEN cents <= 0 THEN 0 ELSE
 least(cents * 100 * 1000 // 1500, 400000)
 + greatest(0, least((cents - 6000) * 100 // 1, 1600000))
 + greatest(0, (cents - 6000 - 16000) * 1000 // 8) END AS units FROM x""")
def budget_units(t: Tables):
    rows = t("orders").select("o_orderkey", (F.floor(F.col("o_totalprice") / 10) - 1000).alias("cents"))
    return rows.withColumn("units", B.units_for_budget(F.col("cents")))


@query("b06_overage_delta", """
SELECT o_orderkey, greatest(0, CAST(floor(o_totalprice) AS BIGINT) - CASE WHEN o_orderstatus = 'F' THEN o_custkey * 100 ELSE 0 END) AS delta FROM orders""")
def overage_delta(t: Tables):
    """What was reported counts only when it was reported for the current cycle."""
    current, older = F.lit("2024-01-01").cast("timestamp_ntz"), F.lit("2023-12-01").cast("timestamp_ntz")
    status = F.col("o_orderstatus")
    reported_cycle = F.when(status == "F", current).when(status == "P", older)
    delta = B.overage_delta(F.floor("o_totalprice"), F.col("o_custkey") * 100, reported_cycle, current)
    return t("orders").select("o_orderkey", delta.alias("delta"))


DRAW = "CAST('0x' || substr(md5('{salt}:' || CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 101"


@query("p17_throttle_sampling", f"""
WITH x AS (SELECT event_id, CASE organization_id WHEN 1 THEN 5 WHEN 2 THEN 10 ELSE 0 END AS org_rate,
 CASE project_id WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN 50 WHEN 3 THEN 100 ELSE 0 END AS project_rate FROM issue_events)
SELECT event_id FROM x WHERE (org_rate = 0 OR {DRAW.format(salt='org')} > org_rate) AND (project_rate = 0 OR {DRAW.format(salt='project')} > project_rate)""")
def throttle_sampling(t: Tables):
    rates = t("projects").where(F.col("project_id") < 4).withColumn(
        "throttle_rate", F.element_at(F.array(F.lit(0), F.lit(10), F.lit(50), F.lit(100)), F.col("project_id") + 1)
    )
    return B.throttle(t("issue_events").select("event_id", "organization_id", "project_id"), t("organizations"), rates).select("event_id")


@query("f35_retry_after", """
SELECT event_id, CAST(ceil(0.02 * pow(CAST(user_id % 101 AS DOUBLE), 2.3)) AS BIGINT) AS seconds FROM events""")
def retry_seconds(t: Tables):
    return t("events").select("event_id", retry_after(F.col("user_id") % 101).alias("seconds"))
