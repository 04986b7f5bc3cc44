"""Usage per organisation, billing windows, throttling, overage pricing."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.timeparam import moment

# Billed weight of each raw category, in summation order.
WEIGHTS = {
    "issue_event_count": 1.0, "transaction_count": 1.0, "log_count": 0.1, "uptime_check_event_count": 0.1, "file_size": 1.0,
}
COUNTED = [c for c in WEIGHTS if c != "file_size"]
FREE_EVENTS = 1000
WINDOW_DAYS = 30
BYTES_PER_UNIT = 1_000_000
# Graduated price per overage event, up to a cumulative number of units.
TIERS: Sequence[tuple[int | None, str]] = ((400_000, "0.00015"), (2_000_000, "0.00010"), (None, "0.00008"))
MONEY = "decimal(38,10)"
ACTIVE_SUBSCRIPTIONS = ("active", "past_due", "trialing")


# -- usage totals --------------------------------------------------------------------

def billed(category: str) -> Column:
    return F.col(category) * F.lit(WEIGHTS[category])


def total_billed() -> Column:
    """Weighted sum in binary floating point, floored once at the end."""
    total = F.lit(0.0)
    for category in WEIGHTS:
        total = total + billed(category)
    return total.cast("bigint")


def usage_totals(usage: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """One row per organisation with a column per category and the weighted total.

    ``usage`` is long (organization_id, category, date, count); ``windows`` gives each
    organisation its own half-open [period_start, period_end).
    """
    if windows is not None:
        w = windows.select("organization_id", F.col("period_start").alias("_s"), F.col("period_end").alias("_e"))
        usage = usage.join(w, "organization_id").where((F.col("date") >= F.col("_s")) & (F.col("date") < F.col("_e")))
    sums = [F.coalesce(F.sum(F.when(F.col("category") == c, F.col("count"))), F.lit(0)).alias(c) for c in COUNTED]
    size = F.coalesce(F.sum(F.when(F.col("category") == "file_bytes", F.col("count"))), F.lit(0))
    return usage.groupBy("organization_id").agg(
        *sums, (size / F.lit(BYTES_PER_UNIT)).cast("bigint").alias("file_size")
    ).withColumn("total_event_count", total_billed())


def daily_usage(usage: DataFrame, windows: DataFrame, today: datetime) -> DataFrame:
    """Billed value per organisation, day and category from the window's start to today, zero-filled."""
    last = F.least(F.to_date("period_end"), F.to_date(moment(today)))
    days = windows.withColumn("day", F.explode(F.sequence(F.to_date("period_start"), last, F.expr("INTERVAL 1 DAY"))))
    w = windows.select("organization_id", "period_start", "period_end")
    sums = usage.where(F.col("category").isin(*COUNTED)).join(w, "organization_id").where(
        (F.col("date") >= F.col("period_start")) & (F.col("date") < F.col("period_end"))
    ).groupBy("organization_id", F.to_date("date").alias("day")).agg(
        *[F.sum(F.when(F.col("category") == c, F.col("count"))).alias(c) for c in COUNTED]
    )
    filled = days.select("organization_id", "day").join(sums, ["organization_id", "day"], "left")
    return filled.select("organization_id", "day", *[(F.coalesce(F.col(c), F.lit(0)) * F.lit(WEIGHTS[c])).alias(c) for c in COUNTED])


def usage_payload(totals: DataFrame) -> DataFrame:
    """Raw and billed figures as shown to a customer."""
    return totals.select(
        "organization_id", F.col("total_event_count").alias("total"), F.col("issue_event_count").alias("event_count"),
        F.col("transaction_count").alias("transaction_event_count"),
        billed("uptime_check_event_count").alias("uptime_check_event_count"),
        billed("log_count").alias("log_event_count"), F.col("file_size").alias("file_size_mb"),
    )


# -- windows -------------------------------------------------------------------------

def add_months(at: Column, months: Column) -> Column:
    """Calendar month shift, clamped to the month's last day."""
    return (at + F.make_interval(F.lit(0), months.cast("int"))).cast("timestamp_ntz")


def rolling_window(now: datetime, periods_ago: int = 0) -> tuple[datetime, datetime]:
    end = now - timedelta(days=WINDOW_DAYS) * periods_ago
    return end - timedelta(days=WINDOW_DAYS), end


def signup_cycle(created: Column, now: datetime, periods_ago: int = 0) -> tuple[Column, Column]:
    """Month that contains ``now``, anchored on the sign-up date; every bound is re-anchored on it."""
    at = moment(now)
    months = (F.year(at) - F.year(created)) * 12 + F.month(at) - F.month(created)
    index = F.when(created > at, 0).otherwise(F.when(add_months(created, months) > at, months - 1).otherwise(months))
    return add_months(created, index - periods_ago), add_months(created, index - periods_ago + 1)


def billing_windows(orgs: DataFrame, now: datetime, *, periods_ago: int = 0, billing: bool = True) -> DataFrame:
    """(organization_id, period_start, period_end) for every organisation.

    ``orgs`` holds created and, with a subscription, current_period_start/end and the
    virtual monthly cycle_start/end of annual plans.  An annual plan has no window
    before its own start.
    """
    if not billing:
        start, end = rolling_window(now, periods_ago)
        return orgs.select("organization_id", moment(start).alias("period_start"), moment(end).alias("period_end"))
    ps, pe, cs, ce = (F.col(c) for c in ("current_period_start", "current_period_end", "cycle_start", "cycle_end"))
    free_start, free_end = signup_cycle(F.col("created"), now, periods_ago)
    if periods_ago == 0:
        sub_start, sub_end = F.coalesce(cs, ps), F.coalesce(ce, pe)
    else:
        annual = cs.isNotNull() & ce.isNotNull()
        anchor = F.when(annual, cs).otherwise(ps)
        sub_start, sub_end = add_months(anchor, F.lit(-periods_ago)), add_months(anchor, F.lit(1 - periods_ago))
        sub_start = F.when(~annual | (sub_start >= ps), sub_start)
    subscribed = ps.isNotNull() & pe.isNotNull()
    return orgs.select(
        "organization_id", F.when(subscribed, sub_start).otherwise(free_start).alias("period_start"),
        F.when(subscribed, sub_end).otherwise(free_end).alias("period_end"),
    ).where(F.col("period_start").isNotNull())


def primary_subscriptions(subscriptions: DataFrame) -> DataFrame:
    """The active subscription with the largest plan, then the newest, per organisation."""
    rank = F.struct("plan_events", "created", "subscription_id")
    rest = [c for c in subscriptions.columns if c != "organization_id"]
    best = subscriptions.where(F.col("status").isin(*ACTIVE_SUBSCRIPTIONS)).groupBy("organization_id").agg(
        F.max_by(F.struct(*rest), rank).alias("_s")
    )
    return best.select("organization_id", *[F.col("_s")[c].alias(c) for c in rest])


# -- throttling ----------------------------------------------------------------------

def throttle_rate(usage: Column, start: Column, width: Column) -> Column:
    """0, 10, 50, 100 percent as usage climbs past ``start`` over ``width``."""
    half = F.floor(width / F.lit(2))
    return F.when(usage > start + width, 100).when(usage > start + half, 50).when(usage > start, 10).otherwise(0)


def accepts(rate: Column, event_id: Column, salt: str) -> Column:
    """Sampling by throttle rate: of 101 equal outcomes those above the rate are kept; rate 0 keeps all."""
    digest = F.md5(F.concat(F.lit(f"{salt}:"), event_id.cast("string")))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 101
    return (rate == 0) | (draw > rate)


def throttle(events: DataFrame, org_rates: DataFrame, project_rates: DataFrame) -> DataFrame:
    """Keep events that pass both their organisation's and their project's rate."""
    orgs = org_rates.select("organization_id", F.col("throttle_rate").alias("_org_rate"))
    projects = project_rates.select("project_id", F.col("throttle_rate").alias("_project_rate"))
    joined = events.join(orgs, "organization_id", "left").join(projects, "project_id", "left")
    zero = F.lit(0)
    keep = accepts(F.coalesce("_org_rate", zero), F.col("event_id"), "org") & accepts(
        F.coalesce("_project_rate", zero), F.col("event_id"), "project"
    )
    return joined.where(keep).select(*events.columns)


def evaluate_throttle(totals: DataFrame, plans: DataFrame) -> DataFrame:
    """New throttle rate of every organisation from its usage and plan.

    No plan: the free quota.  ``no_throttle`` plans: 0.  Metered plans: the spend cap
    buys units above the quota, and the ramp starts after those.
    """
    rows = totals.join(plans, "organization_id", "left")
    free, zero = F.lit(FREE_EVENTS), F.lit(0)
    quota = F.coalesce("plan_events", free)
    cap = F.when(F.coalesce("metered", F.lit(False)), units_for_budget(F.col("spend_cap_cents"))).otherwise(zero)
    usage = F.col("total_event_count")
    return rows.select(
        "organization_id", usage.alias("usage"), quota.alias("quota"), cap.alias("cap_units"),
        F.when(F.coalesce("no_throttle", F.lit(False)), zero).otherwise(throttle_rate(usage, quota + cap, quota)).alias("throttle_rate"),
        F.least(F.greatest(zero, usage - quota), cap).alias("billable_units"),
    )


# -- overage -------------------------------------------------------------------------

def _bands() -> list[tuple[int, int | None, Decimal]]:
    lows = [0] + [up for up, _ in TIERS if up is not None]
    return [(low, up, Decimal(rate)) for low, (up, rate) in zip(lows, TIERS)]


def cost_cents(units: Column) -> Column:
    """Graduated price of overage units in whole cents, rounded half up once."""
    total = F.lit(0).cast(MONEY)
    for low, up, rate in _bands():
        top = units if up is None else F.least(units, F.lit(up))
        share = F.greatest(F.lit(0), top - low).cast("decimal(20,0)")
        total = total + share * F.lit(rate).cast("decimal(12,8)")
    return F.round(total * 100, 0).cast("bigint")


def units_for_budget(cents: Column) -> Column:
    """Most whole units whose price stays within a budget."""
    budget = cents.cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")
    out, spent = F.lit(0).cast("bigint"), Decimal(0)
    for low, up, rate in _bands():
        left = budget - F.lit(spent).cast("decimal(20,8)")
        bought = F.floor(left / F.lit(rate).cast("decimal(12,8)")).cast("bigint")
        if up is not None:
            bought = F.least(bought, F.lit(up - low))
            spent += (up - low) * rate
        out = out + F.greatest(F.lit(0), bought)
    return F.when(cents <= 0, F.lit(0).cast("bigint")).otherwise(out)


def overage_delta(billable: Column, reported: Column, reported_cycle: Column, cycle: Column) -> Column:
    """Units to report now: never negative, from zero in a new cycle."""
    base = F.when(reported_cycle == cycle, reported).otherwise(F.lit(0))
    return F.greatest(F.lit(0), billable - F.coalesce(base, F.lit(0)))


def overage_status(totals: DataFrame, plans: DataFrame) -> DataFrame:
    """Overage figures per organisation as shown to its owner."""
    rows = totals.join(plans, "organization_id", "left")
    zero = F.lit(0)
    eligible = F.col("plan_events").isNotNull() & ~F.coalesce("no_throttle", F.lit(False))
    quota = F.when(eligible, F.col("plan_events")).otherwise(F.lit(FREE_EVENTS))
    cap = units_for_budget(F.coalesce("spend_cap_cents", zero))
    over = F.greatest(zero, F.col("total_event_count") - quota)
    enabled = F.coalesce("metered", F.lit(False))
    return rows.select(
        "organization_id", enabled.alias("enabled"), eligible.alias("eligible"), cap.alias("cap_units"), quota.alias("quota"),
        F.col("total_event_count").alias("usage"), over.alias("overage_units"),
        cost_cents(F.when(enabled, F.least(over, cap)).otherwise(zero)).alias("overage_cost_cents"),
    )
