"""Relative time parameters, resolved on the driver so that scans still prune."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

# Fixed pattern: only subtraction is understood.
RELATIVE = re.compile(r"now\s*\-\s*(\d+)\s*(m|h|d)\s*$")
_UNITS = {"m": "minutes", "h": "hours", "d": "days"}


def resolve_time(value: str | datetime, now: datetime) -> datetime:
    """``now``, ``now-15m`` / ``now - 2h`` / ``now-3d``, else an ISO timestamp."""
    if isinstance(value, datetime):
        return value
    if value == "now":
        return now
    match = RELATIVE.match(value)
    if match:
        return now - timedelta(**{_UNITS[match.group(2)]: int(match.group(1))})
    return datetime.fromisoformat(value.replace("Z", "+00:00"))


def utc(at: datetime) -> datetime:
    """Naive datetimes mean UTC."""
    return at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at.astimezone(timezone.utc)


def micros(at: datetime) -> int:
    """Microseconds since the epoch, without a float on the way."""
    return (utc(at) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def moment(at: datetime) -> Column:
    """A plain (UTC) timestamp literal that does not depend on the driver's own time zone."""
    return F.lit(utc(at).replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")


def slot(unit: str, at: Column) -> Column:
    """Start of the hour or day (``unit``) of a timestamp, without zone."""
    return F.date_trunc(unit, at).cast("timestamp_ntz")
