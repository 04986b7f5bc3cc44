"""Level names, statuses, colours and severity ranges (fixed values)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

LOG_LEVELS = {"trace": 0, "debug": 1, "info": 2, "warn": 3, "warning": 3, "error": 4, "fatal": 5}
LOG_LABELS = {0: "trace", 1: "debug", 2: "info", 3: "warn", 4: "error", 5: "fatal"}
ISSUE_LEVELS = {0: "sample", 1: "debug", 2: "info", 3: "warning", 4: "error", 5: "fatal"}
ISSUE_STATUSES = {0: "unresolved", 1: "resolved", 2: "ignored"}
ISSUE_TYPES = {0: "default", 1: "error", 2: "csp"}
ISSUE_COLOURS = {2: "#4b60b4", 3: "#e9b949", 4: "#e52b50", 5: "#e52b50"}
SEVERITY_RANGES = ((1, 4, "trace"), (5, 8, "debug"), (9, 12, "info"), (13, 16, "warn"), (17, 20, "error"), (21, 24, "fatal"))
ERROR_STATUSES = (
    "internal_error", "unavailable", "deadline_exceeded", "unimplemented", "permission_denied",
    "unauthenticated", "resource_exhausted", "data_loss", "aborted", "failed_precondition",
    "out_of_range", "unknown",
)


def _case(key: Column, mapping: dict) -> Column:
    (first, value), *rest = mapping.items()
    out = F.when(key == first, F.lit(value))
    for k, v in rest:
        out = out.when(key == k, F.lit(v))
    return out


def log_level(name: Column) -> Column:
    """Level number of a log record's level name; unknown or missing means info."""
    return F.coalesce(_case(F.lower(name), LOG_LEVELS), F.lit(LOG_LEVELS["info"]))


def log_level_label(level: Column) -> Column:
    return _case(level, LOG_LABELS)


def issue_level_label(level: Column) -> Column:
    return _case(level, ISSUE_LEVELS)


def issue_status_label(status: Column) -> Column:
    return _case(status, ISSUE_STATUSES)


def issue_type_label(kind: Column) -> Column:
    return _case(kind, ISSUE_TYPES)


def issue_colour(level: Column) -> Column:
    return _case(level, ISSUE_COLOURS)


def severity_level(number: Column, text: Column) -> Column:
    """Severity number 1-24 to a level name, else the text, else info."""
    out = None
    for low, high, name in SEVERITY_RANGES:
        cond = number.between(low, high)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.coalesce(F.lower(F.when(text != "", text)), F.lit("info")))


def level_filter(names: Iterable[str] | None) -> list[int] | None:
    """Level names of a query to numbers; all-unknown names mean no filter at all."""
    wanted = [LOG_LEVELS[n.lower()] for n in names or () if n.lower() in LOG_LEVELS]
    return wanted or None


def is_error_status(status: Column) -> Column:
    """Trace statuses that count as errors; ok, cancelled and null do not."""
    return F.coalesce(status.isin(*ERROR_STATUSES), F.lit(False))
