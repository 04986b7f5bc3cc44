"""Log record fields: span and trace ids, attributes, typed values, client clocks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .ids import as_instant
from .text import non_empty

# Attribute names that fill a field of the log row.
FIELD_ATTRIBUTES = {
    "service": ("sentry.service", "service.name"),
    "environment": ("sentry.environment", "deployment.environment.name"),
    "host": ("host.name",),
    "severity_number": ("sentry.severity_number",),
}
DROPPED_ATTRIBUTES = ("sentry.severity_text", "sentry.message.template")
SDK_RESOURCE_PREFIXES = ("telemetry.sdk.", "telemetry.auto.")
ANY_VALUE_FIELDS = (
    "string_value", "int_value", "double_value", "bool_value",
    "stringValue", "intValue", "doubleValue", "boolValue",
)
MAX_DRIFT_MICROS = 24 * 3600 * 1_000_000


def span_id_to_long(text: Column) -> Column:
    """Hex span id to a signed 64-bit integer; null when it is not one."""
    digits = F.replace(F.replace(text, F.lit("-"), F.lit("")), F.lit("0x"), F.lit(""))
    return F.when(digits.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(digits, 16, -10).cast("bigint"))


def span_id_to_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def trace_id(text: Column) -> Column:
    """Canonical hyphenated id; null for invalid or all-zero ids."""
    d = F.lower(F.regexp_replace(text, r"urn:|uuid:|[{}-]", ""))
    dashed = F.concat_ws(
        "-", F.substring(d, 1, 8), F.substring(d, 9, 4), F.substring(d, 13, 4),
        F.substring(d, 17, 4), F.substring(d, 21, 12),
    )
    return F.when(d.rlike("^[0-9a-f]{32}$") & (d != "0" * 32), dashed)


def within_drift(client: Column, server: Column) -> Column:
    """Client clock at most one day off (inclusive)."""
    gap = F.abs(F.unix_micros(as_instant(client)) - F.unix_micros(as_instant(server)))
    return gap <= F.lit(MAX_DRIFT_MICROS)


def any_value(raw: Column) -> Column:
    """Unwrap a typed value given as JSON text; plain values pass through."""
    fields = [F.get_json_object(raw, f"$.{name}") for name in ANY_VALUE_FIELDS]
    return F.when(raw.startswith("{"), F.coalesce(*fields, raw)).otherwise(raw)


def attribute_field(own: Column, attributes: Column, field: str) -> Column:
    """A field's own value, else the first non-empty attribute that carries it."""
    names = FIELD_ATTRIBUTES[field]
    hits = F.filter(F.map_entries(attributes), lambda e: e["key"].isin(*names) & (e["value"] != ""))
    return F.coalesce(non_empty(own), F.get(hits, F.lit(0))["value"], F.lit(""))


def extra_attributes(attributes: Column) -> Column:
    """Attributes that neither fill a field nor are dropped."""
    taken = [n for names in FIELD_ATTRIBUTES.values() for n in names] + list(DROPPED_ATTRIBUTES)
    return F.map_filter(attributes, lambda k, v: ~k.isin(*taken))


def resource_attributes(attributes: Column) -> Column:
    """Resource attributes without those that only describe the SDK."""
    def keep(k: Column, _: Column) -> Column:
        return ~(k.startswith(SDK_RESOURCE_PREFIXES[0]) | k.startswith(SDK_RESOURCE_PREFIXES[1]))

    return F.map_filter(attributes, keep)


def epoch_nanos_to_timestamp(*candidates: Column) -> Column:
    """First usable nanosecond time (0 and missing do not count); the epoch when none is."""
    usable = [F.when(F.coalesce(c, F.lit("")).isin("", "0"), F.lit(None)).otherwise(c) for c in candidates]
    nanos = F.coalesce(*usable, F.lit("0")).cast("decimal(38,0)")
    return F.timestamp_micros((nanos / F.lit(1000)).cast("bigint"))
