"""Text expressions: grouping of span descriptions, titles, fingerprints, short ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns.
STRING_LITERAL = r"'(?:[^'\\]|\\.)*'"
NUMBER_LITERAL = r"(?U)\b\d+(?:\.\d+)?\b"
IN_LIST = r"(?i)IN\s*\(\s*(%s(?:\s*,\s*%s)*)\s*\)"
UUID_SEGMENT = r"(?i)/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?=/|$)"
HEX_SEGMENT = r"(?i)/[0-9a-f]{32,}(?=/|$)"
NUMBER_SEGMENT = r"(?U)/\d+(?=/|$)"
LINE_BREAK = r"[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def let(value: Column, build) -> Column:
    """``build(value)`` with ``value`` worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def parameterize_sql(text: Column) -> Column:
    out = F.regexp_replace(text, STRING_LITERAL, "%s")
    out = F.regexp_replace(out, NUMBER_LITERAL, "%s")
    return F.regexp_replace(out, IN_LIST, "IN (%s)")


def parameterize_numbers(text: Column) -> Column:
    return F.regexp_replace(text, NUMBER_SEGMENT, "/%s")


def parameterize_url(text: Column) -> Column:
    path = F.regexp_replace(text, r"(?s)[?#].*", "")
    for pattern in (UUID_SEGMENT, HEX_SEGMENT, NUMBER_SEGMENT):
        path = F.regexp_replace(path, pattern, "/%s")
    return path


def parameterize_description(op: Column, text: Column, limit: int | None = None) -> Column:
    """Replace the variable parts of a span description by ``%s``, by kind of span; ``limit`` cuts what is left."""
    routed = (
        F.when(op.startswith("db"), parameterize_sql(text))
        .when(op.startswith("http"), parameterize_url(text))
        .otherwise(parameterize_numbers(text))
    )
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("")).otherwise(
        truncate(routed, limit)
    )


def truncate(text: Column, n: int | None) -> Column:
    """First ``n`` characters; all without a limit."""
    return text if n is None else F.substring(text, 1, n)


def ellipsize(text: Column, n: int | None) -> Column:
    """At most ``n`` characters, the last one an ellipsis when something was cut; all without a limit."""
    return text if n is None else F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def first_line(text: Column) -> Column:
    return F.split(text, LINE_BREAK, 2)[0]


def strip_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\u0000"), F.lit(""))


def strip_nul_map(tags: Column) -> Column:
    return F.transform_values(
        F.transform_keys(tags, lambda k, v: strip_nul(k)), lambda k, v: strip_nul(v)
    )


def strip_nul_json(text: Column) -> Column:
    """Drop escaped NULs from JSON text; an escaped backslash before ``u0000`` is kept."""
    return F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)\\u0000", "$1")


def clean_tag(text: Column, limit: int | None = None) -> Column:
    return truncate(strip_nul(text), limit)


def grouping_hash(title: Column, culprit: Column, kind: Column, fingerprint: Column | None = None) -> Column:
    """MD5 that decides which issue an event belongs to.

    A non-empty fingerprint list replaces the default input; ``{{ default }}`` in it
    stands for that default, null parts count as empty.
    """
    default = F.concat(title, culprit, kind.cast("string"))
    if fingerprint is None:
        return F.md5(default)
    parts = F.transform(
        fingerprint,
        lambda p: F.when(p == "{{ default }}", default).otherwise(F.coalesce(p, F.lit(""))),
    )
    custom = F.array_join(parts, "")
    return F.md5(F.when(F.coalesce(F.size(fingerprint), F.lit(0)) > 0, custom).otherwise(default))


def error_title(kind: Column, value: Column, function: Column, synthetic: Column, limit: int | None = None) -> Column:
    """``Type: first line of value``; synthetic exceptions show their function instead.

    Titles decide about grouping, so they are whole unless ``limit`` asks for one to display.
    """
    value, kind = F.coalesce(value, F.lit("")), F.coalesce(kind, F.lit("Error"))
    named = F.when(value == "", kind).otherwise(F.concat(kind, F.lit(": "), ellipsize(first_line(value), limit)))
    unnamed = F.when(F.coalesce(function, F.lit("")) == "", F.lit("<unknown>")).otherwise(function)
    return ellipsize(F.when(F.coalesce(synthetic, F.lit(False)), unnamed).otherwise(named), limit)


def non_empty(text: Column) -> Column:
    return F.when(text != "", text)


def message_title(formatted: Column, message: Column, limit: int | None = None) -> Column:
    """Title of a plain message event."""
    return ellipsize(F.coalesce(non_empty(formatted), non_empty(message), F.lit("<untitled>")), limit)


def default_title(formatted: Column, message: Column, limit: int | None = None) -> Column:
    """First line of the stripped message, or a placeholder."""
    text = F.regexp_replace(F.coalesce(non_empty(formatted), non_empty(message), F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(text == "", F.lit("<unlabeled event>")).otherwise(ellipsize(first_line(text), limit))


def url_host(url: Column) -> Column:
    """Authority part (with port) of a URL, empty when there is none."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    rest = F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?", "")
    return F.regexp_replace(rest, r"(?s)[?#].*", "")


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def csp_title(directive: Column, blocked_uri: Column) -> Column:
    return F.concat(
        F.lit("Blocked '"), F.replace(directive, F.lit("-src"), F.lit("")),
        F.lit("' from '"), url_host(blocked_uri), F.lit("'"),
    )


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def short_id(slug: Column, number: Column) -> Column:
    """``SLUG-XX`` with the per-project counter in base 32; empty without a counter."""
    return F.when(number.isNull(), F.lit("")).otherwise(
        F.concat(F.upper(slug), F.lit("-"), F.conv(number.cast("string"), 10, 32))
    )


def event_public_id(event_id: Column, uid: Column) -> Column:
    return F.replace(F.coalesce(event_id, uid), F.lit("-"), F.lit(""))


def like_literal(text: str) -> str:
    """Escape LIKE wildcards in user text."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def retry_after(rate: Column) -> Column:
    """Seconds a throttled client should wait."""
    return F.ceil(F.lit(0.02) * F.pow(rate.cast("double"), F.lit(2.3)))
