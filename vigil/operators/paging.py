"""Cursor paging."""

from __future__ import annotations

from base64 import b64decode, b64encode
from urllib.parse import parse_qs, urlencode
from uuid import UUID

from pyspark.sql import DataFrame, functions as F


def encode_cursor(position: str) -> str:
    return b64encode(urlencode({"p": position}).encode()).decode()


def decode_cursor(cursor: str | None) -> str | None:
    """Id inside a log cursor; null for anything that is not one."""
    try:
        found = parse_qs(b64decode(cursor or "").decode(), keep_blank_values=True).get("p", [""])[0]
        return str(UUID(found)) if found else None
    except (ValueError, TypeError):
        return None


def newest_first(rows: DataFrame, key: str, *, before=None, limit: int = 50) -> DataFrame:
    """One page plus one extra row; the extra row tells that there is a next page."""
    if before is not None:
        rows = rows.where(F.col(key) < F.lit(before))
    return rows.orderBy(F.col(key).desc()).limit(limit + 1)


def page(
    rows: DataFrame, sort: str, *, position=None, reverse: bool = False, limit: int = 50, tiebreak: tuple[str, ...] = ()
) -> DataFrame:
    """A page on any sort key (``-key`` is descending), forward or back from ``position``.

    A reverse page is read in the opposite order and sorted back afterwards.
    """
    key, descending = sort.lstrip("-"), sort.startswith("-")
    reading_down = descending != reverse
    if position is not None:
        cond = F.col(key) < F.lit(position) if reading_down else F.col(key) > F.lit(position)
        rows = rows.where(cond)

    def ordering(down: bool):
        return [F.col(c).desc() if down else F.col(c).asc() for c in (key, *tiebreak)]

    rows = rows.orderBy(*ordering(reading_down)).limit(limit)
    return rows.orderBy(*ordering(descending)) if reverse else rows
