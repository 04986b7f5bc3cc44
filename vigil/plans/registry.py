"""Registry of runnable queries, each with the SQL that states its result where SQL can."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.durations import BOUNDARIES, MIDPOINTS
from ..session import prepare, scratch_path
from ..sources.domain import spread, table, with_tables

NOW = datetime(2024, 1, 31)
NOW_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


@dataclass(frozen=True)
class Tables:
    """Access to the tables of one data directory."""

    spark: SparkSession
    path: str

    def __call__(self, name: str) -> DataFrame:
        return table(self.spark, self.path, name)

    def spread(self, name: str) -> DataFrame:
        """A table for heavy per-row work."""
        return spread(self(name))

    def sql(self, text: str) -> DataFrame:
        """Plain SQL over tables named in curly brackets."""
        names = set(re.findall(r"\{(\w+)\}", text))
        return plain(self.spark.sql(text, **{n: self(n) for n in names}))

    def scratch(self, label: str) -> str:
        return scratch_path(self.spark, label)


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables``; ``sql`` may name base and domain tables."""

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(build(Tables(prepare(spark), sf_dir)))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(run, None if sql is None else with_tables(expand(sql)))
        return build

    return register


def plain(df: DataFrame) -> DataFrame:
    """Result timestamps without zone, so that every client reads the same value."""
    return df.select(*[
        F.col(f"`{c}`").cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(f"`{c}`") for c, t in df.dtypes
    ])


def r6(*columns: str):
    """Columns rounded to six digits (sums of floats differ by order)."""
    return [F.round(c, 6).alias(c) for c in columns]


def _list(values: list[float]) -> str:
    return "[" + ", ".join(f"CAST({v!r} AS DOUBLE)" for v in values) + "]"


_D = "raw_description"
# SQL spellings shared by several check queries, written as <<name>>.
SNIPPETS = {
    "now": NOW_SQL,
    "describe": (
        f"CASE WHEN coalesce({_D}, '') = '' THEN '' ELSE CASE "
        f"WHEN op LIKE 'db%' THEN regexp_replace(regexp_replace(regexp_replace({_D}, '''(?:[^''\\\\]|\\\\.)*''', '%s', 'g'),"
        f" '\\b\\d+(?:\\.\\d+)?\\b', '%s', 'g'), '(?i)IN\\s*\\(\\s*(%s(?:\\s*,\\s*%s)*)\\s*\\)', 'IN (%s)', 'g') "
        f"WHEN op LIKE 'http%' THEN regexp_replace(regexp_replace(regexp_replace({_D}, '(?s)[?#].*', ''),"
        f" '/\\d+(/|$)', '/%s\\1', 'g'), '/\\d+(/|$)', '/%s\\1', 'g') "
        f"ELSE regexp_replace(regexp_replace({_D}, '/\\d+(/|$)', '/%s\\1', 'g'), '/\\d+(/|$)', '/%s\\1', 'g') END END"
    ),
    "level": (
        "CASE lower(level_name) WHEN 'trace' THEN 0 WHEN 'debug' THEN 1 WHEN 'info' THEN 2 WHEN 'warn' THEN 3 "
        "WHEN 'warning' THEN 3 WHEN 'error' THEN 4 WHEN 'fatal' THEN 5 ELSE 2 END"
    ),
    "edges": _list(BOUNDARIES),
    "mids": _list(MIDPOINTS),
}


def expand(sql: str) -> str:
    return re.sub(r"<<(\w+)(?:\(([^)]*)\))?>>", lambda m: snippet(m.group(1), m.group(2)), sql)


def snippet(name: str, arg: str | None) -> str:
    if name == "bucket":  # duration bucket of a column
        return (
            f"CASE WHEN {arg} <= 1.0 THEN 0 WHEN {arg} >= 60000.0 THEN 49 ELSE "
            f"CAST(len(list_filter({SNIPPETS['edges']}, lambda b: b <= {arg})) - 1 AS INT) END"
        )
    if name == "hash_bucket":
        return f"CASE WHEN coalesce({arg}, '') = '' THEN 0 ELSE CAST('0x' || substr(md5({arg}), 1, 2) AS INT) END"
    if name == "uuid7":  # time, key
        ts, key = [a.strip() for a in arg.split(";")]
        millis = f"lpad(lower(to_hex(epoch_us({ts}) // 1000)), 12, '0')"
        noise = f"md5(CAST({key} AS VARCHAR))"
        return (
            f"(substr({millis}, 1, 8) || '-' || substr({millis}, 9, 4) || '-7' || substr({noise}, 1, 3) || '-' || "
            f"substr('89ab', CAST('0x' || substr({noise}, 4, 1) AS INT) % 4 + 1, 1) || substr({noise}, 5, 3) || '-' || substr({noise}, 8, 12))"
        )
    return SNIPPETS[name]
