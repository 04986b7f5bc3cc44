"""Run registered queries next to their check SQL and report differences.

usage: python tools/compare.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from vigil.plans import QUERIES  # noqa: E402
from vigil.session import local_session  # noqa: E402
from vigil.sources.domain import BASE_TABLES  # noqa: E402


def canonical(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}")
    if isinstance(value, Decimal):
        return ("dec", str(value.normalize()))
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return ("date", value.isoformat())
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((str(k), canonical(v)) for k, v in value.items()))
    return value


def kind(value) -> str:
    return type(value).__name__


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def oracle_rows(con, sql: str):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def difference(spark_df, con, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    names, rows = oracle_rows(con, sql)
    columns = sorted(spark_df.columns)
    got = [tuple(r) for r in spark_df.select(*[f"`{c}`" for c in columns]).collect()]
    if columns != sorted(names):
        return f"columns {columns} != {sorted(names)}"
    order = [names.index(c) for c in columns]
    want = [tuple(r[i] for i in order) for r in rows]
    for i, c in enumerate(columns):
        a = {kind(r[i]) for r in got if r[i] is not None}
        b = {kind(r[i]) for r in want if r[i] is not None}
        if a and b and a != b:
            return f"type of {c}: {a} != {b}"
    left, right = Counter(canonical(r) for r in got), Counter(canonical(r) for r in want)
    if left != right:
        only_l, only_r = list((left - right).elements()), list((right - left).elements())
        show = lambda rs: "\n      ".join(str(r) for r in sorted(rs, key=str)[:3])
        return f"rows {len(got)} vs {len(want)}; only spark {len(only_l)}:\n      {show(only_l)}\n    only sql {len(only_r)}:\n      {show(only_r)}\n    ({columns})"
    if not got:
        return "EMPTY on both sides"
    return None


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.001"
    chosen = {n: q for n, q in QUERIES.items() if not args or any(n.startswith(a) for a in args)}
    spark, con = local_session(os.environ.get("COMPARE_CPUS", "8")), connect(sf_dir)
    bad = 0
    for name, q in chosen.items():
        began = time.time()
        try:
            if q.sql is None:
                n = q.run(spark, sf_dir).count()
                result = None if n else "EMPTY"
                label = f"rows-only {n}"
            else:
                result, label = difference(q.run(spark, sf_dir), con, q.sql), "ok"
        except Exception as exc:  # noqa: BLE001
            result = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += result is not None
        print(f"{name:42s} {time.time() - began:6.2f}s  {label if result is None else 'FAIL ' + result}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} agree")


if __name__ == "__main__":
    main()
