"""Headline queries, timed; prints one JSON line.

Each query is run twice and the faster run counts; results are fully computed and
thrown away (``noop`` sink).  BENCH_SF_DIR and BENCH_CPUS choose input and cores.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import functions as F

from vigil.functions import pii
from vigil.operators.segmented import written_once
from vigil.plans import QUERIES
from vigil.session import local_session
from vigil.sources.domain import table

HEADLINE = [
    "a02_span_groups", "a03_repeated_queries", "a05_hourly_rollup", "s07_hour_rollup_sketch", "a04_daily_trend",
    "a06_transaction_groups", "p01_log_search", "a13_hourly_log_stats", "a14_log_stats_series", "u01_hot_and_cold_page", "a22_log_resources",
    "f26_log_ingest", "m01_group_events", "a11_issue_tag_counts", "a12_issue_rollup", "p03_issue_search", "a19_tag_breakdown",
    "j06_w02_event_neighbours", "w01_latest_event", "w05_flap_damping", "j05_w03_latest_checks", "a20_evaluate_alerts",
    "a17_stats_by_hour", "a15_u02_usage_totals", "b03_evaluate_throttle", "f17_culprit", "f12_search_text",
    "x01_scrub_documents", "x02_scrub_map", "x03_scrub_json", "s16_otlp_logs", "s15_json_envelopes", "s01_partitioned_scan", "st03_hour_counters",
]
# Queries whose rate per input row compares with the published per-event figures.
RATES = {"x03_scrub_json": "events", "x02_scrub_map": "events", "s15_json_envelopes": "events", "s16_otlp_logs": "events",
         "f26_log_ingest": "events", "m01_group_events": "events", "f17_culprit": "orders"}


def large_events(spark, sf_dir: str):
    """Stored JSON events of about 8 KB: 30 frames and 20 breadcrumbs each, with the table's users in them."""
    user = F.col("user_id").cast("string")
    text = "x" * 90
    frame = F.concat(F.lit('{"filename":"app/module.py","function":"handle","lineno":12,"in_app":true,"vars":{"auth_token":"abc","user":"'), user, F.lit(f'","note":"{text}"}}}}'))
    crumb = F.concat(F.lit('{"category":"http","message":"call of '), user, F.lit(f' {text}","data":{{"url":"https://shop.example.com/a","password":"x"}}}}'))
    listed = lambda item, n: F.array_join(F.array_repeat(item, n), ",")
    payload = F.concat(
        F.lit('{"exception":{"values":[{"type":"E","value":"mail a@b.example","stacktrace":{"frames":['), listed(frame, 30),
        F.lit(']}}]},"breadcrumbs":{"values":['), listed(crumb, 20), F.lit(']},"tags":{"a":"b"}}'),
    )
    config = pii.resolve_config(F.lit('{"enabled": true}'), F.lit(None).cast("string"))
    # As many files as cores: the figure is core time, so all cores have to be at work.
    rows = table(spark, sf_dir, "events").select(payload.alias("payload"), config.alias("config"))
    return written_once(rows.repartition(spark.sparkContext.defaultParallelism), "bench-events")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus, "vigil-bench")
    QUERIES["a02_span_groups"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        best = None
        for _ in range(runs):
            began = time.perf_counter()
            QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    events = large_events(spark, sf_dir)
    began = time.perf_counter()
    pii.scrub_json(events, "payload", "config").write.format("noop").mode("overwrite").save()
    core_us = (time.perf_counter() - began) * int(cpus) / events.count() * 1e6
    rows = {name: table(spark, sf_dir, name).count() for name in set(RATES.values())}
    rates = {name: round(rows[source] / times[name]) for name, source in RATES.items()}
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(sf.group(1)) if sf else None, "cpus": cpus, "rows_per_sec": rates, "scrub_8kb_core_us": round(core_us, 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
