"""Streaming jobs survive a retry of a batch."""

from datetime import datetime

from pyspark.sql import functions as F

from vigil.session import scratch_path
from vigil.sources.domain import table
from vigil.streaming import jobs


def test_retried_batch_counts_once(spark, sf_dir):
    events = table(spark, sf_dir, "issue_events").select("project_id", "received")
    source, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    events.write.parquet(source)
    for attempt in range(2):
        # A new checkpoint makes the engine run batch 0 again, as after a lost driver.
        writer = jobs.hourly_counters(jobs.file_stream(spark, source, events.schema), out, "project_id")
        jobs.start(writer, scratch_path(spark, f"cp{attempt}")).awaitTermination()
    assert jobs.read_counters(spark, out, "project_id").agg(F.sum("count")).first()[0] == events.count()


def test_late_rows_are_rejected_after_the_seal(spark, sf_dir):
    spans = table(spark, sf_dir, "spans").select("timestamp", "op", "duration")
    source, out, cp = scratch_path(spark, "in"), scratch_path(spark, "out"), scratch_path(spark, "cp")

    def run():
        jobs.start(jobs.seal_hours(jobs.file_stream(spark, source, spans.schema), out, ["op"]), cp).awaitTermination()
        return jobs.sealed_hours(spark, out, ["op"]).agg(F.sum("count")).first()[0]

    spans.write.parquet(source)
    first = run()
    late = spans.where(F.col("timestamp") < F.lit("2024-01-02").cast("timestamp_ntz"))
    late.write.mode("append").parquet(source)
    assert run() == first < spans.count()
    assert spark.read.parquet(f"{out}/rejected").where("reason = 'late'").count() == late.count()


def test_a_rule_that_comes_later_counts_its_whole_window(spark, sf_dir):
    events = table(spark, sf_dir, "issue_events").select("project_id", "issue_id", "received")
    source, history, out, cp, rules = (scratch_path(spark, n) for n in ("in", "history", "out", "cp", "rules"))
    shape = "alert_id bigint, project_id int, timespan_minutes int, quantity int"
    now = datetime(2024, 1, 31)

    def run(rows, given):
        rows.write.mode("append").parquet(source)
        spark.createDataFrame(given, shape).write.mode("append").parquet(rules)
        stream = jobs.file_stream(spark, source, events.schema)
        jobs.start(jobs.alerting(stream, spark.read.schema(shape).parquet(rules), history, out, lambda _: now), cp).awaitTermination()

    week = 7 * 24 * 60
    projects = [r[0] for r in events.select("project_id").distinct().collect()]
    run(events, [(p, p, 1, 10**6) for p in projects])
    run(events.limit(0).unionByName(events.limit(1)), [(100 + p, p, 3 * week, 1) for p in projects])
    touched = events.limit(1).first()
    found = spark.read.parquet(out).where(F.col("alert_id") >= 100).collect()
    want = events.where((F.col("issue_id") == touched["issue_id"]) & (F.col("received") >= F.lit("2024-01-10").cast("timestamp_ntz"))).count()
    assert [(r["issue_id"], r["num_events"]) for r in found] in ([(touched["issue_id"], want + 1)], [(touched["issue_id"], want)])


def test_monitor_state_retry(spark, sf_dir):
    checks = table(spark, sf_dir, "monitor_checks").groupBy("monitor_id", "start_check", "check_id").agg(F.min("is_up").alias("is_up"))
    monitors = table(spark, sf_dir, "monitors")
    source, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    checks.write.parquet(source)
    stored = spark.read.parquet(source)
    results = []
    for attempt in range(2):
        writer = jobs.monitor_states(jobs.file_stream(spark, source, stored.schema), monitors, out)
        jobs.start(writer, scratch_path(spark, f"cp{attempt}")).awaitTermination()
        rows = spark.read.parquet(f"{out}/outcomes")
        results.append((rows.count(), rows.where("changed").count()))
    assert results[0] == results[1] and results[0][0] == checks.count()


def test_counter_snapshots(spark, sf_dir):
    events = table(spark, sf_dir, "issue_events").select("project_id", "received")
    source, out, cp = (scratch_path(spark, n) for n in ("in", "out", "cp"))
    edge = F.lit("2024-01-16").cast("timestamp_ntz")
    for part in (events.where(F.col("received") < edge), events.where(F.col("received") >= edge)):
        part.write.mode("append").parquet(source)
        jobs.start(jobs.hourly_counters(jobs.file_stream(spark, source, events.schema), out, "project_id"), cp).awaitTermination()
    shape = lambda: sorted(map(tuple, jobs.read_counters(spark, out, "project_id").collect()))
    before = shape()
    jobs.snapshot_counters(spark, out, 0, "project_id")
    assert shape() == before
    jobs.snapshot_counters(spark, out, 1, "project_id")
    assert shape() == before and jobs.newest_snapshot(spark, out)[0] == 1
    # Two pieces and the older snapshot are covered.
    assert jobs.drop_covered(spark, out) == 3 and shape() == before
