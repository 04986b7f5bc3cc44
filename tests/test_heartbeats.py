"""Timers on streams: silence is noticed by event time and by the clock, over restarts; hours are sealed while nothing comes."""

import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vigil.session import scratch_path
from vigil.streaming import heartbeats, jobs

CHECKS = "monitor_id bigint, start_check timestamp"
MONITORS = "monitor_id bigint, interval_seconds int"
T0 = datetime(2024, 1, 1, 10)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


class Feed:
    def __init__(self, spark, monitors, **options):
        self.spark, self.options = spark, options
        self.monitors = spark.createDataFrame(monitors, MONITORS)
        self.source, self.out, self.checkpoint = (scratch_path(spark, n) for n in ("in", "out", "cp"))

    def put(self, rows):
        self.spark.createDataFrame(rows, CHECKS).repartition(3).write.mode("append").parquet(self.source)

    def flips(self):
        stream = jobs.file_stream(self.spark, self.source, self.spark.createDataFrame([], CHECKS).schema)
        return jobs.append_files(heartbeats.heartbeat_flips(stream, self.monitors, **self.options), self.out, [])

    def drain(self, rows):
        self.put(rows)
        jobs.start(self.flips(), self.checkpoint).awaitTermination()
        return self.found()

    def found(self):
        return sorted((r["monitor_id"], r["at"], r["is_up"]) for r in self.spark.read.parquet(self.out).collect())


def test_silence_is_noticed_as_others_check_in(spark):
    feed = Feed(spark, [(1, 60), (2, 60), (3, 0), (4, 60)], lateness="10 seconds")
    assert feed.drain([(1, at(0)), (1, at(50)), (2, at(0)), (9, at(0)), (3, at(0)), (2, None), (None, at(3))]) == [(1, at(0), True), (2, at(0), True)]
    # Monitor 2 is silent; 1 goes on and moves the watermark past its interval.
    assert feed.drain([(1, at(100)), (1, at(100))]) [2:] == [(2, at(60), False)]
    # A restart later it comes back, and a gap inside a batch is found as well.
    assert feed.drain([(2, at(200)), (2, at(300)), (1, at(150))])[-4:] == [(2, at(60), False), (2, at(200), True), (2, at(260), False), (2, at(300), True)]
    assert (1, at(210), False) in feed.found()


def test_hot_monitor_is_reduced_before_the_shuffle(spark):
    rows = spark.range(50_000).select(F.lit(1).cast("bigint").alias("monitor_id"), F.lit(60_000_000).cast("bigint").alias("interval_us"),
                                      (F.lit(T0).cast("timestamp") + F.make_dt_interval(secs=F.col("id") / 100)).alias("start_check"))
    runs = rows.repartition(4).mapInArrow(heartbeats._runs, heartbeats.RUNS)
    assert runs.count() <= 4 * 2 * 10
    edge = runs.agg(F.min("first_seen"), F.max("last_seen")).first()
    assert (edge[0], edge[1]) == (at(0), at(499.99))


def test_silence_of_the_whole_source_is_noticed_by_the_clock(spark):
    feed = Feed(spark, [(1, 1), (2, 3600)], by_clock=True)
    feed.put([(1, at(0)), (2, at(0))])
    running = jobs.start(feed.flips(), feed.checkpoint, once=False, every="500 milliseconds")
    try:
        until = time.time() + 60
        while time.time() < until and (running.lastProgress is None or len(feed.found()) < 3):
            time.sleep(1)
    finally:
        running.stop()
    assert feed.found() == [(1, at(0), True), (1, at(1), False), (2, at(0), True)]


def test_idle_source_is_sealed_and_later_rows_are_rejected(spark):
    shape = "timestamp timestamp_ntz, op string, duration double"
    source, out, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "cp"))

    def drain(rows):
        spark.createDataFrame(rows, shape).write.mode("append").parquet(source)
        jobs.start(jobs.seal_hours(jobs.file_stream(spark, source, spark.createDataFrame([], shape).schema), out, ["op"]), checkpoint).awaitTermination()

    def hours():
        return [(r["hour_bucket"], r["count"]) for r in jobs.sealed_hours(spark, out, ["op"]).orderBy("hour_bucket").collect()]

    drain([(at(0), "db", 1.0), (at(3600), "db", 1.0)])
    assert hours() == []
    jobs.seal_idle(spark, out, at(2 * 3600))
    assert hours() == [(at(0), 1)]
    drain([(at(10), "db", 1.0), (at(3700), "db", 1.0)])
    assert hours() == [(at(0), 1)]
    assert [(r["reason"], r["timestamp"]) for r in spark.read.parquet(f"{out}/rejected").collect()] == [("late", at(10))]
    jobs.seal_idle(spark, out, at(4 * 3600))
    assert hours() == [(at(0), 1), (at(3600), 2)]
    # A retry of the second batch sees the first note only, as it did before.
    assert jobs.sealed_until(spark, out, batch_id=1) == at(2 * 3600) - jobs.LATENESS


def test_listener_seals_a_waiting_stream(spark):
    shape = "timestamp timestamp_ntz, op string, duration double"
    source, out, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "cp"))
    spark.createDataFrame([(at(0), "db", 1.0)], shape).write.parquet(source)
    sealer = jobs.IdleSealer(spark, out, clock=lambda: at(5 * 3600))
    spark.streams.addListener(sealer)
    stream = jobs.file_stream(spark, source, spark.createDataFrame([], shape).schema)
    running = jobs.start(jobs.seal_hours(stream, out, ["op"]), checkpoint, once=False, every="500 milliseconds")
    try:
        until = time.time() + 90
        while time.time() < until and jobs.sealed_until(spark, out) != at(5 * 3600) - jobs.LATENESS:
            time.sleep(1)
    finally:
        running.stop()
        spark.streams.removeListener(sealer)
    assert [r["count"] for r in jobs.sealed_hours(spark, out, ["op"]).collect()] == [1]
