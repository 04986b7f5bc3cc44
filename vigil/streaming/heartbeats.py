"""Heartbeat monitors on a stream: down because nothing came.

Each monitor keeps its last check-in and whether it is down, with a timer at the end of its
interval. A check-in moves the timer; a timer that fires makes the monitor go down at the end of the
interval, and the next check-in brings it up. Time is that of the check-ins (the watermark, so a
silent monitor goes down as the others' check-ins pass) or, for a source that may fall silent as a whole, the
clock of the processing. A flip's time is that of the check-in, or of the end of the interval, in both.

Check-ins of one interval cannot lie further apart than it, so tasks reduce the rows of a batch to first and last
per monitor and slot of that length before they are shuffled; a monitor with a third of all
check-ins gets a few rows from each task. State is the key's one row, and goes when the monitor has been silent for ``forget``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RUNS = "monitor_id bigint, interval_us bigint, first_seen timestamp, last_seen timestamp"
FLIPS = "monitor_id bigint, at timestamp, is_up boolean"
STATE = "last bigint, interval bigint, down boolean, timer bigint"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FORGET_MS = 90 * 24 * 3600 * 1000


def use_keyed_state(spark: SparkSession) -> None:
    """Timers need the state store that keeps its state on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last check-in of each monitor and slot of its interval."""
    for batch in batches:
        rows = pa.table(batch)
        slot = pc.divide(pc.cast(rows["start_check"], pa.int64()), rows["interval_us"])
        found = rows.append_column("slot", slot).group_by(["monitor_id", "interval_us", "slot"]).aggregate([("start_check", "min"), ("start_check", "max")])
        yield from found.select(["monitor_id", "interval_us", "start_check_min", "start_check_max"]).rename_columns([c.split()[0] for c in RUNS.split(", ")]).to_batches()


def _us(values: pd.Series) -> list[int]:
    return values.astype("datetime64[us]").astype("int64").tolist()


class Heartbeats(StatefulProcessor):
    """Flips of one monitor. ``by_clock`` sets the timers by the processing time."""

    def __init__(self, by_clock: bool, forget: int = FORGET_MS) -> None:
        self.by_clock, self.forget = by_clock, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("monitor", STATE)

    def _set_timer(self, old: int | None, new: int) -> None:
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(new)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        runs = sorted((a, b, n) for part in rows for a, b, n in zip(_us(part["first_seen"]), _us(part["last_seen"]), part["interval_us"].tolist(), strict=True))
        held = self.state.get() if self.state.exists() else (None, runs[0][2], None, None)
        last, interval, down, timer = held
        flips = []
        for first, until, step in runs:
            if last is not None and until <= last:
                continue
            if last is not None and not down and last + interval < first:
                flips.append((last + interval, False))
                down = True
            if last is None or down:
                flips.append((first if last is None or first > last else until, True))
            last, interval, down = until, int(step), False
        due = timer if down else timerValues.getCurrentProcessingTimeInMs() + interval // 1000 if self.by_clock else -(-(last + interval) // 1000)
        self._set_timer(timer, due)
        self.state.update((last, interval, down, due))
        yield self._table(key, flips)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, interval, down, timer = self.state.get()
        if down:
            self.state.clear()
            yield self._table(key, [])
            return
        forget = timer + self.forget
        self.handle.registerTimer(forget)
        self.state.update((last, interval, True, forget))
        yield self._table(key, [(last + interval, False)])

    def close(self) -> None:
        pass

    @staticmethod
    def _table(key, flips) -> pd.DataFrame:
        at = pd.to_datetime([f[0] for f in flips], unit="us", utc=True)
        return pd.DataFrame({"monitor_id": pd.Series([key[0]] * len(flips), dtype="int64"), "at": at, "is_up": pd.Series([f[1] for f in flips], dtype="bool")})


def heartbeat_flips(checks: DataFrame, monitors: DataFrame, *, lateness: str = "5 minutes", by_clock: bool = False) -> DataFrame:
    """The stream of flips (monitor, time, up or down) from a stream of check-ins.

    ``monitors`` has ``interval_seconds``; check-ins without a time, or of no known monitor, are left out. By the
    check-ins' time a monitor is up to ``lateness`` late in going down, and older check-ins are dropped.
    """
    use_keyed_state(checks.sparkSession)
    named = monitors.select("monitor_id", (F.col("interval_seconds").cast("bigint") * 1_000_000).alias("interval_us")).where("interval_us > 0")
    rows = checks.where("start_check IS NOT NULL").select(F.col("monitor_id").cast("bigint").alias("monitor_id"), F.col("start_check").cast("timestamp").alias("start_check"))
    rows = rows.join(named, "monitor_id").select("monitor_id", "interval_us", "start_check")
    runs = rows.mapInArrow(_runs, RUNS)
    if not by_clock:
        runs = runs.withWatermark("last_seen", lateness)
    return runs.groupBy("monitor_id").transformWithStateInPandas(
        Heartbeats(by_clock), FLIPS, outputMode="Append", timeMode="ProcessingTime" if by_clock else "EventTime")


def current_heartbeats(flips: DataFrame, monitors: DataFrame) -> DataFrame:
    """Every monitor with its state after the newest flip; one that never checked in is down since no time."""
    newest = flips.groupBy("monitor_id").agg(F.max("at").alias("since"), F.max_by("is_up", "at").alias("is_up"))
    return monitors.join(newest, "monitor_id", "left").withColumn("is_up", F.coalesce("is_up", F.lit(False)))
