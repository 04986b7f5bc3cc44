"""The table log: snapshots beside rewrites, retries, conflicts, crashes, bounded reads."""

import os
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vigil.session import scratch_path
from vigil.sources import tablelog
from vigil.sources.tablelog import Conflict, TableLog

NOW = datetime(2024, 2, 10)
SCHEMA = "organization_id int, project_id bigint, issue_id string, event_id bigint, received timestamp_ntz"


def rows(spark, first, n, org=1):
    return spark.range(first, first + n).select(
        F.lit(org).alias("organization_id"), (F.col("id") % 3).alias("project_id"), F.concat(F.lit("i"), F.col("id") % 5).alias("issue_id"), F.col("id").alias("event_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("id") % 2).cast("int"), (F.col("id") % 24).cast("int"))).alias("received"))


@pytest.fixture()
def log(spark):
    from pyspark.sql import types as T

    return TableLog.create(spark, scratch_path(spark, "test-log"), T.StructType.fromDDL(SCHEMA), "received", "event_id")


def ids(df):
    return sorted(r["event_id"] for r in df.select("event_id").collect())


def data_files(log):
    return {os.path.join(d, f) for d, _, fs in os.walk(log.data) for f in fs if f.endswith(".parquet")}


def test_reader_keeps_its_version_during_a_rewrite(spark, log):
    log.append(rows(spark, 0, 60), NOW)
    log.append(rows(spark, 60, 60), NOW)
    before = log.scan()
    log.delete(1, NOW, project_id=2)
    log.compact(NOW)
    assert ids(before) == [*range(120)]
    assert ids(log.scan()) == [i for i in range(120) if i % 3 != 2]
    assert ids(log.scan(version=1)) == [*range(60)] and ids(log.scan(version=2)) == [*range(120)]
    # One file for each day is left, and nothing that is deleted is in a live file.
    live = log.snapshot()
    assert live.files.count() == 2 and live.files.agg(F.sum("rows")).first()[0] == 80


def test_retried_run_changes_nothing(spark, log):
    assert log.append(rows(spark, 0, 20), NOW, run_id="a") == 1
    kept = data_files(log)
    assert log.append(rows(spark, 0, 20), NOW, run_id="a") == 1
    assert ids(log.scan()) == [*range(20)] and data_files(log) == kept


def test_uncommitted_batch_is_not_seen_and_vacuumed(spark, log):
    log.append(rows(spark, 0, 20), NOW)
    log._write(rows(spark, 20, 20))
    assert ids(log.scan()) == [*range(20)] and len(data_files(log)) == 4
    log.vacuum(datetime(2000, 1, 1), NOW)
    assert len(data_files(log)) == 4
    log.vacuum(datetime.now() + timedelta(days=1), NOW)
    assert ids(log.scan()) == [*range(20)] and len(data_files(log)) == 2


def test_two_rewrites_of_the_same_files_conflict(spark, log, monkeypatch):
    log.append(rows(spark, 0, 20), NOW)
    log.append(rows(spark, 20, 20), NOW)
    other, write = TableLog(spark, log.path), TableLog._write

    def write_after_another(self, df):
        monkeypatch.setattr(TableLog, "_write", write)
        other.compact(NOW)
        return write(self, df)

    monkeypatch.setattr(TableLog, "_write", write_after_another)
    with pytest.raises(Conflict):
        log.compact(NOW)
    assert ids(log.scan()) == [*range(40)] and log.latest() == 3


def test_delete_recorded_during_a_rewrite_hits_its_result(spark, log, monkeypatch):
    log.append(rows(spark, 0, 20), NOW)
    log.append(rows(spark, 20, 20), NOW)
    write = TableLog._write

    def write_after_delete(self, df):
        monkeypatch.setattr(TableLog, "_write", write)
        self.delete(1, NOW, issues=spark.createDataFrame([("i0",), (None,)], "issue_id string"))
        return write(self, df)

    monkeypatch.setattr(TableLog, "_write", write_after_delete)
    log.compact(NOW)
    assert ids(log.scan()) == [i for i in range(40) if i % 5]


def test_purge_during_an_append_keeps_the_append(spark, log):
    log.append(rows(spark, 0, 20), NOW)
    log.append(rows(spark, 0, 20, org=2), NOW)
    log.purge_organization(1, NOW)
    log.append(rows(spark, 100, 5), NOW)
    assert sorted({(r["organization_id"], r["event_id"] >= 100) for r in log.scan().collect()}) == [(1, True), (2, False)]


def test_writers_side_by_side_all_commit(spark, log):
    errors = []

    def add(k):
        try:
            TableLog(spark, log.path).append(rows(spark, 100 * k, 10), NOW, run_id=f"r{k % 4}")
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    threads = [threading.Thread(target=add, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and log.latest() == 4 and ids(log.scan()) == sorted(100 * k + i for k in range(4) for i in range(10))


def test_expiry_and_pruning_open_no_other_file(spark, log):
    log.append(rows(spark, 0, 48), NOW)
    day = log.scan(datetime(2024, 1, 2), datetime(2024, 1, 3))
    assert len(day.inputFiles()) == 1 and ids(day) == [*range(1, 48, 2)]
    log.expire(39, NOW)
    assert ids(log.scan()) == [*range(1, 48, 2)]
    assert log.scan(datetime(2024, 1, 1), datetime(2024, 1, 1, 12)).count() == 0


def test_delete_that_hits_no_row_is_settled_without_a_rewrite(spark, log):
    log.append(rows(spark, 0, 20), NOW)
    kept = data_files(log)
    log.delete(1, NOW, project_id=77)
    log.compact(NOW)
    assert data_files(log) == kept and ids(log.scan()) == [*range(20)]
    state = log.snapshot()
    assert log._suspects(state, state.files).isEmpty()
    log.checkpoint()
    assert log.snapshot().deletes.isEmpty()


def test_readers_open_a_bounded_part_of_the_log(spark, log, monkeypatch):
    monkeypatch.setattr(tablelog, "CHECKPOINT_EVERY", 4)
    for k in range(10):
        log.delete(1, NOW, project_id=50 + k)
    log.append(rows(spark, 0, 6), NOW)
    opened = []
    monkeypatch.setattr(TableLog, "_read", lambda self, folder, schema, read=TableLog._read: opened.append(folder) or read(self, folder, schema))
    assert log.scan().count() == 6 and len(opened) <= 2 + 4
    log.vacuum(datetime.now() + timedelta(days=1), NOW)
    assert log.scan().count() == 6 and len(log.versions()) == 1
    with pytest.raises(ValueError):
        log.scan(version=3)


def test_rows_are_never_sent_to_every_task(spark, log):
    """Beside a delete record the ages of files are broadcast whatever the estimated sizes, not the rows of the files."""
    log.append(rows(spark, 0, 60), NOW)
    log.delete(1, NOW, project_id=2)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scan = log.scan()
        plan = scan._jdf.queryExecution().executedPlan().toString()
        assert "Inner, BuildRight" in plan and "BuildLeft" not in plan
        assert ids(scan) == [i for i in range(60) if i % 3 != 2]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
