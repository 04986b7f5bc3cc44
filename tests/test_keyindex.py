"""The key index: bounded runs, retries, one bucket for a lookup; stream state that stays bounded."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vigil.session import scratch_path
from vigil.sources.keyindex import KeyIndex, listed
from vigil.streaming import jobs


def keys(spark, first, n):
    return spark.range(first, first + n).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.col("id").alias("place"))


@pytest.fixture()
def index(spark):
    return KeyIndex(spark, scratch_path(spark, "index"), "place bigint", buckets=4, fan=3)


def test_runs_stay_few_and_hold_every_key_once(spark, index):
    most = 0
    for batch in range(20):
        index.merge(batch)
        index.add(keys(spark, 10 * batch, 10), batch)
        most = max(most, len(list(listed(index))))
    assert most <= 3 * 3
    assert len(index.runs()) <= 3 * 3 and index._read(index.runs()).count() == index._read(index.runs()).select("key").distinct().count() == 200
    # What the newest batch sees are the batches before it; older ones are not tried again.
    assert sorted(r["place"] for r in index.known(keys(spark, 175, 30).select("key"), before=19).collect()) == [*range(175, 190)]


def test_retried_batch_does_not_meet_itself(spark, index):
    for batch in (0, 1, 2, 3, 3, 3):
        index.merge(batch)
        assert index.known(keys(spark, 10 * batch, 10), before=batch).count() == 0
        index.add(keys(spark, 10 * batch, 10), batch)
    assert index._read(index.runs()).count() == 40


def test_merge_that_died_is_done_again(spark, index):
    from vigil.sources.storage import drop_folders

    for batch in range(3):
        index.add(keys(spark, 10 * batch, 10), batch)
    index._write(index._read(index.runs()), 1, 0)
    drop_folders(spark, [f"{index._folder(1, 0)}/_SUCCESS"])
    assert index.runs() == [(0, 0), (0, 1), (0, 2)]
    index.merge(3)
    assert index.runs() == [(1, 0)] and index._read(index.runs()).count() == 30


def test_lookup_opens_one_bucket(spark, index):
    for batch in range(4):
        index.merge(batch)
        index.add(keys(spark, 100 * batch, 100), batch)
    found = index.lookup("k317")
    assert [r["place"] for r in found.collect()] == [317] and index.lookup("none").count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(key,k317)" in plan
    bucket = spark.range(1).select(index.bucket(F.lit("k317"))).first()[0]
    opened = found.select(F.input_file_name().alias("f")).collect()
    assert opened and all(f"bucket={bucket}/" in r["f"] for r in opened)


def test_alert_state_is_folded_and_expires(spark):
    shape = "project_id int, issue_id string, received timestamp_ntz"
    rules = spark.createDataFrame([(1, 1, 60, 3), (2, 1, 5, 2)], "alert_id bigint, project_id int, timespan_minutes int, quantity int")
    source, slots, sent, checkpoint = (scratch_path(spark, n) for n in ("in", "slots", "sent", "cp"))
    start = datetime(2024, 1, 1)

    def run(minute, rows):
        spark.createDataFrame([(1, issue, start + timedelta(minutes=m, seconds=7)) for issue, m in rows], shape).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.file_stream(spark, source, spark.createDataFrame([], shape).schema)
        jobs.start(jobs.alerting_by_slots(stream, rules, slots, sent, lambda _: start + timedelta(minutes=minute), keep=timedelta(hours=1), fold_every=2), checkpoint).awaitTermination()

    def told():
        parts = [spark.read.parquet(sent)] if jobs.folder_names(spark, sent) else []
        upto, snapshot = jobs.newest_snapshot(spark, sent)
        rows = [r for p in parts for r in p.collect()] + ([] if snapshot is None else snapshot.collect())
        return sorted({(r["alert_id"], r["issue_id"], r["count"]) for r in rows})

    run(10, [("a", 1), ("a", 2), ("b", 9)])
    assert told() == []
    run(20, [("a", 15), ("b", 18), ("b", 19)])
    assert told() == [(1, "a", 3), (1, "b", 3), (2, "b", 2)]
    for k in range(6):
        run(80 + k, [("b", 80 + k - 1)])
    assert told() == [(1, "a", 3), (1, "b", 3), (2, "b", 2)]
    # Two pieces at most since the last fold, one snapshot; minutes beyond the hour are gone from it.
    for path in (slots, sent):
        assert sum(n.startswith("batch_id=") for n in jobs.folder_names(spark, path)) <= 2
        assert sum(n.startswith("upto=") for n in jobs.folder_names(spark, f"{path}-snapshots")) == 1
    assert jobs.newest_snapshot(spark, slots)[1].agg(F.min("date")).first()[0] >= start + timedelta(minutes=25)
