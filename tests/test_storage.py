"""Archives, retention and rewrites on a folder of their own."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vigil.session import scratch_path
from vigil.sources import storage
from vigil.sources.domain import table


@pytest.fixture()
def archive(spark, sf_dir):
    path = scratch_path(spark, "test-archive")
    storage.archive(table(spark, sf_dir, "issue_events"), path, "received", sort="event_id")
    return path


def test_scan_prunes_folders(spark, archive):
    found = storage.scan(spark.read.parquet(archive), "received", datetime(2024, 1, 5), datetime(2024, 1, 6), organization_id=1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert "date" in filters and "organization_id" in filters
    assert {r["date"].isoformat() for r in found.select("date").distinct().collect()} == {"2024-01-05"}


def test_rerun_replaces_the_same_folders(spark, sf_dir, archive):
    before = spark.read.parquet(archive).count()
    storage.archive(table(spark, sf_dir, "issue_events").where("organization_id = 1"), archive, "received", sort="event_id")
    assert spark.read.parquet(archive).count() == before


def test_rewrite_leaves_other_folders_alone(spark, archive):
    import os

    def files(org):
        return {os.path.join(d, f) for d, _, fs in os.walk(f"{archive}/organization_id={org}") for f in fs if f.endswith(".parquet")}

    others = files(0)
    storage.rewrite_excluding(spark, archive, 1, project_id=4)
    rows = spark.read.parquet(archive)
    assert rows.where("organization_id = 1 AND project_id = 4").count() == 0
    assert files(0) == others


def test_rewrite_removes_emptied_days(spark, sf_dir, archive):
    gone = table(spark, sf_dir, "issues").where("organization_id = 2")
    storage.rewrite_excluding(spark, archive, 2, gone=gone)
    assert spark.read.parquet(archive).where("organization_id = 2").count() == 0


def test_expire_and_purge(spark, archive):
    storage.expire(spark, archive, 10, datetime(2024, 1, 31))
    assert spark.read.parquet(archive).agg(F.min("date")).first()[0].isoformat() == "2024-01-21"
    storage.purge_organization(spark, [archive], 0)
    assert {r[0] for r in spark.read.parquet(archive).select("organization_id").distinct().collect()} == {1, 2}


def test_scratch_path_follows_the_session(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
