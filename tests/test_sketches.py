"""Sketch rollups: they merge in any order, stay within their errors, and are read without the spans."""

import pytest
from pyspark.sql import functions as F

from vigil.operators import sketches as K


def spans(spark, n, hours=6):
    return spark.range(n).select(
        F.lit(1).alias("organization_id"), (F.col("id") % 2).cast("int").alias("project_id"), F.lit("/t").alias("transaction_name"), F.lit("db").alias("op"),
        F.lit("q").alias("description"), (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1000.0).alias("duration"), F.concat(F.lit("t"), F.col("id") % 20_000).alias("transaction_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("id") % hours).cast("int"))).alias("timestamp"))


def test_merged_ranks_stay_within_the_bound(spark):
    raw = spans(spark, 200_000)
    merged = K.merge_rollups(K.sketch_rollup(raw), ["op"])
    read = K.read_rollups(merged, {"p1": 1, "p50": 50, "p95": 95, "p99": 99}).first()
    total = raw.count()
    for name, share in (("p1", 0.01), ("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        assert abs(raw.where(F.col("duration") <= read[name]).count() / total - share) <= 2 * K.rank_error()
    assert read["count"] == read["timed"] == total
    assert abs(read["transaction_count"] - 20_000) <= 5 * 20_000 / 64
    assert abs(merged.select(K.rank_within(merged, F.lit(500.0))).first()[0] - 0.5) <= 2 * K.rank_error()


def test_small_groups_are_exact_however_they_are_merged(spark):
    raw = spans(spark, 180)
    hours = K.sketch_rollup(raw)
    twice = K.merge_rollups(K.merge_rollups(hours, ["project_id", "op", "hour_bucket"]), ["project_id", "op"])
    want = raw.groupBy("project_id").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY duration)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY duration)").alias("p95"),
                                         F.countDistinct("transaction_id").alias("n"))
    assert {(r["project_id"], r["p50"], r["p95"], r["transaction_count"]) for r in K.read_rollups(twice).collect()} == {tuple(r) for r in want.collect()}


def test_groups_without_durations(spark):
    raw = spans(spark, 10).withColumn("duration", F.lit(None).cast("double")).withColumn("transaction_id", F.lit(None).cast("string"))
    read = K.read_rollups(K.merge_rollups(K.sketch_rollup(raw), ["op"])).first()
    assert (read["count"], read["timed"], read["p50"], read["p95"], read["transaction_count"], read["avg_duration"]) == (10, 0, None, None, 0, None)


def test_figures_come_from_the_rollup_table(spark, tmp_path):
    path = str(tmp_path / "rollups")
    K.sketch_rollup(spans(spark, 1000)).write.parquet(path)
    read = K.read_rollups(K.merge_rollups(spark.read.parquet(path), ["op"]))
    assert all("rollups" in f for f in read.inputFiles())
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


@pytest.mark.parametrize("k, error", [(200, 0.0133), (800, 0.0035)])
def test_rank_error(k, error):
    assert abs(K.rank_error(k) - error) < 0.0002
