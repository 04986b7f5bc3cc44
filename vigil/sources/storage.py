"""Parquet tables laid out by organisation and day: scans, archives, compaction, deletes."""

from __future__ import annotations

import json
import logging
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime, timedelta
from functools import reduce
from itertools import islice

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.timeparam import moment, utc
from ..operators.maintenance import acceptable_spans
from ..operators.segmented import written_once
from ..session import scratch_path
from . import files
from .files import exists

log = logging.getLogger(__name__)
SEAL_GRACE = timedelta(minutes=20)
#: Folders removed at the same time.
DELETERS = 16
STAGING_DELAY = timedelta(minutes=5)
#: Columns of a table without its run, for when all its files are elsewhere or gone; readers skip names with an underscore.
SCHEMA_FILE = "_columns.json"
POINT_LOOKUP = {
    # Small row groups and a bloom filter make single-id reads cheap.
    "parquet.block.size": str(4 * 1024 * 1024),
    "parquet.bloom.filter.enabled#id": "true",
}


def read_tolerant(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Scan that skips corrupt or vanished files instead of failing (nothing is deleted)."""
    reader = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    return (reader.schema(schema) if schema is not None else reader).parquet(path)


def scan(
    table: DataFrame, time_column: str, start: datetime, end: datetime, organization_id: int | None = None
) -> DataFrame:
    """Rows of [start, end): the day filter prunes folders, the exact one follows."""
    first, last = utc(start).date(), (utc(end) - timedelta(microseconds=1)).date()
    rows = table.where(F.col("date").between(F.lit(first), F.lit(last)))
    if organization_id is not None:
        rows = rows.where(F.col("organization_id") == organization_id)
    return rows.where((F.col(time_column) >= moment(start)) & (F.col(time_column) < moment(end)))


def archive(
    rows: DataFrame, path: str, time_column: str, *, sort: str, run_id: str = "base", eligible: DataFrame | None = None, lookups: bool = False,
    partitions: tuple[str, ...] = ("organization_id", "date"), max_records: int = 5_000_000,
) -> None:
    """Write rows below organisation/day/run folders, sorted, zstd.

    A run adds to the days it has rows of; rows that other runs wrote stay. A retry of a run
    replaces what that run wrote, so it changes nothing.

    Rows are rebalanced by (organisation, day): small days share a task, and AQE splits
    a day that is larger than the advisory partition size over as many as it needs.
    """
    if eligible is not None:
        rows = rows.join(eligible.select("organization_id").distinct(), "organization_id", "left_semi")
    out = rows.withColumn("date", F.to_date(time_column)).withColumn("run_id", F.lit(run_id))
    spread = out.hint("rebalance", "organization_id", "date").sortWithinPartitions(*partitions, sort)
    writer = spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions, "run_id")
    writer = writer.option("compression", "zstd").option("maxRecordsPerFile", max_records)
    for key, value in (POINT_LOOKUP if lookups else {}).items():
        writer = writer.option(key, value)
    writer.parquet(path)
    if not exists(rows.sparkSession, f"{path}/{SCHEMA_FILE}"):
        files.write_text(rows.sparkSession, f"{path}/{SCHEMA_FILE}", out.drop("run_id").schema.json())


def written_by(spark: SparkSession, path: str, run_id: str) -> DataFrame | None:
    """What one run wrote; None if it wrote nothing."""
    if not exists(spark, path):
        return None
    table = spark.read.parquet(path)
    return table.where(F.col("run_id") == run_id) if "run_id" in table.columns else None


def unarchived(rows: DataFrame, archived: DataFrame, time_column: str) -> DataFrame:
    """Rows whose (organisation, day) is not in the archive yet - makes a rerun a no-op."""
    days = archived.select("organization_id", "date").distinct()
    return rows.withColumn("date", F.to_date(time_column)).join(days, ["organization_id", "date"], "left_anti").drop("date")


def promote_spans(staged: DataFrame, path: str, now: datetime, *, run_id: str = "base", closed: DataFrame | None = None) -> DataFrame:
    """Move staged spans older than five minutes to the span table, by day of event time.

    Each run writes folders of its own: a later run of the same day adds to it, a retry of a
    run replaces its own rows. Spans that cannot be used, and those of an hour that is already
    sealed (``closed``: organization_id, hour_bucket), go to ``<path>-rejected`` with a reason.
    Hours are runs of the sort order, not folders: an hour folder per organisation
    would leave a large cluster with millions of tiny files.

    Returns one row, counted from what was written: consumed, kept and dropped spans.
    """
    spark = staged.sparkSession
    ready = acceptable_spans(staged.where(F.col("inserted") < moment(now - STAGING_DELAY)), now)
    reason = F.when(F.col("timestamp").isNull(), "missing").when(~F.col("kept"), "range")
    if closed is not None:
        hours = closed.select("organization_id", F.col("hour_bucket").alias("_hour")).distinct().withColumn("_sealed", F.lit(True))
        ready = ready.withColumn("_hour", hour_of("timestamp")).join(hours, ["organization_id", "_hour"], "left").drop("_hour")
        reason = reason.when(F.col("_sealed"), "late")
    judged = ready.withColumn("reason", reason).drop("_sealed", "kept", "inserted")
    archive(judged.where("reason IS NULL").drop("reason"), path, "timestamp", sort="timestamp", run_id=run_id)
    rejected = judged.where("reason IS NOT NULL").withColumn("run_id", F.lit(run_id))
    rejected.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}-rejected")
    kept, dropped = (written_by(spark, p, run_id) for p in (path, f"{path}-rejected"))
    zero = spark.range(1).select(F.lit(0).cast("bigint").alias("kept"), F.lit(0).cast("bigint").alias("dropped"))
    counts = [zero, *[rows.agg(F.count(F.lit(1)).alias("n")).select(*columns) for rows, columns in (
        (kept, (F.col("n").alias("kept"), F.lit(0).cast("bigint").alias("dropped"))),
        (dropped, (F.lit(0).cast("bigint").alias("kept"), F.col("n").alias("dropped"))),
    ) if rows is not None]]
    total = reduce(DataFrame.unionByName, counts).agg(F.sum("kept").alias("kept"), F.sum("dropped").alias("dropped"))
    return total.select((F.col("kept") + F.col("dropped")).alias("consumed"), "kept", "dropped")


def unpromoted(staged: DataFrame, path: str, key: str = "span_id") -> DataFrame:
    """Staged rows that no run has written yet, neither as kept nor as rejected."""
    spark = staged.sparkSession
    for table in (path, f"{path}-rejected"):
        if exists(spark, table):
            staged = staged.join(spark.read.parquet(table).select(key), key, "left_anti")
    return staged


def hour_of(column: str):
    return F.date_trunc("hour", column).cast("timestamp_ntz")


def sealed(rows: DataFrame, now: datetime) -> DataFrame:
    """Rows of hours that ended more than 20 minutes ago."""
    hour_end = hour_of("timestamp") + F.expr("INTERVAL 1 HOUR")
    return rows.where(hour_end < moment(now - SEAL_GRACE))


def seal_hours(spark: SparkSession, path: str, rollups: str, now: datetime, roll, *, run_id: str) -> DataFrame:
    """Write the rollup of every sealed hour of every organisation that has none; returns the hours that have one.

    An hour whose rollup is missing, say after a crash, is rolled by the next run. A retry of
    a run works its own hours out again.
    """
    rows = sealed(current(spark, path), now).withColumn("_hour", hour_of("timestamp"))
    if exists(spark, rollups):
        done = spark.read.parquet(rollups).where(F.col("run_id") != run_id)
        rows = rows.join(done.select("organization_id", F.col("hour_bucket").alias("_hour")).distinct(), ["organization_id", "_hour"], "left_anti")
    archive(roll(rows.drop("_hour")), rollups, "hour_bucket", sort="hour_bucket", run_id=run_id)
    return spark.read.parquet(rollups).select("organization_id", "hour_bucket").distinct()


def compact_days(spark: SparkSession, path: str, now: datetime, *, run_id: str, sort: str = "timestamp", rows_per_file: int = 5_000_000) -> DataFrame:
    """Rewrite the runs of every closed day of every organisation into few sorted files, in one job.

    The new files go to ``<path>-days``. The list of the runs they stand for, written last, makes
    readers (``current``) turn to them, so a crash before leaves the day as it was and a retry
    replaces its own files. ``drop_compacted`` removes the old folders at any later time.
    """
    raw = runs_of(spark, path)
    closed = F.col("date") < F.to_date(moment(now - SEAL_GRACE))
    open_runs = raw.where(closed).select("organization_id", "date", "run_id").distinct()
    before = compactions(spark, path)
    if before is not None:
        open_runs = open_runs.join(before.where(F.col("compaction") != run_id).select("organization_id", "date", "run_id"), ["organization_id", "date", "run_id"], "left_anti")
    several = open_runs.groupBy("organization_id", "date").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("organization_id", "date")
    todo = open_runs.join(several, ["organization_id", "date"])
    rows = raw.join(todo, ["organization_id", "date", "run_id"], "left_semi").drop("run_id").withColumn("compaction", F.lit(run_id))
    layout = ["organization_id", "date", "compaction"]
    rows = rows.hint("rebalance", "organization_id", "date").sortWithinPartitions(*layout, sort)
    for part, target in ((rows, f"{path}-days"), (todo.withColumn("compaction", F.lit(run_id)).coalesce(1), f"{path}-compactions")):
        writer = part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file)
        writer.partitionBy(*(layout if part is rows else ["compaction"])).parquet(target)
    return current(spark, path)


def compactions(spark: SparkSession, path: str) -> DataFrame | None:
    """organization_id, date, run_id, compaction: which compaction stands for which run."""
    if not exists(spark, f"{path}-compactions"):
        return None
    return spark.read.schema("organization_id int, date date, run_id string, compaction string").parquet(f"{path}-compactions")


def _rows_by(spark: SparkSession, path: str, folder: str, columns: T.StructType) -> DataFrame:
    """A table's rows with the run or compaction that wrote them; none if all are gone."""
    schema = T.StructType([*columns.fields, T.StructField(folder, T.StringType())])
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def columns_of(spark: SparkSession, path: str) -> T.StructType:
    if exists(spark, f"{path}/{SCHEMA_FILE}"):
        return T.StructType.fromJson(json.loads(files.read_text(spark, f"{path}/{SCHEMA_FILE}")))
    return spark.read.parquet(path).drop("run_id").schema


def runs_of(spark: SparkSession, path: str) -> DataFrame:
    """What the runs wrote and is still there, which may be nothing once all days are compacted."""
    return _rows_by(spark, path, "run_id", columns_of(spark, path))


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows: those of compacted days, and of the runs that no compaction stands for."""
    raw, listed = runs_of(spark, path), compactions(spark, path)
    if listed is None:
        return raw.drop("run_id")
    runs = raw.join(listed.select("organization_id", "date", "run_id"), ["organization_id", "date", "run_id"], "left_anti").drop("run_id")
    key = ["organization_id", "date", "compaction"]
    days = _rows_by(spark, f"{path}-days", "compaction", columns_of(spark, path)).join(listed.select(*key).distinct(), key, "left_semi")
    return runs.unionByName(days.drop("compaction"))


def drop_compacted(spark: SparkSession, path: str) -> int:
    """Remove the folders of runs that a compaction stands for; the number removed."""
    listed = compactions(spark, path)
    if listed is None:
        return 0
    rows = listed.select("organization_id", "date", "run_id").distinct().toLocalIterator()
    return drop_folders(spark, (f"{path}/organization_id={r['organization_id']}/date={r['date']}/run_id={r['run_id']}" for r in rows))


def replace_partitions(rows: DataFrame, path: str, partitions: list[str]) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*partitions).parquet(path)


def rewrite_excluding(
    spark: SparkSession, path: str, organization_id: int, *, project_id: int | None = None, gone: DataFrame | None = None, key: str = "issue_id"
) -> None:
    """Drop a project's (or a set of issues') rows from one organisation's folders, those of compacted days too.

    Only folders that hold such rows are rewritten, in one pass over them: a first scan of the
    key column finds them. A folder left without rows is removed after the others have been
    replaced; a run that dies in between leaves rows that the next run finds again.
    """
    columns = columns_of(spark, path)
    for where, part in ((path, "run_id"), (f"{path}-days", "compaction")):
        if exists(spark, where):
            _rewrite_excluding(spark, where, part, _rows_by(spark, where, part, columns).where(F.col("organization_id") == organization_id), project_id, gone, key)


def _rewrite_excluding(spark: SparkSession, path: str, part: str, table: DataFrame, project_id: int | None, gone: DataFrame | None, key: str) -> None:
    folder = ["organization_id", "date", part]
    if project_id is not None:
        hit, rest = table.where(F.col("project_id") == project_id), lambda rows: rows.where(F.coalesce(F.col("project_id") != project_id, F.lit(True)))
    else:
        keys = gone.select(key).distinct()
        hit, rest = table.join(keys, key, "left_semi"), lambda rows: rows.join(keys, key, "left_anti")
    staging = scratch_path(spark, "rewrite")
    hit.select(*folder).distinct().write.parquet(f"{staging}-folders")
    folders = spark.read.schema(table.select(*folder).schema).parquet(f"{staging}-folders")
    kept = rest(table.join(folders, folder, "left_semi"))
    kept.write.option("compression", "zstd").parquet(staging)
    survivors = spark.read.schema(kept.schema).parquet(staging)
    replace_partitions(survivors, path, folder)
    emptied = folders.join(survivors.select(*folder).distinct(), folder, "left_anti")
    drop_folders(spark, (f"{path}/organization_id={r['organization_id']}/date={r['date']}/{part}={r[part]}" for r in emptied.toLocalIterator()))


def drop_folders(spark: SparkSession, folders: Iterable[str]) -> int:
    """Remove folders through the Hadoop file system, several at a time as they are named; the number removed."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def drop(folder: str) -> bool:
        target = jvm.org.apache.hadoop.fs.Path(folder)
        return bool(target.getFileSystem(conf).delete(target, True))

    removed, names = 0, iter(folders)
    with ThreadPoolExecutor(DELETERS) as pool:
        while some := list(islice(names, 100 * DELETERS)):
            removed += sum(pool.map(drop, some))
    return removed


def day_folders(spark: SparkSession, path: str, before: date) -> Iterator[str]:
    """Day folders of all organisations whose day is before ``before``, from the file system's listing; no file is opened."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    organizations = fs.listStatusIterator(root)
    while organizations.hasNext():
        organization = organizations.next().getPath()
        if not organization.getName().startswith("organization_id="):
            continue
        days = fs.listStatusIterator(organization)
        while days.hasNext():
            day = days.next().getPath()
            if day.getName().startswith("date=") and day.getName()[5:] < before.isoformat():
                yield day.toString()


def expire(spark: SparkSession, path: str, days: int, now: datetime) -> int:
    """Remove day folders, of runs and of compactions, whose day began before ``now`` minus ``days``."""
    edge = utc(now) - timedelta(days=days)
    first = edge.date() if edge.time() == datetime.min.time() else edge.date() + timedelta(days=1)
    return sum(drop_folders(spark, day_folders(spark, p, first)) for p in (path, f"{path}-days") if exists(spark, p))


def purge_organization(spark: SparkSession, paths: list[str], organization_id: int) -> int:
    """Remove an organisation's folders, of runs and of compactions, from several tables."""
    return drop_folders(spark, [f"{p}/organization_id={organization_id}" for path in paths for p in (path, f"{path}-days")])


def archive_then_expire(
    spark: SparkSession, hot: DataFrame, path: str, time_column: str, *, sort: str, hot_days: int, days: int, now: datetime, run_id: str = "base"
) -> tuple[DataFrame, dict[str, int]]:
    """Archive days older than ``hot_days``, remove archived days past retention.

    Rows that come late for an archived day join it. Returns the hot rows that remain and how
    many rows were archived, how many days failed, and how many day folders were deleted. A day
    counts as archived if the run's folder holds as many rows as were to go there; the rows of
    any other day, or of all if the write fails, remain hot.
    """
    edge = moment(datetime.combine(utc(now).date() - timedelta(days=hot_days), datetime.min.time()))
    day = ["organization_id", "date"]
    cold = hot.where(F.col(time_column) < edge)
    wanted = cold.groupBy("organization_id", F.to_date(time_column).alias("date")).agg(F.count(F.lit(1)).alias("n"))
    try:
        archive(cold, path, time_column, sort=sort, run_id=run_id)
    except Exception as error:  # noqa: BLE001 - a table that cannot be written must not stop the others
        log.warning("archive of %s failed: %s", path, error)
    there = written_by(spark, path, run_id)
    found = wanted.withColumn("m", F.lit(0).cast("bigint")) if there is None else wanted.join(
        there.groupBy(*day).agg(F.count(F.lit(1)).alias("m")), day, "left")
    complete = F.coalesce(F.col("n") == F.col("m"), F.lit(False))
    counts = found.agg(F.sum(F.when(complete, F.col("n"))).alias("archived"), F.count_if(~complete).alias("failed")).first()
    done = written_once(found.where(complete).select(*day), "archived-days")
    remaining = hot.withColumn("date", F.to_date(time_column)).join(done.withColumn("_done", F.lit(True)), day, "left")
    remaining = remaining.where((F.col(time_column) >= edge) | F.col(time_column).isNull() | F.col("_done").isNull()).select(*hot.columns)
    deleted = expire(spark, path, days, now) if exists(spark, path) else 0
    return remaining, {"archived": counts["archived"] or 0, "failed": counts["failed"], "deleted": deleted}


def read_by_tier(chunks: DataFrame, hours: DataFrame, days: DataFrame) -> DataFrame:
    """A day file shadows the hour files of that day, an hour file the chunks of that hour."""
    hour_key, day_key = ["organization_id", "date", "hour"], ["organization_id", "date"]
    from_hours = hours.join(days.select(*day_key).distinct(), day_key, "left_anti")
    from_chunks = chunks.join(days.select(*day_key).distinct(), day_key, "left_anti").join(
        hours.select(*hour_key).distinct(), hour_key, "left_anti"
    )
    return days.unionByName(from_hours).unionByName(from_chunks)
