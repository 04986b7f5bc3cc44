"""Tables with a log of versions: atomic commits, snapshots, delete records.

Data files lie below ``data/batch=<id>/organization_id=<n>/date=<day>``. A version is one small file in ``_log``
that appears by one rename; it names a Parquet table of the files it adds and removes (file,
organisation, day, rows, first and last time) and one of the deletes it records. The live
files of a version are those added up to it without those removed, a join of such tables;
every ``CHECKPOINT_EVERY`` versions that join is written down, so that a reader opens a bounded
number of them. Readers take their files from one version, so that a rewrite beside them
changes nothing they see.

* Writers put their data down first and commit last. A crash before leaves a batch that no
  version names; ``vacuum`` removes it. A run that has been committed is not written again.
* A project, or a set of keys, is deleted by a record that readers apply to the files that are
  older than it; rows that come later stay. The next compaction writes the files that hold such rows without them.
* An organisation or a period goes by removing its files from the log; no file is opened.
* A compaction reads a version and gives its files that version's age, so deletes recorded
  meanwhile still hit them. If one of the files it has read is removed meanwhile, it gives up.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.timeparam import moment, utc
from ..operators.segmented import written_once
from . import files
from .storage import SEAL_GRACE, drop_folders

CHECKPOINT_EVERY = 16
MAX_RECORDS = 5_000_000
FILES = "file string, batch string, organization_id int, date date, rows bigint, low timestamp_ntz, high timestamp_ntz, seq bigint"
CHANGES = f"change string, {FILES}"
DELETES = "organization_id int, project_id string, issue_id string, seq bigint"
#: What a delete record may name besides the organisation; as text, whatever the table's type is.
KEYS = ("project_id", "issue_id")


class Conflict(RuntimeError):
    """Another writer has removed what this one has read."""


@dataclass(frozen=True)
class Version:
    """A line of the log: what kind of commit, of which batch and run, and where its changes are."""

    number: int
    kind: str
    at: str
    batch: str | None = None
    run_id: str | None = None
    changes: str | None = None
    deletes: str | None = None


@dataclass(frozen=True)
class Snapshot:
    """The live files of a version, and the delete records that may still hit one of them."""

    version: int
    files: DataFrame
    deletes: DataFrame


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


class TableLog:
    """A table of rows with ``organization_id``, a time column and, for deletes, ``project_id`` or ``issue_id``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.log, self.data = f"{self.path}/_log", f"{self.path}/data"
        about = json.loads(files.read_text(spark, f"{self.log}/table.json"))
        self.schema, self.time_column, self.sort = T.StructType.fromJson(about["schema"]), about["time_column"], about["sort"]

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, time_column: str, sort: str) -> TableLog:
        """A new table; ``sort`` orders the rows inside a file."""
        fields = [f for f in schema.fields if f.name not in ("date", "batch")]
        about = {"schema": T.StructType(fields).jsonValue(), "time_column": time_column, "sort": sort}
        log = f"{path.rstrip('/')}/_log"
        staged = f"{log}/.table-{uuid.uuid4().hex}"
        files.write_text(spark, staged, json.dumps(about))
        if not files.rename_new(spark, staged, f"{log}/table.json"):
            raise Conflict(f"{path} is a table already")
        return cls(spark, path)

    # -- versions ------------------------------------------------------------------------

    def _numbers(self, suffix: str) -> list[int]:
        return sorted(int(n[: -len(suffix)]) for n, _ in files.names(self.spark, self.log) if n.endswith(suffix) and n[: -len(suffix)].isdigit())

    def latest(self) -> int:
        """The number of the newest version; 0 before the first commit."""
        return max(self._numbers(".json"), default=0)

    def version(self, number: int) -> Version:
        return Version(**json.loads(files.read_text(self.spark, f"{self.log}/{number:020d}.json")))

    def versions(self, after: int = 0, until: int | None = None) -> list[Version]:
        """The log from oldest to newest; compacted logs begin later than version 1."""
        return [self.version(n) for n in self._numbers(".json") if n > after and (until is None or n <= until)]

    def _read(self, folder: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.log}/{folder}")

    def _empty(self, schema: str | T.StructType) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def _changes(self, versions: list[Version]) -> DataFrame:
        """All adds and removes; the files of an append are as old as their version."""
        tables = [self._read(v.changes, CHANGES).withColumn("seq", F.coalesce("seq", F.lit(v.number))) for v in versions if v.changes]
        return _union(tables) if tables else self._empty(CHANGES)

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The state of a version, the newest by default: the checkpoint before it and at most the versions between."""
        version = self.latest() if version is None else version
        base = max((n for n in self._numbers(".checkpoint") if n <= version), default=0)
        since = self.versions(base, version)
        if len(since) != version - base:
            raise ValueError(f"version {version} of {self.path} is not kept any more")
        changes = self._changes(since)
        live = changes.where("change = 'add'").drop("change")
        deletes = [self._read(v.deletes, DELETES).withColumn("seq", F.lit(v.number).cast("bigint")) for v in since if v.deletes]
        if base:
            kept = json.loads(files.read_text(self.spark, f"{self.log}/{base:020d}.checkpoint"))
            live = live.unionByName(self._read(kept["files"], FILES))
            deletes.append(self._read(kept["deletes"], DELETES))
        gone = changes.where("change = 'remove'").select("file")
        ages = changes.where("change = 'age'").groupBy("file").agg(F.max("seq").alias("_age"))
        live = live.join(gone, "file", "left_anti").join(ages, "file", "left").withColumn("seq", F.greatest("seq", "_age")).drop("_age")
        return Snapshot(version, live, _union(deletes) if deletes else self._empty(DELETES))

    def checkpoint(self, version: int | None = None) -> int:
        """Write a version's live files down, without the delete records that no file is old enough for."""
        now = self.snapshot(version)
        folders = {part: f"checkpoint-{now.version}-{part}-{uuid.uuid4().hex}" for part in ("files", "deletes")}
        now.files.write.parquet(f"{self.log}/{folders['files']}")
        oldest = self._read(folders["files"], FILES).groupBy("organization_id").agg(F.min("seq").alias("_oldest"))
        pending = now.deletes.join(oldest, "organization_id").where("_oldest < seq").drop("_oldest")
        pending.write.parquet(f"{self.log}/{folders['deletes']}")
        staged = f"{self.log}/.checkpoint-{uuid.uuid4().hex}"
        files.write_text(self.spark, staged, json.dumps(folders))
        files.rename_new(self.spark, staged, f"{self.log}/{now.version:020d}.checkpoint")
        return now.version

    def _commit(self, kind: str, now: datetime, *, base: int, batch: str | None = None, run_id: str | None = None, changes: DataFrame | None = None,
                deletes: DataFrame | None = None) -> int:
        """The next version; ``base`` is the one the changes were worked out from."""
        key = uuid.uuid4().hex
        folders = {}
        for name, frame, schema in (("changes", changes, CHANGES), ("deletes", deletes, DELETES)):
            if frame is not None:
                folders[name] = f"{name}-{key}"
                fields = T.StructType.fromDDL(schema).fields
                frame.select(*[F.col(f.name).cast(f.dataType) for f in fields]).write.parquet(f"{self.log}/{folders[name]}")
        staged, checked = f"{self.log}/.commit-{key}", base
        while True:
            since = self.versions(checked)
            for other in since:
                if run_id is not None and other.run_id == run_id:
                    raise Conflict(f"run {run_id} has been committed as version {other.number}")
            if "changes" in folders and any(v.changes for v in since):
                gone = self._changes(since).where("change = 'remove'").select("file")
                if not self._read(folders["changes"], CHANGES).where("change = 'remove'").join(gone, "file", "left_semi").isEmpty():
                    raise Conflict("a file to be rewritten has been removed")
            checked = max([checked, *[v.number for v in since]])
            line = Version(checked + 1, kind, utc(now).isoformat(), batch, run_id, folders.get("changes"), folders.get("deletes"))
            files.write_text(self.spark, staged, json.dumps(line.__dict__))
            if files.rename_new(self.spark, staged, f"{self.log}/{line.number:020d}.json"):
                break
        if line.number % CHECKPOINT_EVERY == 0:
            self.checkpoint(line.number)
        return line.number

    # -- writing -------------------------------------------------------------------------

    def _write(self, rows: DataFrame) -> tuple[str, DataFrame]:
        """Put rows down as a batch; what it adds, counted from the files."""
        batch = uuid.uuid4().hex
        out = rows.select(*[f.name for f in self.schema.fields], F.to_date(self.time_column).alias("date"))
        layout = ["organization_id", "date"]
        spread = out.hint("rebalance", *layout).sortWithinPartitions(*layout, self.sort)
        writer = spread.write.partitionBy(*layout).option("compression", "zstd").option("maxRecordsPerFile", MAX_RECORDS)
        writer.parquet(f"{self.data}/batch={batch}")
        written = self._open([f"{self.data}/batch={batch}"]).select("*", F.regexp_extract("_metadata.file_path", "(batch=.*)$", 1).alias("file"))
        time = F.col(self.time_column).cast("timestamp_ntz")
        found = written.groupBy("file", "batch", *layout).agg(F.count(F.lit(1)).alias("rows"), F.min(time).alias("low"), F.max(time).alias("high"))
        return batch, found.select(F.lit("add").alias("change"), "*")

    def _open(self, paths: list[str]) -> DataFrame:
        fields = [*self.schema.fields, T.StructField("date", T.DateType()), T.StructField("batch", T.StringType())]
        return self.spark.read.schema(T.StructType(fields)).option("basePath", self.data).parquet(*paths)

    def committed(self, run_id: str) -> int | None:
        """The version that a run was committed as, as long as the log goes back."""
        return next((v.number for v in reversed(self.versions()) if v.run_id == run_id), None)

    def append(self, rows: DataFrame, now: datetime, run_id: str | None = None) -> int:
        """Add rows; a run that is there already changes nothing. Rows without a time have no day and are refused."""
        base = self.latest()
        if run_id is not None and (there := self.committed(run_id)) is not None:
            return there
        batch, added = self._write(rows)
        try:
            return self._commit("append", now, base=base, batch=batch, run_id=run_id, changes=added.withColumn("seq", F.lit(None).cast("bigint")))
        except Conflict:
            drop_folders(self.spark, [f"{self.data}/batch={batch}"])
            there = self.committed(run_id) if run_id is not None else None
            if there is None:
                raise
            return there

    def delete(self, organization_id: int, now: datetime, *, project_id: int | None = None, issues: DataFrame | None = None) -> int:
        """Record that a project's rows, or those of a set of issues, are gone; rows that are appended later stay."""
        if (project_id is None) == (issues is None):
            raise ValueError("delete takes a project or issues")
        if issues is None:
            record = self.spark.range(1).select(F.lit(project_id).alias("project_id"), F.lit(None).alias("issue_id"))
        else:
            record = issues.select(F.lit(None).alias("project_id"), "issue_id").where("issue_id IS NOT NULL").distinct()
        record = record.select(F.lit(organization_id).alias("organization_id"), "*", F.lit(None).alias("seq"))
        return self._commit("delete", now, base=self.latest(), deletes=record)

    def _remove(self, kind: str, now: datetime, where) -> int:
        """Take files out of the log. Files that come into it meanwhile (a compaction) are taken out by another try."""
        while True:
            state = self.snapshot()
            going = state.files.where(where)
            if going.isEmpty():
                return state.version
            try:
                return self._commit(kind, now, base=state.version, changes=going.select(F.lit("remove").alias("change"), "*"))
            except Conflict:
                continue

    def purge_organization(self, organization_id: int, now: datetime) -> int:
        return self._remove("purge", now, F.col("organization_id") == organization_id)

    def expire(self, days: int, now: datetime) -> int:
        """Remove the days that began before ``now`` minus ``days``."""
        edge = utc(now) - timedelta(days=days)
        first = edge.date() if edge.time() == datetime.min.time() else edge.date() + timedelta(days=1)
        return self._remove("expire", now, F.col("date") < F.lit(first))

    def compact(self, now: datetime, *, rows_per_file: int = MAX_RECORDS) -> int:
        """Rewrite, in one job, closed days of several small files, and files with rows that are deleted.

        Files that a record is newer than but that hold none of its rows are only noted as seen.
        """
        state = self.snapshot()
        day = ["organization_id", "date"]
        closed = F.col("date") < F.to_date(moment(now - SEAL_GRACE))
        small = state.files.where(closed & (F.col("rows") < rows_per_file // 2))
        several = small.groupBy(*day).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*day)
        old = small.join(several, day, "left_semi").select("file")
        suspects = self._suspects(state, state.files)
        paths = self._paths(suspects)
        if paths:
            keys = [k for k in KEYS if k in self.schema.names]
            aged = self._aged(suspects, paths).select("file", "_seq", "organization_id", *keys)
            struck = _union([self._deleted(aged, state, k, "left_semi").select("file") for k in keys]).distinct()
            old = old.unionByName(struck).distinct()
        old = written_once(state.files.join(old, "file", "left_semi"), "rewritten-files")
        changes = suspects.join(old.select("file"), "file", "left_anti").select(F.lit("age").alias("change"), "*").withColumn("seq", F.lit(state.version).cast("bigint"))
        going, batch = self._paths(old), None
        if going:
            batch, added = self._write(self._live_rows(state, old))
            changes = changes.unionByName(added.withColumn("seq", F.lit(state.version).cast("bigint"))).unionByName(old.select(F.lit("remove").alias("change"), "*"))
        elif not paths:
            return state.version
        try:
            return self._commit("compact", now, base=state.version, batch=batch, changes=changes)
        except Conflict:
            drop_folders(self.spark, [f"{self.data}/batch={batch}"])
            raise

    def vacuum(self, before: datetime, now: datetime) -> int:
        """Remove files that no version since ``before`` names, uncommitted batches from before it, and the log before its checkpoint.

        Readers of older versions lose their files, so ``before`` lies further back than any reader's begin.
        """
        edge = utc(before)
        self.checkpoint()
        known = self.versions()
        old = [v for v in known if datetime.fromisoformat(v.at) < edge]
        last = self.latest()
        live = self.snapshot(last).files.select("file")
        removed = self._changes(old).where("change = 'remove'").join(live, "file", "left_anti").select("file").distinct()
        count = drop_folders(self.spark, (f"{self.data}/{r['file']}" for r in removed.toLocalIterator()))
        held = {v.batch for v in known} | {r["batch"] for r in self.snapshot(last).files.select("batch").distinct().toLocalIterator()}
        stray = [n for n, at in files.names(self.spark, self.data) if n.startswith("batch=") and n[6:] not in held and at < edge.timestamp() * 1000]
        count += drop_folders(self.spark, [f"{self.data}/{n}" for n in stray])
        # What the newest checkpoint stands for can go once no reader needs it.
        for v in old:
            if v.number < last:
                drop_folders(self.spark, [f"{self.log}/{f}" for f in (v.changes, v.deletes) if f] + [f"{self.log}/{v.number:020d}.json"])
        return count

    # -- reading -------------------------------------------------------------------------

    def _paths(self, chosen: DataFrame) -> list[str]:
        """The chosen files' paths; as in any scan, the files that are read are listed on the driver."""
        return [f"{self.data}/{r['file']}" for r in chosen.select("file").orderBy("file").toLocalIterator()]

    def _suspects(self, state: Snapshot, chosen: DataFrame) -> DataFrame:
        """Files that a delete record of their organisation is newer than."""
        newest = state.deletes.groupBy("organization_id").agg(F.max("seq").alias("_newest"))
        return chosen.join(newest, "organization_id").where("seq < _newest").drop("_newest")

    def _aged(self, chosen: DataFrame, paths: list[str]) -> DataFrame:
        """The rows of the chosen files, each with its file's name and age.

        The ages go to every task, one for each of the paths. By the estimated sizes Spark would send the rows instead.
        """
        rows = self._open(paths).drop("batch").withColumn("file", F.regexp_extract("_metadata.file_path", "(batch=.*)$", 1))
        return rows.join(F.broadcast(chosen.select("file", F.col("seq").alias("_seq"))), "file")

    def _deleted(self, aged: DataFrame, state: Snapshot, key: str, how: str) -> DataFrame:
        newest = state.deletes.where(F.col(key).isNotNull()).groupBy("organization_id", key).agg(F.max("seq").alias("_newest"))
        on = (aged["organization_id"] == newest["organization_id"]) & (aged[key].cast("string") == newest[key]) & (aged["_seq"] < newest["_newest"])
        return aged.join(newest, on, how)

    def _live_rows(self, state: Snapshot, chosen: DataFrame) -> DataFrame:
        """The rows of the chosen files that no delete record names; only files older than a record are compared with it."""
        old = self._suspects(state, chosen)
        suspects = self._paths(old)
        clean = sorted(set(self._paths(chosen)) - set(suspects))
        parts = [self._open(clean).drop("batch")] if clean else []
        if suspects:
            rows = self._aged(old, suspects)
            for key in KEYS:
                if key in self.schema.names:
                    rows = self._deleted(rows, state, key, "left_anti")
            parts.append(rows.drop("file", "_seq"))
        return _union(parts) if parts else self._empty(T.StructType([*self.schema.fields, T.StructField("date", T.DateType())]))

    def scan(self, start: datetime | None = None, end: datetime | None = None, organization_id: int | None = None, version: int | None = None) -> DataFrame:
        """Rows of [start, end) as of a version; only files that can hold such rows are opened."""
        state = self.snapshot(version)
        chosen, time = state.files, F.col(self.time_column).cast("timestamp_ntz")
        if organization_id is not None:
            chosen = chosen.where(F.col("organization_id") == organization_id)
        if start is not None:
            chosen = chosen.where(F.col("high") >= moment(start))
        if end is not None:
            chosen = chosen.where(F.col("low") < moment(end))
        rows = self._live_rows(state, chosen)
        if start is not None:
            rows = rows.where(time >= moment(start))
        return rows.where(time < moment(end)) if end is not None else rows
