"""Tables of one row per key that are merged when they are read: base files, deltas, versions.

A writer puts down a delta: what its batch adds to each key, in hash buckets of the key. It is
committed as the next version by one rename. Readers merge the base of each bucket with the
deltas that came after it; ``fold`` writes a new base for the buckets that have deltas, from
their base and those deltas only.

Each column has a rule by which two values of a key become one. All rules give the same
result in any order and any grouping, so deltas can be folded whenever there is time:

* ``sum``, ``min``, ``max``: of the values that are there;
* ``first <column>``, ``last <column>``: the value that goes with the least or greatest value
  of that column (which is null where the value is, and has the rule ``min`` or ``max``); of
  equal ones the least or greatest value.

Writers that only add never meet. A writer whose rows depend on what it has read names the
version it read and the columns that tell which rows it depends on: if another writer has
since committed rows with the same values there, its commit is refused and it reads again.
Keys may be null; an empty batch is a version without files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.timeparam import utc
from ..operators.segmented import join_on_keys
from . import files
from .storage import drop_folders
from .tablelog import Conflict

BUCKETS = 64
STATE_EVERY = 16


@dataclass(frozen=True)
class State:
    """The base of each bucket (folder, version it covers) and the deltas (version, folder, buckets) that some base does not cover."""

    version: int
    base: dict[int, tuple[str, int]]
    pending: list[tuple[int, str, list[int]]]

    def deltas(self, bucket: int) -> list[str]:
        covered = self.base[bucket][1] if bucket in self.base else 0
        return [folder for number, folder, buckets in self.pending if number > covered and bucket in buckets]

    def folders(self, bucket: int) -> list[str]:
        return ([self.base[bucket][0]] if bucket in self.base else []) + self.deltas(bucket)

    def buckets(self) -> set[int]:
        return {*self.base, *(b for _, _, buckets in self.pending for b in buckets)}

    def after(self, line: Mapping) -> State:
        """The state that a commit leads to."""
        base, pending = dict(self.base), list(self.pending)
        if line["kind"] == "fold":
            base.update({b: (line["folder"], line["covers"]) for b in line["buckets"]})
            pending = [d for d in pending if any(d[0] > (base[b][1] if b in base else 0) for b in d[2])]
        elif line["buckets"]:
            pending.append((line["number"], line["folder"], line["buckets"]))
        return State(line["number"], base, pending)


class KeyedStore:
    """A table with one row for each key, changed by deltas."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.log, self.data = f"{self.path}/_log", f"{self.path}/data"
        about = json.loads(files.read_text(spark, f"{self.log}/table.json"))
        self.schema, self.keys, self.rules, self.n_buckets = T.StructType.fromJson(about["schema"]), about["keys"], about["rules"], about["buckets"]

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: str, keys: Sequence[str], rules: Mapping[str, str], buckets: int = BUCKETS) -> KeyedStore:
        """A new table; ``schema`` has the keys and the columns of ``rules``."""
        fields = T.StructType.fromDDL(schema)
        if {*fields.names} != {*keys, *rules} or {*keys} & {*rules}:
            raise ValueError("the columns are the keys and those that have a rule")
        for column, rule in rules.items():
            word, _, by = rule.partition(" ")
            wanted = {"first": "min", "last": "max"}.get(word)
            if word not in ("sum", "min", "max", "first", "last") or (wanted is None) == bool(by) or (wanted and rules.get(by) != wanted):
                raise ValueError(f"no rule {rule!r} for {column}")
        about = {"schema": fields.jsonValue(), "keys": list(keys), "rules": dict(rules), "buckets": buckets}
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
        return max(self._numbers(".json"), default=0)

    def _lines(self, after: int = 0, until: int | None = None) -> list[dict]:
        chosen = [n for n in self._numbers(".json") if n > after and (until is None or n <= until)]
        return [json.loads(files.read_text(self.spark, f"{self.log}/{n:020d}.json")) for n in chosen]

    def state(self, version: int | None = None) -> State:
        """What a version consists of: the state written down before it and the commits between."""
        version = self.latest() if version is None else version
        known = max((n for n in self._numbers(".state") if n <= version), default=0)
        found = State(0, {}, [])
        if known:
            kept = json.loads(files.read_text(self.spark, f"{self.log}/{known:020d}.state"))
            found = State(known, {int(b): (f, n) for b, (f, n) in kept["base"].items()}, [(n, f, b) for n, f, b in kept["pending"]])
        lines = self._lines(known, version)
        if len(lines) != version - known:
            raise ValueError(f"version {version} of {self.path} is not kept any more")
        return reduce(State.after, lines, found)

    def _write_state(self, version: int) -> None:
        now = self.state(version)
        staged = f"{self.log}/.state-{uuid.uuid4().hex}"
        files.write_text(self.spark, staged, json.dumps({"base": now.base, "pending": now.pending}))
        files.rename_new(self.spark, staged, f"{self.log}/{version:020d}.state")

    def committed(self, run_id: str) -> int | None:
        """The version that a run was committed as, as long as the log goes back."""
        return next((line["number"] for line in reversed(self._lines()) if line["run_id"] == run_id), None)

    def _commit(self, line: dict, base: int, now: datetime, refused) -> int:
        """The next version, unless a commit since ``base`` makes ``refused`` raise."""
        staged, checked = f"{self.log}/.commit-{uuid.uuid4().hex}", base
        while True:
            for other in self._lines(checked):
                refused(other)
                checked = other["number"]
            line = line | {"number": checked + 1, "at": utc(now).isoformat()}
            files.write_text(self.spark, staged, json.dumps(line))
            if files.rename_new(self.spark, staged, f"{self.log}/{line['number']:020d}.json"):
                break
        if line["kind"] == "fold" or line["number"] % STATE_EVERY == 0:
            self._write_state(line["number"])
        return line["number"]

    # -- rows ----------------------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n_buckets)).cast("int").alias("bucket")

    def merged(self, rows: DataFrame) -> DataFrame:
        """One row for each key; combined before the shuffle, so a key that many rows have is no burden."""
        simple = {"sum": F.sum, "min": F.min, "max": F.max}
        out = []
        for column, rule in self.rules.items():
            word, _, by = rule.partition(" ")
            if by:
                there = F.when(F.col(column).isNotNull() & F.col(by).isNotNull(), F.struct(by, column))
                value = (F.min if word == "first" else F.max)(there)[column]
            else:
                value = simple[word](column)
            out.append(value.cast(self.schema[column].dataType).alias(column))
        return rows.groupBy(*self.keys).agg(*out).select(*self.schema.names)

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        """Put merged rows down by bucket, sorted by key; the tasks that share a large bucket each write a part."""
        folder = f"run={uuid.uuid4().hex}"
        spread = rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").sortWithinPartitions("bucket", *self.keys)
        spread.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.data}/{folder}")
        return folder, sorted(int(n[7:]) for n, _ in files.names(self.spark, f"{self.data}/{folder}") if n.startswith("bucket="))

    def _open(self, state: State, buckets: Iterable[int]) -> DataFrame:
        """Rows of the bases and deltas of some buckets, as they are stored."""
        paths = [f"{self.data}/{folder}/bucket={b}" for b in sorted(buckets) for folder in state.folders(b)]
        shape = T.StructType([*self.schema.fields, T.StructField("run", T.StringType()), T.StructField("bucket", T.IntegerType())])
        if not paths:
            return self.spark.createDataFrame([], shape).drop("run")
        return self.spark.read.schema(shape).option("basePath", self.data).parquet(*paths).drop("run")

    def pieces(self, version: int | None = None) -> DataFrame:
        """What is stored for the keys, unmerged: enough for extremes over many keys."""
        state = self.state(version)
        return self._open(state, state.buckets()).drop("bucket")

    def read(self, version: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The table as of a version; with ``keys`` the rows of those keys only, chosen before they are merged."""
        state = self.state(version)
        rows = self._open(state, state.buckets())
        if keys is not None:
            wanted = keys.select(*self.keys).distinct().withColumn("bucket", self._bucket())
            rows = join_on_keys(rows, wanted, ["bucket", *self.keys], "left_semi")
        return self.merged(rows)

    def commit(self, rows: DataFrame, now: datetime, run_id: str | None = None, read: int | None = None,
               scope: Sequence[str] = (), where: str = "true") -> int:
        """Add a delta; rows of the same key are merged first. A run that is there already changes nothing.

        ``read`` is the version that the rows depend on, ``scope`` the columns (all keys by default) that tell
        on which rows: rows committed since that agree there raise ``Conflict``. Rows of either side for which ``where`` does not hold
        neither depend on others nor matter to them.
        """
        base = self.latest()
        if run_id is not None and (there := self.committed(run_id)) is not None:
            return there
        scope = list(scope or self.keys)
        folder, buckets = self._write(self.merged(rows))
        mine = self._open(State(0, {}, [(1, folder, buckets)]), buckets).where(where).select(*scope).distinct()

        def refused(other: dict) -> None:
            if run_id is not None and other["run_id"] == run_id:
                raise Conflict(f"run {run_id} has been committed as version {other['number']}")
            if read is not None and other["kind"] == "delta" and other["buckets"]:
                # Equal keys lie in equal buckets; other scopes may meet in any two.
                meet = [b for b in other["buckets"] if {*scope} != {*self.keys} or b in buckets]
                theirs = self._open(State(0, {}, [(1, other["folder"], other["buckets"])]), meet).where(where)
                if meet and not join_on_keys(theirs, mine, scope, "left_semi").isEmpty():
                    raise Conflict(f"version {other['number']} has changed what was read")

        line = {"kind": "delta", "folder": folder, "buckets": buckets, "run_id": run_id}
        try:
            return self._commit(line, base if read is None else min(base, read), now, refused)
        except Conflict:
            drop_folders(self.spark, [f"{self.data}/{folder}"])
            there = self.committed(run_id) if run_id is not None else None
            if there is None:
                raise
            return there

    def fold(self, now: datetime, least: int = 1) -> int:
        """A new base for the buckets that have at least ``least`` deltas; other buckets and their files are not opened.

        Deltas that are committed meanwhile stay on top of it. If another fold of one of the buckets comes first, this one gives up.
        """
        state = self.state()
        due = [b for b in sorted(state.buckets()) if len(state.deltas(b)) >= least]
        if not due:
            return state.version
        folder, written = self._write(self.merged(self._open(state, due)))

        def refused(other: dict) -> None:
            if other["kind"] == "fold" and {*other["buckets"]} & {*written}:
                raise Conflict(f"version {other['number']} has folded the same buckets")

        line = {"kind": "fold", "folder": folder, "buckets": written, "covers": state.version, "run_id": None}
        try:
            return self._commit(line, state.version, now, refused)
        except Conflict:
            drop_folders(self.spark, [f"{self.data}/{folder}"])
            raise

    def vacuum(self, before: datetime, now: datetime) -> int:
        """Remove folders that no version since ``before`` reads, those of writers that died before it, and the log before the newest state of that time.

        ``before`` lies further back than the begin of any reader or writer that is still at work. A run that is
        tried again must be younger too, since its commit is known by the log.
        """
        edge, lines = utc(before), self._lines()
        old = [line["number"] for line in lines if datetime.fromisoformat(line["at"]) < edge]
        start = max((n for n in self._numbers(".state") if n in old), default=0)
        states = [self.state(n) for n in [start, *(line["number"] for line in lines if line["number"] > start)] if n]
        held = {folder for s in states for b in s.buckets() for folder in s.folders(b)}
        stray = [n for n, at in files.names(self.spark, self.data) if n not in held and at < edge.timestamp() * 1000]
        count = drop_folders(self.spark, [f"{self.data}/{n}" for n in stray])
        drop_folders(self.spark, [f"{self.log}/{line['number']:020d}.json" for line in lines if line["number"] < start])
        return count
