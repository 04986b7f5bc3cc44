"""An index of keys that grows by batches: where a key's rows are, without a scan of the table.

Keys lie in hash buckets, in runs sorted by key with a Bloom filter each. A batch writes a run of
level 0; every ``fan`` runs of a level are merged into one of the next, by the batch after them, so a batch that is tried
again never meets itself. Readers take the fewest runs that cover all batches before a given
one: at most ``fan`` of each level, whatever the number of batches. A lookup opens one bucket of
each run.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from . import files
from .storage import drop_folders

BUCKETS = 64
FAN = 8


class KeyIndex:
    """``key`` (text) to the columns of ``schema``; other than by ``add`` nothing is ever changed."""

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = BUCKETS, fan: int = FAN) -> None:
        self.spark, self.path, self.buckets, self.fan = spark, path.rstrip("/"), buckets, fan
        self.schema = T.StructType([T.StructField("key", T.StringType()), *T.StructType.fromDDL(schema).fields])

    def _folder(self, level: int, nth: int) -> str:
        return f"{self.path}/level={level}/run={nth}"

    def _complete(self, level: int) -> set[int]:
        found = (n for n, _ in files.names(self.spark, f"{self.path}/level={level}") if n.startswith("run="))
        return {k for n in found if files.exists(self.spark, f"{self._folder(level, k := int(n[4:]))}/_SUCCESS")}

    def _levels(self) -> list[int]:
        return sorted((int(n[6:]) for n, _ in files.names(self.spark, self.path) if n.startswith("level=")), reverse=True)

    def runs(self, before: int | None = None) -> list[tuple[int, int]]:
        """Level and number of the runs that cover the batches before one, each batch once."""
        covered: list[tuple[int, int, int]] = []
        for level in self._levels():
            size = self.fan**level
            for nth in sorted(self._complete(level)):
                first, end = nth * size, (nth + 1) * size
                if (before is None or end <= before) and not any(a <= first and end <= b for _, a, b in covered):
                    covered.append((level, first, end))
        return sorted((level, first // self.fan**level) for level, first, _ in covered)

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _read(self, runs: list[tuple[int, int]]) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        parts = [self.spark.read.schema(schema).parquet(self._folder(*r)) for r in runs]
        if not parts:
            return self.spark.createDataFrame([], schema)
        out = parts[0]
        for part in parts[1:]:
            out = out.unionAll(part)
        return out

    def _write(self, rows: DataFrame, level: int, nth: int) -> None:
        """A run; a bucket is written by the tasks that share it, an ordinary one by a single task."""
        sorted_rows = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "key")
        writer = sorted_rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").option("compression", "zstd")
        writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.block.size", str(4 << 20)).parquet(self._folder(level, nth))

    def merge(self, batch_id: int) -> None:
        """Merge the runs that are complete before a batch, and remove what a merged run stands for.

        A run whose merge died half way has no success mark and is merged again; what it covers is still there.
        """
        level = 1
        while batch_id and batch_id % self.fan**level == 0:
            nth = batch_id // self.fan**level - 1
            if nth not in self._complete(level):
                inside = [r for r in self.runs(batch_id) if nth * self.fan**level <= r[1] * self.fan ** r[0] < batch_id and r[0] < level]
                self._write(self._read(inside), level, nth)
            drop_folders(self.spark, (self._folder(level - 1, k) for k in range(nth * self.fan, (nth + 1) * self.fan) if k in self._complete(level - 1)))
            level += 1

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Write a batch's keys; a batch that is tried again replaces its run."""
        named = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]).where("key IS NOT NULL")
        self._write(named.withColumn("bucket", self.bucket(F.col("key"))), 0, batch_id)

    def known(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """Index rows of the given keys (column ``key``), as of the batches before one."""
        wanted = keys.select("key").where("key IS NOT NULL").distinct().withColumn("bucket", self.bucket(F.col("key")))
        return self._read(self.runs(before)).join(wanted, ["bucket", "key"], "left_semi").drop("bucket")

    def lookup(self, key: str) -> DataFrame:
        """Index rows of one key: one bucket of each run is opened, and of its row groups those that the filter lets pass."""
        bucket = self.spark.range(1).select(self.bucket(F.lit(key))).first()[0]
        return self._read(self.runs()).where((F.col("bucket") == bucket) & (F.col("key") == key)).drop("bucket")


def listed(index: KeyIndex) -> Iterator[str]:
    """The run folders that are there."""
    for level in index._levels():
        yield from (f"level={level}/{n}" for n, _ in files.names(index.spark, f"{index.path}/level={level}") if n.startswith("run="))
