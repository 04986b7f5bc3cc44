"""From raw documents to packed training sequences, in stages that are written and read again.

Each stage takes the documents that the stage before has left and returns documents with the
same columns; the last returns pieces of packed sequences.

1. ``quality``: documents that the nearest-neighbour classifier rejects go (score below 0.5).
2. ``line_dedup``: blocks of lines that an earlier document has are deleted from the later
   one; ``n_chars`` follows, and a document left without a word goes.
3. ``near_duplicates``: of each group of near-duplicates the one with the smallest id stays.
4. ``mixing``: documents are written in the order of the source schedule, none is dropped.
5. ``packing``: sequences of at most 4096 ids that follow the source schedule of stage 4, along
   the space-filling curve inside each run of ``packing.TURN_SLOTS`` slots.

Defined cases: empty texts pass all stages; documents without id are never near-duplicates and
stay; rows that repeat an id count as one document in stage 3, and one of them stays; null
sources, languages and other columns are carried along; columns named like those an operator
adds are carried along unchanged; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigil.llm import exchange, jaccard_join, line_dedup, mixing, quality, queries
from vigil.llm.columns import carried, restored
from vigil.session import prepare, scratch_path

CORE = ("doc_id", "text", "source")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, queries.labels(spark, sf_dir))
    return quality.with_score(carried(docs, CORE), model).where("score >= 0.5").select(*restored(docs, CORE))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(carried(docs, CORE)).where("n_removed = 0 OR text RLIKE '[^ \\\\t-\\\\r]'")
    changed = {"n_chars": F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("_rest.n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return kept.select(*restored(docs, CORE, **changed))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard_join.near_duplicates(docs.select("doc_id", "text"))
    keep = found.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionAll(docs.where("doc_id IS NULL")).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(carried(docs, CORE))
    order = ["mix_slot", "mix_place", "doc_id"]
    return mixed.repartitionByRange(exchange.partitions(spark), *order).sortWithinPartitions(*order).select(*restored(docs, CORE))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.packed(docs, scheduled=True)


STAGES = [("quality", keep_good), ("line_dedup", drop_common_lines), ("near_duplicates", keep_one_of_each_group), ("mixing", mix), ("packing", pack)]
#: Fitted models and alignments have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data directory."""
    docs = queries.documents(prepare(spark), sf_dir)
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
