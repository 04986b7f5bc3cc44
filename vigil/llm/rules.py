"""Quality rules whose cutoffs follow the data of each language and source.

Every document's text gets counts (words, symbols, repeated lines and words, word lengths,
capitals). Each count becomes a ratio in thousandths. A quantile sketch per (lang, source)
and ratio holds how many documents fall into each bucket of relative width 1/32; sketches of
any two sets of documents merge by adding their counts, whatever the order, so they are
built with map-side combined sums and a group that holds a third of all documents costs no
task more than another. The quartiles of a sketch set the group's cutoffs:

    high = q75 + FENCE * (q75 - q25) + slack        low = q25 - FENCE * (q75 - q25) - slack

Cutoffs are learnt from documents that pass the base rules. A group with fewer than
``least_docs`` of those uses the cutoffs of all documents. The documents are then joined
with the cutoffs of their group, and one is kept if all its ratios lie within.

Defined cases: a null or empty text has no words and fails the base rules; a null language or
source is a group of its own; a null id is carried along; repeated rows are judged each and
repeat in the result; an empty table gives an empty result; other columns are ignored. Texts
are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import kit
from .exchange import stored

FENCE = 3
LEAST_DOCS = 50
#: Ratio: slack in thousandths; whether low values are bad too.
RATIOS = {"symbols": (30, False), "repeated_lines": (500, False), "repeated_words": (350, False), "capitals": (150, False), "word_length": (1500, True)}
SYMBOLS = b"#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def _repeats(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: does its document have it several times; is it a later one of those."""
    key = kit.mix(hashes ^ kit.mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    first = kit.runs(key[order])
    size = np.diff(first, append=len(key))
    several, later = np.empty(len(key), bool), np.ones(len(key), bool)
    several[order] = np.repeat(size > 1, size)
    later[order[first]] = False
    return several, later


def count_text(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each document, in the order of ``COUNTS``."""
    start, end, first = kit.words(data, offsets)
    docs, n = len(offsets) - 1, np.diff(first)
    doc = kit.doc_of(first)

    def per_doc(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[at[1:]] - sums[at[:-1]]

    # Windows of three words, within one document.
    at = np.flatnonzero(np.arange(len(start)) + 3 <= first[doc + 1]) if len(start) else np.zeros(0, np.int64)
    several, _ = _repeats(kit.span(kit.prefix(kit.word_hashes(data, start, end)), at, at + 3), doc[at])
    covered = kit.cover(at[several], 3, len(start))
    # Lines: a newline or the end of a text closes one; those with a word count.
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    cut = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([cut + 1, offsets[:-1]]))
    stop = np.sort(np.concatenate([cut, offsets[1:]]))
    worded = np.searchsorted(start, stop) > np.searchsorted(start, begin)
    begin, stop = begin[worded], stop[worded]
    line_first = np.searchsorted(begin, offsets)
    line_doc = kit.doc_of(line_first)
    _, later = _repeats(kit.word_hashes(data, begin, stop), line_doc)
    solid = ~kit.SPACE[data]
    return {
        "n_words": n, "word_chars": per_doc(solid & ((data & 0xC0) != 0x80), offsets), "n_symbols": per_doc(_IS_SYMBOL[data], offsets),
        "n_dup_lines": per_doc(later, line_first), "n_repeat_words": per_doc(covered, first),
        "n_lines": np.bincount(line_doc, minlength=docs), "n_capitals": per_doc((data >= 65) & (data <= 90), offsets),
    }


def text_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the counts of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kit.texts(batch["text"])
            for a, b in kit.slices(offsets):
                counts = count_text(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
                rows = batch.slice(a, b - a)
                yield pa.record_batch([rows["doc_id"], rows["lang"], rows["source"], *(pa.array(counts[c].astype(np.int64)) for c in COUNTS)],
                                      ["doc_id", "lang", "source", *COUNTS])

    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    return docs.select("doc_id", "lang", "source", "text").mapInArrow(run, schema)


def ratios() -> dict[str, Column]:
    def per(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.expr(f"1000 * {part} div {whole}")).otherwise(F.lit(0)).cast("long")

    return {"symbols": per("n_symbols", "word_chars"), "repeated_lines": per("n_dup_lines", "n_lines"),
            "repeated_words": per("n_repeat_words", "n_words"), "capitals": per("n_capitals", "word_chars"), "word_length": per("word_chars", "n_words")}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bucket_of(value: Column) -> Column:
    """The lowest value of a sketch bucket: exact below 64, then 32 buckets for each doubling."""
    width = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.greatest(value, F.lit(1)))) - 5, F.lit(0))).cast("long")
    return (value - value % width).cast("long")


def quantile_sketches(stats: DataFrame) -> DataFrame:
    """``lang, source, ratio, bucket, docs``: how many documents lie in each bucket. Add the counts to merge."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("ratio"), bucket_of(value).alias("bucket")) for name, value in ratios().items()]))
    return stats.select("lang", "source", each.alias("e")).groupBy("lang", "source", "e.ratio", "e.bucket").agg(F.count("*").alias("docs"))


def cutoffs(sketches: DataFrame, *group: str) -> DataFrame:
    """``low`` and ``high`` of each ratio and group, and ``docs``, how many documents set them."""
    sums = sketches.groupBy(*group, "ratio", "bucket").agg(F.sum("docs").alias("docs"))
    whole = Window.partitionBy(*group, "ratio")
    ranked = sums.select("*", F.sum("docs").over(whole.orderBy("bucket")).alias("upto"), F.sum("docs").over(whole).alias("all"))
    quartiles = ranked.groupBy(*group, "ratio").agg(
        F.min(F.when(F.col("upto") * 4 >= F.col("all"), F.col("bucket"))).alias("q25"),
        F.min(F.when(F.col("upto") * 4 >= F.col("all") * 3, F.col("bucket"))).alias("q75"), F.first("all").alias("docs"))
    slack = F.create_map(*[x for name, (room, _) in RATIOS.items() for x in (F.lit(name), F.lit(room))])[F.col("ratio")]
    two_sided = F.col("ratio").isin([name for name, (_, both) in RATIOS.items() if both])
    reach = FENCE * (F.col("q75") - F.col("q25")) + slack
    return quartiles.select(*group, "ratio", (F.col("q75") + reach).alias("high"), F.when(two_sided, F.col("q25") - reach).alias("low"), "docs")


def _wide(limits: DataFrame, prefix: str, *group: str) -> DataFrame:
    """One row for each group."""
    sides = [F.max(F.when(F.col("ratio") == name, F.col(side))).alias(f"{prefix}_{name}_{side}") for name in RATIOS for side in ("low", "high")]
    return limits.groupBy(*group).agg(*sides, F.max("docs").alias(f"{prefix}_docs"))


def quality_rules(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The counts of each document, ``base_failed`` and ``kept``."""
    stats = stored(text_statistics(docs), "statistics").withColumn("base_failed", base_failed())
    sketches = stored(quantile_sketches(stats.where("NOT base_failed")), "sketches")
    own = _wide(cutoffs(sketches, "lang", "source"), "own", "lang", "source").withColumnsRenamed({"lang": "own_lang", "source": "own_source"})
    # One row: the cutoffs of all documents, for groups with too few.
    overall = _wide(cutoffs(sketches.withColumn("everything", F.lit(1)), "everything"), "all", "everything").first()
    joined = stats.join(own, F.col("lang").eqNullSafe(F.col("own_lang")) & F.col("source").eqNullSafe(F.col("own_source")), "left")
    good = F.lit(True)
    enough = F.coalesce(F.col("own_docs"), F.lit(0)) >= least_docs
    for name, value in ratios().items():
        for side in ("low", "high"):
            general = F.lit(overall[f"all_{name}_{side}"] if overall else None).cast("long")
            limit = F.when(enough, F.col(f"own_{name}_{side}")).otherwise(general)
            good &= F.coalesce(value >= limit if side == "low" else value <= limit, F.lit(True))
    return joined.select("doc_id", "lang", "source", *COUNTS, "base_failed", (~F.col("base_failed") & good).alias("kept"))
