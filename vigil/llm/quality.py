"""Quality scores by nearest-neighbour voting among labelled documents in a latent space.

Method: a text's terms are hashed byte trigrams, word shapes, and how much of it repeats. Term
frequencies, damped and weighted by their rarity over the whole corpus, are projected to the
leading latent directions of a labelled sample (latent semantic analysis). The sample's
vectors and labels go to every task; for each document the exact cosines to all of them are
computed in blocks, and the ``NEIGHBOURS`` nearest (and any that tie with the last) vote with
their labels, weighted by a power of their similarity.

Bounds: the sample is the ``sample`` labelled rows whose hashed ids come first; the broadcast is
``sample`` vectors of ``RANK`` numbers and one matrix of terms. Document frequencies are sums
over all documents of the table.

Labels are used only of rows with crc32(id as text) mod ``folds`` other than ``held_out``; labels,
language, source and id are no input of a score.

Defined cases: an empty or null text, and any text without a neighbour of positive similarity,
scores the sample's mean label; a null label is not used; without usable labels every score is
0.5; rows with one id and different labels give the larger label; a null id is scored and counts
as held out; repeated rows repeat in the result; an empty table gives an empty result; other
columns are ignored. Texts are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import kit, rules

TRIGRAMS, SHAPES, REPEATS = 2048, 768, 4
TERMS = TRIGRAMS + SHAPES
SAMPLE = 6000
RANK = 48
NEIGHBOURS = 25
POWER = 4

_UPPER, _LOWER, _DIGIT, _SIGN = (np.zeros(256, np.int32) for _ in range(4))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = 1
_LOWER[128:] = 1
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-"]] = 1
_LAST = np.full(256, 3, np.int64)
_LAST[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 0
_LAST[ord(".")], _LAST[ord(",")], _LAST[ord("!")] = 1, 2, 4


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed terms of each document, and four shares of repeated and other lines and words."""
    docs = len(offsets) - 1
    out = np.zeros((docs, TERMS), np.float32)
    size = np.diff(offsets)
    if len(data) >= 3:
        gram = (data[:-2].astype(np.uint32) << np.uint32(16) | data[1:-1].astype(np.uint32) << np.uint32(8) | data[2:]) * np.uint32(2654435761)
        doc = np.repeat(np.arange(docs), size)[:-2]
        inside = np.arange(len(gram)) + 3 <= np.repeat(offsets[1:], size)[:-2]
        out[:, :TRIGRAMS] = np.bincount((doc * TRIGRAMS + (gram >> np.uint32(21)))[inside], minlength=docs * TRIGRAMS).reshape(docs, TRIGRAMS)
    start, end, first = kit.words(data, offsets)
    if len(start):
        def inside_word(kind):
            sums = np.zeros(len(data) + 1, np.int32)
            np.cumsum(kind[data], out=sums[1:])
            return sums[end] - sums[start]

        upper, lower = inside_word(_UPPER), inside_word(_LOWER)
        case = np.where(upper == 0, 0, np.where((lower == 0) & (upper > 1), 2, 1))
        shape = case * 2 + (inside_word(_DIGIT) > 0)
        shape = (shape * 2 + (inside_word(_SIGN) > 0)) * 8 + _LAST[data[end - 1]]
        shape = shape * 8 + np.minimum((end - start) // 3, 7)
        out[:, TRIGRAMS:] = np.bincount(kit.doc_of(first) * np.int64(SHAPES) + shape, minlength=docs * SHAPES).reshape(docs, SHAPES)
    counts = rules.count_text(data, offsets)
    lines = counts["n_dup_lines"] / np.maximum(counts["n_lines"], 1)
    words = counts["n_repeat_words"] / np.maximum(counts["n_words"], 1)
    some = (counts["n_words"] > 0)[:, None]
    return out, np.sqrt(np.stack([lines, 1 - lines, words, 1 - words], 1)).astype(np.float32) * some


def weighted(counts: np.ndarray, repeats: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Damped and weighted terms; trigrams, shapes and repeats count alike."""
    x = np.log1p(counts) * rarity
    blocks = [x[:, :TRIGRAMS], x[:, TRIGRAMS:], repeats]
    return np.concatenate([b / np.maximum(np.sqrt((b * b).sum(1, keepdims=True)), 1e-9) for b in blocks], 1)


def latent(centred: np.ndarray, rank: int) -> np.ndarray:
    """The leading directions of rows around their mean, by subspace iteration."""
    basis = np.linalg.qr(np.random.default_rng(3).standard_normal((centred.shape[1], min(rank, *centred.shape))).astype(np.float32))[0]
    for _ in range(8):
        basis = np.linalg.qr(centred.T @ (centred @ basis))[0]
    return basis


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def vote(vectors: np.ndarray, labelled: np.ndarray, labels: np.ndarray, neighbours: int) -> np.ndarray:
    """Label shares among the nearest labelled vectors, weighted by similarity."""
    k = min(neighbours, len(labels))
    out = np.empty(len(vectors))
    for at in range(0, len(vectors), 256):
        near = vectors[at: at + 256] @ labelled.T
        least = np.partition(near, len(labels) - k, axis=1)[:, len(labels) - k, None]
        weight = np.where(near >= least, np.maximum(near, 0), 0) ** POWER
        total = weight.sum(1)
        out[at: at + 256] = np.where(total > 0, weight @ labels / np.maximum(total, 1e-12), labels.mean())
    return np.clip(out, 0.0, 1.0)


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def _pieces(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        data, offsets = kit.texts(batch["text"])
        for a, b in kit.slices(offsets, 1 << 20):
            yield batch.slice(a, b - a), *terms(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each hashed term occurs, and how many documents there are. The result has a fixed size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS + 1, np.int64)
        for rows, counts, _ in _pieces(batches):
            total[:-1] += (counts > 0).sum(0)
            total[-1] += rows.num_rows
        yield pa.record_batch([pa.array(np.arange(TERMS + 1)), pa.array(total)], ["term", "n"])

    sums = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(TERMS + 1, np.int64)
    out[[r["term"] for r in sums]] = [r["n"] for r in sums]
    return out[:-1], int(out[-1])


class Model:
    """Rarity of terms, latent directions, labelled vectors and labels. None of it grows with the corpus."""

    def __init__(self, rarity, mean, basis, labelled, labels):
        self.rarity, self.mean, self.basis, self.labelled, self.labels = rarity, mean, basis, labelled, labels

    def score(self, counts: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        vectors = unit((weighted(counts, repeats, self.rarity) - self.mean) @ self.basis)
        vectors[~counts.any(1)] = 0
        return vote(vectors, self.labelled, self.labels, NEIGHBOURS)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 3, held_out: int = 1) -> Model:
    """Learn from at most ``sample`` labelled documents outside the held-out fold."""
    frequency, n = document_frequencies(docs)
    rarity = (np.log((n + 1) / (frequency + 1)) + 1).astype(np.float32)
    usable = labels.where(F.col("quality").isNotNull() & (fold(F.col("doc_id"), folds) != held_out)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, counts, repeats in _pieces(batches):
            blobs = [x.tobytes() for x in weighted(counts, repeats, rarity).astype(np.float16)]
            yield pa.record_batch([rows["doc_id"], rows["quality"], pa.array(blobs, pa.binary())], ["doc_id", "quality", "terms"])

    # The sample is bounded, and so is what it sends: one row of terms each. Rows that repeat an id count once.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(run, "doc_id long, quality int, terms binary")
    rows = rows.groupBy("doc_id").agg(F.max(F.struct("quality", "terms")).alias("r")).select("doc_id", "r.*").toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return Model(rarity, None, None, None, np.zeros(0))
    x = np.frombuffer(b"".join(rows["terms"].to_pylist()), np.float16).reshape(rows.num_rows, TERMS + REPEATS).astype(np.float32)
    mean = x.mean(0)
    x -= mean
    basis = latent(x, RANK)
    return Model(rarity, mean, basis, unit(x @ basis), rows["quality"].to_numpy().astype(np.float32))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score``: 0 to 1, higher if label 1 is likelier."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, counts, repeats in _pieces(batches):
            yield pa.record_batch([rows["doc_id"], pa.array(shared.value.score(counts, repeats).astype(np.float64))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def with_score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of the documents and ``score``; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, counts, repeats in _pieces(batches):
            yield pa.record_batch([*rows.columns, pa.array(shared.value.score(counts, repeats).astype(np.float64))], [*names, "score"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("score", DoubleType())]))
