"""Removal of word passages that an earlier document already has.

Method: fixed-block anchors. Every document is an index of non-overlapping blocks of half a
window, and is probed with every rolling window of that length. Whatever window of the full
length two documents share, it holds a whole block of either one, so a block that another
document's probe meets marks all places where a repeat can lie. Around those hits the exact
windows are compared by 128-bit hash over the whole corpus, which extends each hit to the
maximal repeat: the union of its windows.

A word is removed if a window of ``window`` consecutive words of its document covers it and
the same word sequence starts in a document with a smaller id; windows are judged on the input.

Defined cases: a null or empty text has no words; a null id orders after all others and never
counts as smaller than another null; rows with the same id never count as earlier than each
other, and each is judged by itself against smaller ids; texts of any length are used whole;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange as X, kit

WORDS = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:int,length:int>>"
_WORDS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()),
                    ("removed", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))])


class _Bucket:
    """The words of a bucket's documents and its half-window keys."""

    def __init__(self, table: pa.Table, window: int, parts: int):
        self.window, self.block, self.parts = window, window // 2, parts
        self.docs = kit.ids(table["doc_id"])
        self.data, self.offsets = kit.texts(table["text"])
        self.start, self.end, self.first = kit.words(self.data, self.offsets)
        self.doc = kit.doc_of(self.first)
        self.hash = [kit.word_hashes(self.data, self.start, self.end, 0)]
        n = len(self.start)
        self.runs = self.keys = None
        # Probes: all places where half a window fits, in documents that hold a whole one.
        length = np.diff(self.first)
        self.last = np.repeat(self.first[1:], length).astype(np.int32)
        self.at = np.flatnonzero(np.repeat(length >= window, length) & (np.arange(n) + self.block <= self.last)).astype(np.int32)
        shift = X.kept_bits(parts)
        keys = kit.span(kit.prefix(self.hash[0]), self.at, self.at + self.block) >> shift << shift
        self.order = np.argsort(keys).astype(np.int32)
        self.sorted = keys[self.order]
        self.runs = kit.runs(self.sorted)
        self.keys = self.sorted[self.runs]

    def question(self) -> list[tuple[int, bytes]]:
        """Distinct keys: is one of them a block, and do several documents here have it."""
        if not len(self.keys):
            return []
        where = self.at[self.order]
        doc = self.docs[self.doc[where]]
        block = (where - self.first[self.doc[where]]) % self.block == 0
        flags = np.bitwise_or.reduceat(block.astype(np.uint8), self.runs)
        flags |= 2 * (np.minimum.reduceat(doc, self.runs) != np.maximum.reduceat(doc, self.runs)).astype(np.uint8)
        return [(p, kit.pack(kit.gaps(self.keys[s]), flags[s])) for p, s in X.by_part(self.keys, self.parts)]

    def candidates(self, replies: dict[int, bytes]) -> np.ndarray:
        """Words at which a whole window begins that holds a hit."""
        live = X.read_bits(replies, self.keys, self.parts)
        each = np.repeat(live, np.diff(self.runs, append=len(self.sorted)))
        seen = np.zeros(len(self.start) + 1, np.int32)
        hit = np.zeros(len(self.start), np.int32)
        hit[self.at[self.order[each]]] = 1
        np.cumsum(hit, out=seen[1:])
        start = self.at[self.at + self.window <= self.last[self.at]]
        return start[seen[start + self.window - self.block + 1] > seen[start]]

    def windows(self, start: np.ndarray):
        """The windows at ``start`` as sorted 128-bit keys: order, first of each run, both halves, smallest id."""
        ends = start + self.window
        h1 = kit.span(kit.prefix(self.hash[0]), start, ends)
        second = kit.word_hashes(self.data, self.start, self.end, 1)
        h2 = kit.span(kit.prefix(second, 1), start, ends, 1)
        order = np.lexsort((h2, h1))
        h1, h2 = h1[order], h2[order]
        runs = kit.runs(h1, h2)
        doc = self.docs[self.doc[start[order]]]
        least = np.minimum.reduceat(doc, runs) if len(runs) else doc
        return order, runs, h1[runs], h2[runs], least


def _live(blobs: list[bytes]) -> list[bytes]:
    (keys, flags), first = X.joined(blobs)
    order = np.argsort(keys, kind="stable")
    runs = kit.runs(keys[order])
    flag = np.bitwise_or.reduceat(flags[order], runs)
    size = np.diff(runs, append=len(keys))
    live = np.empty(len(keys), bool)
    live[order] = np.repeat((flag & 1 > 0) & ((flag & 2 > 0) | (size > 1)), size)
    return X.bits(live, first)


def _earlier(blobs: list[bytes]) -> list[bytes]:
    """For each window of a bucket: does a document smaller than the bucket's smallest have it."""
    (h1, h2, doc), first = X.joined(blobs)
    order = np.lexsort((h2, h1))
    runs = kit.runs(h1[order], h2[order])
    least = np.minimum.reduceat(doc[order], runs)
    out = np.empty(len(h1), bool)
    out[order] = np.repeat(least, np.diff(runs, append=len(h1))) < doc[order]
    return X.bits(out, first)


def _spans(flags: np.ndarray, first: np.ndarray) -> pa.Array:
    """Runs of set flags of each document as (start, length)."""
    edge = np.zeros(len(flags) + 1, bool)
    edge[first] = True
    begin = flags.copy()
    begin[1:] &= ~flags[:-1] | edge[1:-1]
    stop = flags.copy()
    stop[:-1] &= ~flags[1:] | edge[1:-1]
    begin, stop = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    at = np.searchsorted(begin, first)
    base = np.repeat(first[:-1], np.diff(at))
    rows = pa.StructArray.from_arrays([pa.array((begin - base).astype(np.int32)), pa.array((stop - begin).astype(np.int32))], ["start", "length"])
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), rows)




def dedup_passages(docs: DataFrame, window: int = 50) -> DataFrame:
    """One row per document: words, removed words, the words kept, and the removed spans of words."""
    parts = X.partitions(docs.sparkSession)
    buckets = X.bucketed(docs, "doc_id", "text")

    def first_question(table):
        return _Bucket(table, window, parts).question()

    def second_question(table, replies):
        here = _Bucket(table, window, parts)
        _, _, h1, h2, least = here.windows(here.candidates(replies))
        return X.packed(table["bucket"][0].as_py(), [(p, kit.pack(kit.gaps(h1[s]), h2[s], least[s])) for p, s in X.by_part(h1, parts)])

    def remove(table, replies):
        here = _Bucket(table, window, parts)
        start = here.candidates({p // 2: b for p, b in replies.items() if p % 2 == 0})
        order, runs, h1, _, least = here.windows(start)
        before = X.read_bits({p // 2: b for p, b in replies.items() if p % 2}, h1, parts)
        size = np.diff(runs, append=len(order))
        gone = np.repeat(before, size) | (here.docs[here.doc[start[order]]] > np.repeat(least, size))
        removed = kit.cover(start[order[gone]], window, len(here.start))
        return _kept_words(here, removed)

    hits = X.answer(X.ask(buckets, first_question), _live)
    windows = X.answer(X.with_answers(buckets, hits, second_question, X.PACKED), _earlier)
    both = hits.selectExpr("bucket", "part * 2 AS part", "blob").unionAll(windows.selectExpr("bucket", "part * 2 + 1 AS part", "blob"))
    return X.with_answers(buckets, both, remove, WORDS)


def _kept_words(here: _Bucket, removed: np.ndarray) -> pa.Table:
    n = np.diff(here.first)
    gone = np.zeros(len(removed) + 1, np.int64)
    np.cumsum(removed, out=gone[1:])
    kept = np.flatnonzero(~removed)
    data, step = here.data.copy(), np.zeros(len(here.data) + 2, np.int8)
    # A kept word takes the byte behind it along as the blank, but for the last kept word of a document.
    last = np.zeros(len(kept), bool)
    if len(kept):
        doc = here.doc[kept]
        last[-1] = True
        last[:-1] = doc[1:] != doc[:-1]
    tail = here.end[kept] + ~last
    data[here.end[kept][~last]] = 0x20
    step[here.start[kept]] += 1
    step[tail] -= 1
    data = data[np.cumsum(step, out=step)[: len(data)] > 0]
    size = np.zeros(len(kept) + 1, np.int64)
    np.cumsum(tail - here.start[kept], out=size[1:])
    at = size[np.searchsorted(kept, here.first)]
    texts = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(at), pa.py_buffer(data)).cast(pa.string())
    return pa.table([kit.id_column(here.docs), pa.array(n, pa.int64()), pa.array(np.diff(gone[here.first]), pa.int64()),
                     texts, _spans(removed, here.first)], schema=_WORDS)
