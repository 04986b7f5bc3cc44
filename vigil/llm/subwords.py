"""Subword ids of whole texts, by a public tokenizer's vocabulary file.

A tokenizer that drops white space gives a text the ids of its blank-separated words one after
the other. Words repeat far more often than they differ, so each distinct word of a batch is
looked up by hash in a worker's bounded table, and only new ones are encoded. Plain words (of
ASCII and the Latin-1 letters, without apostrophes) are encoded many at a time by the merge
list of the vocabulary file; any other word by the tokenizers library. Tests hold both to the
library's ids.
"""

from __future__ import annotations

import json

import numpy as np
from tokenizers import Tokenizer

from . import kit

#: Distinct words a worker keeps, in some 30 MB; beyond that it begins anew.
TABLE_WORDS = 500_000
#: Words that wait before they are sorted into the table.
RECENT_WORDS = 100_000
#: Bytes of the longest run that is encoded in bulk.
LONGEST = 32
_ENCODERS: dict[str, Encoder] = {}
_NONE = np.int32(1 << 30)

_CASES = np.zeros(256, np.uint8)  # of bytes: 0 other, 1 letter, 2 digit
_CASES[[*range(65, 91), *range(97, 123), 0xC3]] = 1
_CASES[0x80:0xC0] = 1
_CASES[48:58] = 2


def _byte_names() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in names:
            names[b], extra = chr(extra), extra + 1
    return [names[b] for b in range(256)]


class Merges:
    """The merge list of a byte-level vocabulary with marked word ends, applied to many runs at a time."""

    SLOT_BITS = 19

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        names = _byte_names()
        self.inner = np.array([vocab[n] for n in names], np.int32)
        self.last = np.array([vocab[n + suffix] for n in names], np.int32)
        self.size = np.int64(max(vocab.values()) + 1)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * int(self.size) + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        # Two tables by different hashes; a pair that finds its place taken in the first goes to the second.
        self.tables = []
        rank = np.arange(len(keys), dtype=np.int32)
        for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            place = self._place(keys, odd)
            _, chosen = np.unique(place, return_index=True)
            slot_key, slot_rank = np.full(1 << self.SLOT_BITS, -1, np.int64), np.full(1 << self.SLOT_BITS, _NONE, np.int32)
            slot_key[place[chosen]], slot_rank[place[chosen]] = keys[chosen], rank[chosen]
            self.tables.append((odd, slot_key, slot_rank))
            rest = np.ones(len(keys), bool)
            rest[chosen] = False
            keys, rank = keys[rest], rank[rest]
        self.overflow = dict(zip(keys.tolist(), rank.tolist(), strict=True))
        self.made = made

    def _place(self, keys: np.ndarray, odd: int) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(odd) >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) * self.size + b
        out = np.full(keys.shape, _NONE, np.int32)
        for odd, slot_key, slot_rank in self.tables:
            place = self._place(keys, odd)
            out = np.where(slot_key[place] == keys, slot_rank[place], out)
        for key, rank in self.overflow.items():
            out[keys == key] = rank
        return np.where((a < 0) | (b < 0), _NONE, out)

    def encode(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs of bytes and how many each has; a run ends a word."""
        count = np.zeros(len(start), np.int64)
        found = []
        for low, high in ((0, 4), (4, 8), (8, 12), (12, 20), (20, LONGEST)):
            some = np.flatnonzero((length > low) & (length <= high))
            for at in range(0, len(some), 20_000):
                found.append(self._bulk(data, start, length, some[at: at + 20_000], high, count))
        out = np.zeros(count.sum(), np.uint32)
        first = np.cumsum(count) - count
        for rows, ids in found:
            inside = ids >= 0
            out[(first[rows][:, None] + np.arange(ids.shape[1]))[inside]] = ids[inside]
        return out, count

    def _bulk(self, data, start, length, some, width, count):
        columns = np.arange(width)
        raw = data[np.minimum(start[some][:, None] + columns, len(data) - 1)]
        n = length[some][:, None]
        ids = np.where(columns < n - 1, self.inner[raw], np.where(columns == n - 1, self.last[raw], -1)).astype(np.int32)
        out, todo = ids, np.arange(len(some))
        rank = self.ranks(ids[:, :-1], ids[:, 1:])
        columns = columns[:-1]
        while len(todo):
            # The pair that was merged first when the vocabulary was made, leftmost among equals.
            place = rank.argmin(1)
            row = np.arange(len(place))
            least = rank[row, place]
            going = least < _NONE
            if not going.all():
                out[todo[~going]] = ids[~going]
                todo, ids, rank, place, least = todo[going], ids[going], rank[going], place[going], least[going]
                row = np.arange(len(place))
                if not len(todo):
                    break
            behind = columns >= place[:, None] + 1
            ids[:, :-1] = np.where(behind, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ids[row, place] = self.made[least]
            rank[:, :-1] = np.where(behind[:, :-1], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = _NONE
            after = np.minimum(place + 1, ids.shape[1] - 1)
            right = self.ranks(ids[row, place], ids[row, after])
            right[place + 1 >= ids.shape[1]] = _NONE
            inner = place < rank.shape[1]
            rank[row[inner], place[inner]] = right[inner]
            left = place > 0
            rank[row[left], place[left] - 1] = self.ranks(ids[row[left], place[left] - 1], ids[row[left], place[left]])
        count[some] = (out >= 0).sum(1)
        return some, out


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        if self._plain("a b") != self._plain("a") + self._plain("b"):
            raise ValueError("the tokenizer must drop white space")
        self.size = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        known = (model["type"], model.get("end_of_word_suffix"), model.get("dropout")) == ("BPE", "</w>", None)
        lower = "Lowercase" in json.dumps(told["normalizer"])
        self.merges = Merges(model) if known and lower else None
        self._clear()

    def _plain(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _clear(self) -> None:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.sorted, self.recent = none, none
        self.ids = np.zeros(1 << 20, np.uint32)
        self.used = 0
        self.at, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.rows = 0

    def _store(self, keys: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.rows + len(keys) > len(self.at):
            self.at, self.count = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.count, np.zeros_like(self.count)])
        new = slice(self.rows, self.rows + len(keys))
        self.ids[self.used: self.used + len(ids)] = ids
        self.at[new], self.count[new] = self.used + np.cumsum(count) - count, count
        self.recent = _merged(self.recent, (keys, np.arange(new.start, new.stop)))
        self.used, self.rows = self.used + len(ids), new.stop
        if len(self.recent[0]) > RECENT_WORDS:
            self.sorted, self.recent = _merged(self.sorted, self.recent), (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def _encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, and how many each has."""
        length = (end - start).astype(np.int64)
        first = np.cumsum(length) - length
        raw = data[np.repeat(start - first, length) + np.arange(length.sum())]
        word = np.repeat(np.arange(len(start)), length)
        odd = np.ones(len(start), bool) if self.merges is None else _any(_odd_bytes(raw, first), word, len(start))
        raw = _lowered(raw)
        # Runs of letters, of other signs, and single digits are pieces of their own.
        case = _CASES[raw]
        new = np.ones(len(raw), bool)
        new[1:] = (case[1:] != case[:-1]) | (case[1:] == 2)
        new[first] = True
        begin = np.flatnonzero(new)
        size = np.diff(begin, append=len(raw))
        odd |= _any(size > LONGEST, word[begin], len(start))
        use = ~odd[word[begin]]
        ids, each = self.merges.encode(raw, begin[use], size[use]) if self.merges else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        count = np.bincount(word[begin][use], weights=each, minlength=len(start)).astype(np.int64)
        if not odd.any():
            return ids, count
        slow = np.flatnonzero(odd)
        texts = [data[start[i]: end[i]].tobytes().decode("utf-8", "replace") for i in slow]
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        count[slow] = [len(f) for f in found]
        out = np.zeros(count.sum(), np.uint32)
        theirs = np.repeat(odd, count)
        out[~theirs], out[theirs] = ids, np.concatenate(found)
        return out, count

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (one more at the end)."""
        ids, at, first = self.encode_words(data, offsets)
        return ids, at[first]

    def encode_words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts in a row, where each word's ids begin, and each text's first word (one more at the ends)."""
        start, end, first = kit.words(data, offsets)
        hashes = kit.word_hashes(data, start, end)
        order = np.argsort(hashes)
        ordered = hashes[order]
        runs = kit.runs(ordered)
        rows = self.rows_of(data, start, end, ordered[runs], order[runs])
        each = np.empty(len(order), np.int64)
        each[order] = np.repeat(rows, np.diff(runs, append=len(order)))
        return *self.ids_of(each), first

    def rows_of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray, one: np.ndarray) -> np.ndarray:
        """The rows in the table of distinct words, from their sorted hashes and where each stands among ``start``; good until the next call."""
        if self.rows > TABLE_WORDS:
            self._clear()
        rows = _find(self.sorted, keys)
        rows = np.where(rows < 0, _find(self.recent, keys), rows)
        lost = np.flatnonzero(rows < 0)
        start, end = start[one[lost]], end[one[lost]]
        for a, b in kit.slices(np.append(0, np.cumsum(end - start)), 1 << 20):
            before = self.rows
            self._store(keys[lost[a:b]], *self._encode(data, start[a:b], end[a:b]))
            rows[lost[a:b]] = np.arange(before, self.rows)
        return rows

    def ids_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in a row, from their rows in the table, and where each word's begin (one more at the end)."""
        count = self.count[rows]
        at = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(count, out=at[1:])
        place = np.repeat(self.at[rows] - at[:-1], count)
        place += np.arange(at[-1])
        return self.ids[place], at


def _any(flags: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    out = np.zeros(groups, bool)
    out[group[flags]] = True
    return out


def _odd_bytes(raw: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bytes that bulk encoding leaves to the library: apostrophes, ``<``, controls, and all but ASCII and the letters of Latin-1."""
    odd = (raw == 0x27) | (raw == 0x3C) | (raw < 0x21) | (raw == 0x7F)
    before = np.zeros(len(raw), np.uint8)
    before[1:] = raw[:-1]
    before[first] = 0
    tail = (raw >= 0x80) & (raw < 0xC0)
    odd |= tail & ((before != 0xC3) | (raw == 0x97) | (raw == 0xB7))
    return odd | ((raw >= 0xC0) & (raw != 0xC3))


def _lowered(raw: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and the letters of Latin-1."""
    out = kit.lower(raw)
    wide = np.zeros(len(raw), bool)
    wide[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    out[wide] += 0x20
    return out


def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The row of each key, -1 if it has none."""
    if not len(table[0]):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    return np.where(table[0][at] == keys, table[1][at], -1)


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, rows = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(keys, kind="stable")
    return keys[order], rows[order]


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
