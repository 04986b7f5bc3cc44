"""Substring and suffix-order dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
from conftest_llm import ODD, words

from vigil.llm import bwt, substring_dedup, suffix_dedup
from vigil.llm.queries import QUERIES


def covered(items, windows, size):
    out = [False] * len(items)
    for k in windows:
        out[k: k + size] = [True] * size
    return out


def brute(rows, size, cut):
    """(id, items, removed flags): a window goes if a smaller id has it."""
    pieces = [(10**18 if i is None else i, i, cut(t)) for i, t in rows]
    least = {}
    for order, _, x in pieces:
        for k in range(len(x) - size + 1):
            key = tuple(x[k: k + size])
            least[key] = min(least.get(key, order), order)
    return [(i, x, covered(x, [k for k in range(len(x) - size + 1) if least[tuple(x[k: k + size])] < order], size)) for order, i, x in pieces]


def random_rows(seed, unit):
    rng = random.Random(seed)
    pool = [[rng.choice(unit) for _ in range(rng.randint(3, 40))] for _ in range(8)]
    out = []
    for i in range(40):
        parts = [rng.choice(pool) if rng.random() < 0.5 else [rng.choice(unit) for _ in range(rng.randint(0, 15))] for _ in range(rng.randint(0, 4))]
        out.append((rng.choice([i, i, i, i - 1 if i else 0]), [x for p in parts for x in p]))
    return out


def expected_words(rows, size):
    return sorted(((i, len(x), sum(g), " ".join(w for w, gone in zip(x, g) if not gone)) for i, x, g in brute(rows, size, words)), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_passages_against_brute_force(make, seed):
    rows = [(i, " ".join(x)) for i, x in random_rows(seed, ["ab", "c", "de", "f", "ghi"])]
    got = substring_dedup.dedup_passages(make(rows), window=6).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted((tuple(r) for r in got), key=str) == expected_words(rows, 6)


def test_passages_of_odd_rows(odd, clashing):
    rows = [(r[0], r[1]) for r in ODD]
    for docs in (odd, clashing):
        got = substring_dedup.dedup_passages(docs, window=6).select("doc_id", "n_words", "n_removed", "kept_text").collect()
        assert sorted((tuple(r) for r in got), key=str) == expected_words(rows, 6)


def test_removed_spans_are_the_removed_words(make):
    r = substring_dedup.dedup_passages(make([(1, "a b c d e f"), (2, "x a b c d y c d e")]), window=4).where("doc_id = 2").first()
    assert [tuple(s) for s in r["removed"]] == [(1, 4)] and r["kept_text"] == "x y c d e"


def as_bytes(rows, size):
    out = []
    for i, x, g in brute(rows, size, lambda t: list((t or "").encode())):
        spans = sum(1 for k in range(len(g)) if g[k] and (k == 0 or not g[k - 1]))
        out.append((i, len(x), sum(g), spans, hashlib.sha256(bytes(b for b, gone in zip(x, g) if not gone)).hexdigest()))
    return sorted(out, key=str)


def digest(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_bytes_against_brute_force(make, seed):
    rows = [(i, "".join(x)) for i, x in random_rows(seed, ["a", "b", "é", " "])]
    assert digest(suffix_dedup.dedup_bytes(make(rows), window=9, anchor=4)) == as_bytes(rows, 9)


def test_bytes_of_odd_rows(odd, clashing):
    rows = [(r[0], r[1]) for r in ODD]
    for docs in (odd, clashing):
        assert digest(suffix_dedup.dedup_bytes(docs, window=50)) == as_bytes(rows, 50)


def test_whole_tables(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = QUERIES["op3_substring_dedup"](spark, sf_dir).collect()
    want = {i: (n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in expected_words(docs, 50)}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == want
    got = QUERIES["op6_suffix_dedup"](spark, sf_dir).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == as_bytes(docs, 50)


def test_an_empty_table(make):
    assert substring_dedup.dedup_passages(make([])).count() == 0
    assert suffix_dedup.dedup_bytes(make([])).count() == 0


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(1)
    for trial in range(60):
        texts = [bytes(rng.integers(97, 99 + trial % 3, rng.integers(0, 12)).astype(np.uint8)) for _ in range(rng.integers(1, 8))]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        found = bwt.build(np.frombuffer(b"".join(texts), np.uint8), offsets)
        m = len(texts)

        def suffix(row):
            out = []
            while row >= m:
                out.append(found.symbol[row - m])
                row = found.rest[row - m]
            return bytes(out)

        rows = [suffix(r) for r in range(m + len(found.symbol))]
        assert rows == sorted(t[i:] for t in texts for i in range(len(t) + 1))
        assert [rows[r] for r in found.whole] == texts
        for i in range(1, len(rows)):
            same = [x == y for x, y in zip(rows[i - 1], rows[i])]
            assert found.common[i] == (same + [False]).index(False)
        symbols = found.transform()
        for row, whole in enumerate(rows):
            assert symbols[row] == -1 or bytes([symbols[row]]) + whole in rows
        windows = [t[k: k + 3] for t in texts for k in range(len(t) - 2)]
        classes = bwt.window_classes(found, offsets, 3)
        assert len({*zip(windows, classes.tolist())}) == len({*windows}) == len({*classes.tolist()})


def test_suffix_order_does_not_depend_on_the_block(monkeypatch):
    """Rows are renumbered block by block; a block of 7 gives what one block gives."""
    rng = np.random.default_rng(2)
    length = rng.integers(0, 40, 200)
    data, offsets = rng.integers(97, 100, length.sum()).astype(np.uint8), np.concatenate([[0], np.cumsum(length)])
    whole = bwt.build(data, offsets)
    monkeypatch.setattr(bwt, "BLOCK", 7)
    blocks = bwt.build(data, offsets)
    assert all((getattr(whole, c) == getattr(blocks, c)).all() for c in ("symbol", "rest", "common", "whole"))
