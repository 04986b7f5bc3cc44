"""Whitening against numpy's eigendecomposition and exact sums."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from vigil.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, most=4):
    ok = [(i, v) for i, v in rows if v is not None and all(e is not None and np.isfinite(e) for e in v)]
    width = max((len(v) for _, v in ok), default=0)
    x = [[int(np.floor(256 * float(np.float32(e)))) for e in v] + [0] * (width - len(v)) for _, v in ok]
    distinct = sorted({tuple(r) for r in x})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    centred = np.array([[a - s / n for a, s in zip(r, sums)] for r in distinct])
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:most], q[:, ::-1][:, :most]
    out = []
    for (i, _), r in zip(ok, x):
        dev = sum((n * a - s) ** 2 for a, s in zip(r, sums))
        out.append((i, dev, (np.array(r) - np.array(sums) / n) @ q / np.sqrt(e)))
    return n, out, e / np.trace(v)


def test_query_equals_brute_force(spark, sf_dir):
    from vigil.llm.queries import QUERIES

    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    n, want, explained = brute(rows)
    got = {(r["vec_id"], r["component"]): r for r in QUERIES["op13_embedding_whitening"](spark, sf_dir).collect()}
    assert len(got) == 4 * len(want)
    signs = np.sign([got[want[0][0], c + 1]["whitened"] * want[0][2][c] for c in range(4)])
    for vec, dev, white in want:
        for c in range(4):
            r = got[vec, c + 1]
            assert (r["n"], r["deviation"]) == (n, dev)
            assert abs(r["whitened"] * signs[c] - white[c]) < 1e-7 and abs(r["explained"] / explained[c] - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_odd_rows(spark):
    draw = np.random.default_rng(3)
    rows = [(i, draw.standard_normal(5).tolist(), 1) for i in range(40)]
    rows += [rows[0]] * 30 + [(None, [1.0, 2.0, 3.0, 4.0, 5.0], None), (90, None, 1), (91, [1.0, None, 0.0, 0.0, 0.0], 1), (92, [float("nan")] * 5, 1), (93, [float("-inf")] * 5, 1),
                             (94, [], 1), (95, [0.5], 1), (96, [0.25] * 5, 1), (96, [0.25] * 5, 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'own' AS deviation", "'mine' AS `_x`", "1 AS x").repartition(5)
    model = whitening.fit(df)
    got = whitening.whiten(df, model).collect()
    n, want, _ = brute([r[:2] for r in rows])
    assert model.n == n and model.identity_error < 1e-9
    assert sorted(((r["vec_id"], r["deviation"]) for r in got), key=repr) == sorted(((i, d) for i, d, _ in want), key=repr)
    assert {r["_x"] for r in got} == {"mine"} and all(len(r["whitened"]) == 4 for r in got)


@pytest.mark.parametrize("vectors, nulls", [([[1.0, 2.0]], 2), ([[1.0, 2.0], [1.0, 2.0]], 2), ([[1.0, 0.0], [2.0, 0.0]], 1), ([[]], 0), ([], 0)])
def test_tables_without_variance(spark, vectors, nulls):
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], SCHEMA)
    got = whitening.whiten(df, whitening.fit(df)).collect()
    assert len(got) == len(vectors) and all(sum(w is None for w in r["whitened"]) == nulls for r in got)


def test_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(0, [2.0**50, 1.0], 0), (1, [-(2.0**40), 3.0], 0), (2, [1e30, 0.0], 0)], SCHEMA)
    model = whitening.fit(df)
    assert [r["deviation"] for r in whitening.whiten(df, model).collect()] == [None] * 3
    small = whitening.Whitening("embedding", 3, (5, 7), np.eye(2), np.ones(2), (0.5, 0.5))
    assert small.deviation(np.array([[2**61, 0], [1, 1]])) == [None, (3 - 5) ** 2 + (3 - 7) ** 2]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.lists(st.sampled_from([0.0, 1.0, 1.0 + 1e-9, 2.0, 1e6]), min_size=9, max_size=9), st.integers(0, 99))
def test_components_are_orthonormal_and_diagonalise(width, values, seed):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))[0]
    v = q * values[:width] @ q.T
    v = (v + v.T) / 2
    e, u = whitening.components(v)
    scale = max(np.abs(values[:width]).max(), 1e-300)
    assert np.abs(u.T @ u - np.eye(width)).max() < 1e-13 and np.abs(v @ u - u * e).max() < 1e-12 * scale
    assert np.abs(e - np.sort(values[:width])[::-1]).max() < 1e-12 * scale


def test_polar_factor():
    draw = np.random.default_rng(5)
    a = draw.standard_normal((20, 20))
    a = a + a.T
    values, vectors = np.linalg.eigh(a)
    assert np.abs(whitening.polar(a) - vectors * np.sign(values) @ vectors.T).max() < 1e-12
