import random

import pytest
from conftest_llm import ODD, lowered, words

from vigil.llm import graph, jaccard_join
from vigil.llm.queries import QUERIES


def shingles(text):
    w = words(lowered(text))
    return {tuple(w[k: k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if any(s and t and 100 * len(s & t) >= 75 * len(s | t) for s in sets[i] for t in sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sorted((i, len(shingles(t)), find(i)) for i, t in rows)


def found(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def near_copies(seed, count, size, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 400)}" for _ in range(size)]
    out = []
    for _ in range(count):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(size)] = f"x{rng.randint(0, 99)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize(("size", "edits"), [(12, 2), (40, 3), (70, 5), (300, 12)])
def test_near_copies_around_the_threshold(make, size, edits):
    texts = near_copies(size, 40, size, edits) + near_copies(size + 1, 6, size + 5, 2) + near_copies(3, 4, 3, 1) + near_copies(4, 3, 1, 0)
    random.Random(1).shuffle(texts)
    rows = list(enumerate(texts))
    assert found(jaccard_join.near_duplicates(make(rows))) == brute(rows)


@pytest.mark.parametrize("most", [jaccard_join.MOST_PAIRS, (0.0, 0.0, float("inf"))])
def test_blocks_of_a_frequent_cell(make, monkeypatch, most):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "MOST_PAIRS", most)
    rows = list(enumerate(near_copies(9, 70, 40, 4)))
    assert found(jaccard_join.near_duplicates(make(rows))) == brute(rows)


def test_odd_rows(odd, clashing):
    rows = [(r[0], r[1]) for r in ODD if r[0] is not None]
    for docs in (odd, clashing):
        got = jaccard_join.near_duplicates(docs)
        assert found(got.where("doc_id IS NOT NULL")) == brute(rows)
        # A text without id joins the class of an equal set, or is alone.
        assert sorted((r["n_shingles"], r["component_id"] or -1) for r in got.where("doc_id IS NULL").collect()) == [(0, -1), (10, 1)]


def test_whole_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert found(QUERIES["op7_jaccard_join"](spark, sf_dir)) == brute(docs)


def test_an_empty_table(make):
    assert jaccard_join.near_duplicates(make([])).count() == 0


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 159), (300, 300)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)} | {200: 100}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
