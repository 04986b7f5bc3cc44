"""Mergeable summaries of frequent values: bounds hold, decided groups are exact, others are counted."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vigil.operators import heavy
from vigil.session import scratch_path


def rows():
    rnd = random.Random(5)
    out = []
    for i in range(3000):
        # A third of the rows in one group; a steep group, a flat one with many ties, nulls.
        g = "hot" if i % 3 == 0 else rnd.choice(["flat", "few", None])
        v = {"hot": int(rnd.expovariate(0.08)), "flat": rnd.randrange(300), "few": rnd.randrange(4), None: int(rnd.expovariate(0.5))}[g]
        out.append((rnd.randrange(6), g, None if v == 3 else f"v{v:03d}", rnd.randrange(1, 4)))
    return out


@pytest.fixture(scope="module")
def counts(spark):
    return spark.createDataFrame(rows(), "day int, g string, v string, count int").cache()


@pytest.fixture(scope="module")
def true():
    out = defaultdict(Counter)
    for _, g, v, n in rows():
        out[g][v] += n
    return out


def best(counter, n):
    return sorted(counter.items(), key=lambda c: (-c[1], c[0] is not None, c[0] or ""))[:n]


def stored(df, label):
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@pytest.mark.parametrize("size", [2, 12, 400])
def test_bounds_hold_and_decided_groups_are_exact(counts, true, size):
    daily = stored(heavy.summarize(counts, ["g", "day"], "v", size=size), "daily")
    merged = stored(heavy.merge(daily, ["g"], size=size), "merged")
    for summaries in (daily, merged):
        seen = defaultdict(dict)
        for r in heavy.bounds(summaries, ["g"]).collect():
            assert r["low"] <= true[r["g"]][r["value"]] <= r["high"]
            seen[r["g"]][r["value"]] = r["unseen"]
        for g, values in true.items():
            assert max([n for v, n in values.items() if v not in seen[g]], default=0) <= max(seen[g].values())
        found = defaultdict(list)
        for r in heavy.top(summaries, ["g"], 3).orderBy("nth").collect():
            found[r["g"], r["decided"]].append((r["value"], r["low"]))
        for (g, decided), got in found.items():
            if decided:
                assert got == best(true[g], 3)
        if size == 400:
            assert all(decided for _, decided in found) and len(found) == 4
        if size == 12:
            assert ("few", True) in found and ("flat", False) in found
        assert max(len(r["kept"]) for r in summaries.collect()) <= size


def test_every_group_gets_its_exact_top(counts, true):
    merged = stored(heavy.merge(stored(heavy.summarize(counts, ["g", "day"], "v", size=12), "daily"), ["g"], size=12), "merged")
    got = defaultdict(list)
    for r in heavy.exact_top(merged, counts, ["g"], "v", 5).orderBy("nth").collect():
        got[r["g"]].append((r["value"], r["count"]))
    assert got == {g: best(c, 5) for g, c in true.items()}


def test_empty_table(spark, counts):
    none = heavy.summarize(counts.where(F.lit(False)), ["g"], "v")
    assert none.count() == 0 and heavy.exact_top(heavy.merge(none, ["g"]), counts.limit(0), ["g"], "v", 3).count() == 0
