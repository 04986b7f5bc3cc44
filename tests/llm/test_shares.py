"""Source shares of the schedule and of what is packed by it."""

import math
import random
from collections import Counter
from itertools import islice

import pytest

import corpus_pipeline
from vigil.llm import mixing, packing


def test_packed_sequences_follow_the_target_weights(spark, make, sf_dir):
    rng = random.Random(2)
    pool = "one two three four five six seven eight nine ten tree house river stone cloud".split()
    sizes = {"hot": 64 * 64, "cold": 16 * 64, "rare": 4 * 64}
    names = [s for s, n in sizes.items() for _ in range(n)]
    docs = make([(i, " ".join(rng.choice(pool) for _ in range(6)), s) for i, s in enumerate(names)])
    mixed = docs
    for name, stage in corpus_pipeline.STAGES:
        if name in ("mixing", "packing"):
            mixed = stage(spark, mixed, sf_dir)
    order = [names[r["doc_id"]] for r in mixed.where("start = 0").orderBy("sequence_id", "offset").collect()]
    assert Counter(order) == sizes
    # The default target follows the square roots 4 : 2 : 1; the rare source runs out at slot 28.
    turn = packing.TURN_SLOTS * mixing.BLOCK_DOCS
    for source, weight in {"hot": 4 / 7, "cold": 2 / 7, "rare": 1 / 7}.items():
        assert abs(order[:turn].count(source) - turn * weight) < mixing.BLOCK_DOCS


@pytest.mark.parametrize("weights", [
    {"a": 1 / 3, **{str(i): 2 / 57 for i in range(19)}}, {"a": 1 / 3, **{str(i): 2 / 2997 for i in range(999)}},
    {"a": 0.9999, "b": 0.0001}, {"a": 0.3, "b": 0.7, "c": 0.0}, {str(i): math.sqrt(i + 2) for i in range(50)}])
def test_no_source_strays_by_a_block_from_the_weights_given(weights):
    share = mixing.shares(weights, mixing.SLOTS)
    total = sum(weights.values())
    rows = sorted(((s, n, 10**6) for s, n in share.items() if n), key=lambda r: (-r[1], r[0]))
    done, checked = Counter(), max(weights, key=lambda s: (weights[s], s))
    for t, (s, _, slot, release, deadline) in enumerate(islice(mixing.schedule(rows, sum(share.values()), 0), 30_000)):
        assert slot == t and release <= slot < deadline
        done[s] += 1
        assert abs(done[checked] - (t + 1) * weights[checked] / total) < 1
        if t % 997 == 0:
            assert all(abs(done[x] - (t + 1) * w / total) < 1 for x, w in weights.items())


def test_sources_without_weight_come_last(make):
    rows = [(i, "t", "abc"[i % 3]) for i in range(300)]
    got = mixing.mix_sources(make(rows), {"a": 0.75, "b": 0.25, "c": 0.0}, block_docs=4).toPandas()
    assert sorted(got.doc_id) == list(range(300)) and got.groupby("mix_slot").source.nunique().max() == 1
    last = {s: (g.mix_slot.min(), g.mix_slot.max()) for s, g in got.groupby("source")}
    assert last["c"][0] > max(last["a"][1], last["b"][1])
    assert ((got.mix_release <= got.mix_slot) & (got.mix_slot < got.mix_deadline)).all()


def test_as_many_sources_as_documents(make):
    rows = [(i, "t", f"site {i}" if i % 2 else "hot") for i in range(4000)]
    for weights in (None, {"hot": 0.5, "site 1": 0.5, "nowhere": 3.0}):
        got = mixing.mix_sources(make(rows), weights, block_docs=4).toPandas()
        assert sorted(got.doc_id) == list(range(4000)) and got.groupby("mix_slot").source.nunique().max() == 1
        assert ((got.mix_release <= got.mix_slot) & (got.mix_slot < got.mix_deadline)).all()


def test_the_schedule_holds_only_sources_in_progress():
    rows = ((str(i), 1, 1) for i in range(10**6))
    got = mixing.schedule(rows, 10**6, 0)
    assert [next(got)[2] for _ in range(5)] == [0, 1, 2, 3, 4]
    assert next(rows)[0] == "6"


def test_no_source_names_reach_the_driver(make, monkeypatch):
    docs = make([(i, "t", f"site {i}") for i in range(50)])
    collected = []
    real = type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: collected.append(real(self)) or collected[-1])
    assert len(mixing.mix_sources(docs).toPandas()) == 50
    assert not any("_source" in r.asDict() for rows in collected for r in rows)
