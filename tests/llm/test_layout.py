"""Packing, mixing, fingerprints and the pipeline."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import ODD, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vigil.llm import fingerprints, jaccard_join, mixing, packing, quality
from vigil.llm.queries import QUERIES, packed

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def check_packing(pieces, rows, length):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = sorted(((str(i), tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (packing.END,)) for i, t in rows))
    got = pieces.collect()
    whole, order = {}, {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] > 0
        order.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["key"]))
        whole.setdefault((str(r["doc_id"]), r["sequence_id"] * length + r["offset"] - r["start"]), []).append((r["start"], ids, r["doc_tokens"]))
    texts = []
    for (i, _), parts in whole.items():
        parts.sort(key=lambda p: p[0])
        assert [p[0] for p in parts] == [0, *np.cumsum([len(p[1]) for p in parts])[:-1]]
        ids = tuple(np.concatenate([p[1] for p in parts]).tolist())
        assert all(p[2] == len(ids) for p in parts)
        texts.append((i, ids))
    assert sorted(texts) == want
    last = max(order, default=0)
    for s, parts in order.items():
        parts.sort()
        ends = np.cumsum([p[1] for p in parts])
        assert [p[0] for p in parts] == [0, *ends[:-1]] and (ends[-1] == length or s == last)
    keys = [p[2] for s in sorted(order) for p in order[s]]
    assert keys == sorted(keys)


def test_packing(spark, sf_dir, odd, clashing, make):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_packing(packing.pack(docs, TOKENIZER), [(r["doc_id"], r["text"]) for r in docs.collect()], 4096)
    for some in (odd, clashing):
        check_packing(packing.pack(some, TOKENIZER, length=64), [(r[0], r[1]) for r in ODD], 64)
    assert packed(make([])).count() == 0


def test_packed_digests_and_sequences(odd):
    pieces = packing.pack(odd, TOKENIZER, length=64)
    for r in packed(odd).collect():
        assert r["ids_crc32"] >= 0
    rows = {r["sequence_id"]: r["ids"] for r in packing.sequences(pieces).collect()}
    for s in rows:
        parts = sorted((r["offset"], r["ids"]) for r in pieces.where(F.col("sequence_id") == s).collect())
        assert b"".join(p[1] for p in parts) == rows[s]
    whole = pieces.where("doc_id = 6").first()
    assert zlib.crc32(whole["ids"]) == pieces.where("doc_id = 6").select(F.crc32("ids")).first()[0]


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_keys_visit_every_cell_by_single_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = packing.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(1 << bits * dims))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("weights", [{"a": 0.7, "b": 0.2, "c": 0.1}, {"a": 1.0, "b": 1.0, "c": 1.0, "d": 0.01}, {"a": 5.0}, {str(i): i for i in range(30)}])
def test_no_source_strays_by_a_block(weights):
    share = mixing.shares(weights, 200)
    total = sum(share.values())
    done = dict.fromkeys(share, 0)
    for t, (s, k, slot, release, deadline) in enumerate(mixing.cycle(share)):
        assert slot == t and k == done[s] and release <= slot < deadline
        done[s] += 1
        assert all(abs(done[x] - (t + 1) * share[x] / total) < 1 for x in share)
    assert done == share


def test_mixing_a_hot_source(make):
    rows = [(i, "t", "hot" if i % 3 else ("cold" if i % 6 else None)) for i in range(600)]
    weights = {"hot": 0.5, "cold": 0.3, None: 0.2}
    got = mixing.mix_sources(make(rows), weights, block_docs=4, slots=50).toPandas()
    assert sorted(got.doc_id) == list(range(600)) and "text" in got
    share = mixing.shares({"=hot": 0.5, "=cold": 0.3, "null": 0.2}, 50)
    blocks = got.groupby(got.source.fillna("null")).apply(lambda g: (g.mix_block.max() + 1, sorted(zip(g.mix_block, g.mix_place))), include_groups=False)
    for name, (count, places) in blocks.items():
        assert places == sorted((b, p) for b in range(count) for p in range(4))[: len(places)], name
    slots = got.groupby("mix_slot").source.agg(lambda s: {x if isinstance(x, str) else None for x in s})
    assert all(len(s) == 1 for s in slots)
    first_out = min(got[got.source.fillna("null") == s].mix_slot.max() for s in ("hot", "cold", "null"))
    names = {"=hot": "hot", "=cold": "cold", "null": None}
    for t in range(int(first_out) + 1):
        for key, name in names.items():
            done = sum(name in s for slot, s in slots.items() if slot <= t)
            assert abs(done - (t + 1) * share[key] / sum(share.values())) < 1
    assert ((got.mix_release <= got.mix_slot) & (got.mix_slot < got.mix_deadline)).all()


def test_mixing_odd_rows(odd, clashing, make):
    for docs in (odd, clashing):
        got = mixing.mix_sources(docs)
        assert got.count() == len(ODD) and {*docs.columns} <= {*got.columns}
        assert got.columns.count("mix_slot") == 1
    assert mixing.mix_sources(make([])).count() == 0


def test_mixing_the_whole_table(spark, sf_dir):
    got = QUERIES["op9_mix_sources"](spark, sf_dir).toPandas()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert got.groupby("mix_slot").source.nunique().max() == 1


def edited(text, after):
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def check_fingerprints(df, rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    want = []
    for k, (i, t) in enumerate(order):
        text, after = t or "", order[(k + 1) % len(order)][1] or ""
        want.append((i, len(text), hashlib.sha256(edited(text, after).encode()).hexdigest()))
    got = df.collect()
    assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == sorted(want, key=str)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t or "")
    prints = {}
    for r in got:
        prints.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values()) and len({next(iter(p))[:64] for p in prints.values()}) == len(prints)


def test_fingerprints(spark, sf_dir, clashing, make):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = QUERIES["op8_fingerprints"](spark, sf_dir)
    check_fingerprints(found, rows)
    means = found.agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert means[0] > 0.4 and means[1] < 0.1
    # Ids that repeat have no order of their own beyond their texts; keep one of each.
    odd = [r for k, r in enumerate(ODD) if r[0] is not None and r[0] not in {x[0] for x in ODD[:k]}]
    check_fingerprints(fingerprints.compared(make(odd)), [(r[0], r[1]) for r in odd])
    assert fingerprints.compared(clashing).count() == len(ODD)
    check_fingerprints(fingerprints.compared(make([(3, "only one here")])), [(3, "only one here")])
    assert fingerprints.compared(make([])).count() == 0


def test_next_documents_across_windows_and_gaps(make):
    ids = [0, 1, 255, 256, 257, 5000, 1_048_575, 1_048_576, 3_000_000, 10**12, -7]
    rows = [(i, f"text number {i} with some words") for i in ids]
    check_fingerprints(fingerprints.compared(make(rows)), rows)


def test_branches_locate_an_edit(make):
    paragraphs = [f"paragraph {k} has a few words of its own here" for k in range(6)]
    text = "\n".join(paragraphs[:3]) + "\n\n" + "\n".join(paragraphs[3:])
    changed = text.replace("paragraph 4 has", "paragraph 4 had")
    row = make([(1, text), (2, changed)]).select("doc_id", fingerprints.tree(F.col("text")).alias("t"))
    a, b = row.where("doc_id = 1").select(F.col("t").alias("a")), row.where("doc_id = 2").select(F.col("t").alias("b"))
    both = a.join(b, F.lit(True))
    assert both.select(fingerprints.edited_paragraphs(F.col("a"), F.col("b"))).first()[0] == [4]
    assert both.select(fingerprints.root(F.col("a")) == fingerprints.root(F.col("b"))).first()[0] is False
    near = both.select(fingerprints.likeness(fingerprints.shown(F.col("a")), fingerprints.shown(F.col("b")), fingerprints.leaves(F.col("a")), fingerprints.leaves(F.col("b")))).first()[0]
    assert 0.85 < near < 1


def test_fingerprints_use_no_python(spark, sf_dir):
    plan = QUERIES["op8_fingerprints"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def stage_outputs(spark, docs, sf_dir):
    import corpus_pipeline
    from vigil.session import scratch_path

    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, f"test-{name}")
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_pipeline_stages(spark):
    import corpus_pipeline
    from test_jaccard import brute
    from test_lines import removed_by_brute_force

    sf_dir = "/root/testdata/sf0.01"
    raw, good, lines, single, mixed, pieces = stage_outputs(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    assert [x.schema.simpleString() for x in (good, lines, single, mixed)] == [raw.schema.simpleString()] * 4
    model = quality.fit(raw, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = {r["doc_id"] for r in quality.score(raw, model).where("score >= 0.5").collect()}
    rows = {r["doc_id"]: r["text"] for r in good.collect()}
    assert {*rows} == kept and rows.items() <= {r["doc_id"]: r["text"] for r in raw.collect()}.items()
    gone = removed_by_brute_force(list(rows.items()))
    want = {}
    for i, t in rows.items():
        rest = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[(i, t)])
        if not gone[(i, t)] or words(rest):
            want[i] = rest
    after = lines.collect()
    assert {r["doc_id"]: r["text"] for r in after} == want and all(r["n_chars"] == len(r["text"]) for r in after)
    heads = {i for i, _, c in brute(list(want.items())) if i == c}
    assert {r["doc_id"]: r["text"] for r in single.collect()} == {i: want[i] for i in heads}
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, single.collect()))
    check_packing(packing.pack(mixed, TOKENIZER), [(r["doc_id"], r["text"]) for r in mixed.collect()], 4096)
    assert sum(r["length"] for r in pieces.collect()) == sum(r["length"] for r in packing.pack(mixed, TOKENIZER).collect())
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, pieces.collect()))


def test_pipeline_of_odd_and_empty_tables(spark, odd, clashing, make, sf_dir):
    for docs in (odd, clashing, make([])):
        out = stage_outputs(spark, docs, sf_dir)
        assert all(x.columns == docs.columns for x in out[:-1])
        assert out[-2].count() == out[-3].count() <= docs.count()
    assert jaccard_join.near_duplicates(out[0]).count() == 0
