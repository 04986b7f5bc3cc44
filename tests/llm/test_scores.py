"""Quality classifier, quality rules and language-model scoring."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import ODD, lowered, words
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from vigil.llm import attention, lm, quality, rules
from vigil.llm.queries import QUERIES
from vigil.llm.subwords import Encoder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def auc(scores, labels):
    order = np.argsort(np.argsort(scores)) + 1.0
    good = np.asarray(labels) == 1
    return (order[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_held_out_quality(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = QUERIES["op1_quality_classifier"](spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    judged = rows.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert rows.count() == n and rows.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert rows.where("predicted <> cast(score >= 0.5 AS int)").count() == 0
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(judged.doc_id, judged.held_out))
    assert auc(judged.score, judged.quality) > 0.98
    assert (judged.predicted == judged.quality).mean() > 0.97


def test_labels_of_the_held_out_fold_change_nothing(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = quality.fold(F.col("doc_id"), 3) == 1
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, other = (quality.score(docs, quality.fit(docs, x)).orderBy("doc_id").toPandas() for x in (labels, turned))
    assert one.score.tolist() == other.score.tolist()


def test_votes_are_those_of_all_cosines():
    rng = np.random.default_rng(2)
    labelled, labels = quality.unit(rng.standard_normal((90, 5))), (rng.random(90) < 0.6).astype(float)
    vectors = quality.unit(rng.standard_normal((20, 5)))
    want = []
    for v in vectors:
        near = sorted(((float(v @ x), y) for x, y in zip(labelled, labels)), reverse=True)[:7]
        weight = [max(s, 0) ** quality.POWER for s, _ in near]
        want.append(sum(w * y for w, (_, y) in zip(weight, near)) / sum(weight))
    assert np.allclose(quality.vote(vectors, labelled, labels, 7), want)


def test_scores_of_odd_rows(odd, clashing, make, spark):
    labels = spark.createDataFrame([(1, 1), (8, 0), (9, None), (6, 1), (None, 0), (10, 1), (5, 0)], "doc_id long, quality int")
    for docs in (odd, clashing):
        model = quality.fit(docs, labels)
        rows = quality.score(docs, model).collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
        assert quality.with_score(docs, model).columns == [*(c for c in docs.columns if c != "score"), "score"]
    none = labels.where("false")
    assert {r["score"] for r in quality.score(odd, quality.fit(odd, none)).collect()} == {0.5}
    assert quality.score(make([]), quality.fit(make([]), labels)).count() == 0


def rule_counts(text):
    w = words(text)
    grams = Counter(tuple(w[k: k + 3]) for k in range(len(w) - 2))
    covered = {x for k in range(len(w) - 2) if grams[tuple(w[k: k + 3])] > 1 for x in (k, k + 1, k + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def check_rules(df, rows):
    got = df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    want = [(i, *(c := rule_counts(t)), c[0] < 50 or 100 * c[4] > 50 * c[0]) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_rule_counts(spark, sf_dir, odd, clashing, make):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = QUERIES["op4_quality_rules"](spark, sf_dir)
    check_rules(found, rows)
    assert found.where("base_failed AND kept").count() == 0
    for docs in (odd, clashing):
        check_rules(rules.quality_rules(docs), [(r[0], r[1]) for r in ODD])
    assert rules.quality_rules(make([])).count() == 0


def test_rules_keep_clean_documents_and_drop_bad_ones(spark):
    sf_dir = "/root/testdata/sf0.01"
    judged = QUERIES["op4_quality_rules"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("NOT base_failed").toPandas()
    assert judged[judged.quality == 1].kept.mean() > 0.99 and judged[judged.quality == 0].kept.mean() < 0.1


def test_cutoffs_of_merged_sketches(spark):
    rng = np.random.default_rng(3)
    values = {("en", "a"): rng.integers(0, 1000, 400), (None, "b"): rng.integers(100, 140, 300), ("de", None): np.full(200, 7)}
    rows = [(s[0], s[1], int(v)) for s, vs in values.items() for v in vs]
    frame = spark.createDataFrame(rows, "lang string, source string, v long").select("*", F.lit("symbols").alias("ratio"), rules.bucket_of(F.col("v")).alias("bucket"))
    sketch = frame.groupBy("lang", "source", "ratio", "bucket").agg(F.count("*").alias("docs"))
    halves = [frame.where(f"v % 2 = {k}").groupBy("lang", "source", "ratio", "bucket").agg(F.count("*").alias("docs")) for k in (0, 1)]
    one, merged = (sorted(map(str, rules.cutoffs(x, "lang", "source").collect())) for x in (sketch, halves[0].unionAll(halves[1])))
    assert one == merged
    for r in rules.cutoffs(sketch, "lang", "source").collect():
        v = np.sort(values[(r["lang"], r["source"])])
        q25, q75 = v[math.ceil(len(v) / 4) - 1], v[math.ceil(len(v) * 3 / 4) - 1]
        want = q75 + 3 * (q75 - q25) + rules.RATIOS["symbols"][0]
        # A bucket is at most 1/32 wide, and the fence reads four of them.
        assert abs(r["high"] - want) <= 4 * q75 / 32 + 3 * q25 / 32 and r["docs"] == len(v)


def base_scores(rows):
    docs = [(i, [*words(lowered(t)), None]) for i, t in rows]
    train = [i is not None and zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in docs]
    count = Counter(w for (_, t), use in zip(docs, train) if use for w in t)
    n, v = sum(count.values()), len(count)
    return [(i, not use, len(t), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for (i, t), use in zip(docs, train)]


def check_base(df, rows):
    key = lambda r: (str(r[0]), r[2], r[5])
    got = sorted(((*r[:5], r[5]) for r in df.collect()), key=key)
    for g, w in zip(got, sorted(base_scores(rows), key=key), strict=True):
        assert tuple(g[:5]) == tuple(w[:5]) and abs(g[5] - w[5]) < 1e-6


def test_base_scores(spark, sf_dir, odd, clashing, make):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = QUERIES["op10_lm_scoring"](spark, sf_dir).cache()
    check_base(found, rows)
    assert found.where("score IS NULL OR attention_score IS NULL OR isnan(score) OR score > 0 OR attention_score > 0").count() == 0
    # Held out, the score beats word frequencies, and the attention model alone comes near them.
    row = found.where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("attention_score"), F.sum("n_tokens")).first()
    assert row[0] > row[1] and row[2] > 1.4 * row[1] and row[2] / row[3] > -math.log10(49408) * 2.5 * 0.8
    for docs in (odd, clashing):
        check_base(lm.score(docs, TOKENIZER), [(r[0], r[1]) for r in ODD])
    assert lm.score(make([]), TOKENIZER).count() == 0


def test_training_streams_in_batches_of_one_size(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    ids = rng.integers(0, 300, (700, attention.WINDOW + 1)).astype(lm.narrow(300))
    batches = [pa.record_batch([pa.array([r.tobytes() for r in part], pa.binary())], ["ids"]) for part in np.split(ids, [10, 400, 400, 655])]
    got = list(lm._batches(iter(batches), 300))
    assert [len(g) for g in got] == [lm.BATCH, lm.BATCH, 700 - 2 * lm.BATCH] and (np.concatenate(got) == ids).all()


@pytest.fixture(scope="module")
def small_model():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, 300).astype(float)
    of, share = attention.classes(counts, rng.random(300) < 0.5)
    p = attention.start(np.bincount(of, weights=counts, minlength=attention.CLASSES))
    pairs = np.unique(rng.integers(0, attention.CLASSES * 300, 2000))
    return p, attention.embedding_rows(counts), of, attention.shares_behind(pairs, rng.integers(1, 9, len(pairs)), of, share)


def test_id_probabilities_add_up(small_model):
    scorer = attention.Scorer(*small_model)
    total = [0.0, 0.0]
    for i in range(300):
        logs = scorer.token_logs(np.array([7, i, 5, i]), np.array([0, 2, 4]), 1)
        total[0] += math.exp(logs[1])
        total[1] += math.exp(logs[3])
    assert np.allclose(total, 1.0, atol=1e-4)


def test_each_id_is_scored_once_by_its_window(small_model):
    """Against one window at a time, and without a look at what follows."""
    scorer = attention.Scorer(*small_model)
    rng = np.random.default_rng(1)
    lengths = [1, 31, 32, 33, 56, 57, 200]
    ids, at = rng.integers(0, 300, sum(lengths)), np.concatenate([[0], np.cumsum(lengths)])
    logs = scorer.token_logs(ids, at, 9)
    p, rows, of, share = small_model
    for a, b in zip(at, at[1:]):
        text, context = ids[a:b], np.concatenate([[9], ids[a: b - 1]])
        for k in range(len(text)):
            window = 0 if k < attention.WINDOW else (k - attention.WINDOW) // (attention.WINDOW - attention.OVERLAP) + 1
            low = window * (attention.WINDOW - attention.OVERLAP)
            x = p["embed"][rows[context[low: k + 1]]] + p["place"][: k + 1 - low]
            weight = np.exp(x[-1] @ p["q"] @ (x @ p["k"]).T / math.sqrt(attention.DIM))
            z = (x[-1] + weight @ (x @ p["v"]) / weight.sum() @ p["o"]) @ p["out"] + p["bias"]
            assert math.isclose(logs[a + k], z[of[text[k]]] - math.log(np.exp(z).sum()) + share[of[context[k]], text[k]], abs_tol=1e-3)


def test_gradients(small_model):
    p, rows, of, _ = small_model
    p = {name: a.astype(np.float64) for name, a in p.items()}
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 300, (3, attention.WINDOW + 1))
    x, y, w = rows[ids[:, :-1]], of[ids[:, 1:]], rng.random((3, attention.WINDOW)) < 0.8
    grads, _ = attention._step(p, x, y, w)
    for name in p:
        place = tuple(x[0, 3] if name == "embed" and d == 0 else n // 2 for d, n in enumerate(p[name].shape))
        up, down = ({**p, name: p[name].copy()} for _ in range(2))
        up[name][place] += 1e-4
        down[name][place] -= 1e-4
        slope = (attention._step(up, x, y, w)[1] - attention._step(down, x, y, w)[1]) / 2e-4
        assert math.isclose(grads[name][place], slope, rel_tol=1e-2, abs_tol=1e-6), name


def test_training_lowers_the_loss(small_model):
    p, rows, of, _ = small_model
    ids = np.tile(np.arange(33) % 11, (64, 1))
    x, y, w = rows[ids[:, :-1]], of[ids[:, 1:]], np.ones((64, 32), bool)
    new, first = attention.train(p, x, y, w)
    for _ in range(20):
        new, last = attention.train(new, x, y, w)
    assert last < 0.5 * first


def test_word_table_gives_the_tokenizers_ids(spark, sf_dir, monkeypatch):
    """For all texts of a table, for odd words, and after the table began anew."""
    import pyarrow as pa

    from vigil.llm import kit, subwords

    odd = ["It's a test, isn't it?! <|endoftext|>", "a|b | || |", "x" * 500 + "...", "漢字 𝒳 Éà ﬁ İ́", "\x1c\x85a b", "", "Hello, hello. HELLO; hello", "don't.", "a'", "1,000.5",
           "́ x", "ÀÉÎÕÜß ×÷ ÿŸ ª º µ é É́", "!!!???...$$$###", "a1b2c3", "a" * 49 + " b", "ñandú Ñ", "\x00 \x7f\x1f", "<|", "a<b", "zzzzzzzz" * 4]
    texts = odd + [r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    data, offsets = kit.texts(pa.chunked_array([pa.array(texts)]))
    words_of = Encoder(TOKENIZER)
    want = [e.ids for e in words_of.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for words_kept, recent in ((10**6, 10**6), (10**6, 10), (0, 10)):
        monkeypatch.setattr(subwords, "TABLE_WORDS", words_kept)
        monkeypatch.setattr(subwords, "RECENT_WORDS", recent)
        ids, at = words_of.encode(data, offsets)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=1, max_size=5))
def test_any_text_gets_the_tokenizers_ids(texts):
    import pyarrow as pa

    from vigil.llm import kit

    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    data, offsets = kit.texts(pa.chunked_array([pa.array(texts)]))
    ids, at = SHARED.encode(data, offsets)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [e.ids for e in SHARED.tokenizer.encode_batch(texts, add_special_tokens=False)]


SHARED = Encoder(TOKENIZER)
