"""Exact dedup against grouping by the normalised text, with colliding hashes and splitting buckets."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vigil.llm import exact_dedup

HASHES = {
    "64 bits": F.xxhash64,
    "collisions": lambda t: F.pmod(F.xxhash64(t), F.lit(5)).cast("long") - 2,
    "one chain": lambda t: F.lit(3).cast("long"),
    "equal leading bits": lambda t: F.shiftrightunsigned(F.xxhash64(t), 44),
}


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def expected(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[normal(text)].append(doc)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        out += [(i, min(known) if known else None, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def check(got, rows):
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=repr) == expected(rows)
    kept = [r for r in got if r["kept"]]
    assert all(r["doc_id"] == r["keep_id"] for r in kept)
    assert sorted(r["text_sha256"] for r in kept) == sorted({e[3] for e in expected(rows)})


@pytest.mark.parametrize("name", HASHES)
def test_groups_are_those_of_equal_bytes(name, make):
    texts = [f"text {i % 37}  of\t{i % 11}" for i in range(400)] + ["text 1 of 1", "text\n1 of\r1", " text 1 of 1", "", None, " ", "\t \n", "é 漢", "é  漢"] + ["hot"] * 300
    rows = list(enumerate(texts))
    docs = make(rows).repartition(7)
    check(exact_dedup.group_equal(docs, key=HASHES[name], capacity=4, stretch_rows=16, stretch_bytes=400).collect(), rows)


def test_odd_rows_and_clashing_columns(odd, clashing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check(exact_dedup.group_equal(odd, capacity=2).collect(), rows)
    got = exact_dedup.group_equal(clashing, capacity=2)
    assert [c for c in clashing.columns if c not in exact_dedup.ADDED] == got.columns[:-4]
    check(got.collect(), rows)
    assert {r["bucket"] for r in got.collect()} == {"own"}
    left = exact_dedup.dedup(odd)
    assert left.columns == odd.columns and left.count() == len({normal(t) for _, t in rows})


def test_empty_table(make):
    assert exact_dedup.group_equal(make([])).collect() == []


def test_buckets_hold_no_more_than_their_capacity(make):
    rows = exact_dedup.addressed(make([(i, f"t{i}") for i in range(900)] + [(1000 + i, "hot") for i in range(50)]), stretch_rows=1)
    entries = rows.select(F.col("_key").alias("key"), F.col("_entry").alias("entry"))
    index = exact_dedup.build_index(entries, capacity=8)
    found = index.entries.groupBy("bucket", "depth").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"), F.min("key").alias("key")).collect()
    assert all(r["n"] <= 8 or r["keys"] == 1 for r in found) and max(r["n"] for r in found) >= 50
    assert sum(r["n"] for r in found) == 950 and index.entries.select("entry").distinct().count() == 950
    # The directory covers every hash once: the shares of all buckets that hold entries add up to one at most, and none is inside another.
    assert all((r["key"] % 2**64) >> (64 - r["depth"]) == r["bucket"] for r in found)
    assert sorted((r["bucket"], r["depth"], r["n"]) for r in index.directory.collect()) == sorted((r["bucket"], r["depth"], r["n"]) for r in found)
    assert len({r["depth"] for r in found}) > 1
    # A bucket lies with one owner, and owners hold consecutive ranges.
    owners = index.entries.groupBy("bucket", "depth").agg(F.min("owner").alias("low"), F.max("owner").alias("high")).collect()
    assert all(r["low"] == r["high"] for r in owners)
