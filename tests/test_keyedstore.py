"""The keyed store: merging in any order, folds by bucket, retried and conflicting writers."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vigil.session import scratch_path
from vigil.sources import files, issuestore
from vigil.sources.keyedstore import KeyedStore
from vigil.sources.tablelog import Conflict

NOW = datetime(2024, 1, 31, tzinfo=UTC)
SCHEMA = "k string, n bigint, low int, at int, name string"
RULES = {"n": "sum", "low": "min", "at": "max", "name": "last at"}


@pytest.fixture()
def store(spark):
    return KeyedStore.create(spark, scratch_path(spark, "store"), SCHEMA, ["k"], RULES, buckets=4)


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(df):
    return sorted(map(tuple, df.collect()), key=str)


def rows_of(nth, keys=12):
    """A third of the rows have one key, some none; names come and go."""
    out = []
    for i in range(60):
        key = "hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{(i * 5 + nth) % keys}"
        named = (i + nth) % 4 != 0
        out.append((key, i, i - 7 * nth, 100 * (i % 9) + nth if named else None, f"name{i % 9}-{nth}" if named else None))
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    out = []
    for key, some in groups.items():
        named = max(((r[3], r[4]) for r in some if r[3] is not None), default=(None, None))
        out.append((key, sum(r[1] for r in some), min(r[2] for r in some), *named))
    return sorted(out, key=str)


def test_any_order_of_commits_and_folds_gives_the_same(spark, store):
    rows = []
    for nth in range(6):
        rows += rows_of(nth)
        store.commit(batch(spark, rows_of(nth)), NOW, f"run-{nth}")
        if nth in (1, 4):
            store.fold(NOW)
        assert content(store.read()) == brute(rows)
    assert content(store.read(2)) == brute(rows_of(0) + rows_of(1))
    wanted = batch(spark, [("hot", 0, 0, 0, "")] + [(None, 0, 0, 0, "")])
    assert content(store.read(keys=wanted)) == [r for r in brute(rows) if r[0] in ("hot", None)]


def test_fold_opens_the_base_and_new_deltas_only(spark, store):
    store.commit(batch(spark, rows_of(0)), NOW)
    store.commit(batch(spark, rows_of(1)), NOW)
    store.fold(NOW)
    before = store.state()
    assert before.pending == [] and set(before.base) == {0, 1, 2, 3}
    store.commit(batch(spark, [("hot", 1, 1, 1, "x")]), NOW)
    due = [b for b in range(4) if store.state().deltas(b)]
    assert len(due) == 1
    opened = {r["f"] for r in store._open(store.state(), due).select(F.input_file_name().alias("f")).collect()}
    assert opened and all(f"bucket={due[0]}/" in f for f in opened)
    want = content(store.read())
    store.fold(NOW)
    after = store.state()
    assert after.pending == [] and content(store.read()) == want
    assert [b for b in range(4) if after.base[b] != before.base[b]] == due
    # Nothing is due, so nothing is written.
    assert store.fold(NOW) == after.version


def test_folders_of_a_read_stay_bounded(spark, store):
    for nth in range(9):
        store.commit(batch(spark, [(f"k{nth}", 1, 1, None, None), ("hot", 1, nth, None, None)]), NOW, f"r{nth}")
        if nth % 3 == 2:
            store.fold(NOW)
        assert sum(len(store.state().folders(b)) for b in range(4)) <= 4 * 3
    assert store.read().where("k = 'hot'").first()["n"] == 9


def test_retried_run_adds_once(spark, store):
    first = store.commit(batch(spark, rows_of(0)), NOW, "run")
    assert store.commit(batch(spark, rows_of(0)), NOW, "run") == first == store.latest()
    assert content(store.read()) == brute(rows_of(0))


def test_writers_that_depend_on_what_they_read_conflict(spark, store):
    store.commit(batch(spark, [("a", 1, 1, 1, "x"), ("b", 1, 1, 1, "x")]), NOW)
    seen = store.latest()
    store.commit(batch(spark, [("a", 1, 1, 1, "x")]), NOW)
    folders = {n for n, _ in files.names(spark, store.data)}
    with pytest.raises(Conflict):
        store.commit(batch(spark, [("a", 5, 1, 1, "x")]), NOW, read=seen)
    # The refused writer leaves no files; other keys and plain additions go through, also past a fold.
    assert {n for n, _ in files.names(spark, store.data)} == folders
    store.fold(NOW)
    store.commit(batch(spark, [("b", 5, 1, 1, "x")]), NOW, read=seen)
    store.commit(batch(spark, [("a", 5, 1, 1, "x")]), NOW)
    assert [r[:2] for r in content(store.read())] == [("a", 7), ("b", 6)]


def test_rows_where_nothing_depends_do_not_conflict(spark, store):
    store.commit(batch(spark, [("a", 1, 1, 1, "x")]), NOW)
    store.commit(batch(spark, [("a", 2, 1, None, None)]), NOW, read=0, where="name IS NOT NULL")
    with pytest.raises(Conflict):
        store.commit(batch(spark, [("a", 2, 1, 2, "y")]), NOW, read=0, where="name IS NOT NULL")


def test_delta_during_a_fold_stays_on_top(spark, store, monkeypatch):
    store.commit(batch(spark, rows_of(0)), NOW)
    write = store._write

    def slow(rows):
        done = write(rows)
        monkeypatch.setattr(store, "_write", write)
        store.commit(batch(spark, rows_of(1)), NOW)
        return done

    monkeypatch.setattr(store, "_write", slow)
    store.fold(NOW)
    assert content(store.read()) == brute(rows_of(0) + rows_of(1))
    store.fold(NOW)
    assert content(store.read()) == brute(rows_of(0) + rows_of(1))


def test_second_fold_of_the_same_buckets_gives_up(spark, store, monkeypatch):
    store.commit(batch(spark, rows_of(0)), NOW)
    write = store._write

    def slow(rows):
        done = write(rows)
        monkeypatch.setattr(store, "_write", write)
        store.fold(NOW)
        return done

    monkeypatch.setattr(store, "_write", slow)
    with pytest.raises(Conflict):
        store.fold(NOW)
    assert content(store.read()) == brute(rows_of(0))


def test_empty_batches_and_tables(spark, store):
    assert store.read().count() == 0 and store.fold(NOW) == 0
    store.commit(batch(spark, []), NOW, "none")
    assert store.read().count() == 0 and store.committed("none") == 1
    store.commit(batch(spark, rows_of(0)), NOW)
    assert content(store.read()) == brute(rows_of(0))
    with pytest.raises(Conflict):
        KeyedStore.create(spark, store.path, SCHEMA, ["k"], RULES)
    for bad in ({"n": "avg"}, {"n": "sum x"}, {"n": "last at"}):
        with pytest.raises(ValueError):
            KeyedStore.create(spark, scratch_path(spark, "bad"), "k string, n bigint", ["k"], bad)


def test_vacuum_keeps_what_readers_need(spark, store):
    for nth in range(3):
        store.commit(batch(spark, rows_of(nth)), NOW)
        store.fold(NOW)
    want = content(store.read())
    store._write(batch(spark, rows_of(9)))  # a writer that died
    before = {n for n, _ in files.names(spark, store.data)}
    assert store.vacuum(NOW - timedelta(days=1), NOW) == 0 and {n for n, _ in files.names(spark, store.data)} == before
    later = datetime.now(UTC) + timedelta(days=1)
    assert store.vacuum(later, later) == len(before) - len({f for b in range(4) for f in store.state().folders(b)})
    assert content(store.read()) == want
    store.commit(batch(spark, rows_of(3)), NOW)
    assert content(store.read()) == brute(sum(map(rows_of, range(4)), []))


def test_issue_numbers_of_two_writers_never_meet(spark, monkeypatch):
    store = issuestore.create(spark, scratch_path(spark, "issues"), 4)
    shape = "project_id int, hash string, received timestamp_ntz, title string, release string"

    def events(*hashes):
        return spark.createDataFrame([(1, h, datetime(2024, 1, 1, 0, i), f"t{h}", None) for i, h in enumerate(hashes)], shape)

    issuestore.group_into(store, events("a", "b", "a"), NOW, "one")
    read, done = KeyedStore.read, []

    def meanwhile(self, *args):
        # Another writer adds a new issue to the project after this one has read it.
        found = read(self, *args)
        if not done:
            done.append(True)
            issuestore.group_into(store, events("c", "d"), NOW, "other")
        return found

    monkeypatch.setattr(KeyedStore, "read", meanwhile)
    issuestore.group_into(store, events("b", "d", "e"), NOW, "two")
    issuestore.group_into(store, events("b", "d", "e"), NOW, "two")
    monkeypatch.undo()
    got = {r["hash"]: (r["count"], r["short_id"], r["title"]) for r in store.read().collect()}
    assert got == {"a": (2, 1, "ta"), "b": (2, 2, "tb"), "c": (1, 3, "tc"), "d": (2, 4, "td"), "e": (1, 5, "te")}
