"""Skew-safe operators against brute force, with one key holding a third of the rows."""

import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vigil.operators import alerts, maintenance, quantiles, ranges, segmented, spans, uptime, upsert

START = datetime(2024, 1, 1)


def skewed(n=3000, keys=40, seed=7):
    rnd = random.Random(seed)
    return [(0 if i % 3 == 0 else rnd.randrange(1, keys), START + timedelta(seconds=rnd.randrange(0, 400_000)), i) for i in range(n)]


def frame(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else c for c, t in df.dtypes])


@pytest.fixture(scope="module")
def events(spark):
    return frame(spark, skewed(), "k int, at timestamp, id int")


HOT = pytest.mark.parametrize("hot_rows", [0, 200, segmented.HOT_ROWS])  # all, one, no key cut up


@HOT
def test_neighbours(events, hot_rows):
    rows = defaultdict(list)
    for k, at, i in skewed():
        rows[k].append((at, i))
    want = {}
    for items in rows.values():
        order = [i for _, i in sorted(items)]
        for p, i in enumerate(order):
            want[i] = (order[p - 1] if p else None, order[p + 1] if p + 1 < len(order) else None)
    got = segmented.with_neighbours(events, ["k"], segmented.time_slot(F.col("at"), 3600), ["at", "id"], "id", hot_rows)
    assert {r["id"]: (r["prev_id"], r["next_id"]) for r in got.collect()} == want


@HOT
def test_row_numbers(events, hot_rows):
    rows = defaultdict(list)
    for k, at, i in skewed():
        rows[k].append((at, i))
    want = {i: p for items in rows.values() for p, (_, i) in enumerate(sorted(items), 1)}
    got = segmented.with_row_number(events, ["k"], segmented.time_slot(F.col("at"), 3600), ["at", "id"], "n", hot_rows)
    assert {r["id"]: r["n"] for r in got.collect()} == want


def test_exact_percentiles(spark):
    rnd = random.Random(3)
    rows = [(None if i % 3 == 0 else f"g{rnd.randrange(6)}", rnd.choice([0.0, -4.5, rnd.expovariate(0.01), float(rnd.randrange(90))])) for i in range(4000)]
    rows += [("single", 5.25), ("nulls", None), ("nulls", 2.0)]
    got = quantiles.exact_percentiles(
        quantiles.value_counts(spark.createDataFrame(rows, "g string, v double"), ["g"], "v"), ["g"], "v", {"p1": 1, "p50": 50, "p95": 95, "p100": 100}
    )
    groups = defaultdict(list)
    for g, v in rows:
        if v is not None:
            groups[g].append(v)
    want = {g: tuple(sorted(vs)[max(1, math.ceil(len(vs) * p / 100)) - 1] for p in (1, 50, 95, 100)) for g, vs in groups.items()}
    assert {r["g"]: (r["p1"], r["p50"], r["p95"], r["p100"]) for r in got.collect()} == want


def test_distinct_values_inside_one_cell_are_spread(spark):
    """A hot group whose values all lie within 1 %: none of its values is ranked in a task that holds many."""
    df = spark.range(6000).selectExpr("IF(id % 3 = 0, 'hot', concat('g', id % 40)) AS g", "IF(id % 3 = 0, 1000 + id / 6000, double(id)) AS v")
    df = df.unionAll(spark.range(50).selectExpr("'tight'", "1e300 * (1 + id * 2.3e-16)")).unionAll(spark.range(9).selectExpr("'none'", "double(NULL)"))
    df = df.unionAll(spark.range(700).selectExpr("'same'", "7.5D")).unionAll(spark.range(20).selectExpr("'edge'", "IF(id < 4, double('Infinity'), -0.001D * id)"))
    percents = {"p1": 1, "p50": 50, "p95": 95, "p100": 100}
    groups = defaultdict(list)
    for r in df.where("v IS NOT NULL").collect():
        groups[r["g"]].append(r["v"])
    want = {g: tuple(sorted(vs)[max(1, math.ceil(len(vs) * p / 100)) - 1] for p in percents.values()) for g, vs in groups.items()}
    want["none"] = (None,) * 4
    counts = quantiles.value_counts(df, ["g"], "v")
    for most, levels in ((10, 1), (1, 3), (10_000, 1)):
        got = quantiles.exact_percentiles(counts, ["g"], "v", percents, most=most, levels=levels)
        assert {r["g"]: (r["p1"], r["p50"], r["p95"], r["p100"]) for r in got.collect()} == want
    # What is ranked at last: one cell of the hot group before, a few values after cutting it.
    heads = quantiles.group_heads(counts, ["g"], "v", percents).where("g = 'hot'")
    cut = quantiles.refine_heads(counts, heads, ["g"], "v")
    assert quantiles.in_heads(counts, heads, ["g"], "v").groupBy("_name").count().agg(F.max("count")).first()[0] > 1000
    assert quantiles.in_heads(counts, cut, ["g"], "v").groupBy("_name").count().agg(F.max("count")).first()[0] <= 2


def test_percentile_plan_keeps_no_value_list(spark):
    """No group is gathered: the plan has neither percentile nor collect aggregates."""
    df = spark.range(100).selectExpr("id % 3 AS g", "double(id) AS v")
    plan = quantiles.exact_percentiles(quantiles.value_counts(df, ["g"], "v"), ["g"], "v", {"p": 95})._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan.lower() and "collect_list" not in plan


def replay(rows, thresholds):
    """Row-by-row reference for the state rules."""
    state, out = {}, {}
    for m, at, i, up in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        prev, down = state.get(m, (None, 0))
        need = max(1, thresholds.get(m) or 1)
        if up:
            new, down = True, 0
        else:
            down = min(down + 1, need)
            new = False if down >= need else prev
        out[i] = (down, new, new is not None and new != prev)
        state[m] = (new, down)
    return out


@HOT
def test_flap_damping_equals_replay_and_continues(spark, hot_rows):
    rnd = random.Random(11)
    rows = [(k, at, i, rnd.random() < (0.15 if i % 7 else 0.9)) for k, at, i in skewed(seed=5)]
    thresholds = {k: 1 + k % 4 for k in range(30)}
    checks = frame(spark, rows, "monitor_id int, start_check timestamp, check_id int, is_up boolean")
    monitors = spark.createDataFrame(list(thresholds.items()), "monitor_id int, confirmation_threshold int")
    want = replay(rows, thresholds)
    shape = lambda df: {r["check_id"]: (r["consecutive_down"], r["state"], r["changed"]) for r in df.collect()}
    assert shape(uptime.replay_states(checks, monitors, hot_rows=hot_rows)) == want
    edge = F.lit("2024-01-03").cast("timestamp_ntz")
    first = uptime.replay_states(checks.where(F.col("start_check") < edge), monitors, hot_rows=hot_rows)
    second = uptime.replay_states(checks.where(F.col("start_check") >= edge), monitors, uptime.last_states(first), hot_rows)
    assert {**shape(first), **shape(second)} == want


def test_flap_damping_sorts_once_and_joins_no_rows(spark):
    """Without hot monitors a task holds its rows in one sort; checks without a result keep the state."""
    rows = [(m, START + timedelta(seconds=i), i, up) for m in (1, 2, None) for i, up in enumerate([None, False, None, False, True, None, False, False, True])]
    checks = frame(spark, rows, "monitor_id int, start_check timestamp, check_id int, is_up boolean")
    monitors = spark.createDataFrame([(1, 2), (2, 3)], "monitor_id int, confirmation_threshold int")
    whole = uptime.replay_states(checks, monitors)
    shape = lambda df: sorted(map(str, df.collect()))
    assert shape(whole) == shape(uptime.replay_states(checks, monitors, hot_rows=0))
    plan = uptime.replay_states(checks, F.broadcast(monitors))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "SortMergeJoin" not in plan


def test_interval_join(spark):
    rnd = random.Random(2)
    points = [(d, rnd.choice([rnd.randrange(0, 5000), rnd.randrange(0, 2**46), 2**60 + rnd.randrange(100)])) for d in range(3) for _ in range(60)]
    intervals = []
    for d in range(3):
        for i in range(40):
            low = rnd.choice([rnd.randrange(0, 5000), rnd.randrange(0, 2**46), 2**60])
            intervals.append((d, i, low, low + rnd.choice([0, 1, 15, 16, 17, rnd.randrange(1, 2**45)])))
    got = ranges.interval_join(
        spark.createDataFrame(sorted(set(points)), "d int, p bigint"), spark.createDataFrame(intervals, "d int, i int, low bigint, high bigint"), ["d"], "p", "low", "high"
    )
    pairs = [(r["d"], r["p"], r["i"]) for r in got.collect()]
    want = {(d, p, i) for d, p in points for e, i, low, high in intervals if d == e and low <= p < high}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


@pytest.mark.parametrize("few", [0, 25, 1000])  # all, one, no key by blocks
@pytest.mark.parametrize("how", ["inner", "left"])
def test_interval_join_by_key_or_blocks(spark, few, how):
    rnd = random.Random(4)
    points = [(d, rnd.randrange(0, 3000)) for d in (0, 1, 2, None) for _ in range(50)] + [(1, None), (9, 5)]
    points += points[:20]
    intervals = [(d, i, low, low + rnd.choice([0, 16, 300, 900])) for d, n in ((0, 40), (1, 20), (2, 3), (None, 30)) for i in range(n) for low in [rnd.randrange(0, 3000)]]
    got = ranges.interval_join(
        spark.createDataFrame(points, "d int, p bigint"), spark.createDataFrame(intervals, "d int, i int, low bigint, high bigint"), ["d"], "p", "low", "high", how, few
    )
    want = []
    for d, p in points:
        hits = [i for e, i, low, high in intervals if d is not None and p is not None and d == e and low <= p < high]
        want += [(d, p, i) for i in (hits or ([None] if how == "left" else []))]
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r["d"], r["p"], r["i"]) for r in got.collect()), key=order) == sorted(want, key=order)


def test_modules_of_small_dumps_are_not_cut_into_blocks(spark):
    frames = spark.createDataFrame([(1, 40), (1, 90), (1, 90), (2, 40), (None, 40)], "dump_id int, address bigint")
    modules = spark.createDataFrame([(1, 2, "a", 0, 10**9), (1, 1, "b", 80, 100), (2, 1, "c", 41, 10**9), (None, 1, "d", 0, 100)], "dump_id int, module_order int, module string, base bigint, end bigint")
    found = maintenance.frames_with_modules(frames, modules)
    assert {tuple(r) for r in found.collect()} == {(1, 40, "a", 0), (1, 90, "b", 80), (2, 40, None, None), (None, 40, None, None)}
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_bundle_match_work_does_not_grow_with_the_bundles_of_a_name(spark):
    """Frames meet one bundle for each debug id or name; repeated frames share the first, frames without an event get none."""
    rnd = random.Random(3)
    frames = [(rnd.choice([1, 2, 3, None]), rnd.choice([0, 1, None]), rnd.choice(["r1", "r2", None]), rnd.choice([1, 2, 3, None]), f"https://h/{rnd.choice('abcd')}.js") for _ in range(80)]
    images = [(e, f"/x/{n}.js", d) for e, n, d in [(1, "a", "d1"), (1, "a", "d0"), (2, "b", "d2"), (3, "c", None), (None, "a", "d1")]]
    bundles = [(rnd.choice([0, 1, None]), rnd.choice(["r1", "r2", None]), i, rnd.choice(["d1", "d2", None]), rnd.choice(["a.js", "d.js", None]), rnd.choice(["p/b.js", None])) for i in range(90, 30, -1)]
    found = maintenance.match_bundles(
        spark.createDataFrame(frames, "event_id int, organization_id int, release string, frame_at int, abs_path string"),
        spark.createDataFrame(images, "event_id int, code_file string, debug_id string"),
        spark.createDataFrame(bundles, "organization_id int, release string, bundle_id int, debug_id string, file_name string, code_file string"))
    hits, want = defaultdict(list), []
    ids = {}
    for e, path, d in images:
        if e is not None and d is not None:
            ids[e, path.split("/")[-1]] = max(d, ids.get((e, path.split("/")[-1]), ""))
    for e, org, release, at, path in frames:
        file = path.split("/")[-1]
        for o, r, i, d, name, code in bundles:
            named = release is not None and r == release and (name == file or (code or "").split("/")[-1] == file)
            if org is not None and o == org and (named or (d is not None and d == ids.get((e, file)))):
                hits[e, at].append(i)
    for e, org, release, at, path in frames:
        want.append((e, at, path.split("/")[-1], min(hits[e, at], default=None) if e is not None and at is not None else None))
    order = lambda r: str(tuple(r))
    got = sorted((tuple(r) for r in found.select("event_id", "frame_at", "file", "bundle_id").collect()), key=order)
    assert got == sorted(want, key=order)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join Inner" in line] and "Union" not in plan


def test_first_per_key_is_deterministic(spark):
    rows = [(i % 5, 100 - i, f"v{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "k int, o int, v string").repartition(7)
    got = {tuple(r) for r in upsert.first_per_key(df, ["k"], ["o"]).collect()}
    assert got == {min((r for r in rows if r[0] == k), key=lambda r: r[1]) for k in range(5)}


def test_insert_is_idempotent(spark):
    stored = spark.createDataFrame([(1, "a")], "id int, v string")
    batch = spark.createDataFrame([(1, "z"), (2, "b"), (2, "c")], "id int, v string")
    once = upsert.insert_if_absent(stored, batch, ["id"], ["v"])
    twice = upsert.insert_if_absent(once, batch, ["id"], ["v"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a"), (2, "b")]


def test_transaction_stats_merge_equals_whole(spark, sf_dir):
    from vigil.sources.domain import table

    rows = table(spark, sf_dir, "transactions")
    whole = spans.transaction_groups(spans.transaction_stats(rows))
    parts = [rows.where(F.col("transaction_key") % 3 == n) for n in range(3)]
    merged = spans.transaction_stats(parts[0])
    for part in parts[1:]:
        merged = spans.merge_transaction_stats(merged, spans.transaction_stats(part))
    columns = [*spans.TXN_KEYS, "count", "error_count", "p50", "p95", "duration_histogram"]
    shape = lambda df: {tuple(map(str, r)) for r in df.select(*columns).collect()}
    assert shape(spans.transaction_groups(merged)) == shape(whole)


def test_alert_windows_of_different_length(spark):
    now = datetime(2024, 1, 2)
    rows = [(1, "a", now - timedelta(minutes=m, seconds=s)) for m, s in ((0, 0), (4, 59), (5, 0), (5, 1), (60, 0))]
    events = frame(spark, rows, "project_id int, issue_id string, received timestamp")
    rules = spark.createDataFrame([(1, 10, 3, 5), (1, 11, 4, 5), (1, 12, 5, 60), (1, 13, 1, None), (2, 14, 1, 60)],
                                  "project_id int, alert_id int, quantity int, timespan_minutes int")
    got = {(r["alert_id"], r["num_events"]) for r in alerts.evaluate_alerts(rules, events, now).collect()}
    assert got == {(10, 3), (12, 5)}


def test_top_n_is_cut_before_the_shuffle(spark, events):
    checks = events.selectExpr("k AS monitor_id", "at AS start_check", "id AS check_id")
    plan = uptime.latest_checks(checks, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_newest_and_first_rows_need_no_sorted_aggregation(spark, sf_dir):
    from vigil.operators import issues, upsert
    from vigil.sources.domain import table

    events = table(spark, sf_dir, "issue_events")
    for df in (issues.latest_events(events.select("issue_id", "event_id", "received", "title")), issues.group_batch(events), issues.rollup_updates(events),
               upsert.latest_per_key(events, ["issue_id"], ["received", "event_id"]), upsert.first_per_key(events, ["project_id", "hash"], ["received", "event_id"])):
        assert "SortAggregate" not in plan_of(df)


def test_extremes_settle_ties_and_nulls(spark):
    from vigil.operators import upsert

    rows = [("a", 1, 5, "x"), ("a", 1, 7, "y"), ("a", None, 9, "z"), (None, 3, 1, "n"), (None, 2, 1, "m"), ("b", None, 1, "p"), ("b", None, 2, "q")]
    df = spark.createDataFrame(rows, "k string, t int, u int, v string")
    assert sorted(r["v"] for r in upsert.latest_per_key(df, ["k"], ["t", "u"]).collect()) == ["n", "q", "y"]
    assert sorted(r["v"] for r in upsert.first_per_key(df, ["k"], ["t", "u"]).collect()) == ["m", "p", "x"]


def test_alerts_and_heartbeats_scan_their_windows_only(spark, sf_dir):
    from datetime import datetime

    from vigil.operators import alerts, uptime
    from vigil.session import scratch_path
    from vigil.sources import storage
    from vigil.sources.domain import table

    now, path = datetime(2024, 1, 31), scratch_path(spark, "test-prune")
    storage.archive(table(spark, sf_dir, "issue_events"), path, "received", sort="event_id")
    rules = table(spark, sf_dir, "alert_rules").withColumn("project_id", F.col("project_id").cast("int"))
    plan = plan_of(alerts.evaluate_alerts(rules, spark.read.parquet(path), now))
    scan = plan.split("PartitionFilters:")[1]
    assert "date" in scan.split("PushedFilters")[0] and "received" in scan.split("PushedFilters:")[1].split("ReadSchema")[0]
    checks = scratch_path(spark, "test-checks")
    table(spark, sf_dir, "monitor_checks").withColumn("date", F.to_date("start_check")).write.partitionBy("date").parquet(checks)
    plan = plan_of(uptime.heartbeat_state(table(spark, sf_dir, "monitors"), spark.read.parquet(checks), datetime(2001, 10, 28, 0, 2)))
    assert any("date" in p.split("PushedFilters")[0] and "start_check" in p.split("PushedFilters:")[1].split("ReadSchema")[0] for p in plan.split("PartitionFilters:")[1:])


def test_chained_merges_go_to_the_end(spark):
    import pytest
    from vigil.operators import issues

    rows = spark.createDataFrame([("a", 5, False), ("b", 3, False), ("c", 1, False), ("d", 2, False)], "issue_id string, count long, is_deleted boolean")
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "d")], "source_id string, target_id string")
    merged = {r["issue_id"]: (r["count"], r["is_deleted"]) for r in issues.merge_issues(rows, chain).collect()}
    assert merged["c"] == (9, False) and merged["a"][1] and merged["b"][1] and merged["d"] == (2, False)
    assert {r["issue_id"] for r in issues.repoint(rows.select("issue_id", "count"), chain).collect()} == {"c", "d"}
    with pytest.raises(ValueError):
        issues.final_targets(spark.createDataFrame([("a", "b"), ("b", "a")], "source_id string, target_id string"))
