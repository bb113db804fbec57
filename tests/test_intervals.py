"""Aggregates over overlapping intervals, counters of dense series, and bounded lookups, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise import session
from spanwise.operators import intervals as iv
from spanwise.operators import joins
from spanwise.operators import metrics
from spanwise.operators import snapshot as sn


@pytest.fixture
def many_ranges(spark):
    """Small range partitions stay apart, so that one series lies in several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("fan", [2, 8])
def test_quantiles_of_overlapping_intervals(spark, fan):
    chance = random.Random(6)
    points = [(chance.choice(["a", "b", None]), chance.randrange(500), chance.choice([None, 0, 1, 7, chance.randrange(10**6)])) for _ in range(400)]
    spans = [(k, chance.choice(["a", "b", "c", None]), lo, lo + chance.randrange(-5, 300)) for k, lo in enumerate(chance.choices(range(-20, 520), k=60))]
    spans += [(98, "a", 0, 500), (99, "a", 0, 500)]
    p, s = spark.createDataFrame(points, "g string, t long, v long"), spark.createDataFrame(spans, "id long, g string, lo long, hi long")
    got = {r.id: r.q for r in iv.interval_quantiles(p, s, "t", "lo", "hi", "v", 0.9, 100, ["g"], "q", fan).collect()}
    want = {}
    for k, g, lo, hi in spans:
        inside = [v for own, t, v in points if own == g and lo <= t <= hi and v is not None]
        if inside:
            want[k] = float(np.quantile(inside, 0.9))
    assert got == pytest.approx(want)


def test_quantiles_without_points(spark):
    p, s = spark.createDataFrame([], "t long, v double"), spark.createDataFrame([(1, 0, 5)], "id long, lo long, hi long")
    assert iv.interval_quantiles(p, s, "t", "lo", "hi", "v", 0.5, 10).collect() == []


def test_totals_by_group(spark):
    chance = random.Random(8)
    points = [(chance.choice("abc"), chance.randrange(100), chance.randrange(9)) for _ in range(150)]
    spans = [(k, lo, lo + chance.randrange(40)) for k, lo in enumerate(chance.choices(range(100), k=30))]
    p, s = spark.createDataFrame(points, "g string, t long, v long"), spark.createDataFrame(spans, "id long, lo long, hi long")
    got = {(r.id, r.g): (r.n, r.v) for r in iv.group_totals(p, s, "t", "lo", "hi", ["g"], {"v": "v"}, 20).collect()}
    want = {}
    for k, lo, hi in spans:
        for g in "abc":
            inside = [v for own, t, v in points if own == g and lo <= t <= hi]
            if inside:
                want[k, g] = len(inside), sum(inside)
    assert got == want


def test_interval_snapshot_without_traces(spark):
    spans = spark.createDataFrame([(1, 0, 10), (2, 100, 110)], "id long, lo long, hi long")
    traces = spark.createDataFrame([(5, "p", 40), (6, "p", 60)], "at_us long, pattern string, total_us long")
    samples = spark.createDataFrame([(1, "n", "s", "cpu", 0, 3.0)], "at_us long, node string, service string, metric string, metric_pos int, value double")
    found = spark.createDataFrame([(7, "s"), (7, "unmeasured")], "at_us long, service string")
    limits = spark.createDataFrame([("p", 50.0)], "pattern string, threshold double")
    rows = {r.id: r for r in sn.of_intervals(spans, traces, limits, samples, found, "lo", "hi", 50).collect()}
    assert (rows[1].total_requests, rows[1].mean_response_time, rows[1].p90_response_time, rows[1].deadline_miss_rate) == (2, 50.0, 58.0, 50.0)
    assert rows[1].anomaly_count == 2 and rows[1].services["s"].anomaly_count == 1 and set(rows[1].services) == {"s"}
    assert (rows[2].total_requests, rows[2].anomaly_count, rows[2].patterns) == (0, 0, None)


def test_growth_of_a_dense_series(spark, many_ranges):
    chance = random.Random(9)
    rows, counter = [], 0
    for k in range(3000):
        counter = 0 if chance.random() < 0.01 else counter + chance.randrange(4)
        rows.append(("hot", k // 3, k, float(counter)))
    rows += [("cold", 10 * k, k, float(k)) for k in range(30)]
    df = spark.createDataFrame(rows, "series string, ts_s long, pos long, value double").repartition(8)
    for range_s in (1, 7, 400, 5000):
        got = {(r.series, r.pos): r.increase for r in metrics.increase(df, ["series"], range_s, order=["pos"]).collect()}
        for name in ("hot", "cold"):
            mine = [r for r in rows if r[0] == name]
            steps = [0.0] + [b[3] if b[3] < a[3] else b[3] - a[3] for a, b in zip(mine, mine[1:])]
            total = np.cumsum(steps)
            for k, (_, ts, pos, _) in enumerate(mine):
                first = next(j for j, r in enumerate(mine) if r[1] > ts - range_s)
                assert got[name, pos] == total[k] - total[first]


def test_stage_at(spark):
    df = spark.createDataFrame([(0,), (9,), (10,), (25,), (None,)], "t long")
    got = {r.t: r.load for r in joins.stage_at(df, [(20, 2), (10, 1)], "t", "load").collect()}
    assert got == {0: 1, 9: 1, 10: 2, 25: 2, None: None}
    assert "Exchange" not in joins.stage_at(df, [(10, 1)], "t", "load")._jdf.queryExecution().toString()


def test_slots_inside_intervals(spark, many_ranges):
    """Counts and sums by slot from both ends: equal instants, empty and backward intervals, points without a slot or value."""
    chance = random.Random(4)
    points = [(chance.randrange(60), chance.choice([0, 1, 2, None]), chance.choice([0, 1, None]), chance.choice([None, 5, 10**10])) for _ in range(300)]
    spans = sorted({(lo, lo + chance.randrange(-3, 40)) for lo in chance.choices(range(-10, 70), k=80)})
    p, s = spark.createDataFrame(points, "t long, a int, b int, v long"), spark.createDataFrame(spans, "lo long, hi long")
    rows = iv.slot_totals(p, s, "t", "lo", "hi", ["a"], 3, ["b"], "v", 2).toPandas()
    backwards = (rows.hi < rows.lo).to_numpy()
    n, v = iv.inside(rows, "_n", backwards), iv.inside(rows, "_v", backwards)
    assert sorted(zip(rows.lo, rows.hi)) == spans
    for k, (lo, hi) in enumerate(zip(rows.lo, rows.hi)):
        within = [r for r in points if lo <= r[0] <= hi]
        assert n[k].tolist() == [sum(r[1] == j for r in within) for j in range(3)]
        assert v[k].tolist() == [sum(r[3] or 0 for r in within if r[2] == j) for j in range(2)]


def test_a_task_holds_no_whole_range(spark):
    """Ends are counted batch by batch, also where a range of time goes on in the next one or has points behind its last end."""
    chance = random.Random(6)
    points = [(chance.randrange(300), chance.choice([0, 1, None]), chance.choice([None, 3, -10**15])) for _ in range(500)]
    spans = sorted({(lo, lo + chance.randrange(-3, 200)) for lo in chance.choices(range(-10, 310), k=60)})
    p, s = spark.createDataFrame(points, "t long, a int, v long"), spark.createDataFrame(spans, "lo long, hi long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = iv.slot_totals(p, s, "t", "lo", "hi", ["a"], 2, ["a"], "v", 2)
        assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()
        rows = found.toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    backwards = (rows.hi < rows.lo).to_numpy()
    n, v = iv.inside(rows, "_n", backwards), iv.inside(rows, "_v", backwards)
    assert sorted(zip(rows.lo, rows.hi)) == spans
    for k, (lo, hi) in enumerate(zip(rows.lo, rows.hi)):
        within = [r for r in points if lo <= r[0] <= hi]
        assert n[k].tolist() == [sum(r[1] == j for r in within) for j in range(2)]
        assert v[k].tolist() == [sum(r[2] or 0 for r in within if r[1] == j) for j in range(2)]


def test_runs_have_a_largest_size(spark, tmp_path, monkeypatch):
    """Many points are cut into more runs, so that a task holds no fixed share of the table."""
    monkeypatch.setattr(iv, "POINTS", 40)
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    p = spark.createDataFrame([(k, k % 2, k * 37 % 400) for k in range(400)], "t long, c int, v long")
    s = spark.createDataFrame([(k * 10, k * 10 + 150) for k in range(25)], "lo long, hi long")
    got = {(r.lo, r.hi): r._q[2] for r in iv.group_quantiles(p, s, "t", "lo", "hi", "c", 2, "v", 0.9, 2).collect()}
    asked = [spark.read.parquet(str(d)) for d in tmp_path.glob("questions-*")]
    assert asked[0].agg(F.max("_run")).first()[0] > 5
    for (lo, hi), q in got.items():
        assert q == pytest.approx(float(np.quantile([k * 37 % 400 for k in range(400) if lo <= k <= hi], 0.9)))


@pytest.mark.parametrize("runs, asks", [(1, 1000), (5, 7)])
def test_quantiles_by_group_and_of_all(spark, runs, asks):
    chance = random.Random(5)
    points = [(chance.randrange(50), chance.randrange(3), chance.choice([None, 0, 1, chance.randrange(10**6)])) for _ in range(250)]
    spans = sorted({(lo, lo + chance.randrange(-2, 30)) for lo in chance.choices(range(-10, 60), k=40)})
    p, s = spark.createDataFrame(points, "t long, c int, v long"), spark.createDataFrame(spans, "lo long, hi long")
    got = {(r.lo, r.hi): r._q for r in iv.group_quantiles(p, s, "t", "lo", "hi", "c", 3, "v", 0.9, runs, asks).collect()}
    for lo, hi in spans:
        values = [[v for t, c, v in points if lo <= t <= hi and v is not None and own in (c, 3)] for own in range(4)]
        want = [float(np.quantile(x, 0.9)) if x else None for x in values]
        assert got.get((lo, hi), [None] * 4) == [x if x is None else pytest.approx(x) for x in want]


def test_interval_snapshots_write_little(spark, tmp_path, monkeypatch):
    """Of 400 overlapping intervals the parts that are stored take a row or two an interval and group, not one for each digit
    of a rank, node, service and metric."""
    chance = random.Random(3)
    spans = spark.createDataFrame([(k, 10 * k, 10 * k + 900) for k in range(400)], "id long, lo long, hi long")
    traces = spark.createDataFrame([(chance.randrange(5000), chance.choice("pq"), chance.randrange(10**6)) for _ in range(1500)],
                                   "at_us long, pattern string, total_us long")
    samples = spark.createDataFrame([(chance.randrange(5000), f"n{chance.randrange(5)}", f"s{chance.randrange(5)}", "cpu", k % 4, 1.0) for k in range(1500)],
                                    "at_us long, node string, service string, metric string, metric_pos int, value double")
    found = spark.createDataFrame([(5, "s1")], "at_us long, service string")
    limits = spark.createDataFrame([("p", 50.0)], "pattern string, threshold double")
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    assert sn.of_intervals(spans, traces, limits, samples, found, "lo", "hi", 900).count() == 400
    stored = sum(spark.read.parquet(str(d)).count() for d in tmp_path.iterdir())
    assert stored < 400 * 20 + 6 * 3000
