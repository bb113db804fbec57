"""Streams over chunks of files."""

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from spanwise.operators import ordered as od
from spanwise.streaming import batches as ba
from spanwise.streaming import monitor as mo
from spanwise.streaming import slices as sl
from spanwise.streaming import state as st
from spanwise.streaming import windows as wi

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def run(df, path, name):
    q = (df.writeStream.format("parquet").option("path", f"{path}/{name}")
         .option("checkpointLocation", f"{path}/{name}-checkpoint").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")


def chunks(spark, path, schema, parts):
    """One file per part, in order of their names."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(
        f"{path}/in")


def test_edge_event_counts_twice_and_late_row_is_dropped(spark, tmp_path):
    # The third file closes the early windows with the next; the fifth comes too late for them.
    parts = [[(at(10),), (at(58),)], [(at(70),)], [(at(400),)], [(at(401),)], [(at(11),)], [(at(900),)]]
    stream = chunks(spark, str(tmp_path), "ts timestamp", parts)
    closed = wi.closed_windows(stream, "ts", [F.count(F.lit(1)).alias("n")])
    out = run(closed.select((F.unix_seconds("window.start") + 5).alias("w"), "n"), str(tmp_path), "out")
    base = int(START.replace(tzinfo=dt.timezone.utc).timestamp())
    got = {r.w - base: r.n for r in out.collect()}
    assert got[0] == 2 and got[60] == 2 and got[360] == 2


def test_event_on_the_padded_end_counts(spark):
    df = spark.createDataFrame([(at(65),), (at(66),)], "ts timestamp")
    w = wi.padded(F.col("ts"))
    rows = df.groupBy(w.alias("w")).count().select((F.unix_seconds("w.start") + 5).alias("w"), "count").collect()
    base = int(START.replace(tzinfo=dt.timezone.utc).timestamp())
    assert {r.w - base: r["count"] for r in rows} == {0: 1, 60: 2}


PHASES = [("r", 1, "window", None, None), ("r", 2, "phase", "adaptation", "normal"),
          ("r", 3, "phase", "adaptation", "stabilization"), ("r", 4, "window", None, None),
          ("r", 5, "window", None, None), ("r", 6, "window", None, None)]


@pytest.mark.parametrize("cut", [1, 3, 4])
def test_phase_takes_one_message_per_window(spark, tmp_path, cut):
    tags = st.phase_tags(f"{tmp_path}/tags")
    tags.start(chunks(spark, str(tmp_path), st.MESSAGES, [PHASES[:cut], PHASES[cut:]])).awaitTermination()
    got = [(r.seq, r.phase, r.subphase) for r in ba.results(spark, tags.folder, st.PHASES).orderBy("seq").collect()]
    assert got == [(1, *st.INITIAL_PHASE), (4, "adaptation", "normal"), (5, "adaptation", "stabilization"),
                   (6, "adaptation", "stabilization")]


def test_messages_of_a_hot_run_wait_in_order(spark, tmp_path):
    """Bursts of messages, windows that find none, and another run; a queue of Python's says what is right."""
    chance, rows, want = random.Random(4), [], []
    for run, n in (("hot", 900), ("cold", 20)):
        queue, current = collections.deque(), st.INITIAL_PHASE
        for seq in range(n):
            if chance.random() < 0.45:
                rows.append((run, seq, "phase", "adaptation", f"p{seq}"))
                queue.append(("adaptation", f"p{seq}"))
            else:
                rows.append((run, seq, "window", None, None))
                current = queue.popleft() if queue else current
                want.append((run, seq, *current))
    tags = st.phase_tags(f"{tmp_path}/tags")
    parts = [[r for r in rows if low <= r[1] < high] for low, high in ((0, 5), (5, 400), (400, 900))]
    tags.start(chunks(spark, str(tmp_path), st.MESSAGES, parts)).awaitTermination()
    assert sorted(map(tuple, ba.results(spark, tags.folder, st.PHASES).collect())) == sorted(want)


def test_ranges_spread_one_key(spark):
    rows = spark.range(200_000).withColumn("run", F.lit("hot")).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored, _ = od.ranged(rows, ["run"], [F.col("id")])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in stored.groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 50_000


@pytest.mark.parametrize("cuts", [[7], [2, 4, 5, 7], [1, 3, 7]])
def test_batch_is_released_when_n_wait(spark, tmp_path, cuts):
    rows = [("r", 1, 3.0, 1), ("r", 2, 1.0, 2), ("r", 3, 2.0, 3), ("r", 4, 9.0, 4), ("r", 5, 1.0, 5), ("r", 6, 1.0, 6),
            ("r", 7, 0.5, 7)]
    parts = [rows[low:high] for low, high in zip([0, *cuts], cuts)]
    released = st.anomaly_batches(f"{tmp_path}/released", 3)
    released.start(chunks(spark, str(tmp_path), st.ANOMALIES, parts)).awaitTermination()
    got = [(r.trace_id, r.priority) for r in ba.results(spark, released.folder, st.RELEASED).collect()]
    assert sorted(got) == sorted([(2, 1), (3, 2), (1, 3), (5, 1), (6, 2), (4, 3)])


def plain_discarding(rows, n, every):
    """A queue looked at when a window ends: the shortest n go, the rest is dropped."""
    out = []
    for run in sorted({r[0] for r in rows}):
        waiting, mine = [], [r for r in rows if r[0] == run]
        for slot in sorted({r[3] // every for r in mine}):
            waiting += sorted((d, at, t) for _, t, d, at in mine if at // every == slot)
            if len(waiting) >= n:
                out += [(run, t, d, k + 1) for k, (d, _, t) in enumerate(sorted(waiting)[:n])]
                waiting = []
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_backlog_is_dropped_after_a_release(spark, tmp_path, seed):
    chance = random.Random(seed)
    times = sorted(chance.randrange(1000) for _ in range(1500))
    rows = [("hot" if chance.random() < 0.9 else "cold", k, float(chance.randrange(40)), at) for k, at in enumerate(times)]
    cuts = sorted(chance.sample(range(1500), 3))
    parts = [rows[low:high] for low, high in zip([0, *cuts], [*cuts, 1500])]
    released = st.discarding_batches(f"{tmp_path}/released", 25, 10)
    released.start(chunks(spark, str(tmp_path), st.ANOMALIES, parts)).awaitTermination()
    held = ba.stored(spark, released.folder, "state", released.schema, [ba.last_batch(spark, released.folder)])
    assert max(r["count"] for r in held.groupBy("run", "slot").count().collect()) <= 25
    released.finish(spark, held.select("run", "trace_id", "duration_seconds", "enqueued_at").schema)
    got = [tuple(r) for r in ba.results(spark, released.folder, st.RELEASED).collect()]
    assert sorted(got) == plain_discarding(rows, 25, 10)


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    released = st.anomaly_batches(f"{tmp_path}/released", 2)
    rows = spark.createDataFrame([("r", k, float(k), k) for k in range(5)], st.ANOMALIES)
    for batch, low in ((0, 0), (1, 3), (1, 3)):
        released.run(rows.where(F.col("trace_id").between(low, low + 2 - low // 3)), batch)
    assert ba.results(spark, released.folder, st.RELEASED).count() == 4


def counts(rows, windows):
    n = rows.groupBy("window_us").agg(F.count(F.lit(1)).alias("n"))
    return windows.join(n, "window_us", "left").select("window_us", "window_end_us", F.coalesce("n", F.lit(0)).alias("n"))


def test_windows_close_when_all_sources_have_passed(spark, tmp_path):
    schema = "source string, at_us bigint"
    loop = ba.ClosedWindows(f"{tmp_path}/loop", ["a", "b"], counts, 10, 100, 135, 0, 2)
    parts = [[("a", 101), ("a", 99), ("a", 115), ("b", 105)], [("a", 125), ("a", 110), ("b", 113)], [("b", 122), ("a", 104), ("b", 118)],
             [("a", 134), ("b", 135)], [("a", None)]]
    out = []
    for batch, part in enumerate(parts):
        for _ in range(2):  # each batch is replayed
            loop.run(spark.createDataFrame(part, schema), batch)
        done = ba.results(spark, loop.folder, "window_us long, window_end_us long, n long").collect()
        out.append(sorted((r.window_us, r.n) for r in done))
    # Window 100 closes with b at 113, window 110 with b at 122; then a at 104 is late.
    assert out == [[], [(100, 2)], [(100, 2), (110, 4)], [(100, 2), (110, 4), (120, 2)], [(100, 2), (110, 4), (120, 2)]]
    assert len(ba.written(spark, loop.folder, "rows")) < len(parts)
    loop.finish(spark, spark.createDataFrame([], schema).schema)
    done = ba.results(spark, loop.folder, "window_us long, window_end_us long, n long").collect()
    assert max((r.window_us, r.window_end_us, r.n) for r in done) == (130, 135, 1)
    assert [tuple(r) for r in loop.late_rows(spark).collect()] == [(100, 1)]


def test_padded_windows_share_rows_at_their_edges(spark, tmp_path):
    loop = ba.ClosedWindows(f"{tmp_path}/loop", ["a"], counts, 10, 0, 30, 2, 0)
    rows = spark.createDataFrame([("a", at) for at in (-3, -2, 7, 8, 12, 13, 32, 33)], "source string, at_us bigint")
    loop.run(rows, 0)
    loop.finish(spark, rows.schema)
    done = ba.results(spark, loop.folder, "window_us long, window_end_us long, n long").collect()
    assert sorted((r.window_us, r.n) for r in done) == [(0, 4), (10, 3), (20, 1)]


def test_slices_of_streams_equal_tables(spark, tmp_path):
    base = 10**12  # Spark's first watermark is the epoch itself
    points = [(k, "s" if k % 3 else "t", base + 1_000_000 * k) for k in range(0, 100, 4)]
    spells = [(3, "none", 0, 5_000_000), (1, "s", 3_000_000, 8_000_000), (2, "s", 50_500_000, 50_900_000), (4, "t", 90_000_000, 96_000_000)]
    spells = [(i, s, base + lo, base + hi) for i, s, lo, hi in spells]
    end = [(None, "end", base + 10**9)], [(None, "end", base + 10**9, base + 10**9)]
    schemas = "point long, s string, at_us long", "spell long, s string, lo_us long, hi_us long"
    chunked = [chunks(spark, f"{tmp_path}/{i}", schemas[i], [rows[: len(rows) // 2], rows[len(rows) // 2 :], last]) for i, (rows, last) in enumerate(zip((points, spells), end))]
    joined = sl.interval_slices(*chunked, "at_us", "lo_us", "hi_us", 10_000_000, on=["s"])
    got = run(joined, str(tmp_path), "slices").where("spell IS NOT NULL").select("spell", "point").collect()
    want = [(i, p) for i, s, lo, hi in spells for p, t, at in points if s == t and lo <= at <= hi]
    want += [(i, None) for i, s, lo, hi in spells if not any(s == t and lo <= at <= hi for _, t, at in points)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    with pytest.raises(Exception, match="longer than"):
        tables = spark.createDataFrame(points, schemas[0]), spark.createDataFrame(spells, schemas[1])
        sl.interval_slices(*tables, "at_us", "lo_us", "hi_us", 5_500_000, on=["s"]).collect()


def slice_rows(points, spells):
    return ([("points", at, s, k, None, None) for k, s, at in points]
            + [("intervals", lo, s, None, k, hi) for k, s, lo, hi in spells])


def test_closed_slices_equal_tables(spark, tmp_path):
    """Points and intervals of three services in four batches, each replayed; some rows twice, some without service."""
    chance, names = random.Random(5), ["s", "t", None]
    points = [(k, chance.choice(names), chance.randrange(1000)) for k in range(300)]
    spells = [(k, chance.choice([*names, "gone"]), lo, lo + chance.randrange(90)) for k, lo in enumerate(chance.choices(range(1000), k=120))]
    points, spells = points + points[:9], spells + spells[:5] + [(200, "s", 500, None)]
    loop = sl.ClosedSlices(f"{tmp_path}/loop", ["point"], ["spell"], "hi_us", 100, 20, ["s"], 3)
    schema = "source string, at_us long, s string, point long, spell long, hi_us long"
    rows = slice_rows(points, spells)
    for batch, low in enumerate(range(0, 1000, 250)):
        part = [r for r in rows if low <= r[1] < low + 250]
        for _ in range(2):
            loop.run(spark.createDataFrame(part, schema), batch)
        held = ba.stored(spark, loop.folder, "held", schema, [batch]).agg(F.min("at_us")).first()[0]
        assert held >= low + 250 - 150  # of what has passed, only what may still be needed
    loop.finish(spark, spark.createDataFrame([], schema).schema)
    want = []
    for k, s, lo, hi in spells:
        inside = [p for p, t, at in points if s is not None and s == t and hi is not None and lo <= at <= hi]
        want += [(k, s, p) for p in inside or [None]]
    got = [(r.spell, r.s, r.point) for r in ba.results(spark, loop.folder).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    late = [("points", 10, "s", 999, None, None), ("intervals", 990, "s", None, 998, 1200)]
    with pytest.raises(Exception, match="longer than"):
        sl.ClosedSlices(f"{tmp_path}/other", ["point"], ["spell"], "hi_us", 100, 20, ["s"]).run(spark.createDataFrame(late, schema), 0)


def test_a_point_meets_only_the_intervals_of_its_cell(spark, tmp_path):
    """Of a day with 4,000 points and 4,000 short intervals the join looks at pairs in cells, not at all of the day."""
    day = 86_400
    points = spark.range(4000).select(F.lit("points").alias("source"), (F.col("id") * 20).alias("at_us"), F.col("id").alias("point"))
    spells = spark.range(4000).select(F.lit("intervals").alias("source"), (F.col("id") * 20 + 5).alias("at_us"), F.col("id").alias("spell"),
                                      (F.col("id") * 20 + 25).alias("hi_us"))
    loop = sl.ClosedSlices(f"{tmp_path}/loop", ["point"], ["spell"], "hi_us", day, 100)
    rows = points.unionByName(spells, allowMissingColumns=True)
    near = loop._pairs(rows.where("source = 'points'"), rows.where("source = 'intervals'"))
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join Inner" in line)
    assert "_cell" in join and "_piece" in join
    loop.finish(spark, rows.schema)
    loop.run(rows, 1, True)
    assert ba.results(spark, loop.folder).where("point = spell + 1").count() == 3999


def test_pairs_of_slices_are_not_stored(spark, tmp_path):
    """300 points inside 300 intervals: 90,000 pairs are given out, and a batch writes no more rows than came."""
    chance = random.Random(8)
    points = [(k, "s" if k < 300 else chance.choice(["t", None]), 500 + k % 40) for k in range(340)]
    spells = [(k, "s", 400 + k % 90, 560 + k % 7) for k in range(300)]
    spells += [(300 + k, chance.choice(["t", "gone", None]), lo, lo + chance.randrange(-2, 60)) for k, lo in enumerate(chance.choices(range(450, 600), k=60))]
    spells += spells[-5:] + [(400, "t", 500, None)]
    schema = "source string, at_us long, s string, point long, spell long, hi_us long"
    rows = slice_rows(points, spells)
    loop = sl.LandedSlices(f"{tmp_path}/loop", ["point"], ["spell"], "hi_us", 200, 20, ["s"], 3)
    parts = [[r for r in rows if low <= r[1] < low + 80] for low in range(400, 640, 80)]
    for batch, part in enumerate(parts):
        for _ in range(2):
            loop.run(spark.createDataFrame(part, schema), batch)
        if batch == 1:
            late = [("points", 380, "s", 999, None, None)]
            parts[2] += late
    loop.finish(spark, spark.createDataFrame([], schema).schema)
    want = []
    for k, s, lo, hi in spells:
        inside = [p for p, t, at in points if s is not None and s == t and hi is not None and lo <= at <= hi]
        want += [(k, s, p) for p in inside or [None]]
    got = [(r.spell, r.s, r.point) for r in loop.slices(spark).collect()]
    assert len(got) > 90_000 and sorted(got, key=repr) == sorted(want, key=repr)
    stored = sum(spark.read.parquet(ba.numbered_path(loop.folder, kind, k)).count() for kind in ("out", "landed", "held")
                 for k in ba.written(spark, loop.folder, kind))
    assert stored <= 2 * len(rows)


def test_pairs_of_a_point_come_together(spark, tmp_path):
    """Rows are given out point by point in time, not interval by interval: a point's columns change once for all its intervals."""
    chance = random.Random(3)
    points = [(k, chance.choice("st"), chance.randrange(400)) for k in range(200)]
    spells = [(k, chance.choice("st"), lo, lo + chance.randrange(150)) for k, lo in enumerate(chance.choices(range(400), k=200))]
    rows = spark.createDataFrame(slice_rows(points, spells), "source string, at_us long, s string, point long, spell long, hi_us long")
    for on in ([], ["s"]):
        loop = sl.LandedSlices(f"{tmp_path}/loop{len(on)}", ["point"], ["spell"], "hi_us", 200, 50, on)
        kept = rows if on else rows.drop("s")
        loop.run(kept, 0)
        loop.finish(spark, kept.schema)
        got = loop.slices(spark).where("point IS NOT NULL").select("*", F.spark_partition_id().alias("task")).collect()
        assert len(got) > 2000
        turns = [(r.task, r.point) for r, before in zip(got, [None, *got]) if before is None or (r.task, r.point) != (before.task, before.point)]
        assert len(turns) == len(set(turns)) == len({r.point for r in got})


@pytest.mark.parametrize("size", [9, 40])
def test_loop_equals_batch(spark, tmp_path, size):
    """Windows are cut by batches, traces too; late batches may still add to a window that is open."""
    schema = "trace_id string, operation string, start_us bigint, duration_us bigint, span_pos bigint"
    base = int(START.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    minute = 60_000_000
    rows = [(f"t{m}-{i}", op, base + m * minute + 20_000_000 + i, 10 * i + m + 1, 0) for m in range(3) for i in range(6)
            for op in ("a", "b")]
    rows.append(("only-a", "a", base + 2 * minute + 30_000_000, 5, 0))
    rows.append(("end", "a", base + 9 * minute + 30_000_000, 5, 0))
    parts = [rows[k:k + size] for k in range(0, len(rows), size)]
    limits = spark.createDataFrame([("11", 40.0)], "pattern string, threshold double")
    stream = chunks(spark, str(tmp_path), schema, parts)
    mo.monitor(stream, limits, ["a", "b"], f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = [(r.window_us, (r.total_requests, r.mean_response_time, r.deadline_miss_rate))
           for r in spark.read.json(f"{tmp_path}/out").collect()]
    assert len(got) == 3
    want = {}
    for m in range(3):
        totals = [2 * (10 * i + m + 1) for i in range(6)]
        rate = 100.0 * sum(t > 40 for t in totals) / 6
        if m == 2:  # a pattern without a deadline always misses it
            totals, rate = [*totals, 5], (rate + 100.0) / 2
        want[base + m * minute] = (len(totals), pytest.approx(sum(totals) / len(totals)), pytest.approx(rate))
    assert dict(got) == want
