"""Small fixtures, one per rule that is easy to get wrong, with results worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from spanwise import dims
from spanwise.functions import scalars as sc
from spanwise.operators import attribution as at
from spanwise.operators import configs as cf
from spanwise.operators import experiment as ex
from spanwise.operators import islands as isl
from spanwise.operators import joins, metrics, ordered, prompts, risk
from spanwise.operators import traces as tr
from spanwise.operators.quantiles import quantiles, tail_mean
from spanwise.plans import bindings
from spanwise.functions.buckets import chunk, log_bucket
from spanwise.sources import configs as src_configs
from spanwise.sources import metrics as src_metrics
from spanwise.sources import snapshots as src_snapshots
from spanwise.sources import traces as src_traces

SPANS = "trace_id string, operation string, start_us bigint, duration_us bigint, span_pos bigint"
TRACES = "trace_id string, total_us bigint, pattern string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_last_span_wins_and_total_counts_all(spark):
    spans = spark.createDataFrame(
        [("t", "b", 50, 7, 0), ("t", "a", 40, 5, 1), ("t", "b", 60, 0, 2), ("u", "c", 1, 3, 0)], SPANS)
    out = tr.summarize(spans, ["c", "a", "b"])
    got = {r.trace_id: (r.start_us, r.total_us, dict(r.durations), r.pattern) for r in out.collect()}
    assert got == {"t": (40, 12, {"a": 5, "b": 0, "c": 0}, "100"), "u": (1, 3, {"a": 0, "b": 0, "c": 3}, "001")}
    assert tr.operations(spans) == ["a", "b", "c"]


def test_alignment_drops_unknown_operations_but_keeps_their_time(spark):
    spans = spark.createDataFrame([("t", "a", 1, 5, 0), ("t", "z", 2, 9, 1)], SPANS)
    row = tr.align(tr.summarize(spans, ["a", "z"]), ["a", "b"]).first()
    assert (row.total_us, dict(row.durations), row.pattern) == (14, {"a": 5, "b": 0}, "10")


def test_pattern_without_training_has_threshold_zero(spark):
    live = spark.createDataFrame([("1", 5, "10"), ("2", 7, "01")], TRACES)
    training = spark.createDataFrame([("3", 6, "10")], TRACES)
    limits = risk.thresholds(live, training)
    assert rows(limits) == [("01", 0.0), ("10", 6.0)]
    rates = {r.pattern: (r.miss_count, r.miss_rate) for r in risk.miss_rates(live, limits).collect()}
    assert rates == {"01": (1, 100.0), "10": (0, 0.0)}
    assert risk.overall_miss_rate(risk.miss_rates(live, limits)).first()[0] == 50.0
    assert rows(risk.thresholds(live, None)) == [("01", 7.0), ("10", 5.0)]


def test_no_traces_give_no_misses(spark):
    none = spark.createDataFrame([], TRACES)
    rates = risk.miss_rates(none, risk.thresholds(none, none))
    assert rates.count() == 0 and risk.overall_miss_rate(rates).first()[0] == 0.0


def test_tail_mean_with_ties(spark):
    df = spark.createDataFrame([(1.0,)] * 18 + [(9.0,)] * 2, "v double")
    assert tail_mean(df, "v", []).first()[0] == 9.0
    same = spark.createDataFrame([(4.0,)] * 3, "v double")
    assert tail_mean(same, "v", []).first()[0] == 4.0


@pytest.mark.parametrize("n", [1, 2, 3, 57])
def test_quantiles_match_linear_interpolation(spark, n):
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(n)
    values = np.concatenate([rng.normal(0, 1000, n), rng.integers(-3, 3, n).astype(float)])
    df = spark.createDataFrame([("k", float(v)) for v in values] + [("k", None)], "k string, v double")
    got = quantiles(df, "v", ["k"], {"a": 0.01, "b": 0.5, "c": 0.9}).first()
    for name, p in (("a", 0.01), ("b", 0.5), ("c", 0.9)):
        assert got[name] == pytest.approx(np.quantile(values, p), abs=1e-9)
    tail = values[values >= np.quantile(values, 0.95)].mean()
    assert tail_mean(df, "v", ["k"]).first()["cvar"] == pytest.approx(tail, abs=1e-9)


def test_buckets_keep_the_order(spark):
    values = sorted([0.0, -0.5, -8.0, -7.999999, 1e-300, 7.999999999999999, 8.0, 8.000000000000002, 1e300, -1e300, 3.0])
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", log_bucket(F.col("v")).alias("b"))
    found = [r.b for r in sorted(df.collect())]
    assert found == sorted(found)


def test_ordered_helpers_equal_plain_windows(spark):
    import random

    from pyspark.sql import Window

    rng = random.Random(3)
    data = [(rng.choice("aab"), i, rng.randint(0, 300), rng.choice([None, 1, 2])) for i in range(200)]
    df = spark.createDataFrame(data, "k string, id int, t int, x int")
    w = Window.partitionBy("k").orderBy("t", "id")
    want = df.select("id", F.row_number().over(w).cast("long").alias("rn"), F.lag("id").over(w).alias("p"),
                     F.lead("id").over(w).alias("n"), F.sum("t").over(w).alias("s"),
                     F.last("x", True).over(w).alias("x"))
    piece = chunk(F.col("t"), 7)
    by = ordered.numbered(df, ["k"], [piece, F.col("t")], [F.col("id")])
    near = ordered.neighbours(by, ["k"], chunk(F.col("t"), 7), ["t", "id"], {"p": "id"}, {"n": "id"})
    total = ordered.running_sums(near, ["k"], chunk(F.col("t"), 7), [F.col("t"), F.col("id")], {"s": "t"})
    got = ordered.carried(total, ["k"], chunk(F.col("t"), 7), ["t", "id"], ["x"]).select("id", "rn", "p", "n", "s", "x")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_interval_joins_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    pts = [(i, rng.choice("ab"), rng.randint(0, 400), rng.randint(1, 9)) for i in range(150)]
    spans = [(i, rng.choice("abc"), lo, lo + rng.randint(0, 90)) for i, lo in
             enumerate(rng.randint(-20, 420) for _ in range(60))]
    points = spark.createDataFrame(pts, "pid int, k string, t int, v int")
    intervals = spark.createDataFrame(spans, "iid int, k string, lo int, hi int")
    want = sorted((i, p) for i, k, lo, hi in spans for p, pk, t, _ in pts if pk == k and lo <= t <= hi)
    pairs = joins.interval_join(points, intervals, "t", "lo", "hi", 16, ["k"])
    assert rows(pairs.select("iid", "pid")) == want
    kept = joins.interval_join(points, intervals, "t", "lo", "hi", 16, ["k"], "left")
    assert {r.iid for r in kept.collect()} == {i for i, *_ in spans}
    totals = joins.interval_totals(points, intervals, "t", "lo", "hi", {"v": "v"}, 16, ["k"])
    expected = sorted((i, sum(1 for _, pk, t, _ in pts if pk == k and lo <= t <= hi),
                       sum(v for _, pk, t, v in pts if pk == k and lo <= t <= hi)) for i, k, lo, hi in spans)
    assert rows(totals.select("iid", "n", "v")) == expected


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_equals_brute_force(spark, forward, strict):
    left = [(i, t) for i, t in enumerate([-5, 0, 3, 10, 11, 40, 99])]
    right = [(0, "a"), (10, "b"), (30, "c"), (90, "d")]

    def find(t):
        ok = [(r, v) for r, v in right if (r > t if strict else r >= t) == forward and (r != t or not strict)
              or (r == t and not strict)]
        ok = [(r, v) for r, v in ok if (r >= t if forward else r <= t)]
        return (min(ok) if forward else max(ok))[1] if ok else None

    out = joins.asof(spark.createDataFrame(left, "i int, t int"), spark.createDataFrame(right, "s int, v string"),
                     "t", "s", ["v"], 8, forward=forward, strict=strict)
    assert {r.i: r.v for r in out.collect()} == {i: find(t) for i, t in left}


def test_counter_reset_and_pieces(spark):
    data = [("s", t, float(v)) for t, v in [(0, 1), (10, 4), (20, 2), (30, 5), (3600, 9), (3610, 1)]]
    df = spark.createDataFrame(data, "series string, ts_s bigint, value double")
    out = {r.ts_s: r.increase for r in metrics.increase(df, ["series"], 60).collect()}
    assert out == {0: 0.0, 10: 3.0, 20: 5.0, 30: 8.0, 3600: 0.0, 3610: 1.0}
    long = {r.ts_s: r.increase for r in metrics.increase(df, ["series"], 3600).collect()}
    assert long == {0: 0.0, 10: 3.0, 20: 5.0, 30: 8.0, 3600: 9.0, 3610: 8.0}


def test_increase_at_the_end(spark):
    data = [("s", t, float(v)) for t, v in [(0, 1), (10, 4), (20, 2), (3700, 5), (9000, 6)]]
    df = spark.createDataFrame(data, "series string, ts_s bigint, value double")
    assert rows(metrics.increase_at(df, ["series"], 8000, 8000)) == [("s", 5.0)]
    assert rows(metrics.increase_at(df, ["series"], 9000, 8995)) == [("s", 6.0)]


def test_step_grid_lookback_is_open_at_its_start(spark):
    df = spark.createDataFrame([("s", 0, 1.0), ("s", 7, 2.0)], "series string, ts_s bigint, value double")
    out = {r.step_s: r.value for r in metrics.step_grid(df, ["series"], 0, 400, 5).collect()}
    assert out[0] == out[5] == 1.0 and out[10] == out[305] == 2.0 and 310 not in out
    assert metrics.health_step(60) == (300, 30) and metrics.health_step(6000) == (6000, 600)


def test_restarts_round_half_to_even(spark):
    grown = spark.createDataFrame(
        [("srv-rate-1", 2.5), ("srv-rate-2", 3.5), ("srv-geo-1", 0.0), ("other", 4.0), ("srv-user-1", 0.4)],
        "pod string, increase double")
    restarts = metrics.restarts_by_service(grown, dims.POD_PREFIX_SERVICE)
    assert rows(restarts) == [("srv-rate", 6), ("srv-user", 0)]
    oom = spark.createDataFrame([("srv-rate-1",), ("srv-user-1",), ("srv-geo-1",)], "pod string")
    health = metrics.pod_health(restarts, oom, dims.POD_PREFIX_SERVICE)
    assert rows(health) == [("srv-rate", 6, True), ("srv-user", 0, False)]


def test_longest_prefix(spark):
    pods = ["srv-recommendation-7", "srv-recommend-7", "memcached-reservation-1", "memcached-reserve-1", "nothing", ""]
    df = spark.createDataFrame([(p,) for p in pods], "p string")
    got = [r[0] for r in df.select(sc.longest_prefix(F.col("p"), dims.POD_PREFIX_SERVICE)).collect()]
    assert got == ["srv-recommendation", "srv-recommendation", "memcached-reserve", "memcached-reserve", None, None]


def test_stable_hash_equals_hashlib(spark):
    import hashlib

    words = ["", "a", "run-17", "ünï"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    want = [int(hashlib.sha256(w.encode()).hexdigest(), 16) % 10000 for w in words]
    assert [r[0] for r in df.select(sc.stable_hash(F.col("w"))).collect()] == want


def test_only_one_candidate_is_looked_at(spark):
    kind = "trace_id string, total_us bigint, attribution array<struct<pos int, feature string, value double>>"
    data = [
        ("unmapped first", 1, [(0, "total", -5.0), (1, "op", -4.0)]),
        ("skipped then mapped", 2, [(0, "mongo_rate", -5.0), (1, "op", -4.0), (2, "x", -1.0)]),
        ("skipped then unmapped", 3, [(0, "mongo_rate", -5.0), (1, "total", -4.0), (2, "op", -3.0)]),
        ("tie keeps feature order", 4, [(0, "op", -1.0), (1, "total", -1.0)]),
    ]
    out = at.primary_service(spark.createDataFrame(data, kind), {"op": "x/srv", "mongo_rate": "db"})
    assert rows(out.select("trace_id", "service")) == [("skipped then mapped", "srv"), ("tie keeps feature order", "srv")]


SNAP = "ts_s bigint, phase string, subphase string"


def test_island_open_at_the_end_and_first_block_without_before(spark):
    parts = ["stabilization", "normal", "configuration_application", "stabilization", "normal", "stabilization"]
    df = spark.createDataFrame([(i * 60, "adaptation", s) for i, s in enumerate(parts)], SNAP)
    runs = isl.islands(df, "ts_s", F.col("subphase") == "stabilization")
    assert rows(runs) == [(1, 0, 60), (2, 180, 240), (3, 300, 300)]
    for c in ("mean_response_time", "p90_response_time", "sum_cpu_utilization_cores", "sum_memory_utilization_mb",
              "anomaly_rate", "deadline_miss_rate"):
        df = df.withColumn(c, F.col("ts_s").cast("double"))
    table = ex.effects(ex.window_means(isl.change_roles(df, "ts_s")))
    got = [(r.change_index, r.before_snapshots, r.during_snapshots, r.after_snapshots, r.effect_anomaly_rate,
            r.toxicity_anomaly_rate) for r in table.collect()]
    assert got == [(2, 1, 2, 1, 180.0, 0.0)]


def test_snapshot_without_time_is_an_error(spark):
    df = spark.createDataFrame([(None, None)], "collection_end_time string, timestamp string")
    with pytest.raises(Exception, match="missing a timestamp"):
        isl.snapshot_time(df).collect()


def test_zscore_without_spread_is_zero(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 1.0), ("b", 3.0)], "m string, v double")
    assert rows(ex.zscore(df, "v", ["m"]).select("m", "z")) == [("a", 0.0), ("a", 0.0), ("b", -1.0), ("b", 1.0)]


def test_every_name_at_every_snapshot_beyond_one_slot(spark):
    maps = spark.range(12_000).groupBy(F.pmod("id", F.lit(2)).alias("no")).agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat(F.lit("n"), F.col("id").cast("string")), F.lit(1.0)))).alias("m"))
    out = ex.dense(maps, "m", ex.names_in(maps, "m"), "name")
    assert rows(out.groupBy("no").agg(F.count("*"), F.countDistinct("name"), F.sum("value"))) == [
        (0, 12_000, 12_000, 6000.0), (1, 12_000, 12_000, 6000.0)]


def test_no_names_no_rows(spark):
    maps = spark.createDataFrame([(1, {})], "no int, m map<string,double>")
    out = ex.dense(maps, "m", ex.names_in(maps, "m"), "name")
    assert (out.columns, rows(out)) == (["no", "name", "value"], [])


def test_one_change_per_service_once_applied(spark):
    df = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, True), ("b", 4, True), ("b", 9, True)],
                               "service string, priority bigint, ok boolean")
    out = ex.first_per_service(df, 5, F.col("ok"))
    assert rows(out.select("priority", "skipped")) == [(1, False), (2, False), (3, True), (4, False)]


def docs_of(spark, docs):
    df = spark.createDataFrame([(s, i, json.dumps(d)) for s, i, d in docs], "service string, seq bigint, j string")
    return df.select("service", "seq", F.lit(None).cast("timestamp").alias("applied_at"),
                     F.parse_json("j").alias("doc"))


def test_parameters_of_documents(spark):
    env = [{"name": "A", "value": "1.5"}, {"name": "a", "value": "7"}, {"name": "B"}, {"name": "C", "value": "x.y"}]
    docs = docs_of(spark, [
        ("d", 1, {"kind": "Deployment", "spec": {"replicas": 2, "template": {"spec": {"containers": [
            {"resources": {"limits": {"cpu": "500m", "memory": "1Gi"}}, "env": env}]}}}}),
        ("e", 1, {"kind": "Deployment", "spec": {}}),
        ("m", 1, {"kind": "ConfigMap", "data": {"r": "2.0", "g": "30s", "z": "True", "n": "s", "v": "1.2s"}}),
    ])
    got = {(r.service, r.param): r.value_str if r.value_num is None else r.value_num for r in cf.flatten(docs).collect()}
    assert got == {
        ("d", "replicas"): 2.0, ("d", "cpu-limit"): 0.5, ("d", "cpu-request"): 0.0, ("d", "memory-limit"): 1024.0,
        ("d", "memory-request"): 0.0, ("d", "a"): 7.0, ("d", "c"): "x.y", ("e", "replicas"): 0.0,
        ("m", "r"): 2.0, ("m", "g"): 30.0, ("m", "z"): 1.0, ("m", "n"): "s", ("m", "v"): 1.2,
    }


def test_change_needs_both_versions(spark):
    def doc(**data):
        return {"kind": "ConfigMap", "data": data}

    docs = docs_of(spark, [("s", 0, doc(a="1", b="2")), ("s", 3, doc(a="1")), ("s", 5, doc(a="3", b="9")),
                           ("lone", 1, doc(a="1"))])
    assert rows(cf.changes(docs).select("seq", "param")) == [(5, "a")]
    stats = cf.change_stats(docs)
    assert [(r.service, r.updates, r.changed) for r in stats.collect()] == [("s", 2, ["a"])]


def test_unit_with_bad_number_raises_and_without_gives_zero(spark):
    df = spark.createDataFrame([("bad",)], "t string")
    assert df.select(sc.cpu_cores(F.col("t"))).first()[0] == 0.0
    with pytest.raises(Exception):
        df.select(sc.duration_seconds(F.lit("xs"))).collect()


def test_fixed_replicas(spark):
    docs = docs_of(spark, [
        ("mongodb-geo", 1, {"kind": "Deployment", "spec": {"replicas": 3, "x": 1}}),
        ("mongodb-rate", 1, {"kind": "Deployment", "spec": {"replicas": 1}}),
        ("mongodb-user", 1, {"kind": "Service"}), ("free", 1, {"kind": "Deployment", "spec": {"replicas": 3}})])
    out = {r.service: (r.altered, json.loads(r.j)) for r in cf.enforce_fixed(docs, dims.FIXED_REPLICA_SERVICES).select(
        "service", "altered", F.to_json("doc").alias("j")).collect()}
    assert out["mongodb-geo"] == (True, {"kind": "Deployment", "spec": {"replicas": 1, "x": 1}})
    assert out["mongodb-rate"][0] is False and out["free"][0] is False
    bounds = {"autoscaling.knative.dev/min-scale": "1", "autoscaling.knative.dev/max-scale": "1"}
    assert out["mongodb-user"] == (True, {"kind": "Service", "metadata": {"annotations": bounds}})


def test_constraint_lines(spark):
    text = cf.constraint_text(dims.bounds_table(spark)).first()[0].split("\n")
    assert text[:2] == ["  - autoscaling.knative.dev/min-scale: minimum 0", "    (Integer; 0 allows scale-to-zero)"]
    assert "  - autoscaling.knative.dev/window: allowed range ['6s', '1h']" in text
    assert "  - autoscaling.knative.dev/panic-window-percentage: allowed range [1.0, 100.0]" in text
    assert not any("max-scale-up-rate" in line for line in text)


def test_history_grows_by_one_per_pair(spark):
    for pairs, held in [(1, 2), (2, 4), (3, 5), (4, 6), (5, 7), (6, 8)]:
        df = spark.createDataFrame([("s", i) for i in range(2 * pairs)], "service string, seq bigint")
        kept = sorted(r.seq for r in prompts.kept_history(df, "service", "seq").collect())
        assert kept == list(range(2 * pairs - held, 2 * pairs))


def test_context_cut_counts_roles_and_blanks(spark):
    df = spark.createDataFrame([("k", 1, "user", "aaaa"), ("k", 2, "user", "bb"), ("k", 3, "assistant", "c")],
                               "k string, o bigint, role string, content string")
    # newest first: 9+2+1+2 = 14, then 14+1 + 4+2+2+2 = 25
    assert sorted(r.o for r in prompts.cut_context(df, "k", "o", 25).collect()) == [2, 3]
    assert sorted(r.o for r in prompts.cut_context(df, "k", "o", 24).collect()) == [3]
    kept = prompts.cut_context(df, "k", "o", 1000)
    assert prompts.context_text(kept, "k", "o").first()["text"] == "USER: aaaa\n\n USER: bb\n\n ASSISTANT: c"


def test_block_extraction_order_and_fallback(spark):
    texts = ["x ```yaml\na: 1\n``` y ```YAML\nb: 2\n```", "<yaml>\nc: 3\n</yaml>", "d: 4", "a: b: c\n\t- [",
             "```yaml\na: [\n```\n<yaml>\nz: 1\n</yaml>"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, response string")
    got = {r.i: r.yaml for r in prompts.extract_blocks(df).collect()}
    assert got == {0: "a: 1\n---\nb: 2\n", 1: "c: 3\n", 2: "d: 4", 3: None, 4: "z: 1\n"}


def test_texts_of_placement_and_health(spark):
    df = spark.createDataFrame(
        [({"n2": ({"b": 1.0, "a": 0.25},), "n1": ({},)}, {"s": (2, True), "q": (0, False), "o": (0, True)}), ({}, {})],
        "nodes map<string,struct<services map<string,double>>>, health map<string,struct<restarts bigint,oom_killed boolean>>")
    got = [tuple(r) for r in df.select(prompts.placement_text(F.col("nodes")), prompts.root_cause_text(
        F.col("health"))).collect()]
    assert got[0] == ("  n1: (no services)\n  n2: a=0.2, b=1.0",
                      prompts.HEALTH_TITLE + "\n  o: OOM_KILLED=True\n  s: restarts=2, OOM_KILLED=True")
    assert got[1] == (prompts.NO_PLACEMENT, prompts.NO_HEALTH)


def test_trace_document_in_one_file(spark, tmp_path):
    doc = {"data": [{"traceID": "t", "spans": [{"operationName": "a", "startTime": 5, "duration": 2},
                                               {"operationName": "a", "startTime": 4, "duration": 9}]}]}
    (tmp_path / "t.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "empty.json").write_text('{"data": []}')
    got = tr.summarize(src_traces.read_traces(spark, str(tmp_path)), ["a"]).collect()
    assert [(r.trace_id, r.start_us, r.total_us, r.durations["a"]) for r in got] == [("t", 4, 11, 9)]


def test_metric_files(spark, tmp_path):
    (tmp_path / "run_srv-rate_metrics.csv").write_text("Unnamed: 0,index,srv-rate_cpu\n0,5,1.5\n1,10,\n")
    (tmp_path / "run_total_metrics.csv").write_text("index,x\n5,1\n")
    got = rows(src_metrics.read_metric_csv(spark, f"{tmp_path}/run_*_metrics.csv").where("ts_s = 5").drop("ts"))
    assert got == [("srv-rate", 5, "srv-rate_cpu", 1.5)]
    body = {"data": {"result": [{"metric": {"node": "n"}, "values": [[7.9, "1.5"], [8.2, "2"]]}]}}
    (tmp_path / "r.json").write_text(json.dumps(body))
    back = src_metrics.with_labels(src_metrics.read_range_responses(spark, f"{tmp_path}/r.json"), ["node"])
    assert rows(back) == [("n", 7, 1.5), ("n", 8, 2.0)]


def test_config_files(spark, tmp_path):
    (tmp_path / "srv-a.yaml").write_text("kind: Deployment\nspec: {replicas: 1}\n")
    (tmp_path / "srv-a_2.yaml").write_text("kind: Deployment\nspec: {replicas: 3}\n")
    (tmp_path / "srv-a_3.yaml").write_text("a: [unclosed\n")
    (tmp_path / "srv-a_2.meta.json").write_text('{"applied_at": "2024-01-01T00:00:00Z"}')
    got = [(r.service, r.seq, r.applied_at is not None) for r in src_configs.read_configs(spark, str(tmp_path)).orderBy(
        "seq").collect()]
    assert got == [("srv-a", -1, False), ("srv-a", 2, True)]


def test_missing_snapshots_are_an_error(spark, tmp_path):
    with pytest.raises(Exception):
        src_snapshots.read_snapshots(spark, f"{tmp_path}/none.json").count()


def test_many_versions_take_few_files(spark, tmp_path):
    rows = [(f"s{k % 3}", k - 5, f"kind: A\nsize: {k}\n---\nsize: -1") for k in range(600)]
    rows += [("s0", 1000, "kind: A"), ("s0", 1000, "size: 7"), ("s7", None, "size: 8"), (None, 3, "size: 9"), ("s2", 2000, None), ("s2", 2001, "a: [")]
    src_configs.write_configs(spark.createDataFrame(rows, "service string, seq long, text string"), f"{tmp_path}/c")
    assert len(list(tmp_path.glob("c/*/*.txt"))) < 60
    size = F.try_variant_get("doc", "$.size", "int")
    got = [(r.service, r.seq, r.size) for r in src_configs.read_configs(spark, f"{tmp_path}/c", "*.txt").select(
        "service", "seq", size.alias("size")).collect()]
    want = [(f"s{k % 3}", k - 5, k) for k in range(600)]
    want += [("s0", 1000, 7), ("s7", -1, 8), ("__HIVE_DEFAULT_PARTITION__", 3, 9), ("s2", 2000, None)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_documents_of_a_small_file_are_dealt_over_all_tasks(spark, tmp_path):
    spark.range(400).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand"), F.lit("t").alias("p_type"),
                            (F.col("id") % 50).cast("int").alias("p_size")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    docs = cf.with_params(bindings.config_docs(spark, str(tmp_path)))
    tasks = docs.groupBy(F.spark_partition_id()).agg(F.sum(F.size("params"))).count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
