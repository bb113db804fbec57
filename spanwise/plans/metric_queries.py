"""Metric operators and joins over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwise import dims
from spanwise.functions import scalars as sc
from spanwise.operators import joins
from spanwise.operators import metrics as m
from spanwise.operators import risk
from spanwise.operators import snapshot as sn
from spanwise.plans import bindings as b
from spanwise.plans.registry import query
from spanwise.session import materialize

SERIES = ["service", "pod"]
COUNTERS = ["service"]
RANGE_S = 4 * 3600
def _hour():
    return (F.floor(F.col("ts_s") / 3600) * 3600).cast("long")


HOUR_SQL = "ts_s // 3600 * 3600"

GROWN_SQL = b.SAMPLES_SQL + f""",
prev AS (SELECT *, lag(counter) OVER (PARTITION BY service ORDER BY ts_s, event_id) AS p FROM ev),
stepped AS (SELECT *, sum(CASE WHEN p IS NULL THEN 0 WHEN counter < p THEN counter ELSE counter - p END)
  OVER (PARTITION BY service ORDER BY ts_s, event_id) AS grown FROM prev),
inc AS (SELECT *, grown - min(grown) OVER (PARTITION BY service ORDER BY ts_s
  RANGE BETWEEN {RANGE_S - 1} PRECEDING AND CURRENT ROW) AS increase FROM stepped)"""


@query("m1_counter_rate", f"WITH {GROWN_SQL} SELECT event_id, increase / {RANGE_S}.0 AS rate FROM inc")
def counter_rate(spark, sf_dir):
    return m.rate(b.samples(spark, sf_dir), COUNTERS, RANGE_S, "counter", ["event_id"]).select("event_id", "rate")


@query("m2_counter_increase", f"WITH {GROWN_SQL} SELECT event_id, increase FROM inc")
def counter_increase(spark, sf_dir):
    return m.increase(b.samples(spark, sf_dir), COUNTERS, RANGE_S, "counter", ["event_id"]).select(
        "event_id", "increase")


@query("m3_sum_by_node", f"WITH {b.SAMPLES_SQL} SELECT {HOUR_SQL} AS ts_s, node, sum(value) AS value FROM ev "
       "GROUP BY 1, 2")
def sum_by_node(spark, sf_dir):
    return m.sum_by(b.samples(spark, sf_dir).withColumn("ts_s", _hour()), ["ts_s", "node"])


@query("m4_count_by_node_service", f"WITH {b.SAMPLES_SQL} SELECT {HOUR_SQL} AS ts_s, node, service, count(*) AS value "
       "FROM ev GROUP BY 1, 2, 3")
def count_by_node_service(spark, sf_dir):
    return m.count_by(b.samples(spark, sf_dir).withColumn("ts_s", _hour()), ["ts_s", "node", "service"])


@query("m5_relabel", f"""WITH {b.SAMPLES_SQL} SELECT
  CASE WHEN regexp_full_match(workload_pod, '(srv-[a-z]+)-x([0-9]+)')
    THEN regexp_replace(workload_pod, '^(srv-[a-z]+)-x([0-9]+)$', '\\1') END AS configuration_name,
  count(*) AS n FROM ev GROUP BY 1""")
def relabel(spark, sf_dir):
    rows = m.relabel(b.samples(spark, sf_dir), "workload_pod", "(srv-[a-z]+)-x([0-9]+)", "$1", "configuration_name")
    return rows.groupBy("configuration_name").agg(F.count(F.lit(1)).alias("n"))


@query("m6_many_to_one_match", f"""WITH {b.SAMPLES_SQL},
info AS (SELECT ts_s, pod, service, sum(value) AS value FROM ev GROUP BY 1, 2, 3),
labels AS (SELECT ts_s, pod, max(node) AS node, count(*) AS value FROM ev GROUP BY 1, 2)
SELECT info.ts_s, pod, service, node, info.value * labels.value AS value FROM info JOIN labels USING (ts_s, pod)""")
def many_to_one_match(spark, sf_dir):
    ev = b.samples(spark, sf_dir)
    info = ev.groupBy("ts_s", "pod", "service").agg(F.sum("value").alias("value"))
    labels = ev.groupBy("ts_s", "pod").agg(F.max("node").alias("node"), F.count(F.lit(1)).alias("value"))
    return m.match_left(info, labels, ["ts_s", "pod"], ["node"])


@query("m7_utilisation", f"""WITH {b.SAMPLES_SQL},
used AS (SELECT {HOUR_SQL} AS ts_s, node, sum(value) AS value FROM ev WHERE service = 'click' GROUP BY 1, 2),
total AS (SELECT {HOUR_SQL} AS ts_s, node, sum(value) AS value FROM ev GROUP BY 1, 2)
SELECT ts_s, node, used.value * 100.0 / nullif(total.value, 0) AS utilisation_pct
FROM used JOIN total USING (ts_s, node)""")
def utilisation(spark, sf_dir):
    ev = b.samples(spark, sf_dir).withColumn("ts_s", _hour())
    used = m.sum_by(m.matching(ev, equal={"service": "click"}), ["ts_s", "node"])
    return m.utilisation(used, m.sum_by(ev, ["ts_s", "node"]), ["ts_s", "node"])


START_S = 1704067200  # 2024-01-01
STEP_S = 6 * 3600


@query("m8_step_grid", f"""WITH {b.SAMPLES_SQL},
grid AS (SELECT DISTINCT service, pod, {START_S} + k * {STEP_S} AS step_s
  FROM (SELECT DISTINCT service, pod FROM ev), (SELECT unnest(range(0, 125)) AS k))
SELECT g.service, g.pod, step_s, arg_max(value, (ts_s, event_id)) AS value FROM grid g JOIN ev
  ON ev.service = g.service AND ev.pod = g.pod AND ts_s > step_s - {b.DAY_S} AND ts_s <= step_s GROUP BY 1, 2, 3""")
def step_grid(spark, sf_dir):
    return m.step_grid(b.samples(spark, sf_dir), SERIES, START_S, START_S + 124 * STEP_S, STEP_S, b.DAY_S, ["event_id"])


@query("m9_instant", f"""WITH {b.SAMPLES_SQL} SELECT service, pod, arg_max(value, (ts_s, event_id)) AS value FROM ev
  WHERE ts_s > {START_S + 15 * b.DAY_S} - 432000 AND ts_s <= {START_S + 15 * b.DAY_S} GROUP BY 1, 2""")
def instant(spark, sf_dir):
    return m.instant(b.samples(spark, sf_dir), SERIES, START_S + 15 * b.DAY_S, 5 * b.DAY_S, ["event_id"])


@query("m10_label_matchers", f"""WITH {b.SAMPLES_SQL} SELECT service, count(*) AS n FROM ev WHERE node = 'node-1'
  AND container <> 'c0' AND regexp_full_match(pod, 'pod-1.*') GROUP BY 1""")
def label_matchers(spark, sf_dir):
    rows = m.matching(b.samples(spark, sf_dir), {"node": "node-1"}, {"container": "c0"}, {"pod": "pod-1.*"})
    return rows.groupBy("service").agg(F.count(F.lit(1)).alias("n"))


@query("m11_latest_revision", f"WITH {b.SAMPLES_SQL} SELECT service, max(pod) AS revision FROM ev GROUP BY 1")
def latest_revision(spark, sf_dir):
    return m.latest_revision(b.samples(spark, sf_dir).withColumnRenamed("pod", "revision"), "service", "revision")


WIDE_SQL = ", ".join(f"max(value) FILTER (metric = '{n}') AS {n}" for n in b.METRIC_NAMES)


@query("m12_wide_assembly", f"WITH {b.SAMPLES_SQL} SELECT {HOUR_SQL} AS index, {WIDE_SQL} FROM ev GROUP BY 1")
def wide_assembly(spark, sf_dir):
    ev = b.samples(spark, sf_dir).withColumn("index", _hour())
    return m.wide(ev, "index", F.col("metric"), "value", b.METRIC_NAMES)


@query("m13_first_series", f"""WITH {b.SAMPLES_SQL}, head AS (SELECT service, min(container) AS container FROM ev
  GROUP BY 1) SELECT service, container, count(*) AS n, sum(value) AS value FROM ev JOIN head
  USING (service, container) GROUP BY 1, 2""")
def first_series(spark, sf_dir):
    rows = m.first_series(b.samples(spark, sf_dir), ["service"], "container")
    return rows.groupBy("service", "container").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


EXTRA_CASE = "CASE " + " ".join(
    f"WHEN starts_with(workload_pod, '{p}') THEN '{s}'"
    for p, s in sorted(dims.EXTRA_WORKLOAD_PREFIX.items(), key=lambda kv: -len(kv[0]))) + " END"


@query("m14_extra_workloads", f"""WITH {GROWN_SQL},
extra AS (SELECT {EXTRA_CASE} AS service, 'container_memory_working_set_bytes' AS metric, {HOUR_SQL} AS ts_s,
    value FROM inc WHERE {EXTRA_CASE} IS NOT NULL
  UNION ALL SELECT {EXTRA_CASE}, 'container_cpu_usage_seconds_total', {HOUR_SQL}, increase
    FROM inc WHERE {EXTRA_CASE} IS NOT NULL),
base AS (SELECT CASE WHEN service = 'click' THEN 'mongodb-geo' ELSE service END AS service, metric,
  {HOUR_SQL} AS ts_s, value FROM ev)
SELECT service, metric, ts_s, sum(value) AS value FROM extra GROUP BY 1, 2, 3
UNION ALL SELECT service, metric, ts_s, sum(value) FROM base
  WHERE service NOT IN (SELECT service FROM extra) GROUP BY 1, 2, 3""")
def extra_workloads(spark, sf_dir):
    ev = b.samples(spark, sf_dir)
    grown = m.increase(ev, COUNTERS, RANGE_S, "counter", ["event_id"])
    pods = [F.col("workload_pod").alias("pod"), _hour().alias("ts_s")]
    named = F.when(F.col("service") == "click", F.lit("mongodb-geo")).otherwise(F.col("service"))
    base = ev.groupBy(named.alias("service"), "metric", _hour().alias("ts_s")).agg(F.sum("value").alias("value"))
    return m.extra_workloads(ev.select(*pods, "value"), grown.select(*pods, F.col("increase").alias("value")),
                             dims.EXTRA_WORKLOAD_PREFIX, base)


# --- joins ------------------------------------------------------------------------------------------------------

@query("j1_outer_merge", f"""WITH {b.SAMPLES_SQL},
a AS (SELECT ts_s AS index, sum(value) AS clicks FROM ev WHERE service = 'click' GROUP BY 1),
c AS (SELECT ts_s AS index, sum(value) AS errors FROM ev WHERE service = 'error' GROUP BY 1)
SELECT index, clicks, errors FROM a FULL JOIN c USING (index)""")
def outer_merge(spark, sf_dir):
    ev = b.samples(spark, sf_dir).withColumnRenamed("ts_s", "index")
    one = m.sum_by(m.matching(ev, {"service": "click"}), ["index"], name="clicks")
    two = m.sum_by(m.matching(ev, {"service": "error"}), ["index"], name="errors")
    return m.outer_merge(one, two)


PREFIX_CASE = "CASE " + " ".join(
    f"WHEN starts_with(workload_pod, '{p}') THEN '{s}'"
    for p, s in sorted(dims.POD_PREFIX_SERVICE.items(), key=lambda kv: -len(kv[0]))) + " END"


@query("j2_longest_prefix", f"WITH {b.SAMPLES_SQL} SELECT workload_pod AS pod, {PREFIX_CASE} AS service, count(*) AS n "
       "FROM ev GROUP BY 1, 2")
def longest_prefix(spark, sf_dir):
    service = sc.longest_prefix(F.col("workload_pod"), dims.POD_PREFIX_SERVICE).alias("service")
    return b.samples(spark, sf_dir).groupBy(F.col("workload_pod").alias("pod"), service).agg(
        F.count(F.lit(1)).alias("n"))


# Errors above 1.00 stand for anomalies; each lasts ten seconds per cent of its value.
SPELL_SQL = b.SAMPLES_SQL + """,
cents AS (SELECT *, CAST(value AS BIGINT) AS v FROM ev),
spell AS (SELECT event_id AS anomaly_id, ts_us, CASE WHEN event_id % 10 = 0 THEN 'gone' ELSE 'click' END AS service,
  CAST(value AS BIGINT) * 10000000 AS length_us FROM ev WHERE service = 'error' AND value > 100)"""


def _spells(ev):
    return ev.where((F.col("service") == "error") & (F.col("value") > 100)).select(
        F.col("event_id").alias("anomaly_id"), "ts_us",
        F.when(F.col("event_id") % 10 == 0, F.lit("gone")).otherwise(F.lit("click")).alias("service"),
        (F.col("value").cast("long") * 10_000_000).alias("length_us"))


def _cents(ev):
    return ev.select("service", F.col("ts_us").alias("at_us"), F.col("value").cast("long").alias("v"))


TEN_MIN_US = 600_000_000


def _totals(ev, before_us: int, after_us: int, on=()):
    spells = _spells(ev).withColumn("lo", F.col("ts_us") - before_us).withColumn(
        "hi", F.col("ts_us") + F.col("length_us") + after_us)
    return joins.interval_totals(_cents(ev), spells, "at_us", "lo", "hi", {"v": "v"}, TEN_MIN_US, on)


@query("j3_anomaly_traces", f"""WITH {SPELL_SQL} SELECT anomaly_id, count(c.ts_us) AS n,
  coalesce(CAST(sum(c.v) AS BIGINT), 0) AS v FROM spell s LEFT JOIN cents c
  ON c.ts_us BETWEEN s.ts_us AND s.ts_us + s.length_us GROUP BY 1""")
def anomaly_traces(spark, sf_dir):
    return _totals(b.samples(spark, sf_dir), 0, 0).select("anomaly_id", "n", "v")


@query("j4_anomaly_service_metrics", f"""WITH {SPELL_SQL} SELECT anomaly_id, s.service, count(c.ts_us) AS n,
  coalesce(CAST(sum(c.v) AS BIGINT), 0) AS v FROM spell s LEFT JOIN cents c
  ON c.service = s.service AND c.ts_us BETWEEN s.ts_us AND s.ts_us + s.length_us GROUP BY 1, 2""")
def anomaly_service_metrics(spark, sf_dir):
    return _totals(b.samples(spark, sf_dir), 0, 0, ["service"]).select("anomaly_id", "service", "n", "v")


@query("j5_context_window", f"""WITH {SPELL_SQL} SELECT anomaly_id, count(c.ts_us) AS n,
  CAST(sum(c.v) AS DOUBLE) / count(c.ts_us) AS mean_value FROM spell s LEFT JOIN cents c
  ON c.ts_us BETWEEN s.ts_us - 180000000 AND s.ts_us + s.length_us + 3000000 GROUP BY 1""")
def context_window(spark, sf_dir):
    rows = _totals(b.samples(spark, sf_dir), 180_000_000, 3_000_000)
    return rows.select("anomaly_id", "n", F.try_divide("v", "n").alias("mean_value"))


def _cells_sql(part: str, key: str, fields: dict[str, str], source: str) -> str:
    names = ", ".join(f"'{n}'" for n in fields)
    values = ", ".join(f"CAST({v} AS DOUBLE)" for v in fields.values())
    return f"SELECT anomaly_id, '{part}' AS part, {key} AS key, unnest([{names}]) AS field, unnest([{values}]) AS value FROM {source}"


_NODE_FIELDS = ("cpu_utilization_pct", "memory_utilization_pct", "cpu_usage_cores", "cpu_limit_cores")


@query("j5_context_snapshot", f"""WITH {SPELL_SQL},
var AS (SELECT container, quantile_cont(v, 0.95) AS q FROM cents GROUP BY 1),
limits AS (SELECT c.container, CAST(sum(v) AS DOUBLE) / count(*) AS threshold FROM cents c JOIN var USING (container) WHERE v >= q
  GROUP BY 1),
inside AS (SELECT anomaly_id, c.*, v > threshold AS late FROM spell s JOIN cents c
  ON c.ts_us BETWEEN s.ts_us - 180000000 AND s.ts_us + s.length_us + 3000000 JOIN limits USING (container)),
requests AS (SELECT anomaly_id, count(*) AS n, CAST(sum(v) AS DOUBLE) / count(*) AS mean, quantile_cont(v, 0.9) AS p90 FROM inside
  GROUP BY 1),
rates AS (SELECT anomaly_id, container, count(*) FILTER (late) * 100.0 / count(*) AS r, CAST(sum(v) AS DOUBLE) / count(*) AS mean,
  quantile_cont(v, 0.9) AS p90 FROM inside GROUP BY 1, 2),
means AS (SELECT anomaly_id, service, metric, min(metric_pos) AS pos, CAST(sum(v) AS DOUBLE) / count(*) AS mean FROM inside
  GROUP BY 1, 2, 3),
used AS (SELECT anomaly_id, service,
    coalesce(arg_min(mean, pos) FILTER (metric LIKE '%cpu%' AND mean <> 0), 0) AS cpu,
    coalesce(arg_min(mean, pos) FILTER (metric LIKE '%memory%' AND mean <> 0), 0) / 1048576 AS mem FROM means GROUP BY 1, 2),
totals AS (SELECT anomaly_id, coalesce(sum(mean) FILTER (metric LIKE '%cpu%' AND mean > 0), 0) AS cpu,
  coalesce(sum(mean) FILTER (metric LIKE '%memory%' AND mean > 0), 0) / 1048576 AS mem FROM means GROUP BY 1),
others AS (SELECT s.anomaly_id, o.service, count(*) AS k FROM spell s JOIN spell o
  ON o.ts_us BETWEEN s.ts_us - 180000000 AND s.ts_us + s.length_us + 3000000 GROUP BY 1, 2),
found AS (SELECT anomaly_id, sum(k) AS k FROM others GROUP BY 1),
overall AS (SELECT anomaly_id, avg(r) AS r FROM rates GROUP BY 1),
node_use AS (SELECT anomaly_id, node, {", ".join(f"avg(v) FILTER (metric_pos = {k}) AS m{k}" for k in range(4))} FROM inside GROUP BY 1, 2),
cells AS ({" UNION ALL ".join([
    _cells_sql("window", "''", {
        "total_requests": "coalesce(n, 0)", "mean_response_time": "coalesce(mean, 0)", "p90_response_time": "coalesce(p90, 0)",
        "deadline_miss_rate": "coalesce(o.r, 0)", "sum_cpu_utilization_cores": "coalesce(t.cpu, 0)",
        "sum_memory_utilization_mb": "coalesce(t.mem, 0)", "anomaly_count": "coalesce(k, 0)", "anomaly_rate": "coalesce(k * 100.0 / n, 0)"},
        "spell LEFT JOIN requests USING (anomaly_id) LEFT JOIN overall o USING (anomaly_id) LEFT JOIN totals t USING (anomaly_id) "
        "LEFT JOIN found USING (anomaly_id)"),
    _cells_sql("patterns", "container", {"deadline_miss_rate": "r", "mean_response_time": "mean", "p90_response_time": "p90"}, "rates"),
    _cells_sql("services", "u.service", {
        "anomaly_count": "coalesce(f.k, 0)", "anomaly_rate": "coalesce(f.k * 100.0 / n, 0)", "cpu_utilization_cores": "u.cpu",
        "memory_utilization_mb": "u.mem"}, "used u LEFT JOIN requests USING (anomaly_id) LEFT JOIN others f USING (anomaly_id, service)"),
    _cells_sql("nodes", "node", {n: f"m{k}" for k, n in enumerate(_NODE_FIELDS)}, "node_use"),
    _cells_sql("placement", "node || '/' || service", {"avg_pods": "count(*)"}, "inside GROUP BY anomaly_id, node, service"),
])})
SELECT anomaly_id, part, key, field, round(value, 6) AS value FROM cells WHERE value IS NOT NULL""")
def context_snapshot(spark, sf_dir):
    """The whole snapshot around each anomaly, from three minutes before it to three seconds behind it."""
    ev = materialize(b.samples(spark, sf_dir).withColumn("at_us", F.col("ts_us")), "samples")
    traces = ev.select("at_us", F.col("container").alias("pattern"), F.col("value").cast("long").alias("total_us"))
    spells = _spells(ev).select("anomaly_id", (F.col("ts_us") - 180_000_000).alias("lo"), (
        F.col("ts_us") + F.col("length_us") + 3_000_000).alias("hi"), F.col("ts_us").alias("at_us"), "service")
    limits = materialize(risk.deadlines(traces), "limits")
    rows = sn.of_intervals(spells.select("anomaly_id", "lo", "hi"), traces, limits, ev, spells.select("at_us", "service"), "lo", "hi",
                           12 * 3_600_000_000)
    return sn.flattened(rows, ["anomaly_id"]).withColumn("value", F.round("value", 6))


@query("j6_evaluation_window", f"""WITH {SPELL_SQL} SELECT anomaly_id AS change_id, count(c.ts_us) AS n,
  CAST(sum(c.v) AS DOUBLE) / nullif(count(c.ts_us), 0) AS mean_value FROM spell s LEFT JOIN cents c
  ON c.ts_us BETWEEN s.ts_us + 1200000000 AND s.ts_us + 1200000000 + 1800000000 GROUP BY 1""")
def evaluation_window(spark, sf_dir):
    """Half an hour of measurement that starts once twenty minutes of stabilisation are over."""
    ev = b.samples(spark, sf_dir)
    changes = _spells(ev).withColumn("lo", F.col("ts_us") + 1_200_000_000).withColumn(
        "hi", F.col("lo") + 1_800_000_000)
    rows = joins.interval_totals(_cents(ev), changes, "at_us", "lo", "hi", {"v": "v"}, TEN_MIN_US)
    return rows.select(F.col("anomaly_id").alias("change_id"), "n", F.try_divide("v", "n").alias("mean_value"))


RESTART_SQL = b.SAMPLES_SQL + f""",
err AS (SELECT * FROM ev WHERE service = 'error'),
prev AS (SELECT *, lag(counter) OVER (PARTITION BY workload_pod ORDER BY ts_s, event_id) AS p FROM err),
grown AS (SELECT workload_pod, sum(CASE WHEN p IS NULL THEN 0 WHEN counter < p THEN counter ELSE counter - p END)
  AS increase FROM prev GROUP BY 1),
restarts AS (SELECT {PREFIX_CASE} AS service, CAST(sum(round_even(increase, 0)) AS BIGINT) AS restarts FROM grown
  WHERE increase > 0 AND {PREFIX_CASE} IS NOT NULL GROUP BY 1),
oom AS (SELECT DISTINCT {PREFIX_CASE} AS service FROM ev WHERE service = 'view' AND value > 15000
  AND {PREFIX_CASE} IS NOT NULL),
health AS (SELECT r.service, restarts, o.service IS NOT NULL AS oom_killed FROM restarts r LEFT JOIN oom o
  ON o.service = r.service)"""


def _restarts(spark, sf_dir):
    ev = b.samples(spark, sf_dir)
    err = ev.where(F.col("service") == "error").withColumn("pod", F.col("workload_pod"))
    grown = m.increase_at(err, ["pod"], b.END_S, 31 * b.DAY_S, "counter", ["event_id"])
    return m.restarts_by_service(grown, dims.POD_PREFIX_SERVICE)


def _health(spark, sf_dir):
    oom = b.samples(spark, sf_dir).where((F.col("service") == "view") & (F.col("value") > 15000)).select(
        F.col("workload_pod").alias("pod"))
    return m.pod_health(_restarts(spark, sf_dir), oom, dims.POD_PREFIX_SERVICE)


@query("a13_restart_rollup", f"WITH {RESTART_SQL} SELECT service, restarts FROM restarts")
def restart_rollup(spark, sf_dir):
    return _restarts(spark, sf_dir)


@query("j7_oom_semi_join", f"WITH {RESTART_SQL} SELECT service, restarts, oom_killed FROM health")
def oom_semi_join(spark, sf_dir):
    return _health(spark, sf_dir)


@query("j8_service_health", f"""WITH {RESTART_SQL},
services AS (SELECT {PREFIX_CASE} AS service, count(*) AS n FROM ev GROUP BY 1)
SELECT s.service, n, CAST(restarts AS DOUBLE) AS restart_count, oom_killed FROM services s LEFT JOIN health h ON h.service = s.service
WHERE s.service IS NOT NULL""")
def service_health(spark, sf_dir):
    service = sc.longest_prefix(F.col("workload_pod"), dims.POD_PREFIX_SERVICE).alias("service")
    services = b.samples(spark, sf_dir).groupBy(service).agg(
        F.count(F.lit(1)).alias("n")).where(F.col("service").isNotNull())
    health = _health(spark, sf_dir).select("service", F.col("restarts").cast("double").alias("restart_count"),
                                           "oom_killed")
    return services.join(health, "service", "left")


@query("j9_node_placement", f"""WITH {b.SAMPLES_SQL},
usage AS (SELECT node, sum(value) AS used FROM ev WHERE node <> 'node-4' GROUP BY 1),
place AS (SELECT node, CAST(count(DISTINCT pod) AS DOUBLE) AS pods FROM ev WHERE node <> 'node-0' GROUP BY 1)
SELECT node, used, pods FROM usage FULL JOIN place USING (node)""")
def node_placement(spark, sf_dir):
    ev = b.samples(spark, sf_dir)
    usage = m.matching(ev, differ={"node": "node-4"}).groupBy("node").agg(F.sum("value").alias("used"))
    place = m.matching(ev, differ={"node": "node-0"}).groupBy("node").agg(F.countDistinct("pod").cast("double").alias("pods"))
    return usage.join(place, "node", "full")


STAGES_SQL = """stages AS (SELECT k * 86400 AS start, [500, 1000, 2000][k % 3 + 1] AS load FROM
  (SELECT unnest(range(1, 25)) AS k)),
clock AS (SELECT event_id, epoch_us(ts) // 1000000 - 1704067200 AS t FROM events)"""


@query("j12_load_stage", f"""WITH {STAGES_SQL},
pick AS (SELECT event_id, t, (SELECT arg_min(load, start) FROM stages WHERE clock.t < start) AS load FROM clock)
SELECT event_id, t, CAST(coalesce(load, (SELECT arg_max(load, start) FROM stages)) AS BIGINT) AS load FROM pick""")
def load_stage(spark, sf_dir):
    ev = b.samples(spark, sf_dir).select("event_id", (F.col("ts_s") - START_S).alias("t"))
    loads = (500, 1000, 2000)
    stages = [(k * b.DAY_S, loads[k % 3]) for k in range(1, 25)]
    return joins.stage_at(ev, stages, "t", "load").withColumn("load", F.col("load").cast("long"))


# --- metric aggregates ------------------------------------------------------------------------------------------

@query("a9_service_usage", f"""WITH {b.SAMPLES_SQL},
means AS (SELECT service, metric, min(metric_pos) AS pos, sum(value) / count(*) AS mean FROM ev GROUP BY 1, 2)
SELECT service,
  coalesce(arg_min(mean, pos) FILTER (metric LIKE '%cpu%' AND mean <> 0), 0) AS cpu_utilization_cores,
  coalesce(arg_min(mean, pos) FILTER (metric LIKE '%memory%' AND mean <> 0), 0) / 1048576 AS memory_utilization_mb
FROM means GROUP BY 1""")
def service_usage(spark, sf_dir):
    return m.usage_by_service(b.samples(spark, sf_dir))


@query("a10_cluster_totals", f"""WITH {b.SAMPLES_SQL},
means AS (SELECT service, metric, sum(value) / count(*) AS mean FROM ev GROUP BY 1, 2)
SELECT round(sum(mean) FILTER (metric LIKE '%cpu%' AND mean > 0), 6) AS sum_cpu_utilization_cores,
  round(sum(mean) FILTER (metric LIKE '%memory%' AND mean > 0) / 1048576, 9) AS sum_memory_utilization_mb FROM means""")
def cluster_totals(spark, sf_dir):
    out = m.cluster_totals(b.samples(spark, sf_dir))
    return out.select(F.round("sum_cpu_utilization_cores", 6).alias("sum_cpu_utilization_cores"),
                      F.round("sum_memory_utilization_mb", 9).alias("sum_memory_utilization_mb"))


NODE_METRIC_SQL = b.SAMPLES_SQL + f""",
node_samples AS (SELECT *, [{", ".join(repr(n) for n in m.NODE_METRICS)}][event_id % 6 + 1] AS node_metric FROM ev)"""
NODE_COLS_SQL = ", ".join(
    f"(sum(value) FILTER (node_metric = '{n}') / count(*) FILTER (node_metric = '{n}'))"
    + (f" / 1048576 AS {n.removesuffix('_bytes')}_mb" if n.endswith("_bytes") else f" AS {n}") for n in m.NODE_METRICS)


def node_samples(ev):
    names = F.array(*[F.lit(n) for n in m.NODE_METRICS])
    return ev.withColumn("metric", F.element_at(names, (F.col("event_id") % 6 + 1).cast("int")))


@query("a11_node_summary", f"WITH {NODE_METRIC_SQL} SELECT node, {NODE_COLS_SQL} FROM node_samples GROUP BY 1")
def node_summary(spark, sf_dir):
    return m.node_summary(node_samples(b.samples(spark, sf_dir)))


@query("a12_average_pods", f"""WITH {b.SAMPLES_SQL},
counts AS (SELECT {HOUR_SQL} AS ts_s, node, service, count(DISTINCT pod) AS value FROM ev GROUP BY 1, 2, 3)
SELECT node, service, CAST(sum(value) AS DOUBLE) / count(*) AS avg_pods FROM counts GROUP BY 1, 2""")
def average_pods(spark, sf_dir):
    counts = b.samples(spark, sf_dir).groupBy(_hour().alias("ts_s"), "node", "service").agg(
        F.countDistinct("pod").alias("value"))
    return m.average_pods(counts)


# --- scalar functions -------------------------------------------------------------------------------------------

HASH_SQL = "0"
for _i in range(8):
    HASH_SQL = f"(({HASH_SQL}) * 7296 + CAST('0x' || substr(h, {8 * _i + 1}, 8) AS BIGINT)) % 10000"


@query("f1_stable_hash", f"SELECT o_orderkey, {HASH_SQL} AS bucket FROM (SELECT o_orderkey, "
       "sha256(o_orderkey || '-' || o_orderpriority) AS h FROM orders)")
def stable_hash(spark, sf_dir):
    text = F.concat_ws("-", F.col("o_orderkey").cast("string"), "o_orderpriority")
    return b.table(spark, sf_dir, "orders").select("o_orderkey", sc.stable_hash(text).alias("bucket"))


@query("f2_iso_timestamps", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE epoch_us(ts) END AS us,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' END AS iso FROM events""")
def iso_timestamps(spark, sf_dir):
    ev = b.table(spark, sf_dir, "events")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
                    F.when(F.col("event_id") % 2 == 0, F.lit("Z")).otherwise(F.lit("+00:00")))
    text = F.when(F.col("event_id") % 5 == 0, F.lit("not a time")).otherwise(text)
    parsed = sc.iso_timestamp(text)
    return ev.select("event_id", F.coalesce(F.unix_micros(parsed), F.lit(-1)).alias("us"), sc.iso_text(parsed).alias("iso"))


@query("f3_suffix_routing", f"""WITH {NODE_METRIC_SQL} SELECT node, node_metric AS metric, count(*) AS n
  FROM node_samples GROUP BY 1, 2""")
def suffix_routing(spark, sf_dir):
    ev = node_samples(b.samples(spark, sf_dir))
    column = F.concat_ws("_", "node", "metric")
    metric, node = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in m.NODE_METRICS:
        hit = column.endswith(f"_{name}")
        metric = F.when(hit, F.lit(name)).otherwise(metric)
        node = F.when(hit, sc.strip_suffix(column, f"_{name}")).otherwise(node)
    return ev.groupBy(node.alias("node"), metric.alias("metric")).agg(F.count(F.lit(1)).alias("n"))


@query("f4_unit_scaling", f"""WITH {b.SAMPLES_SQL} SELECT event_id, value / 1000.0 AS ms, value / 1000000.0 AS s,
  value / 1048576.0 AS mib, value * 1000.0 AS millicores FROM ev""")
def unit_scaling(spark, sf_dir):
    v = F.col("value")
    return b.samples(spark, sf_dir).select(
        "event_id", sc.us_to_ms(v).alias("ms"), sc.us_to_s(v).alias("s"), sc.to_mib(v).alias("mib"),
        sc.to_millicores(v).alias("millicores"))
