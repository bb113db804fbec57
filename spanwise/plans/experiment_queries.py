"""Snapshots and experiment analysis over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwise.operators import experiment as ex
from spanwise.operators import islands as isl
from spanwise.operators import metrics as m
from spanwise.operators import risk
from spanwise.operators import snapshot as sn
from spanwise.operators import traces as tr
from spanwise.plans import bindings as b
from spanwise.plans.registry import query
from spanwise.plans.trace_queries import anomalies_of
from spanwise.session import materialize


def _snapshots(spark, sf_dir):
    """Snapshots are a stored table: several branches read them."""
    return materialize(b.snapshots(spark, sf_dir), "snapshots")


def _rounded(df, names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("w1_snapshot_time", f"WITH {b.SNAPSHOTS_SQL} SELECT snapshot_no, ts_s FROM snap")
def snapshot_time(spark, sf_dir):
    rows = isl.snapshot_time(b.snapshots(spark, sf_dir).drop("ts_s"))
    return rows.orderBy("ts").select("snapshot_no", F.unix_seconds("ts").alias("ts_s"))


@query("w2_stabilization_islands", f"""WITH {b.SNAPSHOTS_SQL},
a AS (SELECT *, subphase = 'stabilization' AS f, lag(subphase = 'stabilization') OVER (ORDER BY ts_s) AS p,
  lead(ts_s) OVER (ORDER BY ts_s) AS nxt FROM snap),
g AS (SELECT *, sum(CASE WHEN f AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (ORDER BY ts_s) AS run_no FROM a)
SELECT CAST(run_no AS BIGINT) AS run_no, min(ts_s) AS start, max(coalesce(nxt, ts_s)) AS "end" FROM g WHERE f
GROUP BY 1""")
def stabilization_islands(spark, sf_dir):
    return isl.islands(_snapshots(spark, sf_dir), "ts_s", F.col("subphase") == "stabilization")


BLOCKS_SQL = b.SNAPSHOTS_SQL + """,
adapt AS (SELECT *, subphase IN ('stabilization', 'configuration_application') AS f FROM snap
  WHERE phase = 'adaptation'),
lagged AS (SELECT *, coalesce(lag(f) OVER (ORDER BY ts_s), false) AS p, lead(ts_s) OVER (ORDER BY ts_s) AS nxt
  FROM adapt),
blocks AS (SELECT *, CAST(sum(CASE WHEN f AND NOT p THEN 1 ELSE 0 END) OVER (ORDER BY ts_s) AS BIGINT) AS k
  FROM lagged),
roles AS (SELECT *, k AS change_index, CASE WHEN f THEN 'during' ELSE 'after' END AS role FROM blocks
  UNION ALL SELECT *, k + 1, 'before' FROM blocks WHERE NOT f)"""


@query("w3_change_blocks", f"""WITH {BLOCKS_SQL} SELECT k AS run_no, min(ts_s) AS start,
  max(coalesce(nxt, ts_s)) AS "end" FROM blocks WHERE f GROUP BY 1""")
def change_blocks(spark, sf_dir):
    rows = _snapshots(spark, sf_dir).where(F.col("phase") == "adaptation")
    return isl.islands(rows, "ts_s", F.col("subphase").isin(*isl.CHANGE_SUBPHASES))


@query("w4_change_windows", f"SELECT * FROM (WITH {BLOCKS_SQL} SELECT snapshot_no, change_index, role FROM roles)")
def change_windows(spark, sf_dir):
    return isl.change_roles(_snapshots(spark, sf_dir), "ts_s").select("snapshot_no", "change_index", "role")


def _role_means_sql():
    cols = []
    for role in ex.ROLES:
        cols.append(f"count(*) FILTER (role = '{role}') AS {role}_snapshots")
        for name, column, times, over in ex.EFFECT_METRICS:
            cols.append(f"avg(coalesce({column}, 0) * {times} / {over}) FILTER (role = '{role}') AS {role}_{name}")
    keep = " AND ".join(f"count(*) FILTER (role = '{r}') > 0" for r in ex.ROLES)
    return BLOCKS_SQL + f""",
means AS (SELECT change_index, {", ".join(cols)} FROM roles GROUP BY 1 HAVING {keep})"""


MEANS_SQL = _role_means_sql()
MEAN_NAMES = [f"{r}_{n}" for r in ex.ROLES for n, *_ in ex.EFFECT_METRICS]
EFFECT_NAMES = [f"{k}_{n}" for k in ("effect", "toxicity") for n, *_ in ex.EFFECT_METRICS]
EFFECT_SQL = ", ".join(
    [f"after_{n} - before_{n} AS effect_{n}" for n, *_ in ex.EFFECT_METRICS]
    + [f"during_{n} - (before_{n} + after_{n}) / 2.0 AS toxicity_{n}" for n, *_ in ex.EFFECT_METRICS])
EFFECT_LONG_SQL = " UNION ALL ".join(
    f"SELECT change_index, '{k}' AS kind, '{n}' AS metric, {k}_{n} AS value FROM effects"
    for k in ("effect", "toxicity") for n, *_ in ex.EFFECT_METRICS)


def _means(spark, sf_dir):
    return ex.window_means(isl.change_roles(_snapshots(spark, sf_dir), "ts_s"))


@query("a16_window_means", f"""WITH {MEANS_SQL} SELECT change_index, before_snapshots, during_snapshots,
  after_snapshots, {", ".join(f"round({n}, 6) AS {n}" for n in MEAN_NAMES)} FROM means""")
def window_means(spark, sf_dir):
    return _rounded(_means(spark, sf_dir), MEAN_NAMES)


@query("a17_effect_and_toxicity", f"""WITH {MEANS_SQL}, effects AS (SELECT change_index, {EFFECT_SQL} FROM means)
  SELECT change_index, {", ".join(f"round({n}, 6) AS {n}" for n in EFFECT_NAMES)} FROM effects""")
def effect_and_toxicity(spark, sf_dir):
    return _rounded(ex.effects(_means(spark, sf_dir)), EFFECT_NAMES).select("change_index", *EFFECT_NAMES)


@query("a18_effect_spread", f"""WITH {MEANS_SQL}, effects AS (SELECT change_index, {EFFECT_SQL} FROM means),
long AS ({EFFECT_LONG_SQL})
SELECT kind, metric, count(value) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS low,
  round(max(value), 6) AS high, round(quantile_cont(value, 0.25), 6) AS q25,
  round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75 FROM long GROUP BY 1, 2""")
def effect_spread(spark, sf_dir):
    rows = ex.effect_rows(ex.effects(_means(spark, sf_dir)))
    return _rounded(ex.spread(rows, "value", ["kind", "metric"]), ["mean", "low", "high", "q25", "median", "q75"])


@query("w12_effect_zscore", f"""WITH {MEANS_SQL}, effects AS (SELECT change_index, {EFFECT_SQL} FROM means),
long AS ({EFFECT_LONG_SQL}),
stats AS (SELECT kind, metric, avg(value) AS mu, stddev_pop(value) AS sd FROM long GROUP BY 1, 2)
SELECT change_index, kind, metric, round(CASE WHEN sd > 0 THEN (value - mu) / sd ELSE 0 END, 6) AS z
FROM long JOIN stats USING (kind, metric)""")
def effect_zscore(spark, sf_dir):
    rows = ex.zscore(ex.effect_rows(ex.effects(_means(spark, sf_dir))), "value", ["kind", "metric"])
    return rows.select("change_index", "kind", "metric", F.round("z", 6).alias("z"))


_BOXES_SQL = " UNION ALL ".join(
    f"SELECT role, '{n}' AS metric, {column} * {times} / {over} AS value FROM roles"
    for n, column, times, over in ex.EFFECT_METRICS)


@query("a19_role_boxes", f"""WITH {BLOCKS_SQL},
long AS ({_BOXES_SQL})
SELECT metric, role, count(value) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS low,
  round(max(value), 6) AS high, round(quantile_cont(value, 0.25), 6) AS q25,
  round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75 FROM long GROUP BY 1, 2""")
def role_boxes(spark, sf_dir):
    roles = isl.change_roles(_snapshots(spark, sf_dir), "ts_s")
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), (F.col(column) * times / over).alias("value"))
                      for n, column, times, over in ex.EFFECT_METRICS])
    rows = roles.select("role", F.explode(pairs).alias("_m")).select("role", "_m.*")
    return _rounded(ex.spread(rows, "value", ["metric", "role"]), ["mean", "low", "high", "q25", "median", "q75"])


@query("p1_response_series", f"""WITH {b.SNAPSHOTS_SQL} SELECT ts_s, mean_response_time / 1000.0 AS mean_ms,
  p90_response_time / 1000.0 AS p90_ms FROM snap""")
def response_series(spark, sf_dir):
    return b.snapshots(spark, sf_dir).select("ts_s", (F.col("mean_response_time") / 1000.0).alias("mean_ms"),
                                             (F.col("p90_response_time") / 1000.0).alias("p90_ms"))


@query("p2_rate_series", f"WITH {b.SNAPSHOTS_SQL} SELECT ts_s, deadline_miss_rate, anomaly_rate, total_requests "
       "FROM snap")
def rate_series(spark, sf_dir):
    return b.snapshots(spark, sf_dir).select("ts_s", "deadline_miss_rate", "anomaly_rate", "total_requests")


@query("p3_usage_series", f"""WITH {b.SNAPSHOTS_SQL} SELECT ts_s, sum_cpu_utilization_cores AS total_cpu,
  sum_memory_utilization_mb AS total_memory FROM snap""")
def usage_series(spark, sf_dir):
    """Odd snapshots carry the older column names."""
    odd = F.col("snapshot_no") % 2 == 1
    cpu, mem = F.col("sum_cpu_utilization_cores"), F.col("sum_memory_utilization_mb")
    rows = b.snapshots(spark, sf_dir).select(
        "ts_s", F.when(~odd, cpu).alias("cpu_new"), F.when(odd, cpu).alias("cpu_old"),
        F.when(~odd, mem).alias("mem_new"), F.when(odd, mem).alias("mem_old"))
    return rows.select("ts_s", F.coalesce("cpu_new", "cpu_old", F.lit(0.0)).alias("total_cpu"),
                       F.coalesce("mem_new", "mem_old", F.lit(0.0)).alias("total_memory"))


DENSE_SQL = b.SNAPSHOTS_SQL + """,
dense AS (SELECT s.snapshot_no, k.service, coalesce(cpu, 0) AS cpu, coalesce(mem, 0) AS mem
  FROM (SELECT DISTINCT snapshot_no FROM hourly) s CROSS JOIN (SELECT DISTINCT service FROM hourly) k
  LEFT JOIN usage u ON u.snapshot_no = s.snapshot_no AND u.service = k.service)"""


def _dense_services(spark, sf_dir):
    maps = materialize(b.snapshot_services(spark, sf_dir), "service-maps")
    rows = ex.dense(maps.select("snapshot_no", "services"), "services", ex.names_in(maps, "services"), "service",
                    ["cpu_utilization_cores", "memory_utilization_mb"])
    return rows.select("snapshot_no", "service", F.col("cpu_utilization_cores").alias("cpu"),
                       F.col("memory_utilization_mb").alias("mem"))


@query("p4_dense_service_series", f"WITH {DENSE_SQL} SELECT snapshot_no, service, cpu, mem FROM dense")
def dense_service_series(spark, sf_dir):
    return _dense_services(spark, sf_dir)


@query("w9_stacked_usage", f"""WITH {DENSE_SQL},
ranked AS (SELECT *, CASE WHEN contains(service, 'memcached') THEN 0 WHEN contains(service, 'mongo')
  OR contains(service, 'database') OR contains(service, 'db') THEN 1 ELSE 2 END AS r
  FROM (SELECT snapshot_no, replace(replace(service, 'view', 'memcached-view'), 'signup', 'mongodb-signup') AS service,
    mem FROM dense))
SELECT snapshot_no, service, sum(mem) OVER (PARTITION BY snapshot_no ORDER BY r, service) AS top FROM ranked""")
def stacked_usage(spark, sf_dir):
    renamed = F.when(F.col("service") == "view", F.lit("memcached-view")).when(
        F.col("service") == "signup", F.lit("mongodb-signup")).otherwise(F.col("service"))
    rows = _dense_services(spark, sf_dir).withColumn("service", renamed)
    out = ex.stacked(rows, ["snapshot_no"], [ex.memory_rank(F.col("service")), F.col("service")], "mem")
    return out.select("snapshot_no", "service", "top")


@query("p5_node_usage_series", f"""WITH {b.SNAPSHOTS_SQL} SELECT s.snapshot_no, k.node,
  coalesce(v / 1000.0, 0) AS cpu_usage_cores, CASE WHEN v IS NULL THEN 0 ELSE 64.0 END AS cpu_limit_cores,
  coalesce(v / 10.0, 0) AS memory_usage_mb, CASE WHEN v IS NULL THEN 0 ELSE 4096.0 END AS memory_limit_mb
FROM (SELECT DISTINCT snapshot_no FROM hourly) s CROSS JOIN (SELECT DISTINCT node FROM hourly) k
LEFT JOIN node_use u ON u.snapshot_no = s.snapshot_no AND u.node = k.node""".replace(
    "THEN 0 ELSE 64.0 END", "THEN 0.0::DOUBLE ELSE 64.0::DOUBLE END").replace(
    "THEN 0 ELSE 4096.0 END", "THEN 0.0::DOUBLE ELSE 4096.0::DOUBLE END"))
def node_usage_series(spark, sf_dir):
    maps = materialize(b.snapshot_services(spark, sf_dir), "node-maps")
    fields = ["cpu_usage_cores", "cpu_limit_cores", "memory_usage_mb", "memory_limit_mb"]
    rows = ex.dense(maps.select("snapshot_no", "nodes"), "nodes", ex.names_in(maps, "nodes"), "node", fields)
    return rows.select("snapshot_no", "node", *fields)


@query("p6_node_service_pods", f"""WITH {b.SNAPSHOTS_SQL},
pairs AS (SELECT DISTINCT node, service FROM pods)
SELECT s.snapshot_no, k.node, k.service, coalesce(pods, 0) AS pods
FROM (SELECT DISTINCT snapshot_no FROM hourly) s CROSS JOIN pairs k LEFT JOIN pods p
  ON p.snapshot_no = s.snapshot_no AND p.node = k.node AND p.service = k.service""")
def node_service_pods(spark, sf_dir):
    return _placement(spark, sf_dir).select("snapshot_no", "node", "service", "pods")


def _placement(spark, sf_dir):
    """Pods of every placement seen, at every snapshot."""
    maps = materialize(b.snapshot_services(spark, sf_dir), "placement-maps")
    pods = ex.placement_rows(maps, ["snapshot_no"])
    keyed = pods.groupBy("snapshot_no").agg(F.map_from_entries(F.collect_list(
        F.struct(F.concat_ws("@", "service", "node"), "pods"))).alias("placed"))
    rows = ex.dense(keyed, "placed", ex.names_in(keyed, "placed"), "placement", name="pods")
    return rows.withColumns({"service": F.substring_index("placement", "@", 1),
                             "node": F.substring_index("placement", "@", -1)})


@query("p7_placement_matrix", f"""WITH {b.SNAPSHOTS_SQL},
pairs AS (SELECT DISTINCT node, service FROM pods)
SELECT k.service || '@' || k.node AS placement, s.snapshot_no, coalesce(pods, 0) AS pods
FROM (SELECT DISTINCT snapshot_no FROM hourly) s CROSS JOIN pairs k LEFT JOIN pods p
  ON p.snapshot_no = s.snapshot_no AND p.node = k.node AND p.service = k.service""")
def placement_matrix(spark, sf_dir):
    return _placement(spark, sf_dir).select("placement", "snapshot_no", "pods")


LATEST_PIVOT_SQL = ", ".join(f"coalesce(max(pods) FILTER (service = '{n}'), 0) AS {n}" for n in b.EVENT_TYPES)


@query("p8_latest_placement", f"""WITH {b.SNAPSHOTS_SQL} SELECT node, {LATEST_PIVOT_SQL} FROM pods
  WHERE snapshot_no = (SELECT max(snapshot_no) FROM pods) GROUP BY 1""")
def latest_placement(spark, sf_dir):
    last = ex.latest(b.snapshot_services(spark, sf_dir), ["snapshot_no"])
    rows = ex.placement_rows(last, ["snapshot_no"])
    return rows.groupBy("node").pivot("service", b.EVENT_TYPES).agg(F.max("pods")).na.fill(0.0)


@query("p9_adaptation_timeline", f"""WITH {b.SNAPSHOTS_SQL} SELECT ts_s, subphase FROM snap WHERE phase = 'adaptation'
  AND snapshot_no % 10 <> 0""")
def adaptation_timeline(spark, sf_dir):
    """Every tenth snapshot has an unreadable time and is skipped."""
    rows = b.snapshots(spark, sf_dir).where(F.col("phase") == "adaptation")
    text = F.when(F.col("snapshot_no") % 10 == 0, F.lit("unknown")).otherwise(
        F.coalesce("collection_end_time", "timestamp"))
    ts = text.try_cast("timestamp")
    return rows.where(ts.isNotNull()).select(F.unix_seconds(ts).alias("ts_s"), "subphase")


@query("w11_latest_row", f"""WITH {b.SAMPLES_SQL} SELECT pod, arg_max(service, event_id) AS service,
  max(event_id) AS event_id FROM ev GROUP BY 1""")
def latest_row(spark, sf_dir):
    rows = b.samples(spark, sf_dir).select("pod", "event_id", "service")
    return ex.latest(rows, ["event_id"], ["pod"])


QUEUE_SQL = b.SAMPLES_SQL + """,
queued AS (SELECT event_id AS trace_id, service, value / 100.0 AS duration_seconds, ts_us AS enqueued_at,
  row_number() OVER (ORDER BY value, ts_us, CAST(event_id AS VARCHAR)) AS priority FROM ev)"""


def _waiting(spark, sf_dir):
    return b.samples(spark, sf_dir).select(
        F.col("event_id").alias("trace_id"), "service", (F.col("value") / 100.0).alias("duration_seconds"),
        F.col("ts_us").alias("enqueued_at"))


@query("w5_priority_order", f"WITH {QUEUE_SQL} SELECT trace_id, priority FROM queued")
def priority_order(spark, sf_dir):
    return ex.by_priority(_waiting(spark, sf_dir)).select("trace_id", "priority")


@query("w6_one_per_service", f"""WITH {QUEUE_SQL},
batch AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY priority) AS rn FROM queued WHERE priority <= 100)
SELECT service, count(*) FILTER (rn = 1) AS chosen, count(*) FILTER (rn > 1) AS skipped, min(trace_id)
  FILTER (rn = 1) AS trace_id FROM batch GROUP BY 1""")
def one_per_service(spark, sf_dir):
    rows = ex.first_per_service(ex.head_of_queue(_waiting(spark, sf_dir), 100), 100)
    return rows.groupBy("service").agg(
        F.count(F.when(~F.col("skipped"), 1)).alias("chosen"), F.count(F.when(F.col("skipped"), 1)).alias("skipped"),
        F.min(F.when(~F.col("skipped"), F.col("trace_id"))).alias("trace_id"))


# --- nested snapshots from traces -------------------------------------------------------------------------------
# Spans double as metric samples of their service, so that every part of a snapshot shares its windows.

SPAN_SAMPLE_SQL = b.ATTRIBUTED_SQL + f""",
span_samples AS (SELECT (start_us // {b.WINDOW_US}) * {b.WINDOW_US} AS window_us,
    CASE operation WHEN 'op_0' THEN 'srv-a' WHEN 'op_1' THEN 'srv-b' WHEN 'op_2' THEN 'srv-c' ELSE 'srv-d' END
      AS service, {b._sql_list(b.METRIC_NAMES)}[span_pos % 4 + 1] AS metric, span_pos % 4 AS metric_pos,
    CAST(duration_us AS DOUBLE) AS value, span_pos % 5 AS node_no FROM spans),
windows AS (SELECT window_us, (window_us // {b.WINDOW_US}) % 2 = 0 AS even FROM span_samples GROUP BY 1),
requests AS (SELECT window_us, count(*) AS total_requests, CAST(sum(total_us) AS DOUBLE) / count(*) AS mean_rt,
  quantile_cont(total_us, 0.9) AS p90 FROM live GROUP BY 1),
rates AS (SELECT window_us, pattern, CAST(count(*) FILTER (total_us > threshold) AS DOUBLE) / count(*) * 100
  AS miss_rate, CAST(sum(total_us) AS DOUBLE) / count(*) AS mean_rt, quantile_cont(total_us, 0.9) AS p90
  FROM live JOIN limits USING (pattern) GROUP BY 1, 2),
overall AS (SELECT window_us, avg(miss_rate) AS miss_rate FROM rates GROUP BY 1),
found AS (SELECT window_us, count(*) AS k FROM anomalies GROUP BY 1),
found_by AS (SELECT window_us, service, count(*) AS k FROM anomalies GROUP BY 1, 2),
means AS (SELECT window_us, service, metric, min(metric_pos) AS pos, sum(value) / count(*) AS mean FROM span_samples
  GROUP BY 1, 2, 3),
service_use AS (SELECT window_us, service,
    coalesce(arg_min(mean, pos) FILTER (metric LIKE '%cpu%' AND mean <> 0), 0) AS cpu,
    coalesce(arg_min(mean, pos) FILTER (metric LIKE '%memory%' AND mean <> 0), 0) / 1048576 AS mem
  FROM means GROUP BY 1, 2),
totals AS (SELECT window_us, coalesce(sum(mean) FILTER (metric LIKE '%cpu%' AND mean > 0), 0) AS cpu,
  coalesce(sum(mean) FILTER (metric LIKE '%memory%' AND mean > 0), 0) / 1048576 AS mem FROM means GROUP BY 1)"""


def span_samples(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in b.METRIC_NAMES])
    service = F.concat(F.lit("srv-"), F.translate(F.substring("operation", 4, 1), "0123", "abcd"))
    pos = F.col("span_pos")
    return b.spans(spark, sf_dir).select(
        tr.window_start(F.col("start_us"), b.WINDOW_US).alias("window_us"), F.col("start_us").alias("at_us"), service.alias("service"),
        F.element_at(names, (pos % 4 + 1).cast("int")).alias("metric"), (pos % 4).alias("metric_pos"),
        F.col("duration_us").cast("double").alias("value"),
        F.concat(F.lit("node-"), (pos % 5).cast("string")).alias("node"))


def snapshot_of(live, samples, limits, windows):
    """Snapshots of ``windows`` from their traces and samples; both carry ``window_us``."""
    even = F.col("window_us") / b.WINDOW_US % 2 == 0
    windows = windows.select(
        "window_us", F.when(even, "adaptation").otherwise("initialization").alias("phase"),
        F.when(even, "normal").otherwise("collection_start").alias("subphase"))
    # All parts that come from samples need sums, counts and maxima only: the samples are read once.
    over = F.col("value") > 100_000
    cells = materialize(samples.groupBy("window_us", "node", "service", "metric", "metric_pos").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.count(F.when(over, 1)).alias("restarts"),
        F.max("value").alias("most")), "cells")
    health = cells.where("restarts > 0").groupBy("window_us", "service").agg(
        F.sum("restarts").alias("restarts"), (F.max("most") > 104_000).alias("oom_killed"))
    placement = cells.groupBy("window_us", "node", "service").agg(F.sum("n").cast("double").alias("avg_pods"))
    mean = (F.sum("total") / F.sum("n")).alias("value")
    node_names = F.array(*[F.lit(n) for n in m.NODE_METRICS])
    named = F.element_at(node_names, (F.col("metric_pos") + 1).cast("int")).alias("metric")
    nodes = m.node_summary(cells.groupBy("window_us", "node", named).agg(mean), ["window_us", "node"])
    means = cells.groupBy("window_us", "service", "metric").agg(F.min("metric_pos").alias("metric_pos"), mean)
    return sn.assemble(windows, live, limits, anomalies_of(live, limits), means, health, nodes, placement)


def assembled(spark, sf_dir):
    """Snapshot of every 30-day window."""
    traces = materialize(b.traces(spark, sf_dir).withColumn("window_us", tr.window_start(F.col("start_us"), b.WINDOW_US)), "traces")
    limits = risk.deadlines(traces.where("training"))
    samples = span_samples(spark, sf_dir)
    return snapshot_of(traces.where(~F.col("training")), samples, limits, samples.select("window_us").distinct())


def snapshot_rows(snapshots):
    """Every number of the snapshots, maps included, with the window and its phase."""
    rows = sn.flattened(snapshots, ["window_us", "phase", "subphase"])
    return rows.withColumn("value", F.round("value", 6))


def _cells_sql(part: str, key: str, fields: dict[str, str], source: str) -> str:
    names = ", ".join(f"'{n}'" for n in fields)
    values = ", ".join(f"CAST({v} AS DOUBLE)" for v in fields.values())
    return f"SELECT window_us, '{part}' AS part, {key} AS key, unnest([{names}]) AS field, unnest([{values}]) AS value FROM {source}"


SNAPSHOT_ROWS_SQL = f"""WITH {SPAN_SAMPLE_SQL},
health AS (SELECT window_us, service, count(*) AS restarts, max(value) > 104000 AS oom FROM span_samples WHERE value > 100000
  GROUP BY 1, 2),
node_use AS (SELECT window_us, node_no, avg(value) FILTER (metric_pos = 0) AS m0, avg(value) FILTER (metric_pos = 1) AS m1,
  avg(value) FILTER (metric_pos = 2) AS m2, avg(value) FILTER (metric_pos = 3) AS m3 FROM span_samples GROUP BY 1, 2),
cells AS ({" UNION ALL ".join([
    _cells_sql("window", "''", {
        "total_requests": "coalesce(total_requests, 0)", "mean_response_time": "coalesce(r.mean_rt, 0)",
        "p90_response_time": "coalesce(r.p90, 0)", "deadline_miss_rate": "coalesce(o.miss_rate, 0)",
        "sum_cpu_utilization_cores": "coalesce(t.cpu, 0)", "sum_memory_utilization_mb": "coalesce(t.mem, 0)",
        "anomaly_count": "coalesce(k, 0)", "anomaly_rate": "coalesce(k * 100.0 / total_requests, 0)"},
        "windows w LEFT JOIN requests r USING (window_us) LEFT JOIN overall o USING (window_us) LEFT JOIN totals t "
        "USING (window_us) LEFT JOIN found USING (window_us)"),
    _cells_sql("patterns", "pattern", {
        "deadline_miss_rate": "miss_rate", "mean_response_time": "mean_rt", "p90_response_time": "p90"}, "rates"),
    _cells_sql("services", "u.service", {
        "anomaly_count": "coalesce(f.k, 0)", "anomaly_rate": "coalesce(f.k * 100.0 / total_requests, 0)",
        "cpu_utilization_cores": "u.cpu", "memory_utilization_mb": "u.mem", "restart_count": "restarts", "oom_killed": "oom"},
        "service_use u LEFT JOIN requests r USING (window_us) LEFT JOIN found_by f USING (window_us, service) "
        "LEFT JOIN health h USING (window_us, service)"),
    _cells_sql("pod_health", "service", {"restarts": "restarts", "oom_killed": "oom"}, "health"),
    _cells_sql("nodes", "'node-' || node_no", {
        "cpu_utilization_pct": "m0", "memory_utilization_pct": "m1", "cpu_usage_cores": "m2", "cpu_limit_cores": "m3"},
        "node_use"),
    _cells_sql("placement", "'node-' || node_no || '/' || service", {"avg_pods": "count(*)"},
               "span_samples GROUP BY window_us, node_no, service"),
])})
SELECT window_us, CASE WHEN even THEN 'adaptation' ELSE 'initialization' END AS phase,
  CASE WHEN even THEN 'normal' ELSE 'collection_start' END AS subphase, part, key, field, round(value, 6) AS value
FROM cells JOIN windows USING (window_us) WHERE value IS NOT NULL"""


@query("a14_snapshot_maps", SNAPSHOT_ROWS_SQL)
def snapshot_maps(spark, sf_dir):
    """All scalars and all maps of the snapshots: patterns, services, pod health, nodes and their pods."""
    return snapshot_rows(assembled(spark, sf_dir))


@query("a14_snapshot", f"""WITH {SPAN_SAMPLE_SQL}
SELECT w.window_us, CASE WHEN even THEN 'adaptation' ELSE 'initialization' END AS phase,
  coalesce(total_requests, 0) AS total_requests, coalesce(r.mean_rt, 0) AS mean_response_time,
  round(coalesce(r.p90, 0), 4) AS p90_response_time, round(coalesce(o.miss_rate, 0), 6) AS deadline_miss_rate,
  round(t.cpu, 6) AS sum_cpu_utilization_cores, round(t.mem, 9) AS sum_memory_utilization_mb,
  coalesce(k, 0) AS anomaly_count, round(coalesce(k * 100.0 / total_requests, 0), 6) AS anomaly_rate,
  coalesce(x.pattern, '-') AS pattern, coalesce(x.miss_rate, -1) AS pattern_miss_rate,
  round(coalesce(x.p90, -1), 4) AS pattern_p90
FROM windows w LEFT JOIN requests r USING (window_us) LEFT JOIN overall o USING (window_us)
LEFT JOIN totals t USING (window_us) LEFT JOIN found USING (window_us) LEFT JOIN rates x USING (window_us)""")
def snapshot(spark, sf_dir):
    rows = assembled(spark, sf_dir)
    rows = rows.select("*", F.explode_outer("patterns").alias("pattern", "_p"))
    return rows.select(
        "window_us", "phase", "total_requests", "mean_response_time", F.round("p90_response_time", 4).alias(
            "p90_response_time"), F.round("deadline_miss_rate", 6).alias("deadline_miss_rate"),
        F.round("sum_cpu_utilization_cores", 6).alias("sum_cpu_utilization_cores"),
        F.round("sum_memory_utilization_mb", 9).alias("sum_memory_utilization_mb"), "anomaly_count",
        F.round("anomaly_rate", 6).alias("anomaly_rate"), F.coalesce("pattern", F.lit("-")).alias("pattern"),
        F.coalesce("_p.deadline_miss_rate", F.lit(-1.0)).alias("pattern_miss_rate"),
        F.round(F.coalesce("_p.p90_response_time", F.lit(-1.0)), 4).alias("pattern_p90"))


@query("a15_snapshot_metadata", f"""WITH {SPAN_SAMPLE_SQL},
health AS (SELECT window_us, service, count(*) AS restarts FROM span_samples WHERE value > 100000 GROUP BY 1, 2)
SELECT u.window_us, u.service, 'run' AS collection_label,
  strftime(make_timestamp(u.window_us), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS collection_start_time,
  coalesce(r.total_requests, 0) AS trace_count, count(*) OVER (PARTITION BY u.window_us) AS metrics_config_count,
  coalesce(f.k, 0) AS service_anomalies, u.cpu AS cpu_utilization_cores, coalesce(restarts, 0) AS restart_count
FROM service_use u LEFT JOIN requests r USING (window_us)
LEFT JOIN found_by f ON f.window_us = u.window_us AND f.service = u.service
LEFT JOIN health h ON h.window_us = u.window_us AND h.service = u.service""")
def snapshot_metadata(spark, sf_dir):
    rows = assembled(spark, sf_dir).withColumn("end_us", F.col("window_us") + b.WINDOW_US)
    rows = sn.describe(rows, "run", "window_us", "end_us")
    rows = rows.select("*", F.explode("services").alias("service", "_s"))
    return rows.select(
        "window_us", "service", "collection_label", "collection_start_time", "trace_count",
        F.col("metrics_config_count").cast("long").alias("metrics_config_count"),
        F.col("_s.anomaly_count").alias("service_anomalies"), "_s.cpu_utilization_cores",
        F.coalesce("_s.restart_count", F.lit(0)).alias("restart_count"))
