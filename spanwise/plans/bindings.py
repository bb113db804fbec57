"""Canonical telemetry tables from the given tables, once as DataFrames and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.functions.scalars import DAY_US, epoch_micros
from spanwise.operators import traces as tr
from spanwise.session import materialize

OPS = ["op_0", "op_1", "op_2", "op_3"]
# op_3 has no service on purpose: it exercises the drop rule.
OP_SERVICE = {"op_0": "srv-a", "op_1": "srv-b", "op_2": "cluster/srv-c"}
WINDOW_US = 30 * DAY_US
HOUR_S = 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- spans and traces -------------------------------------------------------------------------------------------

def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as spans. ``span_pos`` packs day, line, part and duration, so it has no ties that matter."""
    li = table(spark, sf_dir, "lineitem")
    us = epoch_micros(F.col("l_shipdate"))
    dur = F.round("l_extendedprice").cast("long")
    day = F.floor(us / DAY_US)
    pos = ((day * 8 + F.col("l_linenumber")) * 268435456 + F.col("l_partkey")) * 131072 + dur % 131072
    return li.select(
        F.col("l_orderkey").alias("trace_id"),
        F.concat(F.lit("op_"), ((F.col("l_linenumber") - 1) % 4).cast("string")).alias("operation"),
        us.alias("start_us"), dur.alias("duration_us"), pos.cast("long").alias("span_pos"),
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All traces with ``training`` set for orders before 1999."""
    role = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("trace_id"),
        (F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ'1999-01-01 00:00:00'")).alias("training"),
    )
    return tr.summarize(spans(spark, sf_dir), OPS).join(role, "trace_id")


def split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Live and training traces."""
    both = traces(spark, sf_dir)
    return both.where(~F.col("training")), both.where("training")


SPANS_SQL = """spans AS (
  SELECT l_orderkey AS trace_id, 'op_' || CAST((l_linenumber - 1) % 4 AS VARCHAR) AS operation,
    epoch_us(l_shipdate) AS start_us, CAST(round(l_extendedprice) AS BIGINT) AS duration_us,
    (((epoch_us(l_shipdate) // 86400000000) * 8 + l_linenumber) * 268435456 + l_partkey) * 131072
      + CAST(round(l_extendedprice) AS BIGINT) % 131072 AS span_pos
  FROM lineitem)"""

TRACES_SQL = SPANS_SQL + """,
last_span AS (SELECT trace_id, operation, arg_max(duration_us, span_pos) AS d FROM spans GROUP BY 1, 2),
sums AS (SELECT trace_id, min(start_us) AS start_us, CAST(sum(duration_us) AS BIGINT) AS total_us
  FROM spans GROUP BY 1),
wide AS (SELECT trace_id,
    coalesce(max(d) FILTER (operation = 'op_0'), 0) AS op_0, coalesce(max(d) FILTER (operation = 'op_1'), 0) AS op_1,
    coalesce(max(d) FILTER (operation = 'op_2'), 0) AS op_2, coalesce(max(d) FILTER (operation = 'op_3'), 0) AS op_3
  FROM last_span GROUP BY 1),
traces AS (SELECT s.trace_id, s.start_us, s.total_us, op_0, op_1, op_2, op_3,
    CAST(CAST(op_0 > 0 AS INT) AS VARCHAR) || CAST(CAST(op_1 > 0 AS INT) AS VARCHAR)
      || CAST(CAST(op_2 > 0 AS INT) AS VARCHAR) || CAST(CAST(op_3 > 0 AS INT) AS VARCHAR) AS pattern,
    (s.start_us // 2592000000000) * 2592000000000 AS window_us,
    o_orderdate < TIMESTAMP '1999-01-01' AS training
  FROM sums s JOIN wide w ON s.trace_id = w.trace_id JOIN orders ON o_orderkey = s.trace_id),
live AS (SELECT * FROM traces WHERE NOT training),
train AS (SELECT * FROM traces WHERE training)"""

LIMITS_SQL = TRACES_SQL + """,
var AS (SELECT pattern, quantile_cont(total_us, 0.95) AS v FROM train GROUP BY 1),
cvar AS (SELECT t.pattern, sum(total_us) / count(*) AS threshold FROM train t JOIN var USING (pattern)
  WHERE total_us >= v GROUP BY 1),
limits AS (SELECT pattern, coalesce(threshold, 0) AS threshold
  FROM (SELECT DISTINCT pattern FROM live) LEFT JOIN cvar USING (pattern))"""


# --- attributed outliers ----------------------------------------------------------------------------------------
# A stand-in for model output that SQL can also compute: every seventh trace is flagged, and each feature gets a
# contribution by integer arithmetic. The model itself is exercised by the forest queries.

FEATURES = ["total", *OPS]


def feature_value(name: str):
    return F.col("total_us") if name == "total" else F.col("durations")[name]


def attributions(live: DataFrame) -> DataFrame:
    """Flagged traces with one array of (pos, feature, contribution)."""
    contribution = [
        F.struct(F.lit(i).alias("pos"), F.lit(f).alias("feature"),
                 ((F.col("trace_id") * 31 + i * 17 + feature_value(f)) % 201 - 100).cast("double").alias("value"))
        for i, f in enumerate(FEATURES)
    ]
    return live.withColumn("is_outlier", F.col("trace_id") % 7 == 0).withColumn("attribution", F.array(*contribution))


ATTRIBUTED_SQL = LIMITS_SQL + """,
flagged AS (SELECT l.*, threshold FROM live l JOIN limits USING (pattern)
  WHERE trace_id % 7 = 0 AND total_us > threshold),
contrib AS (
  SELECT trace_id, 0 AS pos, 'total' AS feature, (trace_id * 31 + total_us) % 201 - 100 AS c FROM flagged
  UNION ALL SELECT trace_id, 1, 'op_0', (trace_id * 31 + 17 + op_0) % 201 - 100 FROM flagged
  UNION ALL SELECT trace_id, 2, 'op_1', (trace_id * 31 + 34 + op_1) % 201 - 100 FROM flagged
  UNION ALL SELECT trace_id, 3, 'op_2', (trace_id * 31 + 51 + op_2) % 201 - 100 FROM flagged
  UNION ALL SELECT trace_id, 4, 'op_3', (trace_id * 31 + 68 + op_3) % 201 - 100 FROM flagged),
ranked AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY c, pos) AS rn FROM contrib),
anomalies AS (SELECT f.trace_id, f.pattern, f.total_us, f.start_us, f.window_us, r.feature, CAST(r.c AS DOUBLE) AS c,
    CASE r.feature WHEN 'op_0' THEN 'srv-a' WHEN 'op_1' THEN 'srv-b' WHEN 'op_2' THEN 'srv-c' END AS service
  FROM flagged f JOIN ranked r ON f.trace_id = r.trace_id AND rn = 1
  WHERE r.feature IN ('op_0', 'op_1', 'op_2'))"""


# --- metric samples ---------------------------------------------------------------------------------------------

POD_NAMES = ["srv-rate-x", "srv-recommendation-x", "srv-recommend-x", "memcached-reservation-x", "memcached-reserve-x",
             "mongodb-geo-x", "frontend-x", "other-x"]
METRIC_NAMES = ["app_cpu_seconds", "app_memory_bytes", "app_cpu_throttled", "app_target_concurrency"]
END_S = 1706745600  # 2024-02-01, after the last event
DAY_S = 86_400


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as metric samples: a gauge in whole cents and a counter that wraps at 500."""
    ev = table(spark, sf_dir, "events")
    us = epoch_micros(F.col("ts"))
    user = F.col("user_id")
    pods = F.array(*[F.lit(p) for p in POD_NAMES])
    names = F.array(*[F.lit(m) for m in METRIC_NAMES])
    return ev.select(
        "event_id", us.alias("ts_us"), F.floor(us / 1_000_000).alias("ts_s"), F.col("event_type").alias("service"),
        F.concat(F.lit("pod-"), user.cast("string")).alias("pod"),
        F.concat(F.lit("node-"), (user % 5).cast("string")).alias("node"),
        F.concat(F.lit("c"), (user % 3).cast("string")).alias("container"),
        F.concat(F.element_at(pods, (user % 8 + 1).cast("int")), user.cast("string")).alias("workload_pod"),
        F.element_at(names, (F.col("event_id") % 4 + 1).cast("int")).alias("metric"),
        (F.col("event_id") % 4).alias("metric_pos"),
        F.round(F.col("value") * 100).cast("long").cast("double").alias("value"),
        (F.col("event_id") % 500).cast("double").alias("counter"),
    )


def _sql_list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


SAMPLES_SQL = f"""ev AS (
  SELECT event_id, epoch_us(ts) AS ts_us, epoch_us(ts) // 1000000 AS ts_s, event_type AS service,
    'pod-' || user_id AS pod, 'node-' || (user_id % 5) AS node, 'c' || (user_id % 3) AS container,
    {_sql_list(POD_NAMES)}[user_id % 8 + 1] || user_id AS workload_pod,
    {_sql_list(METRIC_NAMES)}[event_id % 4 + 1] AS metric, event_id % 4 AS metric_pos,
    CAST(CAST(round(value * 100) AS BIGINT) AS DOUBLE) AS value, CAST(event_id % 500 AS DOUBLE) AS counter
  FROM events)"""


# --- hourly snapshots -------------------------------------------------------------------------------------------

START_S = 1704067200  # 2024-01-01
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).withColumn("snapshot_no", F.floor((F.col("ts_s") - START_S) / HOUR_S).cast("long"))


def _phases(h):
    phase = F.when(h >= 24, "adaptation").otherwise("initialization")
    part = h % 12
    subphase = F.when(part.isin(5, 6), "stabilization").when(part == 7, "configuration_application").otherwise("normal")
    return phase, subphase


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flat snapshot per hour with its phase; every fourth has only the fallback time stamp."""
    h = F.col("snapshot_no")
    phase, subphase = _phases(h)
    cents = F.col("value")

    def of(kind: str):
        return F.sum(F.when(F.col("service") == kind, cents).otherwise(0.0))

    rows = hours(spark, sf_dir).groupBy("snapshot_no").agg(
        F.count(F.lit(1)).alias("total_requests"),
        (F.sum(cents) * 10.0 / F.count(F.lit(1))).alias("mean_response_time"),
        F.max(cents * 10.0).alias("p90_response_time"),
        (F.count(F.when(cents > 10000, 1)) * 100.0 / F.count(F.lit(1))).alias("deadline_miss_rate"),
        (F.count(F.when(F.col("service") == "error", 1)) * 100.0 / F.count(F.lit(1))).alias("anomaly_rate"),
        (of("click") / 1000.0).alias("sum_cpu_utilization_cores"),
        (of("view") / 100.0).alias("sum_memory_utilization_mb"),
    )
    end = F.timestamp_seconds((h + 1) * HOUR_S + START_S)
    text = F.concat(F.date_format(end, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return rows.select(
        "*", ((h + 1) * HOUR_S + START_S).alias("ts_s"), phase.alias("phase"), subphase.alias("subphase"),
        F.when(h % 4 != 0, text).alias("collection_end_time"), text.alias("timestamp"))


def snapshot_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per hour a map from service to usage and one from node to its usage and pods per service."""
    rows = hours(spark, sf_dir)
    services = rows.groupBy("snapshot_no", "service").agg(
        (F.sum("value") / 1000.0).alias("cpu"), F.count(F.lit(1)).cast("double").alias("mem"))
    services = services.groupBy("snapshot_no").agg(F.map_from_entries(F.collect_list(F.struct(
        "service", F.struct(F.col("cpu").alias("cpu_utilization_cores"), F.col("mem").alias("memory_utilization_mb"))
    ))).alias("services"))
    pods = rows.groupBy("snapshot_no", "node", "service").agg(F.countDistinct("pod").cast("double").alias("pods"),
                                                              F.sum("value").alias("v"))
    nodes = pods.groupBy("snapshot_no", "node").agg(
        F.map_from_entries(F.collect_list(F.struct("service", "pods"))).alias("services"), F.sum("v").alias("v"))
    nodes = nodes.groupBy("snapshot_no").agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct(
        (F.col("v") / 1000.0).alias("cpu_usage_cores"), F.lit(64.0).alias("cpu_limit_cores"),
        (F.col("v") / 10.0).alias("memory_usage_mb"), F.lit(4096.0).alias("memory_limit_mb"), "services",
    )))).alias("nodes"))
    return services.join(nodes, "snapshot_no")


SNAPSHOTS_SQL = SAMPLES_SQL + """,
hourly AS (SELECT *, (ts_s - 1704067200) // 3600 AS snapshot_no FROM ev),
snap AS (SELECT snapshot_no, (snapshot_no + 1) * 3600 + 1704067200 AS ts_s, count(*) AS total_requests,
    sum(value) * 10.0 / count(*) AS mean_response_time, max(value * 10.0) AS p90_response_time,
    count(*) FILTER (value > 10000) * 100.0 / count(*) AS deadline_miss_rate,
    count(*) FILTER (service = 'error') * 100.0 / count(*) AS anomaly_rate,
    coalesce(sum(value) FILTER (service = 'click'), 0) / 1000.0 AS sum_cpu_utilization_cores,
    coalesce(sum(value) FILTER (service = 'view'), 0) / 100.0 AS sum_memory_utilization_mb,
    CASE WHEN snapshot_no >= 24 THEN 'adaptation' ELSE 'initialization' END AS phase,
    CASE WHEN snapshot_no % 12 IN (5, 6) THEN 'stabilization' WHEN snapshot_no % 12 = 7
      THEN 'configuration_application' ELSE 'normal' END AS subphase
  FROM hourly GROUP BY 1),
usage AS (SELECT snapshot_no, service, sum(value) / 1000.0 AS cpu, CAST(count(*) AS DOUBLE) AS mem FROM hourly
  GROUP BY 1, 2),
pods AS (SELECT snapshot_no, node, service, CAST(count(DISTINCT pod) AS DOUBLE) AS pods, sum(value) AS v FROM hourly
  GROUP BY 1, 2, 3),
node_use AS (SELECT snapshot_no, node, sum(v) AS v FROM pods GROUP BY 1, 2)"""


# --- configuration documents ------------------------------------------------------------------------------------

def config_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as configuration versions of their brand; Service, Deployment and ConfigMap take turns.

    Every fifth version has no application time. A part is a few bytes and its document costs a hundred times that to build
    and read, so rows are dealt over as many tasks as a shuffle has, whatever the size of the file.
    """
    part = table(spark, sf_dir, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = F.col("p_size").cast("string")
    note = "autoscaling.knative.dev/"
    notes = F.create_map(
        F.lit(note + "max-scale"), (F.col("p_size") % 10).cast("string"), F.lit(note + "target"),
        F.concat(size, F.lit(".5")), F.lit(note + "metric"), F.lit("rps"), F.lit(note + "window"),
        F.concat(size, F.lit("s")), F.lit(note + "stable-window"), F.concat(size, F.lit("m")))
    notes = F.when(F.col("p_size") % 2 == 0, F.map_concat(
        notes, F.create_map(F.lit(note + "min-scale"), F.lit("1")))).otherwise(notes)
    container = F.struct(
        F.struct(F.struct(F.concat(size, F.lit("m")).alias("cpu"), F.concat(size, F.lit("Mi")).alias("memory"))
                 .alias("limits"), F.struct(F.lit("1").alias("cpu")).alias("requests")).alias("resources"),
        F.array(F.struct(F.lit("CACHE_SIZE").alias("name"), size.alias("value")),
                F.struct(F.lit("RATIO").alias("name"), F.concat(size, F.lit(".25")).alias("value")),
                F.struct(F.lit("MODE").alias("name"), F.col("p_type").alias("value"))).alias("env"))
    pod = F.struct(F.struct(F.array(container).alias("containers")).alias("spec"))
    meta = F.struct(F.col("p_brand").alias("name"))
    service = F.to_json(F.struct(F.lit("Service").alias("kind"), meta.alias("metadata"), F.struct(F.struct(
        F.struct(notes.alias("annotations")).alias("metadata"),
        F.struct(F.array(container).alias("containers")).alias("spec")).alias("template")).alias("spec")))
    deployment = F.to_json(F.struct(F.lit("Deployment").alias("kind"), meta.alias("metadata"), F.struct(
        (F.col("p_size") % 5).alias("replicas"), pod.alias("template")).alias("spec")))
    data = F.create_map(F.lit("rate"), F.concat(size, F.lit(".0")), F.lit("grace"), F.concat(size, F.lit("s")),
                        F.lit("zero"), F.when(F.col("p_size") % 2 == 0, "true").otherwise("False"),
                        F.lit("note"), F.col("p_type"))
    settings = F.to_json(F.struct(F.lit("ConfigMap").alias("kind"), data.alias("data")))
    turn = F.col("p_partkey") % 3
    text = F.when(turn == 0, service).when(turn == 1, deployment).otherwise(settings)
    at = F.timestamp_seconds(F.col("p_partkey") * 3600)
    return part.select(
        F.col("p_brand").alias("service"), F.col("p_partkey").alias("seq"),
        F.when(F.col("p_partkey") % 5 != 0, at).alias("applied_at"), F.parse_json(text).alias("doc"))


CONFIG_SQL = """cfg AS (SELECT p_brand AS service, p_partkey AS seq, p_partkey % 3 AS turn, p_size AS size,
    p_type AS kind_text, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey * 3600 END AS applied_s FROM part),
params AS (
  SELECT service, seq, 'max-scale' AS param, CAST(size % 10 AS DOUBLE) AS num, NULL AS str FROM cfg WHERE turn = 0
  UNION ALL SELECT service, seq, 'min-scale', CASE WHEN size % 2 = 0 THEN 1 ELSE 0 END, NULL FROM cfg WHERE turn = 0
  UNION ALL SELECT service, seq, unnest(['initial-scale', 'activation-scale', 'panic-threshold-percentage',
    'panic-window-percentage', 'scale-down-delay']), 0, NULL FROM cfg WHERE turn = 0
  UNION ALL SELECT service, seq, 'target', size + 0.5, NULL FROM cfg WHERE turn = 0
  UNION ALL SELECT service, seq, 'window', size, NULL FROM cfg WHERE turn = 0
  UNION ALL SELECT service, seq, 'stable-window', size * 60, NULL FROM cfg WHERE turn = 0
  UNION ALL SELECT service, seq, 'metric', NULL, 'rps' FROM cfg WHERE turn = 0
  UNION ALL SELECT service, seq, 'replicas', size % 5, NULL FROM cfg WHERE turn = 1
  UNION ALL SELECT service, seq, 'cpu-limit', CAST(size AS DOUBLE) / 1000, NULL FROM cfg WHERE turn < 2
  UNION ALL SELECT service, seq, 'cpu-request', 1, NULL FROM cfg WHERE turn < 2
  UNION ALL SELECT service, seq, 'memory-limit', size, NULL FROM cfg WHERE turn < 2
  UNION ALL SELECT service, seq, 'memory-request', 0, NULL FROM cfg WHERE turn < 2
  UNION ALL SELECT service, seq, 'cache_size', size, NULL FROM cfg WHERE turn < 2
  UNION ALL SELECT service, seq, 'ratio', size + 0.25, NULL FROM cfg WHERE turn < 2
  UNION ALL SELECT service, seq, 'mode', NULL, kind_text FROM cfg WHERE turn < 2
  UNION ALL SELECT service, seq, 'rate', size, NULL FROM cfg WHERE turn = 2
  UNION ALL SELECT service, seq, 'grace', size, NULL FROM cfg WHERE turn = 2
  UNION ALL SELECT service, seq, 'zero', CASE WHEN size % 2 = 0 THEN 1 ELSE 0 END, NULL FROM cfg WHERE turn = 2
  UNION ALL SELECT service, seq, 'note', NULL, kind_text FROM cfg WHERE turn = 2),
ordered AS (SELECT service, seq, lag(seq) OVER (PARTITION BY service ORDER BY seq) AS prev FROM cfg),
changed AS (SELECT o.service, o.seq, a.param FROM ordered o
  JOIN params a ON a.service = o.service AND a.seq = o.seq
  JOIN params c ON c.service = o.service AND c.seq = o.prev AND c.param = a.param
  WHERE a.num IS DISTINCT FROM c.num OR a.str IS DISTINCT FROM c.str)"""
