"""File readers and writers: the given tables are written in each format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwise.operators import experiment as ex
from spanwise.operators import traces as tr
from spanwise.plans import bindings as b
from spanwise.plans.experiment_queries import EFFECT_NAMES, EFFECT_SQL, MEANS_SQL, _means
from spanwise.plans.registry import query
from spanwise.session import scratch_path
from spanwise.sources import configs, logs, metrics, sinks, snapshots, traces

TRACE_ROWS_SQL = (f"WITH {b.TRACES_SQL} SELECT CAST(s.trace_id AS VARCHAR) AS trace_id, start_us, total_us, op_0, op_1, "
                  "op_2, op_3 FROM sums s JOIN wide w ON w.trace_id = s.trace_id")


def _trace_rows(spark, sf_dir, path):
    rows = tr.summarize(traces.read_traces(spark, path, multi_line=False), b.OPS)
    return rows.select("trace_id", "start_us", "total_us", *[F.col("durations")[op].alias(op) for op in b.OPS])


@query("s1_trace_documents", TRACE_ROWS_SQL)
def trace_documents(spark, sf_dir):
    path = scratch_path(spark, "trace-documents")
    spans = b.spans(spark, sf_dir)
    span = F.struct(F.col("operation").alias("operationName"), F.col("start_us").alias("startTime"),
                    F.col("duration_us").alias("duration"), F.col("span_pos").alias("spanPos"))
    trace = F.struct(F.col("trace_id").cast("string").alias("traceID"), F.array(span).alias("spans"))
    spans.select(F.array(trace).alias("data")).write.json(path)
    return _trace_rows(spark, sf_dir, path)


@query("s10_trace_archive", TRACE_ROWS_SQL)
def trace_archive(spark, sf_dir):
    """Two appends of half the traces each."""
    path = scratch_path(spark, "trace-archive")
    spans = b.spans(spark, sf_dir)
    for half in (0, 1):
        traces.write_traces(spans.where(F.col("trace_id") % 2 == half), path)
    return _trace_rows(spark, sf_dir, path)


@query("s2_range_responses", f"WITH {b.SAMPLES_SQL} SELECT service, pod, ts_s, value / 100 AS value FROM ev")
def range_responses(spark, sf_dir):
    path = scratch_path(spark, "range-responses")
    ev = b.samples(spark, sf_dir)
    second = F.concat((F.col("ts_us") / 1_000_000).cast("decimal(20,6)").cast("string"))
    pair = F.array(second, (F.col("value") / 100).cast("string"))
    series = F.struct(F.create_map(F.lit("service"), "service", F.lit("pod"), "pod").alias("metric"),
                      F.array(pair).alias("values"))
    ev.select(F.struct(F.array(series).alias("result")).alias("data")).write.json(path)
    rows = metrics.read_range_responses(spark, path, multi_line=False)
    return metrics.with_labels(rows, ["service", "pod"])


@query("s3_metric_tables", f"""WITH {b.SAMPLES_SQL}, c AS (SELECT *, ts_s // 3600 * 3600 AS h FROM ev)
SELECT 'srv-' || service AS service, h AS ts_s, service || '_cpu' AS metric, sum(value) AS value FROM c GROUP BY 1, 2, 3
UNION ALL SELECT 'srv-' || service, h, service || '_memory', CAST(count(*) AS DOUBLE) FROM c GROUP BY 1, 2, 3""")
def metric_tables(spark, sf_dir):
    """One table per service, each with columns of its own."""
    path = scratch_path(spark, "metric-tables")
    hour = (F.floor(F.col("ts_s") / 3600) * 3600).cast("long")
    for kind in b.EVENT_TYPES:
        rows = b.samples(spark, sf_dir).where(F.col("service") == kind).groupBy(hour.alias("index")).agg(
            F.sum("value").alias(f"{kind}_cpu"), F.count(F.lit(1)).alias(f"{kind}_memory"))
        sinks.append_csv(rows, f"{path}/run_srv-{kind}_metrics.csv")
    rows = metrics.read_metric_csv(spark, f"{path}/run_*_metrics.csv")
    return rows.select("service", "ts_s", "metric", "value")


@query("s4_load_history", f"WITH {b.SAMPLES_SQL} SELECT ts_s, count(*) AS requests FROM ev GROUP BY 1")
def load_history(spark, sf_dir):
    path = scratch_path(spark, "load-history")
    rows = b.samples(spark, sf_dir).groupBy(F.col("ts_s").alias("Timestamp")).agg(F.count(F.lit(1)).alias("Requests"))
    rows.withColumn("Name", F.lit("Aggregated")).write.csv(path, header=True)
    back = logs.read_load_history(spark, path)
    return back.select(F.unix_seconds("Timestamp").alias("ts_s"), F.col("Requests").cast("long").alias("requests"))


@query("s5_response_logs", f"""WITH {b.SAMPLES_SQL} SELECT service AS name, count(*) AS n,
  sum(value) AS response_time, max(200 + event_id % 3) AS status_code FROM ev GROUP BY 1""")
def response_logs(spark, sf_dir):
    """Worker logs without header and with a blank before the status code, merged into one table and read again."""
    worker, merged = scratch_path(spark, "worker-logs"), scratch_path(spark, "response-log")
    ev = b.samples(spark, sf_dir).select(
        F.lit("GET"), "service", "value", "event_id", F.concat(F.lit(" "), (F.col("event_id") % 3 + 200).cast("string")))
    ev.write.csv(worker, ignoreLeadingWhiteSpace=False)
    logs.consolidate_response_logs(spark, worker, merged)
    rows = spark.read.schema(logs.RESPONSE_LOG_SCHEMA).csv(merged, header=True)
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("response_time").alias("response_time"),
                                    F.max("status_code").cast("long").alias("status_code"))


def _stored_snapshots(spark, sf_dir):
    flat = b.snapshots(spark, sf_dir).withColumnRenamed("snapshot_no", "trace_count").drop("ts_s")
    services = b.snapshot_services(spark, sf_dir).withColumnRenamed("snapshot_no", "trace_count")
    return flat.join(services, "trace_count")


SNAPSHOT_ROWS_SQL = f"""WITH {b.SNAPSHOTS_SQL} SELECT s.snapshot_no AS trace_count, phase, subphase,
  s.mean_response_time, u.service, u.cpu FROM snap s JOIN usage u ON u.snapshot_no = s.snapshot_no"""


def _snapshot_rows(spark, path):
    rows = snapshots.read_snapshots(spark, path, multi_line=False)
    return rows.select("trace_count", "phase", "subphase", "mean_response_time",
                       F.explode("services").alias("service", "_s")).select(
        "trace_count", "phase", "subphase", "mean_response_time", "service", F.col("_s.cpu_utilization_cores").alias("cpu"))


@query("s6_snapshot_documents", SNAPSHOT_ROWS_SQL)
def snapshot_documents(spark, sf_dir):
    path = scratch_path(spark, "snapshot-documents")
    _stored_snapshots(spark, sf_dir).write.json(path)
    return _snapshot_rows(spark, path)


@query("s9_snapshot_append", SNAPSHOT_ROWS_SQL)
def snapshot_append(spark, sf_dir):
    """Three appends leave the same table as one write."""
    path = scratch_path(spark, "snapshot-append")
    rows = _stored_snapshots(spark, sf_dir)
    for third in range(3):
        snapshots.append_snapshots(rows.where(F.col("trace_count") % 3 == third), path)
    return _snapshot_rows(spark, path)


@query("s7_versioned_configs", """SELECT 'srv-' || s_nationkey AS service,
  CASE WHEN s_suppkey % 4 = 0 THEN -1 - s_suppkey ELSE s_suppkey END AS seq, s_suppkey % 7 AS replicas,
  s_name AS owner FROM supplier""")
def versioned_configs(spark, sf_dir):
    """Suppliers as versions of configuration files in a folder per service."""
    folder = scratch_path(spark, "config-files")
    key = F.col("s_suppkey")
    text = F.concat(F.lit("kind: Deployment\nmetadata:\n  name: "), F.col("s_name").cast("string"),
                    F.lit("\nspec:\n  replicas: "), (key % 7).cast("string"))
    seq = F.when(key % 4 == 0, -1 - key).otherwise(key)
    files = b.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("srv-"), F.col("s_nationkey").cast("string")).alias("service"), seq.alias("seq"), text.alias("text"))
    configs.write_configs(files, folder)
    docs = configs.read_configs(spark, folder, glob="*.txt")
    return docs.select("service", "seq", F.try_variant_get("doc", "$.spec.replicas", "bigint").alias("replicas"),
                       F.try_variant_get("doc", "$.metadata.name", "string").alias("owner"))


@query("s8_csv_append", f"WITH {b.SAMPLES_SQL} SELECT node, service, count(*) AS n, sum(value) AS value FROM ev "
       "GROUP BY 1, 2")
def csv_append(spark, sf_dir):
    path = scratch_path(spark, "csv-append")
    ev = b.samples(spark, sf_dir).select("event_id", "node", "service", "value")
    for part in range(2):
        sinks.append_csv(ev.where(F.col("event_id") % 2 == part), path)
    rows = spark.read.schema("event_id bigint, node string, service string, value double").csv(path, header=True)
    return rows.groupBy("node", "service").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


@query("s12_effect_table", f"""WITH {MEANS_SQL}, effects AS (SELECT change_index, {EFFECT_SQL} FROM means)
  SELECT change_index, {", ".join(f"round({n}, 6) AS {n}" for n in EFFECT_NAMES)} FROM effects""")
def effect_table(spark, sf_dir):
    path = scratch_path(spark, "effect-table")
    sinks.write_effects(ex.effects(_means(spark, sf_dir)), path)
    schema = "change_index bigint, " + ", ".join(
        [f"{r}_{c} {t}" for r in ex.ROLES for c, t in [("snapshots", "bigint"), *[(n, "double") for n, *_ in
                                                                                 ex.EFFECT_METRICS]]]
        + [f"{k}_{n} double" for n, *_ in ex.EFFECT_METRICS for k in ("effect", "toxicity")])
    rows = spark.read.schema(schema).csv(path, header=True)
    return rows.select("change_index", *[F.round(n, 6).alias(n) for n in EFFECT_NAMES])


def exchanges(spark, sf_dir):
    """Conversation turns as exchanges of five services, in order of conversation and turn."""
    turns = b.table(spark, sf_dir, "conversations")
    order = F.col("conv_id") * 1000 + F.col("turn")
    text = F.struct(F.col("role").alias("role"), F.col("text").alias("content"))
    return turns.select(
        F.concat(F.lit("srv-"), (F.col("conv_id") % 5).cast("string")).alias("service"), order.alias("seq"),
        F.lit("run").alias("label"), F.lit("local").alias("llm_type"), F.array(text).alias("messages"),
        F.col("text").alias("response"))


@query("s13_exchange_transcripts", """SELECT 'srv-' || conv_id % 5 AS service, CAST(sum(9
  + len(text) - len(replace(text, chr(10), '')) + len(text) - len(replace(text, chr(10), ''))) AS BIGINT) AS lines
  FROM conversations GROUP BY 1""")
def exchange_transcripts(spark, sf_dir):
    path = scratch_path(spark, "transcripts")
    sinks.write_transcripts(exchanges(spark, sf_dir), path)
    return spark.read.text(path).groupBy("service").agg(F.count(F.lit(1)).alias("lines"))
