"""Trace shaping, deadlines and attribution over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwise import dims
from spanwise.functions import scalars as sc
from spanwise.operators import attribution as at
from spanwise.operators import risk
from spanwise.operators import traces as tr
from spanwise.operators.quantiles import tail_mean
from spanwise.plans import bindings as b
from spanwise.plans.registry import query


def _wide(df):
    return [F.col("durations")[op].alias(op) for op in b.OPS]


def anomalies_of(live, limits):
    return at.primary_service(risk.past_deadline(b.attributions(live), limits), b.OP_SERVICE)


def _anomalies(spark, sf_dir):
    live, training = b.split(spark, sf_dir)
    return anomalies_of(live, risk.deadlines(training))


@query("t1_trace_summary", f"WITH {b.SPANS_SQL} SELECT trace_id, min(start_us) AS start_us, "
       "CAST(sum(duration_us) AS BIGINT) AS total_us FROM spans GROUP BY 1")
def trace_summary(spark, sf_dir):
    return tr.summarize(b.spans(spark, sf_dir), b.OPS).select("trace_id", "start_us", "total_us")


@query("t2_span_pivot", f"WITH {b.TRACES_SQL} SELECT trace_id, op_0, op_1, op_2, op_3 FROM wide")
def span_pivot(spark, sf_dir):
    rows = tr.summarize(b.spans(spark, sf_dir), b.OPS)
    return rows.select("trace_id", *_wide(rows))


@query("t3_pattern_signature", f"WITH {b.TRACES_SQL} SELECT pattern, count(*) AS n FROM traces GROUP BY 1")
def pattern_signature(spark, sf_dir):
    return b.traces(spark, sf_dir).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


@query("t4_align_to_training", f"""WITH {b.TRACES_SQL} SELECT trace_id, total_us, op_0, op_2, CAST(0 AS BIGINT) AS op_9,
  CAST(CAST(op_0 > 0 AS INT) AS VARCHAR) || CAST(CAST(op_2 > 0 AS INT) AS VARCHAR) || '0' AS pattern FROM live""")
def align_to_training(spark, sf_dir):
    live, _ = b.split(spark, sf_dir)
    rows = tr.align(live, ["op_9", "op_2", "op_0"])
    return rows.select("trace_id", "total_us", "pattern",
                       *[F.col("durations")[op].alias(op) for op in ("op_0", "op_2", "op_9")])


@query("t5_micros_to_timestamp", f"""WITH {b.SPANS_SQL} SELECT trace_id,
  strftime(make_timestamp(min(start_us)), '%Y-%m-%d %H:%M:%S.%f') AS start_time FROM spans GROUP BY 1""")
def micros_to_timestamp(spark, sf_dir):
    starts = b.spans(spark, sf_dir).groupBy("trace_id").agg(F.min("start_us").alias("us"))
    return starts.select("trace_id", F.date_format(sc.micros_to_timestamp(F.col("us")), "yyyy-MM-dd HH:mm:ss.SSSSSS")
                         .alias("start_time"))


@query("t6_operation_service", f"""WITH {b.SPANS_SQL} SELECT operation, CASE operation WHEN 'op_0' THEN 'srv-a'
  WHEN 'op_1' THEN 'srv-b' WHEN 'op_2' THEN 'srv-c' END AS service, count(*) AS n FROM spans GROUP BY 1, 2""")
def operation_service(spark, sf_dir):
    service = sc.base_name(sc.lookup(F.col("operation"), b.OP_SERVICE)).alias("service")
    return b.spans(spark, sf_dir).groupBy("operation", service).agg(F.count(F.lit(1)).alias("n"))


@query("t7_numeric_coercion", """SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority
  ELSE CAST(o_custkey AS VARCHAR) END AS DOUBLE) AS number FROM orders""")
def numeric_coercion(spark, sf_dir):
    mixed = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.col("o_custkey").cast("string"))
    return b.table(spark, sf_dir, "orders").select("o_orderkey", sc.number(mixed).alias("number"))


@query("s11_capped_window_fetch", f"""WITH {b.TRACES_SQL},
padded AS (SELECT *, unnest(generate_series(
    CAST(ceil((start_us - 2592000000000 - 86400000000) / 2592000000000) AS BIGINT),
    CAST(floor((start_us + 86400000000) / 2592000000000) AS BIGINT))) * 2592000000000 AS w FROM traces),
numbered AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY start_us DESC, trace_id) AS rn FROM padded),
kept AS (SELECT * FROM numbered WHERE rn <= 50)
SELECT w AS window_us, trace_id, rn, count(*) OVER (PARTITION BY w) >= 50 AS cap_hit FROM kept""")
def capped_window_fetch(spark, sf_dir):
    rows = tr.capped(b.traces(spark, sf_dir), b.WINDOW_US, pad_us=sc.DAY_US, cap=50)
    return rows.select("window_us", "trace_id", F.col("rn").cast("long").alias("rn"), "cap_hit")


@query("a1_count_and_mean", f"""WITH {b.TRACES_SQL} SELECT window_us, count(*) AS total_requests,
  CAST(sum(total_us) AS DOUBLE) / count(*) AS mean_response_time FROM live GROUP BY 1""")
def count_and_mean(spark, sf_dir):
    live, _ = b.split(spark, sf_dir)
    windowed = live.withColumn("window_us", tr.window_start(F.col("start_us"), b.WINDOW_US))
    return risk.response_summary(windowed, ["window_us"])


@query("a2_p90_overall", f"""WITH {b.TRACES_SQL} SELECT round(quantile_cont(total_us, 0.9), 4) AS p90_response_time
  FROM live""")
def p90_overall(spark, sf_dir):
    live, _ = b.split(spark, sf_dir)
    return risk.p90(live).select(F.round("p90_response_time", 4).alias("p90_response_time"))


@query("a3_p90_per_pattern", f"""WITH {b.TRACES_SQL} SELECT window_us, pattern,
  round(quantile_cont(total_us, 0.9), 4) AS p90_response_time FROM live GROUP BY 1, 2""")
def p90_per_pattern(spark, sf_dir):
    live, _ = b.split(spark, sf_dir)
    windowed = live.withColumn("window_us", tr.window_start(F.col("start_us"), b.WINDOW_US))
    out = risk.p90(windowed, ["window_us", "pattern"])
    return out.withColumn("p90_response_time", F.round("p90_response_time", 4))


@query("a4_cvar", f"WITH {b.LIMITS_SQL} SELECT pattern, round(threshold, 4) AS cvar FROM cvar")
def cvar(spark, sf_dir):
    _, training = b.split(spark, sf_dir)
    return tail_mean(training, "total_us", ["pattern"]).withColumn("cvar", F.round("cvar", 4))


@query("a5_deadline_threshold", f"WITH {b.LIMITS_SQL} SELECT pattern, round(threshold, 4) AS threshold FROM limits")
def deadline_threshold(spark, sf_dir):
    return risk.thresholds(*b.split(spark, sf_dir)).withColumn("threshold", F.round("threshold", 4))


MISS_SQL = b.LIMITS_SQL + """,
rates AS (SELECT pattern, count(*) FILTER (total_us > threshold) AS miss_count, count(*) AS total_requests,
    CAST(sum(total_us) AS DOUBLE) / count(*) AS mean_response_time, max(total_us) AS max_response_time,
    CAST(count(*) FILTER (total_us > threshold) AS DOUBLE) / count(*) * 100 AS miss_rate
  FROM live JOIN limits USING (pattern) GROUP BY 1)"""


@query("a6_pattern_miss_rate", f"WITH {MISS_SQL} SELECT * FROM rates")
def pattern_miss_rate(spark, sf_dir):
    live, training = b.split(spark, sf_dir)
    return risk.miss_rates(live, risk.deadlines(training))


@query("a7_overall_miss_rate", f"WITH {MISS_SQL} SELECT round(avg(miss_rate), 6) AS deadline_miss_rate FROM rates")
def overall_miss_rate(spark, sf_dir):
    rates = pattern_miss_rate(spark, sf_dir)
    return risk.overall_miss_rate(rates).select(F.round("deadline_miss_rate", 6).alias("deadline_miss_rate"))


@query("a8_anomaly_rate", f"""WITH {b.ATTRIBUTED_SQL},
requests AS (SELECT window_us, count(*) AS n FROM live GROUP BY 1),
hits AS (SELECT window_us, service, count(*) AS k FROM anomalies GROUP BY 1, 2)
SELECT window_us, service, k AS anomaly_count, round(CAST(k AS DOUBLE) / n * 100, 6) AS anomaly_rate
FROM hits JOIN requests USING (window_us)""")
def anomaly_rate(spark, sf_dir):
    live, _ = b.split(spark, sf_dir)
    width = tr.window_start(F.col("start_us"), b.WINDOW_US)
    requests = live.groupBy(width.alias("window_us")).agg(F.count(F.lit(1)).alias("n"))
    hits = at.counts_by_service(_anomalies(spark, sf_dir).withColumn("window_us", width), ["window_us"])
    rate = F.coalesce(F.try_divide(F.col("anomaly_count") * 100.0, "n"), F.lit(0.0))
    return hits.join(requests, "window_us").select(
        "window_us", "service", "anomaly_count", F.round(rate, 6).alias("anomaly_rate"))


@query("a21_contribution_rollup", f"""WITH {b.ATTRIBUTED_SQL} SELECT feature, count(*) AS n,
  sum(abs(c)) AS total_contribution, sum(abs(c)) / count(*) AS average_contribution FROM anomalies GROUP BY 1""")
def contribution_rollup(spark, sf_dir):
    return at.contribution_rollup(_anomalies(spark, sf_dir))


@query("a22_anomalies_per_service", f"""WITH {b.ATTRIBUTED_SQL} SELECT coalesce(service, '(all)') AS service,
  count(*) AS anomaly_count FROM anomalies GROUP BY ROLLUP (service)""")
def anomalies_per_service(spark, sf_dir):
    found = _anomalies(spark, sf_dir)
    return found.rollup("service").agg(F.count(F.lit(1)).alias("anomaly_count")).withColumn(
        "service", F.coalesce("service", F.lit("(all)")))


@query("d6_deadline_gate", f"WITH {b.ATTRIBUTED_SQL} SELECT trace_id, pattern, total_us FROM flagged")
def deadline_gate(spark, sf_dir):
    live, training = b.split(spark, sf_dir)
    gated = risk.past_deadline(b.attributions(live), risk.deadlines(training))
    return gated.select("trace_id", "pattern", "total_us")


@query("d8_primary_contributor", f"WITH {b.ATTRIBUTED_SQL} SELECT trace_id, feature, c AS contribution, service "
       "FROM anomalies")
def primary_contributor(spark, sf_dir):
    return _anomalies(spark, sf_dir).select("trace_id", "feature", "contribution", "service")


@query("d9_anomaly_record", f"""WITH {b.ATTRIBUTED_SQL} SELECT trace_id, pattern, total_us AS response_time,
  start_us AS timestamp_us, total_us / 1000000.0 AS duration_seconds, service FROM anomalies""")
def anomaly_record(spark, sf_dir):
    return _anomalies(spark, sf_dir).select(
        "trace_id", "pattern", "response_time", F.col("start_us").alias("timestamp_us"), "duration_seconds", "service")


@query("w7_slowest_first", f"""WITH {b.ATTRIBUTED_SQL} SELECT service, trace_id, total_us AS response_time,
  row_number() OVER (PARTITION BY service ORDER BY total_us DESC, CAST(trace_id AS VARCHAR)) AS position FROM anomalies""")
def slowest_first(spark, sf_dir):
    return at.slowest_first(_anomalies(spark, sf_dir)).select("service", "trace_id", "response_time", "position")


@query("w8_two_lowest", f"""WITH {b.LIMITS_SQL},
contrib AS (
  SELECT trace_id, 0 AS pos, 'total' AS feature, (trace_id * 31 + total_us) % 201 - 100 AS c FROM live
  UNION ALL SELECT trace_id, 1, 'op_0', (trace_id * 31 + 17 + op_0) % 201 - 100 FROM live
  UNION ALL SELECT trace_id, 2, 'op_1', (trace_id * 31 + 34 + op_1) % 201 - 100 FROM live
  UNION ALL SELECT trace_id, 3, 'op_2', (trace_id * 31 + 51 + op_2) % 201 - 100 FROM live
  UNION ALL SELECT trace_id, 4, 'op_3', (trace_id * 31 + 68 + op_3) % 201 - 100 FROM live),
ranked AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY c, pos) AS place FROM contrib)
SELECT trace_id, place, feature, CAST(c AS DOUBLE) AS contribution FROM ranked WHERE place <= 2""")
def two_lowest(spark, sf_dir):
    live, _ = b.split(spark, sf_dir)
    rows = b.attributions(live).select("trace_id", F.posexplode(at.two_lowest(F.col("attribution"))))
    return rows.select("trace_id", (F.col("pos") + 1).cast("long").alias("place"), F.col("col.feature").alias("feature"),
                       F.col("col.value").alias("contribution"))


# Events take the known operations and pod prefixes in turn; one more of each is unknown.
_KNOWN_OPS = [*sorted(dims.OPERATION_SERVICE), "unknown"]
_KNOWN_PODS = [*sorted(dims.POD_PREFIX_SERVICE), "unknown"]


def _values_sql(mapping):
    return ", ".join(f"('{k}', '{v}')" for k, v in sorted(mapping.items()))


@query("s14_dimension_tables", f"""WITH e AS (SELECT {b._sql_list(_KNOWN_OPS)}[event_id % {len(_KNOWN_OPS)} + 1] AS operation,
  {b._sql_list(_KNOWN_PODS)}[event_id % {len(_KNOWN_PODS)} + 1] AS prefix FROM events),
ops(operation, service) AS (VALUES {_values_sql(dims.OPERATION_SERVICE)}),
pods(prefix, pod_service) AS (VALUES {_values_sql(dims.POD_PREFIX_SERVICE)}),
aliases(pod_service, config_key) AS (VALUES {_values_sql(dims.CONFIG_KEY_ALIAS)})
SELECT service, pod_service, config_key, count(*) AS n FROM e LEFT JOIN ops USING (operation)
LEFT JOIN pods USING (prefix) LEFT JOIN aliases USING (pod_service) GROUP BY 1, 2, 3""")
def dimension_tables(spark, sf_dir):
    def pick(names):
        return F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % len(names) + 1).cast("int"))

    events = b.table(spark, sf_dir, "events").groupBy(
        pick(_KNOWN_OPS).alias("operation"), pick(_KNOWN_PODS).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    ops = dims.mapping_table(spark, dims.OPERATION_SERVICE, "operation", "service")
    pods = dims.mapping_table(spark, dims.POD_PREFIX_SERVICE, "prefix", "pod_service")
    keys = dims.mapping_table(spark, dims.CONFIG_KEY_ALIAS, "pod_service", "config_key")
    rows = events.join(F.broadcast(ops), "operation", "left").join(F.broadcast(pods), "prefix", "left").join(
        F.broadcast(keys), "pod_service", "left")
    return rows.groupBy("service", "pod_service", "config_key").agg(F.sum("n").alias("n"))
