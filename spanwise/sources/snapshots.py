"""Stored snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SNAPSHOT_SCHEMA = """
timestamp string, total_requests bigint, mean_response_time double, p90_response_time double,
deadline_miss_rate double,
patterns map<string, struct<deadline_miss_rate double, mean_response_time double, p90_response_time double>>,
sum_cpu_utilization_cores double, sum_cpu_utilization double, sum_memory_utilization_mb double,
sum_memory_utilization double, anomaly_count bigint, anomaly_rate double,
services map<string, struct<anomaly_count bigint, anomaly_rate double, cpu_utilization_cores double,
  memory_utilization_mb double, restart_count bigint, oom_killed boolean>>,
phase string, subphase string, pod_health map<string, struct<restarts bigint, oom_killed boolean>>,
collection_label string, collection_start_time string, collection_end_time string,
nodes map<string, struct<cpu_utilization_pct double, memory_utilization_pct double, cpu_usage_cores double,
  cpu_limit_cores double, memory_usage_mb double, memory_limit_mb double, services map<string, double>>>,
configurations array<string>, trace_count bigint, metrics_config_count bigint
"""


def read_snapshots(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Snapshots from a JSON array (``multi_line``) or from lines; a missing path is an error."""
    return spark.read.schema(SNAPSHOT_SCHEMA).json(path, multiLine=multi_line)


def append_snapshots(snapshots: DataFrame, path: str) -> None:
    """Add snapshots as lines; what is stored is not rewritten."""
    snapshots.write.mode("append").json(path)
