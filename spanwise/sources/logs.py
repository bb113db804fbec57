"""Load-test logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESPONSE_LOG_SCHEMA = ("request_type string, name string, response_time double, response_length bigint, "
                       "status_code int")


def read_load_history(spark: SparkSession, path: str) -> DataFrame:
    """Load history with its epoch seconds as a timestamp and without the name column."""
    rows = spark.read.csv(path, header=True)
    return rows.withColumn("Timestamp", F.timestamp_seconds(F.col("Timestamp").cast("long"))).drop("Name")


def read_response_logs(spark: SparkSession, glob: str) -> DataFrame:
    """Header-less worker logs as one table; blanks before a value are ignored."""
    return spark.read.schema(RESPONSE_LOG_SCHEMA).csv(glob, ignoreLeadingWhiteSpace=True)


def consolidate_response_logs(spark: SparkSession, glob: str, out: str) -> None:
    """Write the worker logs as one table with headers."""
    read_response_logs(spark, glob).write.mode("overwrite").csv(out, header=True)
