"""Trace documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE_SCHEMA = ("data array<struct<traceID string, spans array<struct<operationName string, startTime bigint, "
                "duration bigint, spanPos bigint>>>>")


def read_traces(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Spans of trace documents. A span's place in its trace is its array index unless the document states one.

    ``multi_line`` reads one document per file; without it every line is a document, which can be split.
    """
    docs = spark.read.schema(TRACE_SCHEMA).json(path, multiLine=multi_line)
    traces = docs.select(F.explode("data").alias("t"))
    spans = traces.select(F.col("t.traceID").alias("trace_id"), F.posexplode("t.spans").alias("at", "s"))
    return spans.select(
        "trace_id", F.col("s.operationName").alias("operation"), F.col("s.startTime").alias("start_us"),
        F.col("s.duration").alias("duration_us"), F.coalesce("s.spanPos", F.col("at").cast("long")).alias("span_pos"))


def write_traces(spans: DataFrame, path: str, mode: str = "append") -> None:
    """Archive spans as trace documents, one fragment of a trace per line; no trace is gathered into one row."""
    span = F.struct(F.col("operation").alias("operationName"), F.col("start_us").alias("startTime"),
                    F.col("duration_us").alias("duration"), F.col("span_pos").alias("spanPos"))
    trace = F.struct(F.col("trace_id").cast("string").alias("traceID"), F.array(span).alias("spans"))
    spans.select(F.array(trace).alias("data")).write.mode(mode).json(path)
