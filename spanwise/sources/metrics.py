"""Metric responses and metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESPONSE_SCHEMA = "data struct<result array<struct<metric map<string,string>, values array<array<string>>>>>"


def read_range_responses(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Samples (labels, ts_s, value) of range-query responses; times are cut to whole seconds. Empty results give none."""
    docs = spark.read.schema(RESPONSE_SCHEMA).json(path, multiLine=multi_line)
    series = docs.select(F.explode("data.result").alias("r"))
    pairs = series.select(F.col("r.metric").alias("labels"), F.explode("r.values").alias("p"))
    seconds = F.col("p")[0].cast("double")
    return pairs.select("labels", F.when(seconds < 0, F.ceil(seconds)).otherwise(F.floor(seconds)).alias("ts_s"),
                        F.col("p")[1].cast("double").alias("value"))


def with_labels(samples: DataFrame, labels: list[str]) -> DataFrame:
    """Labels of the map as columns."""
    return samples.select(*[F.try_element_at("labels", F.lit(n)).alias(n) for n in labels], "ts_s", "value")


def read_metric_csv(spark: SparkSession, glob: str) -> DataFrame:
    """Long samples (service, ts_s, metric, value) of files named ``<label>_<service>_metrics.csv``.

    Files may differ in their columns; each is read by its own header. Other file names are skipped, and so is an
    unnamed leading column.
    """
    lines = spark.read.text(glob).select(F.col("_metadata.file_path").alias("file"), F.split("value", ",").alias("cells"))
    name = F.regexp_extract("file", r"([^_/]+-[^_]+)_metrics\.csv", 1)
    lines = lines.withColumn("service", name).where(F.col("service") != "")
    is_header = F.array_contains("cells", "index")
    headers = lines.where(is_header).groupBy("file").agg(F.first("cells").alias("names"))
    rows = lines.where(~is_header).join(headers, "file")
    index = F.element_at("cells", F.array_position("names", "index").cast("int")).cast("long")
    cells = rows.select("service", index.alias("ts_s"), F.explode(F.arrays_zip("names", "cells")).alias("c"))
    kept = cells.where(~F.col("c.names").isin("index", "", "Unnamed: 0"))
    return kept.select("service", "ts_s", F.timestamp_seconds("ts_s").alias("ts"), F.col("c.names").alias("metric"),
                       F.col("c.cells").try_cast("double").alias("value"))
