"""Versioned configuration files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.functions.yaml_text import yaml_to_json
from spanwise.operators.configs import with_applied_at

BASE_VERSION = -1


def _service_and_seq(suffix: str) -> tuple[Column, Column]:
    """Service and version from ``<service>.yaml`` (base), ``<service>_<n>.yaml`` or ``service=<s>/seq=<n>/`` folders."""
    path = F.col("path")
    folder = F.regexp_extract(path, r"/service=([^/]+)/seq=(-?\d+)/", 1)
    folder_seq = F.regexp_extract(path, r"/service=([^/]+)/seq=(-?\d+)/", 2)
    stem = F.regexp_extract(path, rf"([^/]+?)(_\d+)?{suffix}$", 1)
    number = F.regexp_extract(path, rf"_(\d+){suffix}$", 1)
    seq = F.coalesce(F.nullif(folder_seq, F.lit("")).cast("long"), F.nullif(number, F.lit("")).cast("long"),
                     F.lit(BASE_VERSION).cast("long"))
    return F.coalesce(F.nullif(folder, F.lit("")), stem), seq


MARK = "--- # version "
# Bounds what a task reads at once.
VERSIONS_PER_FILE = 10_000


def write_configs(files: DataFrame, folder: str) -> None:
    """Documents (service, seq, text) in a folder per service; a file holds many versions, each below its mark.

    A file for each version costs more to make, move, list and open than all else. What comes for one version is one
    document, line below line; a version without a number is the base.
    """
    docs = files.groupBy("service", F.coalesce("seq", F.lit(BASE_VERSION)).cast("long").alias("seq")).agg(
        F.array_join(F.collect_list("text"), "\n").alias("text"))
    text = F.concat(F.lit(MARK), F.col("seq").cast("string"), F.lit("\n"), F.col("text"))
    docs.repartitionByRange("service", "seq").select("service", text.alias("value")).write.option(
        "maxRecordsPerFile", VERSIONS_PER_FILE).partitionBy("service").text(folder)


def _documents(files: DataFrame) -> DataFrame:
    """A row (path, version, text) per document; ``version`` is null in a file without marks, which is one document."""
    text = F.col("content").cast("string")
    parts = F.split(text, rf"(?m)^{MARK}(?=-?\d+$)")
    marked = F.slice(parts, F.lit(2), F.size(parts))
    many = F.transform(marked, lambda p: F.struct(F.substring_index(p, "\n", 1).alias("version"),
                                                  F.regexp_replace(p, r"\A-?\d+\n", "").alias("text")))
    one = F.array(F.struct(F.lit(None).cast("string").alias("version"), text.alias("text")))
    docs = files.select("path", F.explode(F.when(text.rlike(rf"\A{MARK}-?\d+\n"), many).otherwise(one)).alias("_d"))
    # A file may hold many documents: reading YAML is spread anew.
    return docs.select("path", "_d.*").repartition(files.sparkSession.sparkContext.defaultParallelism)


def read_configs(spark: SparkSession, folder: str, glob: str = "*.yaml") -> DataFrame:
    """Documents (service, seq, applied_at, doc) of a configuration folder, in version order per service.

    The base file has version -1. Files that do not read as YAML are skipped; application times come from the
    ``.meta.json`` files beside them and are null where there is none. Files of ``write_configs`` are read too.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(
        folder)
    service, seq = _service_and_seq(r"\.yaml")
    packed = F.nullif(F.regexp_extract("path", r"/service=([^/]+)/[^/]+$", 1), F.lit(""))
    version = F.col("version")
    docs = _documents(files).select(
        F.coalesce(F.when(version.isNotNull(), packed), service).alias("service"), F.coalesce(version.cast("long"), seq).alias("seq"),
        yaml_to_json(F.col("text")).alias("json"))
    docs = docs.where(F.col("json").isNotNull()).select("service", "seq", F.parse_json("json").alias("doc"))
    notes = spark.read.format("binaryFile").option("pathGlobFilter", "*.meta.json").option(
        "recursiveFileLookup", "true").load(folder)
    service, seq = _service_and_seq(r"\.meta\.json")
    applied = F.get_json_object(F.col("content").cast("string"), "$.applied_at")
    meta = notes.select(service.alias("service"), seq.alias("seq"), applied.alias("applied_at"))
    return with_applied_at(docs, meta).select("service", "seq", "applied_at", "doc")
