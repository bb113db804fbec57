"""From per-feature contributions of flagged traces to the responsible service."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions.scalars import base_name, lookup, us_to_s
from spanwise.operators.ordered import numbered_by_range

SKIPPED_FEATURES = ("mongo_rate",)


def two_lowest(attribution: Column) -> Column:
    """The two most negative contributions; equal values keep feature order."""
    keyed = F.transform(attribution, lambda a: F.struct(a.value.alias("value"), a.pos.alias("pos"),
                                                        a.feature.alias("feature")))
    return F.slice(F.array_sort(keyed), 1, 2)


def primary_service(
    flagged: DataFrame, op_service: Mapping[str, str], skip: Sequence[str] = SKIPPED_FEATURES
) -> DataFrame:
    """Anomaly records of the traces whose first candidate feature has a service.

    Only one candidate is looked at: of the two lowest contributions the first that is not skipped. Where it has no
    service, the trace is dropped.
    """
    kept = F.filter(two_lowest(F.col("attribution")), lambda a: ~a.feature.isin(*skip))
    return (
        flagged.withColumn("_first", F.try_element_at(kept, F.lit(1)))
        .withColumn("service", base_name(lookup(F.col("_first.feature"), op_service)))
        .where(F.col("service").isNotNull())
        .withColumn("feature", F.col("_first.feature"))
        .withColumn("contribution", F.col("_first.value"))
        .withColumn("response_time", F.col("total_us"))
        .withColumn("duration_seconds", us_to_s(F.col("total_us")))
        .drop("_first")
    )


def contribution_rollup(anomalies: DataFrame) -> DataFrame:
    """Per feature: how often it came first, the sum of absolute contributions and their mean."""
    return anomalies.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs("contribution")).alias("total_contribution"),
    ).withColumn("average_contribution", F.col("total_contribution") / F.col("n"))


def counts_by_service(anomalies: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return anomalies.groupBy(*by, "service").agg(F.count(F.lit(1)).alias("anomaly_count"))


def slowest_first(anomalies: DataFrame) -> DataFrame:
    """Number the anomalies of each service from the longest response time down; ties go by the text of their id."""
    time, tie = F.col("response_time"), F.col("trace_id").cast("string")
    return numbered_by_range(anomalies, ["service"], [-time, tie], "position")
