"""Deadline thresholds and miss rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.operators.quantiles import quantiles, tail_mean


def response_summary(traces: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Request count and mean response time per key."""
    return traces.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_requests"), F.avg("total_us").alias("mean_response_time"))


def p90(traces: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    return quantiles(traces, "total_us", by, {"p90_response_time": 0.9}, weight)


def deadlines(training: DataFrame, alpha: float = 0.95) -> DataFrame:
    """Deadline per training pattern: the mean of its slowest share."""
    return tail_mean(training, "total_us", ["pattern"], alpha, "threshold")


def thresholds(live: DataFrame, training: DataFrame | None, alpha: float = 0.95) -> DataFrame:
    """Deadline per live pattern from the training tail; 0 for a pattern that training lacks.

    Without any training table the live traces stand in for it.
    """
    if training is None:
        return deadlines(live, alpha)
    return (
        live.select("pattern").distinct().join(deadlines(training, alpha), "pattern", "left")
        .withColumn("threshold", F.coalesce("threshold", F.lit(0.0)))
    )


def miss_rates(live: DataFrame, limits: DataFrame, by: Sequence[str] = ("pattern",), weight: str | None = None) -> DataFrame:
    """Share of traces above their pattern's deadline, in percent, with count, mean and maximum.

    Equal totals are combined before the deadlines are joined in; with ``weight`` they are, and it names their number. A
    pattern without a deadline has deadline 0.
    """
    keys = list(dict.fromkeys([*by, "pattern"]))
    if weight is None:
        combined = live.groupBy(*keys, "total_us").agg(F.count(F.lit(1)).alias("_n"))
    else:
        combined = live.withColumn("_n", F.col(weight))
    late = F.when(F.col("total_us") > F.coalesce("threshold", F.lit(0.0)), F.col("_n")).otherwise(F.lit(0))
    out = combined.join(limits, "pattern", "left").groupBy(*by).agg(
        F.sum(late).alias("miss_count"), F.sum("_n").alias("total_requests"),
        (F.sum(F.col("total_us") * F.col("_n")) / F.sum("_n")).alias("mean_response_time"),
        F.max("total_us").alias("max_response_time"),
    )
    return out.withColumn("miss_rate", F.col("miss_count") / F.col("total_requests") * 100)


def overall_miss_rate(rates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean of the pattern miss rates; 0 where there is none."""
    return rates.groupBy(*by).agg(F.coalesce(F.avg("miss_rate"), F.lit(0.0)).alias("deadline_miss_rate"))


def past_deadline(flagged: DataFrame, limits: DataFrame) -> DataFrame:
    """Outliers that also took longer than their pattern's deadline."""
    limit = F.coalesce("threshold", F.lit(0.0))
    return flagged.where("is_outlier").join(limits, "pattern", "left").where(F.col("total_us") > limit)
