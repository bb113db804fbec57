"""Exact quantiles and tail means without gathering a group.

Values are counted per (key, bucket, value) and bucket totals locate the ranks asked for; only the buckets that hold
such a rank are then ordered. The built-in ``percentile`` keeps all distinct values of a key in one aggregation buffer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwise.functions.buckets import log_bucket


def _points(df: DataFrame, value: str, by: Sequence[str], weight: str | None = None) -> DataFrame:
    """Distinct values with their counts; rows without a value or a key are left out."""
    number = F.col(value).cast("double")
    kept = df.where(number.isNotNull() & ~F.isnan(number))
    for k in by:
        kept = kept.where(F.col(k).isNotNull())
    many = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return kept.groupBy(*by, log_bucket(number).alias("_b"), number.alias("_v")).agg(many.alias("_n"))


def _quantiles(points: DataFrame, by: list[str], probs: dict[str, float]) -> DataFrame:
    by_bucket = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    start, size = F.col("_start"), F.col("_size")
    ranks = []
    for name, p in probs.items():
        at = (F.col("_total") - 1) * F.lit(float(p))
        low = F.floor(at).cast("long")
        ranks.append(F.struct(F.lit(f"{name}|lo").alias("k"), low.alias("rank"), (at - low).alias("part")))
        ranks.append(F.struct(F.lit(f"{name}|hi").alias("k"), F.least(low + 1, F.col("_total") - 1).alias("rank"),
                              (at - low).alias("part")))
    buckets = (
        points.groupBy(*by, "_b").agg(F.sum("_n").alias("_size"))
        .withColumn("_start", F.coalesce(F.sum("_size").over(by_bucket), F.lit(0)))
        .withColumn("_total", F.sum("_size").over(Window.partitionBy(*by)))
        .withColumn("_ranks", F.filter(F.array(*ranks), lambda r: (r.rank >= start) & (r.rank < start + size)))
        .where(F.size("_ranks") > 0)
        .select(*by, "_b", "_start", "_ranks")
    )
    in_bucket = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_before")
    hits = (
        points.join(buckets, [*by, "_b"])
        .withColumn("_before", F.col("_start") + F.coalesce(F.sum("_n").over(in_bucket), F.lit(0)))
        .select(*by, "_v", F.explode(
            F.filter("_ranks", lambda r: (r.rank >= before) & (r.rank < before + F.col("_n")))).alias("_r"))
    )
    picks = []
    for name in probs:
        lo = F.max(F.when(F.col("_r.k") == f"{name}|lo", F.col("_v")))
        hi = F.max(F.when(F.col("_r.k") == f"{name}|hi", F.col("_v")))
        part = F.max(F.when(F.col("_r.k") == f"{name}|lo", F.col("_r.part")))
        picks.append((lo + (hi - lo) * part).alias(name))
    return hits.groupBy(*by).agg(*picks)


def quantiles(
    df: DataFrame, value: str, by: Sequence[str], probs: dict[str, float], weight: str | None = None
) -> DataFrame:
    """One row per key with a linearly interpolated quantile per entry of ``probs`` (name to probability).

    ``weight`` names a column that says how many rows a row stands for.
    """
    if not by:
        whole = df.withColumn("_all", F.lit(0))
        return _quantiles(_points(whole, value, ["_all"], weight), ["_all"], probs).drop("_all")
    return _quantiles(_points(df, value, by, weight), list(by), probs)


def tail_mean(df: DataFrame, value: str, by: Sequence[str], alpha: float = 0.95, name: str = "cvar") -> DataFrame:
    """Mean of the values at or above their ``alpha`` quantile (conditional value at risk), per key.

    Whole buckets above the quantile enter through their totals; only the bucket with the quantile is ordered.
    """
    keyed, keys = (df, list(by)) if by else (df.withColumn("_all", F.lit(0)), ["_all"])
    points = _points(keyed, value, keys)
    below = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_size").over(Window.partitionBy(*keys))
    cuts = (
        points.groupBy(*keys, "_b").agg(F.sum("_n").alias("_size"), F.sum(F.col("_v") * F.col("_n")).alias("_sum"))
        .select(*keys, "_b", "_size",
                F.coalesce(F.sum("_size").over(below), F.lit(0)).alias("_start"),
                F.coalesce(F.sum("_size").over(above), F.lit(0)).alias("_n_above"),
                F.coalesce(F.sum("_sum").over(above), F.lit(0.0)).alias("_s_above"),
                F.ceil((total - 1) * F.lit(float(alpha))).alias("_rank"))
        .where((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_size")))
    )
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tail = points.join(cuts, [*keys, "_b"]).withColumn("_last", F.col("_start") + F.sum("_n").over(inside)).where(
        F.col("_last") > F.col("_rank"))
    whole = F.sum(F.col("_v") * F.col("_n")) + F.max("_s_above")
    count = F.sum("_n") + F.max("_n_above")
    return tail.groupBy(*keys).agg((whole / count).alias(name)).drop("_all")
