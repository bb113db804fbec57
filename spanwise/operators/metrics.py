"""Metric samples to rates, aggregates, ratios, step grids and wide tables.

A sample is one row with label columns, an integer epoch second ``ts_s`` and a ``value``. A series is a set of label
columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.functions.buckets import chunk
from spanwise.functions.scalars import longest_prefix
from spanwise.operators.ordered import BEFORE, UP_TO_HERE, neighbours, ranged, same_keys

LOOKBACK_S = 300


def matching(
    samples: DataFrame, equal: Mapping[str, str] | None = None, differ: Mapping[str, str] | None = None,
    like: Mapping[str, str] | None = None,
) -> DataFrame:
    """Label matchers ``=``, ``!=`` and ``=~``; a regular expression has to match the whole label."""
    for label, want in (equal or {}).items():
        samples = samples.where(F.col(label) == want)
    for label, out in (differ or {}).items():
        samples = samples.where(F.coalesce(F.col(label), F.lit("")) != out)
    for label, regex in (like or {}).items():
        samples = samples.where(F.col(label).rlike(f"^(?:{regex})$"))
    return samples


def increase(
    samples: DataFrame, series: Sequence[str], range_s: int, value: str = "value", order: Sequence[str] = (),
    name: str = "increase",
) -> DataFrame:
    """Counter growth over the trailing ``range_s`` seconds of every sample, corrected for resets.

    The growth of a series up to each sample comes from pieces of equal size: samples are range-partitioned by series and
    time, a piece tells its first and last value and its growth, and the pieces of a series are joined by these. A second
    line holds for every sample also the start of its range, which takes the growth up to the next sample there, if need be
    that of a later piece. So a dense series is spread like any other.
    """
    stored, ranks = ranged(samples, series, [F.col("ts_s"), *[F.col(o) for o in order]])
    line = Window.partitionBy(*series, "_part").orderBy(*ranks)
    grown = stored.withColumn("_step", _step(F.col(value), F.lag(value).over(line)))
    grown = grown.withColumn("_grown", F.sum("_step").over(line.rowsBetween(*UP_TO_HERE)))
    pieces = Window.partitionBy(*series).orderBy("_part")
    ends = grown.groupBy(*series, "_part").agg(
        F.min_by(value, F.struct(*ranks)).alias("_first"), F.max_by(value, F.struct(*ranks)).alias("_last"), F.sum("_step").alias("_own"))
    ends = ends.withColumn("_joint", _step(F.col("_first"), F.lag("_last").over(pieces))).select(
        *series, "_part", (F.coalesce(F.sum("_own").over(pieces.rowsBetween(*BEFORE)), F.lit(0.0))
                           + F.sum("_joint").over(pieces.rowsBetween(*UP_TO_HERE))).alias("_before"))
    total = grown.alias("g").join(ends.alias("e"), same_keys([*series, "_part"], "g", "e")).select(
        *[F.col(f"g.`{c}`") for c in samples.columns], (F.col("g._grown") + F.col("e._before")).alias("_total"))
    both = total.withColumn("_asks", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn(
        "_at", F.when(F.col("_asks"), F.col("ts_s") - range_s + 1).otherwise(F.col("ts_s")))
    # A range starts before a sample at its first second. Read backwards, the first sample of a range is the last one seen.
    asked, ranks = ranged(both, series, [F.col("_at"), ~F.col("_asks"), *[F.col(o) for o in order]])
    backwards = Window.partitionBy(*series, "_part").orderBy(*[F.desc(r) for r in ranks]).rowsBetween(*UP_TO_HERE)
    seen = F.when(~F.col("_asks"), F.col("_total"))
    near = asked.withColumn("_near", F.last(seen, ignorenulls=True).over(backwards)).where("_asks")
    later = Window.partitionBy(*series).orderBy(F.desc("_part")).rowsBetween(*BEFORE)
    heads = asked.groupBy(*series, "_part").agg(F.min_by("_total", F.when(~F.col("_asks"), F.struct(*ranks))).alias("_head"))
    heads = heads.select(*series, "_part", F.last("_head", ignorenulls=True).over(later).alias("_later"))
    out = near.alias("n").join(heads.alias("h"), same_keys([*series, "_part"], "n", "h"))
    first = F.coalesce(F.col("n._near"), F.col("h._later"))
    return out.select(*[F.col(f"n.`{c}`") for c in samples.columns], (F.col("n._total") - first).alias(name))


def _step(value: Column, before: Column) -> Column:
    """Growth from one sample to the next; after a reset the counter started from zero."""
    return F.when(before.isNull(), F.lit(0.0)).when(value < before, value).otherwise(value - before)


def increase_at(
    samples: DataFrame, series: Sequence[str], end: int, lookback_s: int, value: str = "value",
    order: Sequence[str] = (), piece_s: int = 3600,
) -> DataFrame:
    """Counter growth of each series over the ``lookback_s`` seconds up to ``end``, corrected for resets."""
    recent = samples.where((F.col("ts_s") > end - lookback_s) & (F.col("ts_s") <= end)).select(
        *series, "ts_s", *order, value)
    near = neighbours(recent, series, chunk(F.col("ts_s"), piece_s), ["ts_s", *order], back={"_before": value})
    return near.groupBy(*series).agg(F.sum(_step(F.col(value), F.col("_before"))).alias("increase"))


def rate(samples: DataFrame, series: Sequence[str], range_s: int, value: str = "value", order: Sequence[str] = (),
         name: str = "rate") -> DataFrame:
    """Counter growth per second over the trailing range."""
    grown = increase(samples, series, range_s, value, order, name)
    return grown.withColumn(name, F.col(name) / F.lit(float(range_s)))


def sum_by(samples: DataFrame, labels: Sequence[str], value: str = "value", name: str = "value") -> DataFrame:
    return samples.groupBy(*labels).agg(F.sum(value).alias(name))


def count_by(samples: DataFrame, labels: Sequence[str], name: str = "value") -> DataFrame:
    return samples.groupBy(*labels).agg(F.count(F.lit(1)).alias(name))


def relabel(samples: DataFrame, src: str, regex: str, replacement: str, dst: str) -> DataFrame:
    """Write ``replacement`` into ``dst`` where the whole source label matches; elsewhere ``dst`` keeps its value."""
    whole = f"^(?:{regex})$"
    source = F.coalesce(F.col(src), F.lit(""))
    kept = F.col(dst) if dst in samples.columns else F.lit(None).cast("string")
    return samples.withColumn(
        dst, F.when(source.rlike(whole), F.regexp_replace(source, whole, replacement)).otherwise(kept))


def match_left(many: DataFrame, one: DataFrame, on: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Product of two sample tables, many rows to one, with labels of the one side carried over."""
    right = one.select(*on, *carry, F.col("value").alias("_one"))
    return many.join(right, list(on)).withColumn("value", F.col("value") * F.col("_one")).drop("_one")


def utilisation(used: DataFrame, limit: DataFrame, on: Sequence[str], name: str = "utilisation_pct") -> DataFrame:
    """Hundred times used over limit; null where the limit is zero."""
    right = limit.select(*on, F.col("value").alias("_limit"))
    ratio = F.try_divide(F.col("value") * 100.0, F.col("_limit"))
    return used.join(right, list(on)).select(*on, ratio.alias(name))


def step_grid(
    samples: DataFrame, series: Sequence[str], start: int, end: int, step_s: int, lookback_s: int = LOOKBACK_S,
    order: Sequence[str] = (),
) -> DataFrame:
    """Value of each series at every step: its latest sample within the lookback. Steps without one are absent.

    Samples are thinned to the latest per step, then offered to the steps that can still see them.
    """
    at = F.struct("ts_s", *order, "value")
    usable = samples.where((F.col("ts_s") > start - lookback_s) & (F.col("ts_s") <= end))
    first = F.greatest(F.ceil((F.col("ts_s") - start) / step_s), F.lit(0)).cast("long")
    thin = usable.groupBy(*series, first.alias("_first")).agg(F.max(at).alias("_at"))
    final = F.least(F.floor((F.col("_at.ts_s") + (lookback_s - 1) - start) / step_s),
                    F.lit((end - start) // step_s)).cast("long")
    seen = thin.withColumn("_last", final).where(F.col("_first") <= F.col("_last")).withColumn(
        "_k", F.explode(F.sequence("_first", "_last")))
    return seen.groupBy(*series, (F.lit(start) + F.col("_k") * step_s).cast("long").alias("step_s")).agg(
        F.max("_at").alias("_at")).select(*series, "step_s", F.col("_at.value").alias("value"))


def health_step(window_s: int) -> tuple[int, int]:
    """Lookback and step of the pod-health query: at least five minutes, in ten steps."""
    lookback = max(LOOKBACK_S, int(window_s))
    return lookback, lookback // 10


def instant(samples: DataFrame, series: Sequence[str], at: int, lookback_s: int = LOOKBACK_S,
            order: Sequence[str] = ()) -> DataFrame:
    """Latest value of each series at one instant, within the lookback."""
    recent = samples.where((F.col("ts_s") > at - lookback_s) & (F.col("ts_s") <= at))
    return recent.groupBy(*series).agg(F.max(F.struct("ts_s", *order, "value")).alias("_at")).select(
        *series, F.col("_at.value").alias("value"))


def label_values(samples: DataFrame, label: str) -> DataFrame:
    return samples.select(label).where(F.col(label).isNotNull()).distinct()


def latest_revision(samples: DataFrame, service: str, revision: str) -> DataFrame:
    return samples.groupBy(service).agg(F.max(revision).alias(revision))


def wide(samples: DataFrame, index: str, name: Column, value: str, names: Sequence[str]) -> DataFrame:
    """One column per metric on a common time index, the full outer merge of the metrics in one aggregation."""
    return samples.withColumn("_name", name).groupBy(index).pivot("_name", list(names)).agg(F.max(value))


def outer_merge(a: DataFrame, b: DataFrame, on: str = "index") -> DataFrame:
    return a.join(b, on, "full")


def first_series(samples: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """Keep only the first series of each key, in label order."""
    head = samples.groupBy(*by).agg(F.min(label).alias(label))
    return samples.join(head, [*by, label])


def extra_workloads(
    memory: DataFrame, cpu: DataFrame, prefixes: Mapping[str, str], base: DataFrame
) -> DataFrame:
    """Per-service sums for workloads known by pod prefix; they replace whatever ``base`` has for these services.

    ``memory`` holds gauge samples, ``cpu`` per-second rates, ``base`` rows (service, metric, ts_s, value).
    """
    parts = []
    for frame, metric in ((memory, "container_memory_working_set_bytes"), (cpu, "container_cpu_usage_seconds_total")):
        tagged = frame.withColumn("service", longest_prefix(F.col("pod"), prefixes)).where(
            F.col("service").isNotNull())
        parts.append(tagged.groupBy("service", F.lit(metric).alias("metric"), "ts_s").agg(F.sum("value").alias("value")))
    extra = parts[0].unionByName(parts[1])
    kept = base.join(extra.select("service").distinct(), "service", "left_anti")
    return kept.unionByName(extra)


NODE_METRICS = ("cpu_utilization_pct", "memory_utilization_pct", "cpu_usage_cores", "cpu_limit_cores",
                "memory_usage_bytes", "memory_limit_bytes")


def node_summary(samples: DataFrame, by: Sequence[str] = ("node",)) -> DataFrame:
    """Mean of the six node metrics per key; byte metrics come out in MiB under ``_mb`` names."""
    means = samples.groupBy(*by).pivot("metric", list(NODE_METRICS)).agg(F.avg("value"))
    out = []
    for m in NODE_METRICS:
        if m.endswith("_bytes"):
            out.append((F.col(m) / (1024 * 1024)).alias(m.removesuffix("_bytes") + "_mb"))
        else:
            out.append(F.col(m))
    return means.select(*by, *out)


def usage_by_service(samples: DataFrame, by: Sequence[str] = ("service",)) -> DataFrame:
    """CPU and memory of a service: mean of its first non-zero matching metric, memory in MiB, else 0."""
    means = samples.groupBy(*by, "metric").agg(F.min("metric_pos").alias("pos"), F.avg("value").alias("mean"))

    def pick(word: str) -> Column:
        use = F.lower(F.col("metric")).contains(word) & (F.col("mean") != 0)
        return F.coalesce(F.min_by(F.when(use, F.col("mean")), F.when(use, F.col("pos"))), F.lit(0.0))

    return means.groupBy(*by).agg(
        pick("cpu").alias("cpu_utilization_cores"), (pick("memory") / (1024 * 1024)).alias("memory_utilization_mb"))


def cluster_totals(samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum of the positive metric means over all services, memory in MiB."""
    keys = list(by)
    means = samples.groupBy(*keys, "service", "metric").agg(F.avg("value").alias("mean")).where(F.col("mean") > 0)

    def total(word: str) -> Column:
        return F.coalesce(F.sum(F.when(F.lower(F.col("metric")).contains(word), F.col("mean"))), F.lit(0.0))

    return means.groupBy(*keys).agg(
        total("cpu").alias("sum_cpu_utilization_cores"),
        (total("memory") / (1024 * 1024)).alias("sum_memory_utilization_mb"))


def average_pods(counts: DataFrame, by: Sequence[str] = ("node", "service")) -> DataFrame:
    """Mean pod count over the samples present."""
    return counts.groupBy(*by).agg(F.avg("value").alias("avg_pods"))


def restarts_by_service(grown: DataFrame, prefixes: Mapping[str, str]) -> DataFrame:
    """Restarts per service from the increase of each pod at the end, positive ones only, rounded half to even."""
    return (
        grown.withColumn("service", longest_prefix(F.col("pod"), prefixes))
        .where(F.col("service").isNotNull() & (F.col("increase") > 0))
        .groupBy("service").agg(F.sum(F.bround("increase")).cast("long").alias("restarts"))
    )


def pod_health(restarts: DataFrame, oom_pods: DataFrame, prefixes: Mapping[str, str]) -> DataFrame:
    """Restarts with an out-of-memory flag, which counts only where the service restarted in the same window."""
    killed = oom_pods.select(longest_prefix(F.col("pod"), prefixes).alias("service")).where(
        F.col("service").isNotNull()).distinct()
    active = killed.join(restarts.where(F.col("restarts") > 0), "service", "left_semi").withColumn(
        "oom_killed", F.lit(True))
    return restarts.join(active, "service", "left").withColumn(
        "oom_killed", F.coalesce("oom_killed", F.lit(False)))
