"""Experiment analysis over snapshots: effects of changes, spread, z-scores, dense series, placement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.operators.ordered import numbered_by_range
from spanwise.operators.quantiles import quantiles

# Compared metric, snapshot column, multiplier and divisor to the reported unit.
EFFECT_METRICS = (
    ("mean_response_time", "mean_response_time", 1.0, 1000.0),
    ("p90_response_time", "p90_response_time", 1.0, 1000.0),
    ("cpu_utilization", "sum_cpu_utilization_cores", 1000.0, 1.0),
    ("memory_utilization", "sum_memory_utilization_mb", 1.0, 1.0),
    ("anomaly_rate", "anomaly_rate", 1.0, 1.0),
    ("deadline_miss_rate", "deadline_miss_rate", 1.0, 1.0),
)
ROLES = ("before", "during", "after")
NAMES_PER_SLOT = 1000


def window_means(roles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per change: size and metric means of its before, during and after windows; changes without one are dropped."""
    out = []
    for role in ROLES:
        mine = F.col("role") == role
        out.append(F.count(F.when(mine, F.lit(1))).alias(f"{role}_snapshots"))
        for name, column, times, over in EFFECT_METRICS:
            reported = F.coalesce(F.col(column), F.lit(0.0)) * times / over
            out.append(F.avg(F.when(mine, reported)).alias(f"{role}_{name}"))
    rows = roles.groupBy(*by, "change_index").agg(*out)
    for role in ROLES:
        rows = rows.where(F.col(f"{role}_snapshots") > 0)
    return rows


def effects(means: DataFrame) -> DataFrame:
    """Effect (after minus before) and toxicity (during minus the middle of both) per change."""
    for name, *_ in EFFECT_METRICS:
        before, during, after = (F.col(f"{r}_{name}") for r in ROLES)
        means = means.withColumn(f"effect_{name}", after - before).withColumn(
            f"toxicity_{name}", during - (before + after) / 2.0)
    return means


def effect_rows(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Long form: one row per change, kind (effect or toxicity) and metric."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("metric"), F.col(f"{k}_{n}").alias("value"))
                      for k in ("effect", "toxicity") for n, *_ in EFFECT_METRICS])
    return table.select(*by, "change_index", F.explode(pairs).alias("_m")).select(*by, "change_index", "_m.*")


def spread(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean, extrema and quartiles per key."""
    plain = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"),
                                  F.max(value).alias("high"))
    return plain.join(quantiles(rows, value, by, {"q25": 0.25, "median": 0.5, "q75": 0.75}), list(by))


def zscore(rows: DataFrame, value: str, by: Sequence[str], name: str = "z") -> DataFrame:
    """Distance from the mean in population standard deviations; 0 where there is no spread."""
    stats = rows.groupBy(*by).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    z = F.when(F.col("_sd") > 0, (F.col(value) - F.col("_mean")) / F.col("_sd")).otherwise(F.lit(0.0))
    return rows.join(stats, list(by)).withColumn(name, z).drop("_mean", "_sd")


def names_in(maps: DataFrame, column: str) -> DataFrame:
    """All keys of a map column, one ``name`` a row."""
    return maps.select(F.explode(F.map_keys(column)).alias("name")).distinct()


def at_every_name(rows: DataFrame, names: DataFrame, key: str, per_slot: int = NAMES_PER_SLOT) -> DataFrame:
    """Each row once for every name, in column ``key``.

    Names are dealt to slots of about ``per_slot``, each an array; a row joins the slots by number and expands there.
    A name list of few slots is small enough for a broadcast; one that is not has slots enough to spread the rows.
    """
    slots = max(1, -(-names.count() // per_slot))
    listed = names.groupBy(F.pmod(F.xxhash64("name"), F.lit(slots).cast("long")).alias("_slot")).agg(
        F.collect_list("name").alias("_names"))
    at = F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))
    return rows.withColumn("_slot", F.explode(at)).join(listed, "_slot").withColumn(key, F.explode("_names")).drop(
        "_slot", "_names")


def dense(snapshots: DataFrame, column: str, names: DataFrame, key: str, fields: Sequence[str] | None = None,
          name: str = "value") -> DataFrame:
    """Every name at every snapshot, 0 where the map lacks it."""
    rows = at_every_name(snapshots, names, key)
    found = F.try_element_at(F.col(column), F.col(key))
    if fields is None:
        return rows.withColumn(name, F.coalesce(found, F.lit(0.0))).drop(column)
    return rows.select("*", *[F.coalesce(found[f], F.lit(0.0)).alias(f) for f in fields]).drop(column)


def memory_rank(service: Column) -> Column:
    """Caches first, then databases, then everything else."""
    s = F.lower(service)
    return F.when(s.contains("memcached"), 0).when(s.contains("mongo") | s.contains("database") | s.contains("db"),
                                                   1).otherwise(2)


def stacked(rows: DataFrame, at: Sequence[str], order: Sequence[Column], value: str, name: str = "top") -> DataFrame:
    """Running total across the names of one instant."""
    w = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.sum(value).over(w))


def latest(rows: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The last row per key."""
    picked = rows.groupBy(*by).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_row"))
    return picked.select("_row.*")


def placement_rows(snapshots: DataFrame, at: Sequence[str]) -> DataFrame:
    """One row per snapshot, node and service with its pod count."""
    nodes = snapshots.select(*at, F.explode("nodes").alias("node", "info"))
    return nodes.select(*at, "node", F.explode("info.services").alias("service", "pods"))


def by_priority(anomalies: DataFrame, duration: str = "duration_seconds", enqueued: str = "enqueued_at",
                tie: str = "trace_id", by: Sequence[str] = ()) -> DataFrame:
    """Number anomalies in queue order: shortest first, then oldest, then by the text of their id."""
    time, last = F.col(duration), F.col(tie).cast("string")
    return numbered_by_range(anomalies, by, [time, F.col(enqueued), last], "priority")


def head_of_queue(anomalies: DataFrame, n: int, duration: str = "duration_seconds", enqueued: str = "enqueued_at",
                  tie: str = "trace_id") -> DataFrame:
    """The first ``n`` in queue order with their ``priority``; each task keeps ``n`` rows at most, nothing else is ranked."""
    order = [F.col(duration), F.col(enqueued), F.col(tie).cast("string")]
    return anomalies.orderBy(*order).limit(n).withColumn("priority", F.row_number().over(Window.orderBy(*order)).cast("long"))


def first_per_service(queued: DataFrame, n: int, applied: Column | None = None) -> DataFrame:
    """Of the first ``n`` in the queue, those whose service has no applied change yet, the others marked as skipped.

    ``applied`` tells whether the change made for a row went through; a service counts as taken only after one did.
    """
    took = F.lit(True) if applied is None else applied
    earlier = Window.partitionBy("service").orderBy("priority").rowsBetween(Window.unboundedPreceding, -1)
    batch = queued.where(F.col("priority") <= n).withColumn("_took", took)
    return batch.withColumn("skipped", F.coalesce(F.max("_took").over(earlier), F.lit(False))).drop("_took")
