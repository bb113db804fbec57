"""One nested row per collection window."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwise.operators import intervals as intervals_of
from spanwise.operators import metrics, risk
from spanwise.operators.attribution import counts_by_service
from spanwise.session import materialize


SCALARS = ("total_requests", "mean_response_time", "p90_response_time", "deadline_miss_rate", "sum_cpu_utilization_cores",
           "sum_memory_utilization_mb", "anomaly_count", "anomaly_rate")


def _as_map(rows: DataFrame, by: Sequence[str], key: str, fields: Sequence[str], name: str) -> DataFrame:
    entry = F.struct(F.col(key), F.struct(*fields))
    return rows.groupBy(*by).agg(F.map_from_entries(F.collect_list(entry)).alias(name))


def service_map(usage: DataFrame, anomalies: DataFrame, requests: DataFrame, health: DataFrame | None,
                by: Sequence[str]) -> DataFrame:
    """Per window a map from measured service to usage, anomalies (counted per service) and health.

    Anomalies and health of services without metrics are not in the map.
    """
    keys = [*by, "service"]
    rows = usage.join(anomalies, keys, "left").join(requests, list(by), "left")
    rows = rows.withColumn("anomaly_count", F.coalesce("anomaly_count", F.lit(0))).withColumn(
        "anomaly_rate", F.coalesce(F.try_divide(F.col("anomaly_count") * 100.0, "total_requests"), F.lit(0.0)))
    if health is None:
        rows = rows.withColumn("restart_count", F.lit(None).cast("long")).withColumn(
            "oom_killed", F.lit(None).cast("boolean"))
    else:
        rows = rows.join(health.withColumnRenamed("restarts", "restart_count"), keys, "left")
    fields = ["anomaly_count", "anomaly_rate", "cpu_utilization_cores", "memory_utilization_mb", "restart_count",
              "oom_killed"]
    return _as_map(rows, by, "service", fields, "services")


def assemble(
    windows: DataFrame, traces: DataFrame, limits: DataFrame, anomalies: DataFrame, samples: DataFrame,
    health: DataFrame | None, nodes: DataFrame | None, placement: DataFrame | None, by: Sequence[str] = ("window_us",),
) -> DataFrame:
    """Snapshot rows for every row of ``windows`` (key, phase, subphase); a window without traces keeps its row.

    Traces, samples and anomalies are combined once, to distinct totals, means and counts, and stored; all parts come from
    these, and meet in one aggregation by window. Samples may be means already, a row for each service and metric.
    """
    keys = list(by)
    totals = materialize(traces.groupBy(*keys, "pattern", "total_us").agg(F.count(F.lit(1)).alias("_w")), "totals")
    means = materialize(samples.groupBy(*keys, "service", "metric").agg(
        F.min("metric_pos").alias("metric_pos"), F.avg("value").alias("value")), "means")
    found = materialize(counts_by_service(anomalies, keys), "found")
    # The whole window takes part as one more pattern, so that quantiles and means are taken once.
    both = totals.unionByName(totals.withColumn("pattern", F.lit("*")))
    rates = risk.miss_rates(both, limits, [*keys, "pattern"], "_w").join(risk.p90(both, [*keys, "pattern"], "_w"), [*keys, "pattern"])
    rates = materialize(rates.withColumnRenamed("miss_rate", "deadline_miss_rate"), "rates")
    whole = rates.where("pattern = '*'").select(*keys, "total_requests", "mean_response_time", "p90_response_time")
    rates = rates.where("pattern <> '*'")
    usage = metrics.usage_by_service(means, [*keys, "service"])
    parts = [
        whole, risk.overall_miss_rate(rates.withColumnRenamed("deadline_miss_rate", "miss_rate"), keys),
        _as_map(rates, keys, "pattern", MAP_FIELDS["patterns"], "patterns"),
        metrics.cluster_totals(means, keys), found.groupBy(*keys).agg(F.sum("anomaly_count").alias("anomaly_count")),
        service_map(usage, found, whole.select(*keys, "total_requests"), health, keys),
    ]
    if health is not None:
        parts.append(_as_map(health, keys, "service", ["restarts", "oom_killed"], "pod_health"))
    if nodes is not None or placement is not None:
        parts.append(node_map(nodes, placement, keys))
    return _together(windows, parts, keys)


def _together(windows: DataFrame, parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """All parts of the given windows in one row each, and zeros where a scalar has none."""
    together = windows.withColumn("_known", F.lit(True))
    for part in parts:
        together = together.unionByName(part, allowMissingColumns=True)
    named = [c for c in together.columns if c not in keys]
    out = together.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in named]).where("_known").drop("_known")
    return out.na.fill({c: 0 for c in SCALARS[:-1]}).withColumn("anomaly_rate", F.coalesce(
        F.try_divide(F.col("anomaly_count") * 100.0, "total_requests"), F.lit(0.0)))


def of_intervals(
    intervals: DataFrame, traces: DataFrame, limits: DataFrame, samples: DataFrame, anomalies: DataFrame, lo: str, hi: str,
    width: float | None = None,
) -> DataFrame:
    """A snapshot of every interval of ``intervals`` (its columns are kept), both ends included, aggregated anew.

    ``traces`` (at_us, pattern, total_us), ``samples`` (at_us, node, service, metric, metric_pos, value) and ``anomalies``
    (at_us, service) are points; total_us and value are whole numbers. Intervals may overlap in any way: totals come from
    differences of running totals, P90 from ranks, and no interval is paired with its points. Patterns, services, nodes and
    metrics are names of the watched system: the driver sees them, and an interval end has a number for each. Time is cut by
    ranges of rows, so ``width``, once the usual interval length, makes no difference. Intervals without traces have zeros
    and no patterns.
    """
    spans = intervals.select(lo, hi).where(F.col(lo).isNotNull() & F.col(hi).isNotNull()).distinct()
    traces, samples = traces.where(F.col("at_us").isNotNull()), samples.where(F.col("at_us").isNotNull())
    anomalies = anomalies.where(F.col("at_us").isNotNull())

    def names(rows: DataFrame, *by: str) -> list[tuple]:
        return sorted((tuple(r) for r in rows.select(*by).distinct().collect()), key=lambda r: [(x is not None, x) for x in r])

    patterns, found = names(traces, "pattern"), names(anomalies, "service")
    cells = names(samples, "node", "service", "metric", "metric_pos")
    wrong = [p for _, _, _, p in cells if p is not None and not 0 <= p < len(metrics.NODE_METRICS)]
    if wrong:
        raise ValueError(f"no node metric has the position {wrong[0]}")
    kinds = [sorted({pick(c) for c in cells}, key=lambda r: [(x is not None, x) for x in r]) for pick in (
        lambda c: c[1:], lambda c: (c[0], c[3]), lambda c: c[:2])]
    measured, used, placed = kinds
    n_patterns, n_sums = len(patterns), len(measured) + len(used)

    def numbered(rows: DataFrame, by: Sequence[str], keys: list[tuple], numbers: list[tuple], cols: Sequence[str]) -> DataFrame:
        """Rows with the numbers of their key; the keys are few."""
        spark = rows.sparkSession
        own = [f"_own{k}" for k in range(len(by))]
        kinds_ = ", ".join([f"{o} {rows.schema[b].dataType.simpleString()}" for o, b in zip(own, by)] + [f"{c} int" for c in cols])
        table = F.broadcast(spark.createDataFrame([(*k, *n) for k, n in zip(keys, numbers)], kinds_))
        same = F.lit(True)
        for o, b in zip(own, by):
            same = same & F.col(b).eqNullSafe(F.col(o))
        return rows.join(table, same).drop(*own)

    # Slots: counts of patterns, their late traces, samples by service and metric, by node and metric, by node and service,
    # anomalies by service; sums of patterns, of service metrics and of node metrics.
    starts = np.cumsum([0, n_patterns, n_patterns, len(measured), len(used), len(placed), len(found)]).tolist()
    late = F.col("total_us") > F.coalesce("threshold", F.lit(0.0))
    judged = numbered(traces.join(limits, "pattern", "left"), ["pattern"], patterns, [(k,) for k in range(n_patterns)], ["_code"])
    judged = materialize(judged.select("at_us", "_code", F.col("total_us").cast("long").alias("_value"), F.when(late, F.col("_code") + starts[1]).alias("_late")), "judged")
    where = [{k: i for i, k in enumerate(kind)} for kind in kinds]
    numbers = []
    for c in cells:
        m, u, p = where[0][c[1:]], where[1][c[0], c[3]], where[2][c[:2]]
        numbers.append((starts[2] + m, starts[3] + u, starts[4] + p, n_patterns + m, n_patterns + len(measured) + u))
    slots = ["_s0", "_s1", "_s2", "_a0", "_a1"]
    known = numbered(samples, ["node", "service", "metric", "metric_pos"], cells, numbers, slots).select(
        "at_us", F.col("value").cast("long").alias("_value"), *slots)
    seen = numbered(anomalies, ["service"], found, [(starts[5] + k,) for k in range(len(found))], ["_s0"]).select("at_us", "_s0")
    points = judged.select("at_us", "_value", F.col("_code").alias("_s0"), F.col("_late").alias("_s1"), F.col("_code").alias("_a0")).unionByName(
        known, allowMissingColumns=True).unionByName(seen, allowMissingColumns=True)
    totals = intervals_of.slot_totals(points, spans, "at_us", lo, hi, slots[:3], starts[6], slots[3:], "_value", n_patterns + n_sums)
    p90 = intervals_of.group_quantiles(judged, spans, "at_us", lo, hi, "_code", n_patterns, "_value", 0.9)
    rows = intervals.join(totals, [lo, hi]).join(p90, [lo, hi], "left")
    services = sorted({m[0] for m in measured}, key=lambda x: (x is not None, x))
    nodes = sorted({u[0] for u in used}, key=lambda x: (x is not None, x))
    counts_of = {s[0]: k for k, s in enumerate(found) if s[0] is not None}
    mb = 1024 * 1024

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in intervals_of.pieces(batches):
            none = rows[hi].to_numpy() < rows[lo].to_numpy()
            n, v = intervals_of.inside(rows, "_n", none), intervals_of.inside(rows, "_v", none)
            empty = np.full(n_patterns + 1, np.nan)
            q = np.stack([empty if x is None else np.asarray(x, dtype=float) for x in rows["_q"]])

            def over(a, b):
                return np.divide(a, b, out=np.full(a.shape, np.nan), where=b != 0)

            size, missed, spent = n[:, :n_patterns], n[:, starts[1]:starts[2]], v[:, :n_patterns]
            rate, mean = over(missed.astype(float), size) * 100, over(spent.astype(float), size)
            # A pattern without a name, or whose traces have no total at all, is left out.
            valued = (size > 0) & ~np.isnan(q[:, :-1]) & np.array([p[0] is not None for p in patterns], dtype=bool)
            q[:, :-1][~valued] = np.nan
            rate, mean = np.where(valued, rate, np.nan), np.where(valued, mean, np.nan)
            whole = ~np.isnan(q[:, -1])
            requests = np.where(whole, size.sum(axis=1), 0)
            overall = over(np.where(valued, rate, 0.0).sum(axis=1), valued.sum(axis=1))
            m_n, m_v = n[:, starts[2]:starts[3]], v[:, n_patterns:n_patterns + len(measured)]
            m_mean = over(m_v.astype(float), m_n)
            cluster, usage = {w: np.zeros(len(rows)) for w in ("cpu", "memory")}, []
            for s in services:
                # Of several positions of a metric the mean of means, at the first of them.
                ks = [k for k, m in enumerate(measured) if m[0] == s]
                found_ = {w: np.zeros(len(rows)) for w in ("cpu", "memory")}
                first = {w: np.full(len(rows), np.inf) for w in ("cpu", "memory")}
                for metric in sorted({measured[k][1] for k in ks if measured[k][1] is not None}):
                    mine = [k for k in ks if measured[k][1] == metric]
                    has = m_n[:, mine] > 0
                    mean_ = over(np.where(has, m_mean[:, mine], 0.0).sum(axis=1), has.sum(axis=1))
                    at = np.where(has, np.array([np.inf if measured[k][2] is None else float(measured[k][2]) for k in mine]), np.inf).min(axis=1)
                    for word in ("cpu", "memory"):
                        if word in metric.lower():
                            cluster[word] += np.where(mean_ > 0, mean_, 0.0)
                            use = (at < first[word]) & ~np.isnan(mean_) & (mean_ != 0)
                            found_[word], first[word] = np.where(use, mean_, found_[word]), np.where(use, at, first[word])
                count = n[:, starts[5] + counts_of[s]] if s in counts_of else np.zeros(len(rows))
                share = np.nan_to_num(over(count * 100.0, requests.astype(float)))
                usage.append(np.stack([(m_n[:, ks] > 0).any(axis=1), count, share, found_["cpu"], found_["memory"] / mb], axis=1))
            u_mean = over(v[:, n_patterns + len(measured):].astype(float), n[:, starts[3]:starts[4]])
            p_n = n[:, starts[4]:starts[5]]
            by_node = []
            for node in nodes:
                six = np.full((len(rows), len(metrics.NODE_METRICS)), np.nan)
                for k, (own, pos) in enumerate(used):
                    if own == node and pos is not None:
                        six[:, pos] = u_mean[:, k] / (mb if metrics.NODE_METRICS[pos].endswith("_bytes") else 1)
                pods = np.stack([p_n[:, placed.index((node, s))] if (node, s) in placed else np.zeros(len(rows)) for s in services], axis=1)
                by_node.append(np.concatenate([six, pods], axis=1))
            anomalies_ = n[:, starts[5]:].sum(axis=1)
            out = rows[keep].copy()
            out["total_requests"], out["anomaly_count"] = requests, anomalies_
            out["mean_response_time"] = np.where(whole, np.nan_to_num(over(spent.sum(axis=1).astype(float), size.sum(axis=1))), 0.0)
            out["p90_response_time"], out["deadline_miss_rate"] = np.nan_to_num(q[:, -1]), np.nan_to_num(overall)
            out["sum_cpu_utilization_cores"], out["sum_memory_utilization_mb"] = cluster["cpu"], cluster["memory"] / mb
            out["anomaly_rate"] = np.nan_to_num(over(anomalies_ * 100.0, requests.astype(float)))
            for name, parts in (("_patterns", [np.stack([rate, mean, q[:, :-1]], axis=2).reshape(len(rows), -1)]), ("_services", usage), ("_nodes", by_node)):
                flat = np.concatenate(parts, axis=1) if parts else np.zeros((len(rows), 0))
                out[name] = pd.Series(list(flat), dtype=object, index=out.index)
            yield out

    keep = intervals.columns
    schema = T.StructType([*intervals.schema.fields, *[T.StructField(c, T.LongType() if c in ("total_requests", "anomaly_count") else T.DoubleType()) for c in SCALARS],
                           *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("_patterns", "_services", "_nodes")]])
    rows = rows.select(*keep, *intervals_of.sides("_n"), *intervals_of.sides("_v"), "_q").mapInPandas(
        lambda batches: (b[schema.names] for b in read(batches)), schema)

    def named(array: str, width: int, keys: list, held, entry):
        """A map from name to the numbers of its ``width`` places, of those that are held."""
        if not keys:
            return F.lit(None)
        texts = F.array(*[F.lit(k).cast("string") for k in keys])

        def place(k):
            return lambda i: F.when(~F.isnan(F.get(array, k * width + i)), F.get(array, k * width + i))

        places = F.filter(F.sequence(F.lit(0), F.lit(len(keys) - 1)), lambda k: held(place(k)))
        entries = F.transform(places, lambda k: F.struct(F.get(texts, k), entry(place(k))))
        return F.when(F.size(places) > 0, F.map_from_entries(entries))

    def pods(at):
        first = len(metrics.NODE_METRICS)
        there = F.filter(F.sequence(F.lit(0), F.lit(len(services) - 1)), lambda s: at(s + first) > 0)
        texts = F.array(*[F.lit(s).cast("string") for s in services])
        return F.map_from_entries(F.transform(there, lambda s: F.struct(F.get(texts, s), at(s + first))))

    fields = MAP_FIELDS["services"]
    return rows.select(
        *keep, *SCALARS,
        named("_patterns", 3, [p[0] for p in patterns], lambda at: at(2).isNotNull(), lambda at: F.struct(
            *[at(k).alias(f) for k, f in enumerate(MAP_FIELDS["patterns"])])).alias("patterns"),
        named("_services", 5, services, lambda at: at(0) > 0, lambda at: F.struct(
            at(1).cast("long").alias(fields[0]), *[at(k).alias(fields[k - 1]) for k in (2, 3, 4)],
            F.lit(None).cast("long").alias(fields[4]), F.lit(None).cast("boolean").alias(fields[5]))).alias("services"),
        named("_nodes", len(metrics.NODE_METRICS) + len(services), nodes, lambda at: F.size(pods(at)) > 0, lambda at: F.struct(
            *[at(k).alias(f) for k, f in enumerate(MAP_FIELDS["nodes"])], pods(at).alias("services"))).alias("nodes"))


MAP_FIELDS = {
    "patterns": ("deadline_miss_rate", "mean_response_time", "p90_response_time"),
    "services": ("anomaly_count", "anomaly_rate", "cpu_utilization_cores", "memory_utilization_mb", "restart_count", "oom_killed"),
    "pod_health": ("restarts", "oom_killed"),
    "nodes": ("cpu_utilization_pct", "memory_utilization_pct", "cpu_usage_cores", "cpu_limit_cores", "memory_usage_mb",
              "memory_limit_mb"),
}


def flattened(snapshots: DataFrame, keep: Sequence[str], scalars: Sequence[str] = SCALARS) -> DataFrame:
    """Every number of a snapshot as a row: ``keep``, ``part``, ``key``, ``field`` and ``value``; nulls have none.

    Scalars are of the part ``window``, entries of a map of the part with its name; pods of a service on a node are of the
    part ``placement`` with the key ``node/service``.
    """

    def cell(part: str, key, field: str, value):
        return F.struct(F.lit(part).alias("part"), key.alias("key"), F.lit(field).alias("field"), value.cast("double").alias("value"))

    def entries(name: str):
        return F.flatten(F.transform(F.map_entries(name), lambda e: F.array(
            *[cell(name, e["key"], f, e["value"][f]) for f in MAP_FIELDS[name]])))

    cells = [F.array(*[cell("window", F.lit(""), c, F.col(c)) for c in scalars])]
    cells += [entries(name) for name in MAP_FIELDS if name in snapshots.columns]
    if "nodes" in snapshots.columns:
        cells.append(F.flatten(F.transform(F.map_entries("nodes"), lambda e: F.transform(
            F.map_entries(e["value"]["services"]), lambda s: cell(
                "placement", F.concat_ws("/", e["key"], s["key"]), "avg_pods", s["value"])))))
    held = F.concat(*[F.coalesce(c, F.filter(cells[0], lambda _: F.lit(False))) for c in cells])
    rows = snapshots.select(*keep, F.explode(held).alias("_c"))
    return rows.select(*keep, "_c.part", "_c.key", "_c.field", F.col("_c.value").alias("value")).where(F.col("value").isNotNull())


def node_map(nodes: DataFrame | None, placement: DataFrame | None, by: Sequence[str]) -> DataFrame:
    """Per window a map from node to its means and pods per service; a node known to one side only is kept."""
    keys = [*by, "node"]
    placed = None if placement is None else placement.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("service", "avg_pods")))).alias("services"))
    if nodes is None:
        rows = placed
    elif placed is None:
        rows = nodes
    else:
        rows = nodes.join(placed, keys, "full")
    fields = [c for c in rows.columns if c not in keys]
    return _as_map(rows, by, "node", fields, "nodes")


def describe(snapshots: DataFrame, label: str, start: str, end: str) -> DataFrame:
    """Add collection metadata: label, bounds as ISO text, measured services, trace and service counts."""
    names = F.coalesce(F.array_sort(F.map_keys("services")), F.array().cast("array<string>"))
    return snapshots.withColumns({
        "collection_label": F.lit(label),
        "collection_start_time": F.date_format(F.timestamp_micros(F.col(start)), "yyyy-MM-dd'T'HH:mm:ssxxx"),
        "collection_end_time": F.date_format(F.timestamp_micros(F.col(end)), "yyyy-MM-dd'T'HH:mm:ssxxx"),
        "configurations": names,
        "trace_count": F.col("total_requests"),
        "metrics_config_count": F.size(names),
    })
