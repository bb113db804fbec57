"""Spans to one row per trace, call-pattern signature, schema alignment, capped window fetch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def operations(spans: DataFrame, most: int = 10_000) -> list[str]:
    """The operation names of a span table, in code-point order. A table with more than ``most`` is an error."""
    found = [r[0] for r in spans.select("operation").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} operation names")
    return sorted(found)


def signature(durations: Column, ops: Sequence[str]) -> Column:
    """One digit per operation in name order: 1 where its duration is above zero."""
    return F.concat(*[F.when(durations[op] > 0, F.lit("1")).otherwise(F.lit("0")) for op in sorted(ops)])


def _duration_map(ops: Sequence[str], value) -> Column:
    pairs = []
    for op in sorted(ops):
        pairs += [F.lit(op), F.coalesce(value(op), F.lit(0)).cast("long")]
    return F.create_map(*pairs)


def summarize(spans: DataFrame, ops: Sequence[str]) -> DataFrame:
    """Trace rows: earliest start, sum over all spans, last duration per operation, pattern.

    One shuffle on the trace with fixed-size buffers per operation, so partial aggregation absorbs a huge trace.
    """
    ops = sorted(ops)
    last = []
    for i, op in enumerate(ops):
        mine = F.col("operation") == F.lit(op)
        last.append(
            F.max_by(F.when(mine, F.col("duration_us")), F.when(mine, F.col("span_pos"))).alias(f"_d{i}"))
    rows = spans.groupBy("trace_id").agg(
        F.min("start_us").alias("start_us"), F.sum("duration_us").cast("long").alias("total_us"), *last)
    by_op = {op: F.col(f"_d{i}") for i, op in enumerate(ops)}
    return rows.select(
        "trace_id", "start_us", F.timestamp_micros("start_us").alias("start_time"), "total_us",
        _duration_map(ops, by_op.__getitem__).alias("durations"),
        F.concat(*[F.when(by_op[op] > 0, F.lit("1")).otherwise(F.lit("0")) for op in ops]).alias("pattern"),
    )


def align(traces: DataFrame, training_ops: Sequence[str]) -> DataFrame:
    """Give live traces the operations of the training set; the total still counts dropped spans."""
    have = F.col("durations")
    aligned = _duration_map(training_ops, lambda op: F.try_element_at(have, F.lit(op)))
    return traces.withColumn("durations", aligned).withColumn("pattern", signature(F.col("durations"), training_ops))


def window_start(us: Column, width_us: int) -> Column:
    """Start of the tumbling window that holds the instant."""
    return (F.floor(us / width_us) * width_us).cast("long")


def padded_windows(rows: DataFrame, us: str, width_us: int, pad_us: int, name: str = "window_us") -> DataFrame:
    """Put each row into every tumbling window whose padded range (both ends included) holds it."""
    first = F.ceil((F.col(us) - width_us - pad_us) / width_us)
    last = F.floor((F.col(us) + pad_us) / width_us)
    starts = F.transform(F.sequence(first, last), lambda i: i * F.lit(width_us))
    return rows.withColumn(name, F.explode(starts))


def capped(
    traces: DataFrame, width_us: int, pad_us: int = 5_000_000, cap: int = 1000,
    retry: DataFrame | None = None, retry_cap: int = 20_000,
) -> DataFrame:
    """The latest ``cap`` traces of each padded window, with a flag where the cap was reached.

    Windows that got nothing are filled from ``retry`` (a later read of the source), unpadded, up to ``retry_cap``. The
    row limit runs before the shuffle too, so a crowded window moves at most ``cap`` rows per task.
    """
    newest = Window.partitionBy("window_us").orderBy(F.desc("start_us"), "trace_id")
    out = (
        padded_windows(traces, "start_us", width_us, pad_us)
        .withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= cap).withColumn("limit", F.lit(cap))
    )
    if retry is not None:
        again = (
            retry.withColumn("window_us", window_start(F.col("start_us"), width_us))
            .join(out.select("window_us").distinct(), "window_us", "left_anti")
            .withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= retry_cap)
            .withColumn("limit", F.lit(retry_cap))
        )
        out = out.unionByName(again)
    size = F.count(F.lit(1)).over(Window.partitionBy("window_us"))
    return out.withColumn("cap_hit", size >= F.col("limit")).drop("limit")
