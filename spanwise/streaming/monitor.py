"""The monitoring loop as a streaming job."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanwise.operators.traces import summarize
from spanwise.session import materialize
from spanwise.streaming.batches import ClosedWindows
from spanwise.streaming.windows import padded


def window_snapshots(spans: DataFrame, limits: DataFrame, ops: Sequence[str], at: str = "start_us", width_s: int = 60,
                     pad_s: int = 5, late: str = "5 seconds") -> DataFrame:
    """One row per window, on streams and on tables: requests, mean response time and deadline miss rate.

    ``at`` is the start of the span's trace, so a trace is whole in its window. Spans fold into their trace, traces into
    their pattern and patterns into the window, each with partial aggregation. On a stream a window is given out once,
    when the watermark has passed its padded end; how its spans were spread over micro-batches does not matter, and
    state holds the traces of open windows only.
    """
    timed = spans.withColumn("_ts", F.timestamp_micros(at)).withWatermark("_ts", late)
    mine = [F.col("operation") == F.lit(op) for op in sorted(ops)]
    last = [F.max_by(F.when(m, F.col("duration_us")), F.when(m, F.col("span_pos"))).alias(f"_d{i}")
            for i, m in enumerate(mine)]
    traces = timed.groupBy(padded(F.col("_ts"), width_s, pad_s).alias("window"), "trace_id").agg(
        F.sum("duration_us").alias("total_us"), *last)
    digits = [F.when(F.col(f"_d{i}") > 0, "1").otherwise("0") for i in range(len(mine))]
    traces = traces.select("window", "total_us", F.concat(*digits).alias("pattern")).join(limits, "pattern", "left")
    missed = F.col("total_us") > F.coalesce("threshold", F.lit(0.0))
    patterns = traces.groupBy("window", "pattern").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("total_us").alias("_sum"),
        (F.count(F.when(missed, 1)) / F.count(F.lit(1)) * 100).alias("_rate"))
    out = patterns.groupBy("window").agg(
        F.sum("_n").alias("total_requests"), (F.sum("_sum") / F.sum("_n")).alias("mean_response_time"),
        F.avg("_rate").alias("deadline_miss_rate"))
    start = F.unix_micros("window.start") + pad_s * 1_000_000
    return out.select(start.alias("window_us"), "total_requests", "mean_response_time", "deadline_miss_rate")


def monitor(spans: DataFrame, limits: DataFrame, ops: Sequence[str], out: str, checkpoint: str, at: str = "start_us",
            width_s: int = 60, pad_s: int = 5, late: str = "5 seconds") -> StreamingQuery:
    """Start the loop over a span stream: closed windows are appended to ``out``, each exactly once."""
    rows = window_snapshots(spans, limits, ops, at, width_s, pad_s, late)
    return (rows.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def snapshot_loop(folder: str, ops: Sequence[str], make: Callable[[DataFrame, DataFrame, DataFrame], DataFrame], width_us: int,
                  start_us: int, deadline_us: int, late_us: int = 5_000_000) -> ClosedWindows:
    """The loop with whole snapshots: spans (``source`` = ``traces``, ``at_us`` the start of their trace) and metric samples
    (``source`` = ``metrics``) are landed, and ``make`` gets the traces, the samples and the windows that closed.

    Windows are laid from ``start_us``; the last is cut at the deadline. The operators are those of the batch form, so the
    snapshots are too.
    """

    def snapshots(rows: DataFrame, windows: DataFrame) -> DataFrame:
        spans, samples = rows.where("source = 'traces'"), rows.where("source = 'metrics'")
        placed = spans.groupBy("trace_id").agg(F.min("window_us").alias("window_us"))
        traces = materialize(summarize(spans, ops).join(placed, "trace_id"), "closed-traces")
        return make(traces, samples, windows)

    return ClosedWindows(folder, ["traces", "metrics"], snapshots, width_us, start_us, deadline_us, 0, late_us)
