"""Monitoring windows, in batch and on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(rows: DataFrame, us: str, width_us: int, start_us: int, deadline_us: int) -> DataFrame:
    """Windows laid from the start of the run to its deadline; the last one is cut short. Adds both bounds."""
    inside = rows.where((F.col(us) >= start_us) & (F.col(us) < deadline_us))
    first = F.floor((F.col(us) - start_us) / width_us) * width_us + start_us
    return inside.withColumn("window_start_us", first.cast("long")).withColumn(
        "window_end_us", F.least(F.col("window_start_us") + width_us, F.lit(deadline_us)).cast("long"))


def padded(ts: Column, width_s: int = 60, pad_s: int = 5) -> Column:
    """Windows every ``width_s`` seconds that also read ``pad_s`` seconds before and after, both ends included.

    Without padding they tile the time, and an instant on a border belongs to the later one.
    """
    length = f"{width_s + 2 * pad_s} seconds" + (" 1 microsecond" if pad_s else "")
    return F.window(ts, length, f"{width_s} seconds", f"{(width_s - pad_s) % width_s} seconds")


def closed_windows(stream: DataFrame, ts: str, aggregates: list[Column], width_s: int = 60, pad_s: int = 5,
                   late: str = "5 seconds", by: list[str] | None = None) -> DataFrame:
    """Aggregates of padded windows, given out once when the watermark has passed them; later rows change nothing."""
    return stream.withWatermark(ts, late).groupBy(padded(F.col(ts), width_s, pad_s).alias("window"), *(by or [])).agg(
        *aggregates)
