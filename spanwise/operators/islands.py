"""Runs of consecutive snapshots, and the windows before, during and after each change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions.buckets import chunk
from spanwise.operators.ordered import neighbours, running_sums

DAY_S = 86_400
CHANGE_SUBPHASES = ("stabilization", "configuration_application")


def snapshot_time(snapshots: DataFrame, name: str = "ts") -> DataFrame:
    """Collection end, else the snapshot's own time stamp, parsed from ISO text; neither is an error."""
    text = F.coalesce(F.col("collection_end_time"), F.col("timestamp"))
    checked = F.when(text.isNull(), F.raise_error(F.lit("Snapshot is missing a timestamp"))).otherwise(text)
    return snapshots.withColumn(name, checked.cast("timestamp"))


def numbered_runs(rows: DataFrame, order: str, flag: Column, by: Sequence[str] = (), width: float = DAY_S) -> DataFrame:
    """Add ``in_run`` and ``run_no``, the count of runs that have begun so far, and the order of the next row."""
    bucket = chunk(F.col(order), width)
    marked = rows.withColumn("in_run", F.coalesce(flag, F.lit(False)))
    near = neighbours(marked, by, bucket, [order], back={"_was": "in_run"}, ahead={"next_order": order})
    begun = near.withColumn("_begins", (F.col("in_run") & ~F.coalesce("_was", F.lit(False))).cast("long"))
    return running_sums(begun, by, bucket, [F.col(order)], {"run_no": "_begins"}).drop("_was", "_begins")


def islands(rows: DataFrame, order: str, flag: Column, by: Sequence[str] = (), width: float = DAY_S) -> DataFrame:
    """Start and end of each run; it ends at the row after it, or at its last row when it is still open."""
    runs = numbered_runs(rows, order, flag, by, width).where("in_run")
    return runs.groupBy(*by, "run_no").agg(
        F.min(order).alias("start"), F.max(F.coalesce("next_order", order)).alias("end"))


def change_roles(
    snapshots: DataFrame, order: str, by: Sequence[str] = (), width: float = DAY_S,
    subphases: Sequence[str] = CHANGE_SUBPHASES,
) -> DataFrame:
    """Adaptation snapshots with the change they belong to and their role in it.

    A row inside block k is during k; a row between blocks k and k+1 is after k and before k+1. Blocks keep their number.
    """
    rows = numbered_runs(snapshots.where(F.col("phase") == "adaptation"), order, F.col("subphase").isin(*subphases),
                         by, width)
    k = F.col("run_no")

    def role(change: Column, name: str) -> Column:
        return F.struct(change.alias("change_index"), F.lit(name).alias("role"))

    roles = F.when(F.col("in_run"), F.array(role(k, "during"))).otherwise(
        F.array(role(k, "after"), role(k + 1, "before")))
    return rows.withColumn("_role", F.explode(roles)).select("*", "_role.*").drop("_role", "in_run", "run_no",
                                                                                  "next_order")
