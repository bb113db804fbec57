"""Stateful stream operators: the phase in force, and anomaly batches.

Each is a step over a micro-batch and a state table (see ``batches``). A run's rows are spread by ranges of their order or
by partial top-n, so no run is one task's.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwise.functions.buckets import floor_div
from spanwise.operators.joins import asof
from spanwise.operators.ordered import numbered_by_range, queue_turns
from spanwise.session import materialize
from spanwise.streaming.batches import TableState

cloudpickle.register_pickle_by_value(sys.modules[__name__])

INITIAL_PHASE = ("initialization", "collection_start")

PHASES = "run string, seq bigint, phase string, subphase string"
MESSAGES = "run string, seq bigint, kind string, phase string, subphase string"
ANOMALIES = "run string, trace_id bigint, duration_seconds double, enqueued_at bigint"
RELEASED = "run string, trace_id bigint, duration_seconds double, priority int"


def phase_at(windows: DataFrame, messages: DataFrame, at: str, sent: str, width: float,
             by: list[str] | None = None) -> DataFrame:
    """Batch form: each window with the newest phase message at or before it, the initial phase before any."""
    rows = asof(windows, messages, at, sent, ["phase", "subphase"], width, by or [])
    return rows.withColumn("phase", F.coalesce("phase", F.lit(INITIAL_PHASE[0]))).withColumn(
        "subphase", F.coalesce("subphase", F.lit(INITIAL_PHASE[1])))


def _phase_step(rows: DataFrame, state: DataFrame, over: bool) -> tuple[DataFrame, DataFrame]:
    # State: the messages that wait, and the one in force, which counts as taken by a window before all others.
    held = state.where("kind <> 'current'").unionByName(rows)
    order = [F.col("seq"), F.col("kind"), F.coalesce("phase", F.lit("")), F.coalesce("subphase", F.lit(""))]
    line = materialize(queue_turns(held, ["run"], order, F.col("kind") == "phase"), "phases")
    windows = line.where("kind = 'window'").select("run", "seq", "turn")
    messages = line.where("kind = 'phase'").select("run", F.col("seq").alias("sent"), "turn", "phase", "subphase")
    current = state.where("kind = 'current'").select("run", F.col("phase").alias("p"), F.col("subphase").alias("s"))
    tagged = windows.join(messages.drop("sent"), ["run", "turn"], "left").join(current, "run", "left").select(
        "run", "seq", F.coalesce("phase", "p", F.lit(INITIAL_PHASE[0])).alias("phase"),
        F.coalesce("subphase", "s", F.lit(INITIAL_PHASE[1])).alias("subphase"))
    taken = windows.groupBy("run").agg(F.max("turn").alias("taken"))
    left = messages.join(taken, "run", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    waiting = left.where("turn > taken").select("run", F.col("sent").alias("seq"), F.lit("phase").alias("kind"), "phase", "subphase")
    newest = left.where("turn = taken").select("run", "phase", "subphase").join(
        current, "run", "full").select("run", F.lit(None).cast("long").alias("seq"), F.lit("current").alias("kind"),
        F.coalesce("phase", "p").alias("phase"), F.coalesce("subphase", "s").alias("subphase"))
    return tagged, waiting.unionByName(newest)


def phase_tags(folder: str) -> TableState:
    """Stream form over rows (run, seq, kind, phase, subphase) with kind ``phase`` or ``window``.

    Each window takes at most one waiting message, first in first out; what it takes stays in force. State is the table of
    waiting messages, and a row a run for the one in force. Batches arrive in the order of ``seq``; where they are cut does
    not matter. A message and a window of one ``seq``: the message comes first.
    """
    return TableState(folder, _phase_step, MESSAGES)


def anomaly_batches(folder: str, n: int) -> TableState:
    """Stream form over anomalies (run, trace_id, duration_seconds, enqueued_at): each time ``n`` wait, in the order of
    ``enqueued_at``, ``trace_id`` and duration, they are released, the shortest first; nobody is dropped.

    Batches arrive in that order; where they are cut does not matter. State holds fewer than ``n`` anomalies of a run.
    """

    def step(rows: DataFrame, state: DataFrame, over: bool) -> tuple[DataFrame, DataFrame]:
        columns = [c for c, _ in (x.split(" ") for x in ANOMALIES.split(", "))]
        order = [F.col("enqueued_at"), F.col("trace_id"), F.col("duration_seconds")]
        placed = materialize(numbered_by_range(state.unionByName(rows.select(*columns)), ["run"], order), "anomalies")
        whole = placed.groupBy("run").agg((F.floor(F.count(F.lit(1)) / n) * n).alias("whole"))
        placed = placed.join(whole, "run")
        lot = Window.partitionBy("run", F.floor((F.col("rn") - 1) / n)).orderBy("duration_seconds", "enqueued_at", "trace_id")
        out = placed.where("rn <= whole").withColumn("priority", F.row_number().over(lot))
        return out.select("run", "trace_id", "duration_seconds", "priority"), placed.where("rn > whole").select(*columns)

    return TableState(folder, step, ANOMALIES)


def discarding_batches(folder: str, n: int, every_us: int) -> TableState:
    """Stream form over anomalies where a run's queue is looked at when a window of ``every_us`` ends.

    If ``n`` or more wait then, the ``n`` shortest are released and the others dropped. State holds for each run and open or
    waited-for window the number of anomalies and the ``n`` shortest: no more can be released. A window ends with the first
    anomaly behind it, of any run, and when the stream is over. Batches arrive in the order of ``enqueued_at``.
    """
    shortest = ["duration_seconds", "enqueued_at", "trace_id"]

    def head(rows: DataFrame, by: list[str], weight) -> DataFrame:
        """The ``n`` shortest of each group; the first of them stands for all that were left out."""
        ranked = rows.withColumn("priority", F.row_number().over(Window.partitionBy(*by).orderBy(*shortest))).where(F.col("priority") <= n)
        sums = rows.groupBy(*by).agg(F.sum("weight").alias("_all"), F.count(F.lit(1)).alias("_rows"))
        return ranked.join(sums, by).withColumn("weight", F.when(F.col("priority") == 1, F.col("_all") - F.least("_rows", F.lit(n)) + 1).otherwise(
            weight)).drop("_all", "_rows")

    def spells(counts: pd.DataFrame) -> pd.DataFrame:
        """Each window of a run with the window that ends its wait, if one does; the count starts anew behind a release."""
        counts = counts.sort_values("slot")
        waiting, first, ends = 0, 0, [None] * len(counts)
        for k, (slot, more) in enumerate(zip(counts["slot"], counts["n"])):
            waiting += more
            if waiting >= n:
                ends[first : k + 1] = [slot] * (k + 1 - first)
                waiting, first = 0, k + 1
        return pd.DataFrame({"run": counts["run"], "slot": counts["slot"], "at": pd.array(ends, dtype="Int64")})

    def step(rows: DataFrame, state: DataFrame, over: bool) -> tuple[DataFrame, DataFrame]:
        one = F.lit(1).cast("long")
        new = rows.select("run", "trace_id", "duration_seconds", "enqueued_at", floor_div(F.col("enqueued_at"), every_us).alias("slot"), one.alias("weight"))
        held = materialize(state.unionByName(new), "waiting")
        newest = held.agg(F.max("slot")).first()[0]
        ended = F.lit(True) if over else F.col("slot") < F.lit(newest)
        counts = held.where(ended).groupBy("run", "slot").agg(F.sum("weight").alias("n"))
        # A pass over the windows of a run, not over its anomalies.
        slots = counts.groupBy("run").applyInPandas(spells, "run string, slot bigint, at bigint")
        known = held.join(slots, ["run", "slot"], "left")
        released = known.where("at IS NOT NULL").withColumn("priority", F.row_number().over(
            Window.partitionBy("run", "at").orderBy(*shortest))).where(F.col("priority") <= n)
        waiting = head(known.where("at IS NULL").drop("at"), ["run", "slot"], one)
        return released.select("run", "trace_id", "duration_seconds", "priority"), waiting.select(
            "run", "trace_id", "duration_seconds", "enqueued_at", "slot", "weight")

    return TableState(folder, step, f"{ANOMALIES}, slot bigint, weight bigint")
