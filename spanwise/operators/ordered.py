"""Ordered operators split into buckets below each key.

A plain window over a key puts the whole key into one task. Here the rows of a key are cut into buckets that follow
the order; windows run inside a bucket, and one row per bucket carries the state across. A key that holds a large
share of the table is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.session import materialize

BEFORE = (Window.unboundedPreceding, -1)
UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)


def _with_key(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(by)) if by else (df.withColumn("_all", F.lit(0)), ["_all"])


def same_keys(keys: Sequence[str], a: str, b: str) -> Column:
    """Null-safe equality of two sides' keys."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`"))
    return cond


def numbered(
    df: DataFrame, by: Sequence[str], buckets: Sequence[Column], order: Sequence[Column], name: str = "rn"
) -> DataFrame:
    """``row_number`` per key in the order (buckets, order).

    ``buckets`` go from coarse to fine, each cutting the rows of the one before; a finer one lets equal values of the
    coarser be split as well.
    """
    levels = [f"_bucket{i}" for i in range(len(buckets))]
    rows, keys = _with_key(df.withColumns(dict(zip(levels, buckets))), by)
    sizes = rows.groupBy(*keys, *levels).agg(F.count(F.lit(1)).alias("_size"))
    offsets, start = sizes, F.lit(0)
    for depth, level in enumerate(levels):
        outer = [*keys, *levels[:depth]]
        across = Window.partitionBy(*outer).orderBy(level).rowsBetween(*BEFORE)
        totals = sizes if depth == len(levels) - 1 else sizes.groupBy(*outer, level).agg(F.sum("_size").alias("_size"))
        before = totals.select(*outer, level, F.coalesce(F.sum("_size").over(across), F.lit(0)).alias(f"_o{depth}"))
        offsets = offsets.alias("a").join(before.alias("b"), same_keys([*outer, level], "a", "b")).select(
            "a.*", f"b._o{depth}")
        start = start + F.col(f"_o{depth}")
    offsets = offsets.select(*keys, *levels, start.alias("_offset"))
    inside = Window.partitionBy(*keys, *levels).orderBy(*order)
    joined = rows.alias("r").join(offsets.alias("o"), same_keys([*keys, *levels], "r", "o")).select("r.*", "o._offset")
    return (
        joined.withColumn(name, (F.col("_offset") + F.row_number().over(inside)).cast("long"))
        .drop("_offset", "_all", *levels)
    )


def ranged(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    """Rows range-partitioned by key and full order, stored with their partition as ``_part``; and the order's columns.

    No key is one task's: a window over (key, ``_part``) sees a run of consecutive rows, and one row per key and
    partition carries the state across.
    """
    ranks = {f"_k{i}": c for i, c in enumerate(order)}
    stored = materialize(df.withColumns(ranks).repartitionByRange(*by, *ranks).withColumn(
        "_part", F.spark_partition_id()), "ranged")
    return stored, list(ranks)


def numbered_by_range(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rn") -> DataFrame:
    """``row_number`` per key, or over the whole table, in an order without ties.

    The rows lie in ranges; a count per key and range gives the offsets, and the numbers are counted inside each.
    """
    rows, keys = _with_key(df, by)
    stored, ranks = ranged(rows, keys, order)
    across = Window.partitionBy(*keys).orderBy("_part").rowsBetween(*BEFORE)
    offsets = stored.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_size")).select(
        *keys, "_part", F.coalesce(F.sum("_size").over(across), F.lit(0)).alias("_offset"))
    joined = stored.alias("r").join(offsets.alias("o"), same_keys([*keys, "_part"], "r", "o")).select("r.*", "o._offset")
    inside = Window.partitionBy(*keys, "_part").orderBy(*ranks)
    return joined.withColumn(name, (F.col("_offset") + F.row_number().over(inside)).cast("long")).drop(
        "_offset", "_part", "_all", *ranks)


def queue_turns(line: DataFrame, by: Sequence[str], order: Sequence[Column], comes: Column) -> DataFrame:
    """First in, first out: each consumer on the line takes at most one of what has come before it.

    ``comes`` marks what enters the queue, all other rows are consumers. Added is ``turn``: for what comes its number
    per key, for a consumer the number of the last thing taken up to and including its own turn, 0 before any. With m
    things come and k consumers so far that number is k + min(0, the least m - k so far): a prefix minimum, taken inside
    each range and carried across ranges.
    """
    rows, keys = _with_key(line.withColumn("_comes", comes), by)
    stored, ranks = ranged(rows, keys, order)
    inside = Window.partitionBy(*keys, "_part").orderBy(*ranks).rowsBetween(*UP_TO_HERE)
    come, here = F.sum(F.col("_comes").cast("long")), F.sum((~F.col("_comes")).cast("long"))
    local = stored.withColumns({"_m": come.over(inside), "_w": here.over(inside)})
    local = local.withColumn("_low", F.min(F.when(~F.col("_comes"), F.col("_m") - F.col("_w"))).over(inside))
    across = Window.partitionBy(*keys).orderBy("_part").rowsBetween(*BEFORE)
    parts = local.groupBy(*keys, "_part").agg(come.alias("_am"), here.alias("_aw"), F.min("_low").alias("_al")).select(
        *keys, "_part", "_al", F.coalesce(F.sum("_am").over(across), F.lit(0)).alias("_om"),
        F.coalesce(F.sum("_aw").over(across), F.lit(0)).alias("_ow"))
    parts = parts.select(*keys, "_part", "_om", "_ow", F.min(F.col("_al") + F.col("_om") - F.col("_ow")).over(across).alias("_ol"))
    joined = local.alias("r").join(parts.alias("p"), same_keys([*keys, "_part"], "r", "p")).select("r.*", "p._om", "p._ow", "p._ol")
    least = F.least(F.lit(0), F.col("_ol"), F.col("_low") + F.col("_om") - F.col("_ow"))
    turn = F.when(F.col("_comes"), F.col("_om") + F.col("_m")).otherwise(F.col("_ow") + F.col("_w") + least)
    return joined.withColumn("turn", turn).select(*line.columns, "turn")


def running_sums(
    df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[Column], values: dict[str, str]
) -> DataFrame:
    """Inclusive running sums per key; ``values`` maps a new column to the column it sums."""
    rows, keys = _with_key(df.withColumn("_bucket", bucket), by)
    across = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(*BEFORE)
    totals = rows.groupBy(*keys, "_bucket").agg(*[F.sum(src).alias(f"_t_{new}") for new, src in values.items()])
    offsets = totals.select(
        *keys, "_bucket",
        *[F.coalesce(F.sum(f"_t_{new}").over(across), F.lit(0)).alias(f"_o_{new}") for new in values],
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(*UP_TO_HERE)
    out = rows.alias("r").join(offsets.alias("o"), same_keys([*keys, "_bucket"], "r", "o")).select(
        "r.*", *[F.col(f"o._o_{new}") for new in values]
    )
    for new, src in values.items():
        out = out.withColumn(new, F.col(f"_o_{new}") + F.coalesce(F.sum(src).over(inside), F.lit(0)))
    return out.drop("_bucket", "_all", *[f"_o_{new}" for new in values])


def neighbours(
    df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[str],
    back: dict[str, str] | None = None, ahead: dict[str, str] | None = None,
) -> DataFrame:
    """``lag`` (``back``) and ``lead`` (``ahead``) per key; both map a new column to the column it takes.

    The new columns are null on the first, or last, row of a key.
    """
    rows, keys = _with_key(df.withColumn("_bucket", bucket), by)
    pos = F.struct(*order)
    across = Window.partitionBy(*keys).orderBy("_bucket")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    edge, step, near = [], [], {}
    for side, cols, pick, shift in (("_back", back, F.max_by, F.lag), ("_ahead", ahead, F.min_by, F.lead)):
        if cols:
            packed = F.struct(*[F.col(src).alias(new) for new, src in cols.items()])
            edge.append(pick(packed, pos).alias(side))
            step.append(shift(side).over(across).alias(side))
            near[side] = (F.coalesce(shift(packed).over(inside), F.col(side)), list(cols))
    edges = rows.groupBy(*keys, "_bucket").agg(*edge).select(*keys, "_bucket", *step)
    out = rows.alias("r").join(edges.alias("e"), same_keys([*keys, "_bucket"], "r", "e")).select(
        "r.*", *[F.col(f"e.{side}") for side in near])
    for side, (value, _) in near.items():
        out = out.withColumn(f"{side}_row", value)
    new = [F.col(f"{side}_row.`{c}`").alias(c) for side, (_, names) in near.items() for c in names]
    return out.select(*df.columns, *new)


def carried(
    df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[str], cols: Sequence[str], ahead: bool = False
) -> DataFrame:
    """Replace nulls by the last non-null value at or before the row (``ahead``: at or after it), per key."""
    rows, keys = _with_key(df.withColumn("_bucket", bucket), by)
    pos = F.struct(*order)
    pick = F.min_by if ahead else F.max_by
    edges = rows.groupBy(*keys, "_bucket").agg(
        *[pick(F.col(c), F.when(F.col(c).isNotNull(), pos)).alias(f"_e_{c}") for c in cols]
    )
    # Looking ahead is looking back in the reverse order: a growing frame costs one step per row, a shrinking one does
    # not.
    turn = F.desc if ahead else F.asc
    across = Window.partitionBy(*keys).orderBy(turn("_bucket")).rowsBetween(*BEFORE)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*[turn(o) for o in order]).rowsBetween(*UP_TO_HERE)
    edges = edges.select(
        *keys, "_bucket", *[F.last(f"_e_{c}", ignorenulls=True).over(across).alias(f"_c_{c}") for c in cols]
    )
    out = rows.alias("r").join(edges.alias("e"), same_keys([*keys, "_bucket"], "r", "e")).select(
        "r.*", *[F.col(f"e.`_c_{c}`") for c in cols]
    )
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_c_{c}")) for c in cols}
    return out.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])
