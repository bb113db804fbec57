"""Aggregates over many overlapping intervals without their pairs with points."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwise.functions.buckets import chunk
from spanwise.operators.joins import interval_totals
from spanwise.operators.ordered import BEFORE, numbered_by_range, ranged, same_keys
from spanwise.session import materialize

#: Children of a node of ranks.
FAN = 8
#: Runs of equal size that all values are cut into, in their order.
RUNS = 32
#: Points of a run at most: there are more runs where ``RUNS`` would be larger.
POINTS = 1 << 20
#: Interval ends whose totals a task holds at a time, and questions that meet a run's points in one task.
ENDS, ASKS = 2048, 250_000


def group_totals(
    points: DataFrame, intervals: DataFrame, t: str, lo: str, hi: str, by: Sequence[str], sums: dict[str, str],
    width: float, count: str = "n",
) -> DataFrame:
    """``interval_totals`` for every group of points that has one inside the interval.

    A group is looked at for an interval only if it has a point in one of the ``width``-wide pieces that the interval
    touches. ``intervals`` keeps its columns; sum integers.
    """
    present = points.select(chunk(F.col(t), width).alias("_piece"), *by).distinct()
    reach = F.sequence(chunk(F.col(lo), width), chunk(F.col(hi), width))
    spread = intervals.where(F.col(lo) <= F.col(hi)).withColumn("_piece", F.explode(reach))
    wanted = spread.join(present, "_piece").drop("_piece").distinct()
    found = interval_totals(points, materialize(wanted, "wanted"), t, lo, hi, sums, width, by, count)
    return found.where(F.col(count) > 0)


def interval_quantiles(
    points: DataFrame, intervals: DataFrame, t: str, lo: str, hi: str, value: str, prob: float, width: float,
    on: Sequence[str] = (), name: str = "quantile", fan: int = FAN,
) -> DataFrame:
    """``intervals`` with a linearly interpolated quantile of the values inside; intervals without points are left out.

    Values are numbered in their order once. A rank is then found from the top down, a digit (of ``fan``) at a time: the
    points inside the interval are counted for each next digit, by differences of running totals, and the digit that holds
    the rank is taken. Work is linear in points plus intervals for every digit, however much the intervals overlap, and no
    interval's points are brought together. ``fan`` is a power of two, so that digits are shifts.
    """
    step = fan.bit_length() - 1
    if 1 << step != fan or fan < 2:
        raise ValueError("fan is not a power of two")
    keys = [*on, lo, hi]
    known = points.where(F.col(value).isNotNull()).select(*on, t, F.col(value).cast("double").alias("_v"))
    ranked = materialize(numbered_by_range(known, [], [F.col("_v"), F.col(t)], "_rank").withColumn("_rank", F.col("_rank") - 1), "ranked")
    top = ranked.agg(F.max("_rank")).first()[0]
    if top is None:
        return intervals.where(F.lit(False)).withColumn(name, F.lit(None).cast("double"))
    n = interval_totals(ranked, intervals.select(*keys).distinct(), t, lo, hi, {}, width, on, "_n").where("_n > 0")
    at = (F.col("_n") - 1) * F.lit(float(prob))
    low = F.floor(at).cast("long")
    sides = materialize(n.select(*keys, low.alias("_low"), F.least(low + 1, F.col("_n") - 1).alias("_high"), (at - low).alias("_part")), "sides")
    asked = sides.select(*keys, F.explode(F.array_distinct(F.array("_low", "_high"))).alias("_asked"))
    found = asked.withColumns({"_left": F.col("_asked"), "_node": F.lit(0).cast("long")})
    for level in reversed(range(-(-max(1, top.bit_length()) // step))):
        digits = F.sequence(F.shiftleft("_node", step), F.shiftleft("_node", step) + (fan - 1))
        wanted = found.select(*keys, "_asked", "_left", F.explode(digits).alias("_node"))
        leveled = ranked.withColumn("_node", F.shiftright("_rank", level * step))
        counts = interval_totals(leveled, wanted.select(*keys, "_node").distinct(), t, lo, hi, {}, width, [*on, "_node"], "_n").where("_n > 0")
        line = wanted.alias("w").join(counts.alias("c"), same_keys([*keys, "_node"], "w", "c")).select("w.*", "c._n")
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys, "_asked").orderBy("_node").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))
        line = line.withColumn("_before", before).where("_left >= _before AND _left < _before + _n")
        found = materialize(line.select(*keys, "_asked", (F.col("_left") - F.col("_before")).alias("_left"), "_node"), "digits")
    values = found.join(ranked.select(F.col("_rank").alias("_node"), "_v"), "_node").select(*keys, "_asked", "_v")

    def side(which: str) -> DataFrame:
        return values.select(*[F.col(k).alias(f"_{which}{k}") for k in keys], F.col("_asked").alias(f"_{which}"), F.col("_v").alias(f"_{which}v"))

    out = intervals.alias("i").join(sides.alias("s"), same_keys(keys, "i", "s")).select("i.*", "s._low", "s._high", "s._part")
    for which in ("_low", "_high"):
        mine = side(which)
        cond = F.col(which) == F.col(f"_{which}")
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_{which}{k}"))
        out = out.join(mine, cond).drop(f"_{which}", *[f"_{which}{k}" for k in keys])
    result = F.col("__lowv") + (F.col("__highv") - F.col("__lowv")) * F.col("_part")
    return out.withColumn(name, result).drop("__lowv", "__highv", "_low", "_high", "_part")


def slot_totals(points: DataFrame, spans: DataFrame, t: str, lo: str, hi: str, ones: Sequence[str], slots: int,
                adds: Sequence[str] = (), value: str | None = None, sums: int = 0) -> DataFrame:
    """Counts and sums of many small groups inside each of the distinct intervals ``spans``, as arrays, both ends included.

    A point names the slots it counts in (``ones``, below ``slots``) and those its ``value`` is added to (``adds``, below
    ``sums``); null is none. Points and interval ends lie in one line of time, cut by ranges. A task counts from the start
    of its range, a row a range tells what lies before it, and an interval is the difference of its two ends: one row of
    small numbers an end, however many groups and overlaps there are. Sum integers. Added are ``_n``, ``_v`` of each end
    (``_low``, ``_high``), to be subtracted by ``inside``.
    """
    kept = [*ones, *adds] if value is None else [*ones, *adds, value]
    names = {c: f"_p{k}" for k, c in enumerate(kept)}
    line = points.where(F.col(t).isNotNull()).select(F.col(t).cast("long").alias("_t"), F.lit(1).alias("_kind"), *[F.col(c).alias(n) for c, n in names.items()])
    ends = spans.select(F.col(lo).alias("_a"), F.col(hi).alias("_b"), F.explode(F.array(
        F.struct(F.col(lo).cast("long").alias("_t"), F.lit(0).alias("_kind")), F.struct(F.col(hi).cast("long").alias("_t"), F.lit(2).alias("_kind")))).alias("_e"))
    line = line.unionByName(ends.select("_a", "_b", "_e.*"), allowMissingColumns=True)
    tie = F.xxhash64(*names.values(), "_a", "_b")
    stored, ranks = ranged(line, [], [F.col("_t"), F.col("_kind"), tie])
    own, added, v = [names[c] for c in ones], [names[c] for c in adds], None if value is None else names[value]

    def totals(cols: list[str], measure) -> DataFrame:
        spread = stored.where("_kind = 1").select("_part", F.explode(F.array(*cols)).alias("_slot"), *([v] if v else []))
        return spread.where("_slot IS NOT NULL").groupBy("_part", "_slot").agg(measure.alias("_x"))

    tables = [totals(own, F.count(F.lit(1))).withColumn("_sum", F.lit(False))]
    if added:
        tables.append(totals(added, F.coalesce(F.sum(v), F.lit(0).cast("long"))).withColumn("_sum", F.lit(True)))
    per = tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])
    parts = stored.select("_part").distinct()
    # One row a range and slot: what earlier ranges hold, also for ranges without such a point.
    groups = parts.crossJoin(per.select("_slot", "_sum").distinct()).join(per, ["_part", "_slot", "_sum"], "left")
    before = F.coalesce(F.sum("_x").over(Window.partitionBy("_slot", "_sum").orderBy("_part").rowsBetween(*BEFORE)), F.lit(0))
    start = groups.select("_part", F.struct("_slot", "_sum", before.alias("_x")).alias("_s")).groupBy("_part").agg(F.collect_list("_s").alias("_s"))

    def array_of(sum_: bool, n: int):
        held = F.map_from_entries(F.transform(F.filter("_s", lambda s: s["_sum"] == sum_), lambda s: F.struct(s["_slot"], s["_x"])))
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.try_element_at(held, k), F.lit(0).cast("long"))) if n else F.array().cast("array<long>")

    start = materialize(parts.join(start, "_part", "left").withColumn("_s", F.coalesce("_s", F.array().cast(start.schema["_s"].dataType))).select(
        "_part", array_of(False, slots).alias("_n0"), array_of(True, sums).alias("_v0")), "starts")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Totals at each end since the start of its range. Rows come range by range, in their order, a batch at a time."""
        now, n, s = None, None, None
        for rows in batches:
            if not rows.num_rows:
                continue
            parts, kinds = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("_part", "_kind"))
            slot_of = {c: pc.fill_null(rows.column(c), -1).to_numpy(zero_copy_only=False).astype(np.int64) for c in {*own, *added}}
            amounts = pc.fill_null(rows.column(v), 0).to_numpy(zero_copy_only=False).astype(np.int64) if v else None
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for begin, stop in zip(cuts, cuts[1:]):
                if parts[begin] != now:
                    now, n, s = parts[begin], np.zeros(slots, dtype=np.int64), np.zeros(sums, dtype=np.int64)
                is_end = kinds[begin:stop] != 1
                at = begin + np.flatnonzero(is_end)
                first = begin
                for k in range(0, max(1, len(at)), ENDS):
                    some = at[k:k + ENDS]
                    # Behind the last end of a batch there may be points that count for the next one.
                    here = slice(first, stop if k + ENDS >= len(at) else some[-1] + 1)
                    first = here.stop
                    ends = kinds[here] != 1
                    place = np.cumsum(ends)

                    def grown(cols, width, weights):
                        out = np.zeros((len(some) + 1) * width, dtype=np.int64)
                        for c in cols:
                            slot = slot_of[c][here]
                            known = (slot >= 0) & ~ends
                            np.add.at(out, place[known] * width + slot[known], 1 if weights is None else weights[here][known])
                        return np.cumsum(out.reshape(-1, width), axis=0) if width else out.reshape(len(some) + 1, 0)

                    counts, totals_ = grown(own, slots, None) + n, grown(added, sums, amounts) + s
                    n, s = counts[-1], totals_[-1]
                    if not len(some):
                        continue

                    def lists(numbers, kind):
                        return pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * numbers.shape[1], pa.array(numbers[:-1].ravel().astype(kind)))

                    columns = [rows.column(c).take(pa.array(some)) for c in ("_a", "_b", "_kind", "_part")]
                    yield pa.RecordBatch.from_arrays([*columns, lists(counts, np.int32), lists(totals_, np.int64)],
                                                     ["_a", "_b", "_kind", "_part", "_n", "_v"])

    # Ranges follow the order, so sorted rows come range by range.
    in_order = stored.repartition("_part").sortWithinPartitions(*ranks).select("_part", "_kind", "_a", "_b", *names.values())
    at_ends = in_order.mapInArrow(counted, "_a long, _b long, _kind int, _part int, _n array<int>, _v array<long>")
    low, high = (at_ends.where(f"_kind = {k}").select(
        F.col("_a").alias(lo), F.col("_b").alias(hi), *[F.col(c).alias(f"{c}_{side}") for c in ("_part", "_n", "_v")])
        for k, side in ((0, "low"), (2, "high")))
    rows = low.join(high, [lo, hi])
    for side in ("low", "high"):
        named = start.select(*[F.col(c).alias(f"{c}_{side}") for c in ("_part", "_n0", "_v0")])
        rows = rows.join(F.broadcast(named), f"_part_{side}")
    return rows.drop("_part_low", "_part_high")


def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows, a few at a time: wide rows are unfolded to many numbers each."""
    for rows in batches:
        for k in range(0, len(rows), ENDS):
            yield rows.iloc[k:k + ENDS]


#: Columns of ``slot_totals`` for one kind of number.
def sides(kind: str) -> list[str]:
    return [f"{c}_{side}" for side in ("low", "high") for c in (kind, f"{kind}0")]


def inside(rows: pd.DataFrame, kind: str, backwards: np.ndarray) -> np.ndarray:
    """Numbers inside each interval, a row each, from both ends; zeros for an interval that ends before it starts."""
    low, low0, high, high0 = (np.stack(rows[c].to_numpy()).astype(np.int64) for c in sides(kind))
    out = high + high0 - low - low0
    out[backwards] = 0
    return out


def smallest(t: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place, in the order of values, of the k-th smallest (from 0) of the points with lo <= t <= hi, for each question.

    Points come in the order of ``t``; ``order`` are their places by value. Bit by bit from the top, points are parted by
    the bit and each question follows its rank, all questions at once.
    """
    i, j, k = np.searchsorted(t, lo, "left"), np.searchsorted(t, hi, "right"), k.copy()
    found, line = np.zeros(len(k), dtype=np.int64), order
    zeros = np.zeros(len(t) + 1, dtype=order.dtype)
    for bit in reversed(range(max(1, int(len(t)).bit_length()))):
        one = ((line >> bit) & 1).astype(bool)
        np.cumsum(~one, out=zeros[1:])
        zi, zj = zeros[i], zeros[j]
        up = k >= zj - zi
        k = np.where(up, k - (zj - zi), k)
        found |= up.astype(np.int64) << bit
        last = int(zeros[-1])
        i, j = np.where(up, last + i - zi, zi), np.where(up, last + j - zj, zj)
        line = np.concatenate([line[~one], line[one]])
    return found


def group_quantiles(points: DataFrame, spans: DataFrame, t: str, lo: str, hi: str, code: str, codes: int, value: str, prob: float,
                    runs: int = RUNS, asks: int = ASKS) -> DataFrame:
    """Linearly interpolated quantiles inside each of the distinct intervals ``spans``, as the array ``_q``.

    ``code`` numbers the groups of points; the array has the quantile of each, and last that of all points, null where there
    are none. All values are numbered in their order and cut into ``runs`` runs of equal size, or into more of ``POINTS``.
    Counts of points by group and run inside an interval (``slot_totals``) tell the run of a rank; the run's points then meet
    its questions, at most ``asks`` of them in a task. A point is written a few times and an interval a few times for each
    group, however much intervals overlap.
    """
    known = points.where(F.col(value).isNotNull()).select(F.col(t).cast("long").alias("_t"), F.col(code).cast("int").alias("_code"), F.col(value).cast("double").alias("_x"))
    rank = numbered_by_range(known.where("_t IS NOT NULL"), [], [F.col("_x"), F.col("_t"), F.col("_code")], "_rank")
    ranked = materialize(rank.withColumn("_rank", F.col("_rank") - 1), "ranked")
    last = max(1, ranked.agg(F.max("_rank")).first()[0] or 0)
    runs = max(runs, -(-last // POINTS))
    size = -(-last // runs) + 1
    ranked = ranked.withColumn("_run", F.floor(F.col("_rank") / size).cast("int"))
    counts = slot_totals(ranked.withColumn("_slot", F.col("_code") * runs + F.col("_run")), spans, "_t", lo, hi, ["_slot"], codes * runs)

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in pieces(batches):
            a, b = rows[lo].to_numpy(), rows[hi].to_numpy()
            n = inside(rows, "_n", b < a).reshape(len(rows), codes, runs)
            n = np.concatenate([n, n.sum(axis=1, keepdims=True)], axis=1)
            upto = np.cumsum(n, axis=2)
            total = upto[:, :, -1]
            at = (total - 1) * prob
            low = np.floor(at).astype(np.int64)
            for side, want in ((0, low), (1, np.minimum(low + 1, total - 1))):
                who, which = np.nonzero(total > 0)
                want_, cum = want[who, which], upto[who, which]
                run = (cum <= want_[:, None]).sum(axis=1)
                left = want_ - np.where(run > 0, cum[np.arange(len(run)), np.maximum(run - 1, 0)], 0)
                yield pd.DataFrame({"_a": a[who], "_b": b[who], "_code": which.astype(np.int32), "_side": np.int32(side), "_run": run.astype(np.int32),
                                    "_left": left, "_share": (at - low)[who, which]})

    schema = "_a long, _b long, _code int, _side int, _run int, _left long, _share double"
    questions = materialize(counts.select(lo, hi, *sides("_n")).mapInPandas(asked, schema), "questions")
    deals = questions.groupBy("_run").agg(F.ceil(F.count(F.lit(1)) / asks).cast("int").alias("_deals"))
    dealt = questions.join(F.broadcast(deals), "_run").withColumn("_deal", F.pmod(F.xxhash64("_a", "_b"), F.col("_deals")).cast("int"))
    copies = ranked.join(F.broadcast(deals), "_run").withColumn("_deal", F.explode(F.sequence(F.lit(0), F.col("_deals") - 1)))

    def answered(theirs: pa.Table, questions_: pa.Table) -> pa.Table:
        t = theirs.column("_t").to_numpy()
        by_time = np.argsort(t, kind="stable").astype(np.int32)
        t = t[by_time]
        a, b, left, code_of = (questions_.column(c).to_numpy() for c in ("_a", "_b", "_left", "_code"))
        value_of = np.full(len(a), np.nan)
        for c in np.unique(code_of):
            mine = by_time if c == codes else by_time[theirs.column("_code").to_numpy()[by_time] == c]
            place = np.argsort(theirs.column("_rank").to_numpy()[mine], kind="stable").astype(np.int32)
            order = np.empty(len(mine), dtype=np.int32)
            order[place] = np.arange(len(mine), dtype=np.int32)
            who = code_of == c
            found = smallest(t if c == codes else theirs.column("_t").to_numpy()[mine], order, a[who], b[who], left[who])
            value_of[who] = theirs.column("_x").to_numpy()[mine[place[found]]]
        return questions_.select(["_a", "_b", "_code", "_side", "_share"]).append_column("_x", pa.array(value_of))

    answers = copies.select("_run", "_deal", "_t", "_code", "_rank", "_x").groupBy("_run", "_deal").cogroup(
        dealt.select("_run", "_deal", "_a", "_b", "_code", "_side", "_left", "_share").groupBy("_run", "_deal")).applyInArrow(
        answered, "_a long, _b long, _code int, _side int, _share double, _x double")

    def quantile(c: int):
        low, high = (F.max(F.when((F.col("_code") == c) & (F.col("_side") == side), F.col("_x"))) for side in (0, 1))
        return low + (high - low) * F.max(F.when(F.col("_code") == c, F.col("_share")))

    return answers.groupBy(F.col("_a").alias(lo), F.col("_b").alias(hi)).agg(F.array(*[quantile(c) for c in range(codes + 1)]).alias("_q"))
