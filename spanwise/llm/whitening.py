"""Embedding whitening from an exact bit-sliced scatter matrix.

Entries become integers, shifted by their dimension's least value. The bits of one weight of one dimension, over all rows,
form a plane, packed into 64-bit words; the cross-product of two dimensions is the sum over pairs of their planes of the
popcount of the AND, times both weights. Planes are counted block by block within tasks and the counts added up, so sums
are exact whatever the order. They are centred as integers (n * sum of products - product of sums) before division and eigh.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Integers beyond this size are set to it.
LARGEST = 1 << 60
#: Rows of a block whose planes are counted together.
ROWS = 1 << 15


@dataclass
class Whitening:
    """Row count, least values, sums of the shifted integers, unit eigenvectors as columns, eigenvalues, and the trace."""

    n: int
    low: np.ndarray
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector has no null or non-finite entry, and the most frequent length (of equally frequent ones the greater)."""
    good = F.forall(column, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    rows = vectors.where(F.col(column).isNotNull() & (F.size(column) > 0) & good)
    dims = rows.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.lit(False)) if dims is None else rows.where(F.size(column) == dims.d)


def integers(lists: pa.Array) -> np.ndarray:
    """Rows x dimensions of 64-bit integers."""
    flat = np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), -1)
    return np.clip(np.floor(SCALE * flat), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def planes(shifted: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Planes x words: for every dimension its bits from the lowest up, packed across the rows."""
    rows = len(shifted)
    padded = np.zeros((int(bits.sum()), -(-rows // 64) * 64), dtype=np.uint8)
    for k, (dim, bit) in enumerate((d, b) for d in range(len(bits)) for b in range(bits[d])):
        padded[k, :rows] = shifted[:, dim] >> bit & 1
    return np.packbits(padded, axis=1).view(np.uint64)


def _bounds(batches):
    low = high = None
    for batch in batches:
        if len(batch):
            x = integers(batch.column(0))
            low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
            high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
    if low is not None:
        yield pa.RecordBatch.from_pydict({"dim": np.arange(len(low)), "low": low, "high": high})


def _counter(low: np.ndarray, bits: np.ndarray):
    dim = np.repeat(np.arange(len(bits)), bits)
    weight = np.concatenate([np.arange(b) for b in bits]) if len(dim) else dim

    def counted(batches):
        both, rows = np.zeros((len(dim), len(dim)), dtype=np.int64), 0
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = integers(batch.column(0).slice(at, ROWS)) - low
                packed = planes(part, bits)
                rows += len(part)
                for p in range(len(packed)):
                    both[p, p:] += np.bitwise_count(packed[p:] & packed[p]).sum(axis=1, dtype=np.int64)
        # Counts by pair of dimensions and sum of weights; pairs of one dimension's planes count in both orders.
        first, second = np.nonzero(both)
        n, shift = both[first, second], weight[first] + weight[second]
        n = np.where((dim[first] == dim[second]) & (first != second), 2 * n, n)
        own = np.flatnonzero(np.diag(both))
        parts = [(dim[first], dim[second], shift, n), (dim[own], np.full(len(own), -1), weight[own], np.diag(both)[own]),
                 (np.array([-1]), np.array([-1]), np.array([0]), np.array([rows]))]
        frame = pd.DataFrame(dict(zip(("a", "b", "shift", "n"), map(np.concatenate, zip(*parts)))))
        yield pa.RecordBatch.from_pandas(frame.groupby(["a", "b", "shift"], as_index=False)["n"].sum(), preserve_index=False)

    return counted


def fit(vectors: DataFrame, column: str) -> Whitening | None:
    """The whitening of all given rows (see :func:`usable`); None without rows.

    The driver gets one number per pair of dimensions and weight, whatever the number of rows.
    """
    entries = vectors.select(F.col(column).cast("array<double>"))
    bounds = entries.mapInArrow(_bounds, "dim long, low long, high long").groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    bounds = bounds.orderBy("dim").toPandas()
    if not len(bounds):
        return None
    low = bounds["low"].to_numpy(np.int64)
    bits = np.array([int(h - v).bit_length() for v, h in zip(low.tolist(), bounds["high"].tolist())])
    counts = entries.mapInArrow(_counter(low, bits), "a long, b long, shift long, n long").groupBy("a", "b", "shift").agg(F.sum("n").alias("n"))
    d, n = len(low), 0
    sums, products = [0] * d, {}
    for a, b, shift, count in counts.toPandas().itertuples(index=False):
        value = int(count) << int(shift)
        if a < 0:
            n = value
        elif b < 0:
            sums[a] += value
        else:
            products[a, b] = products.get((a, b), 0) + value
    scatter = np.zeros((d, d))
    for a in range(d):
        for b in range(a, d):
            scatter[a, b] = scatter[b, a] = (n * products.get((a, b), 0) - sums[a] * sums[b]) / (n * n)
    values, found = np.linalg.eigh(scatter)
    values, found = values[::-1], found[:, ::-1]
    # Either sign is right: the largest entry is made positive.
    found = found * np.sign(found[np.abs(found).argmax(axis=0), np.arange(d)])
    return Whitening(n, low, sums, found, values, float(np.trace(scatter)))


def whitened(vectors: DataFrame, column: str, fitted: Whitening, components: int) -> DataFrame:
    """``vectors`` with ``deviation`` and ``whitened``, an array with an entry for each component that has variance.

    ``deviation`` is the exact sum over dimensions of (n * x - sum of x)^2, null where it exceeds a long. Columns of these
    names are replaced. Components whose eigenvalue is rounding error only (constant or dependent dimensions) are left out.
    """
    kept = fitted.values[:components] > len(fitted.low) * np.finfo(float).eps * max(fitted.values[0], 0)
    values, found = fitted.values[:components][kept], fitted.vectors[:, :components][:, kept]
    turn = found / np.sqrt(values)

    @F.arrow_udf("struct<deviation: long, whitened: array<double>>")
    def project(lists: pa.Array) -> pa.Array:
        if not len(lists):
            return pa.array([], pa.struct([("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))]))
        shifted = integers(lists) - fitted.low
        widest = fitted.n * int(shifted.max()) + max(fitted.sums) + 1
        wide = widest**2 * len(fitted.low) >= 1 << 63
        apart = (shifted.astype(object) if wide else shifted) * fitted.n - np.array(fitted.sums, dtype=object if wide else np.int64)
        deviation = (apart * apart).sum(axis=1)
        if wide:
            deviation = [x if x < 1 << 63 else None for x in deviation]
        centred = (apart / fitted.n).astype(np.float64)
        out = centred @ turn
        ends = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
        return pa.StructArray.from_arrays([pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))], ["deviation", "whitened"])

    # Selected by name, as neither the rows' own columns nor the struct's may be read under the other's name.
    rows = vectors.withColumn("__w", project(F.col(column).cast("array<double>")))
    return rows.withColumns({"deviation": F.col("__w.deviation"), "whitened": F.col("__w.whitened")}).drop("__w")


def _centred(batches):
    n, mean, products = 0, 0.0, 0.0
    for batch in batches:
        if len(batch):
            w = np.asarray(batch.column(0).flatten()).reshape(len(batch), -1)
            own = w.mean(axis=0)
            apart, off = w - own, own - mean
            both = n + len(w)
            products = products + apart.T @ apart + np.outer(off, off) * (n * len(w) / both)
            mean = mean + off * (len(w) / both)
            n = both
    if n and np.ndim(mean):
        a, b = np.triu_indices(len(mean))
        frame = pd.DataFrame({"a": a, "b": b, "inside": products[a, b], "between": n * mean[a] * mean[b], "first": n * mean[a], "second": n * mean[b], "n": n})
        yield pa.RecordBatch.from_pandas(frame, preserve_index=False)


def identity_error(rows: DataFrame) -> float | None:
    """Largest absolute entry of the covariance of ``whitened``, less the identity; centred within tasks, then between them."""
    parts = rows.select("whitened").mapInArrow(_centred, "a long, b long, inside double, between double, first double, second double, n long")
    summed = parts.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("inside", "between", "first", "second", "n")))
    n = F.col("n")
    covariance = (F.col("inside") + F.col("between") - F.col("first") * F.col("second") / n) / n
    return summed.agg(F.max(F.abs(covariance - (F.col("a") == F.col("b")).cast("double")))).first()[0]
