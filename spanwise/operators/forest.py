"""Isolation forests per call pattern, trained and applied as Spark jobs (Liu, Ting and Zhou, 2008).

Training deals all rows of a key into slices of about twice a sample by a seeded hash; each tree samples its own slice, so
trees come from the whole key, never depend on partitioning, and no task sees more than a slice. Scores and contributions are evaluated where the rows are; the trees travel to them.
"""

from __future__ import annotations

import math
import sys
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Iterator, Tuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.operators.quantiles import quantiles
from spanwise.session import materialize

# Workers get these helpers with the task, whether or not the package is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREE_BLOCKS = 10
ROWS_PER_SPLIT = 50_000
# About 50 bytes a node: beyond this the trees are shuffled to the rows instead of broadcast.
MAX_BROADCAST_NODES = 2_000_000
NODE_SCHEMA = "tree int, node int, feature int, threshold double, lower int, upper int, n int, path double"


def average_path(n):
    """Mean depth of an unsuccessful search in a binary tree of n leaves."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    deep = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, deep))


def grow_trees(x: np.ndarray, samples: np.ndarray, rng: np.random.Generator) -> pd.DataFrame:
    """Trees over the row samples (one per line of ``samples``), all grown together level by level.

    A node splits at a uniform threshold of a random feature among those that vary in it.
    """
    count, size = samples.shape
    limit = math.ceil(math.log2(max(size, 2)))
    rows = x[samples.ravel()]
    owner = np.arange(count)
    number = np.zeros(count, dtype=np.int64)
    sizes = np.full(count, size)
    used = np.ones(count, dtype=np.int64)
    levels = []
    for depth in range(limit + 1):
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        low, high = np.minimum.reduceat(rows, first), np.maximum.reduceat(rows, first)
        varies = high > low
        split = varies.any(axis=1) & (sizes > 1) & (depth < limit)
        lot = np.where(varies, rng.random(varies.shape), -1.0)
        feature = lot.argmax(axis=1)
        at = np.arange(len(owner))
        low, high = low[at, feature], high[at, feature]
        cut = low + rng.random(len(owner)) * (high - low)
        cut = np.where(cut >= high, low, cut)
        # Children are numbered per tree in the order of their parents.
        parents = np.flatnonzero(split)
        child_owner = np.repeat(owner[parents], 2)
        if len(parents):
            start = np.searchsorted(child_owner, child_owner, side="left")
            child_number = used[child_owner] + np.arange(len(child_owner)) - start
            np.add.at(used, child_owner, 1)
        else:
            child_number = np.zeros(0, dtype=np.int64)
        lower, upper = number.copy(), number.copy()
        lower[parents], upper[parents] = child_number[0::2], child_number[1::2]
        levels.append(pd.DataFrame({
            "tree": owner, "node": number, "feature": np.where(split, feature, -1),
            "threshold": np.where(split, cut, 0.0), "lower": lower, "upper": upper, "n": sizes,
            "path": np.where(split, 0.0, depth + average_path(sizes))}))
        if not len(parents):
            break
        node = np.repeat(at, sizes)
        keep = split[node]
        rows, node = rows[keep], node[keep]
        place = np.cumsum(split) - 1
        target = 2 * place[node] + (rows[np.arange(len(rows)), feature[node]] > cut[node])
        order = np.argsort(target, kind="stable")
        rows = rows[order]
        sizes = np.bincount(target, minlength=2 * len(parents))
        owner, number = child_owner, child_number
    return pd.concat(levels, ignore_index=True)


class Trees:
    """All trees of one key as padded arrays."""

    def __init__(self, nodes: pd.DataFrame):
        ids = np.sort(nodes["tree"].unique())
        self.count, width = len(ids), int(nodes["node"].max()) + 1
        row = np.searchsorted(ids, nodes["tree"].to_numpy())
        col = nodes["node"].to_numpy()

        def table(name, fill, kind):
            out = np.full((self.count, width), fill, dtype=kind)
            out[row, col] = nodes[name].to_numpy()
            return out

        self.feature, self.cut = table("feature", -1, np.int32), table("threshold", 0.0, float)
        self.lower, self.upper = table("lower", 0, np.int32), table("upper", 0, np.int32)
        self.n, self.path = table("n", 1, np.int64), table("path", 0.0, float)
        self.sample = int(self.n[:, 0].max())
        self._leaves = None

    def mean_depth(self, x: np.ndarray, rows_at_once: int = 512) -> np.ndarray:
        """Mean leaf path of each row. All trees are walked together; a leaf leads to itself.

        Nodes lie in flat arrays and a few rows are taken at a time, so that a step is a few gathers within the cache.
        """
        width = self.feature.shape[1]
        first = np.arange(self.count, dtype=np.int64) * width
        leaf = self.feature < 0
        here = first[:, None] + np.arange(width)
        # Beside each other: the child for values above the cut (or none), the child for the others.
        child = np.stack([np.where(leaf, here, first[:, None] + self.upper), np.where(leaf, here, first[:, None] + self.lower)], axis=-1).ravel()
        feature, cut, path, ended = np.where(leaf, 0, self.feature).ravel(), self.cut.ravel(), self.path.ravel(), leaf.ravel()
        out = np.empty(len(x))
        for start in range(0, len(x), rows_at_once):
            part = np.ascontiguousarray(x[start:start + rows_at_once])
            values, row = part.ravel(), (np.arange(len(part)) * part.shape[1])[:, None]
            at = np.broadcast_to(first, (len(part), self.count))
            for step in range(64):
                if step and ended[at].all():
                    break
                low = values[row + feature[at]] <= cut[at]
                at = child[2 * at + low]
            out[start:start + rows_at_once] = path[at].mean(axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        base = float(average_path(self.sample))
        depth = self.mean_depth(x)
        return -np.power(2.0, -(depth / base if base > 0 else np.ones_like(depth)))

    def leaves(self):
        """Per leaf: value, and for each feature on its path the interval and the share of training rows kept."""
        if self._leaves is None:
            found, stack = [], [(t, 0, {}) for t in range(self.count)]
            while stack:
                t, i, path = stack.pop()
                f = int(self.feature[t, i])
                if f < 0:
                    found.append((self.path[t, i] / self.count, path))
                    continue
                low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
                cut, n = self.cut[t, i], self.n[t, i]
                for child, side in ((self.lower[t, i], (low, min(high, cut))), (self.upper[t, i],
                                                                                (max(low, cut), high))):
                    stack.append((t, int(child), {**path, f: (*side, share * self.n[t, child] / n)}))
            width = max(1, max(len(p) for _, p in found))
            shape = (len(found), width)
            feature = np.zeros(shape, dtype=np.int32)
            low, high = np.full(shape, -np.inf), np.full(shape, np.inf)
            share, used = np.ones(shape), np.zeros(shape, dtype=bool)
            for i, (_, path) in enumerate(found):
                for j, (f, (a, b, s)) in enumerate(path.items()):
                    feature[i, j], low[i, j], high[i, j], share[i, j], used[i, j] = f, a, b, s, True
            self._leaves = (np.array([v for v, _ in found]), feature, low, high, share, used)
        return self._leaves

    def base_depth(self) -> float:
        value, _, _, _, share, _ = self.leaves()
        return float((value * share.prod(axis=1)).sum())

    def contributions(self, x: np.ndarray, rows_at_once: int = 32) -> np.ndarray:
        """Shapley contributions of the features to the mean depth, path-dependent (Lundberg et al., 2018).

        The weights over coalitions are the integral over t in (0, 1) of the product over the other features of
        ``share * (1 - t) + hit * t``, a polynomial that a Gauss rule of half its degree integrates exactly.
        """
        value, feature, low, high, share, used = self.leaves()
        points, weights = np.polynomial.legendre.leggauss(feature.shape[1] // 2 + 1)
        points, weights = (points + 1) / 2, weights / 2
        pick = np.zeros((feature.size, x.shape[1]))
        pick[np.flatnonzero(used), feature[used]] = 1.0
        out = np.empty((len(x), x.shape[1]))
        for start in range(0, len(x), rows_at_once):
            part = x[start:start + rows_at_once]
            at = part[:, feature]
            hit = ((at > low) & (at <= high)).astype(float)
            mass = np.zeros_like(hit)
            for t, w in zip(points, weights):
                term = share * (1 - t) + hit * t
                mass += w * term.prod(axis=2, keepdims=True) / term
            phi = value[None, :, None] * (hit - share) * mass
            out[start:start + rows_at_once] = phi.reshape(len(part), -1) @ pick
        return out


def _evaluate(nodes: dict, built: dict, keys: pd.Series, x: np.ndarray, method: str, empty):
    """Apply a method of each row's trees; ``built`` keeps the trees of keys met before."""
    out = [empty] * len(keys)
    for key, where in pd.Series(np.arange(len(keys))).groupby(keys.to_numpy(), sort=False):
        if key in nodes:
            if key not in built:
                built[key] = Trees(pd.DataFrame(nodes[key]))
            at = where.to_numpy()
            for i, v in zip(at, getattr(built[key], method)(x[at])):
                out[i] = v
    return out


@dataclass
class Forest:
    """Fitted trees per key, with the score below which a row counts as an outlier."""

    nodes: DataFrame
    key: str
    features: Sequence[Column]
    id: str
    node_count: int
    offsets: DataFrame | None = None
    max_broadcast_nodes: int = MAX_BROADCAST_NODES
    _shared: object = field(default=None, repr=False)

    def _node_arrays(self) -> dict:
        """Node columns per key on the driver; only used below the size bound."""
        nodes = self.nodes.toPandas()
        return {k: {c: g[c].to_numpy() for c in g.columns if c != self.key} for k, g in nodes.groupby(self.key)}

    def trees(self) -> dict:
        return {k: Trees(pd.DataFrame(v)) for k, v in self._node_arrays().items()}

    def _apply(self, rows: DataFrame, method: str, name: str, kind: str) -> DataFrame:
        names = [f"_x{i}" for i in range(len(self.features))]
        vector = F.struct(*[f.cast("double").alias(n) for f, n in zip(self.features, names)])
        empty = None if kind.startswith("array") else float("nan")
        if self.node_count <= self.max_broadcast_nodes:
            if self._shared is None:
                self._shared = rows.sparkSession.sparkContext.broadcast(self._node_arrays())
            shared = self._shared

            @F.pandas_udf(kind)
            def run(batches: Iterator[Tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.Series]:
                built = {}
                for keys, x in batches:
                    yield pd.Series(_evaluate(shared.value, built, keys, x.to_numpy(float), method, empty))

            # Marked so that the optimizer neither repeats the call nor merges it into a filter that uses it.
            return rows.withColumn(name, run.asNondeterministic()(F.col(self.key), vector))
        return self._apply_shuffled(rows, method, name, kind, names, vector, empty)

    def _apply_shuffled(self, rows, method, name, kind, names, vector, empty) -> DataFrame:
        """Send trees and rows to the same tasks; a large key is cut into splits, each with its own copy of the trees."""
        key, columns = self.key, rows.columns
        splits = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_SPLIT).cast("long").alias("_splits"))
        # Null-safe: rows without a key stay, as they do where the trees are broadcast.
        sized = splits.withColumnRenamed(key, "_key")
        spread = rows.withColumn("_x", vector).join(sized, F.col(key).eqNullSafe(F.col("_key"))).withColumn(
            "_split", F.pmod(F.xxhash64(self.id), F.col("_splits"))).select(*columns, "_x.*", "_split")
        copies = self.nodes.join(splits, key).withColumn(
            "_split", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_splits") - 1))).drop("_splits")

        def run(part: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
            out = part[columns].copy()
            out[key] = out[key].astype(object)
            known = {nodes[key].iloc[0]: nodes} if len(nodes) else {}
            out[name] = _evaluate(known, {}, part[key], part[names].to_numpy(float), method, empty)
            return out

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {name} {kind}"
        return spread.groupBy(key, "_split").cogroup(copies.groupBy(key, "_split")).applyInPandas(run, schema)

    def score(self, rows: DataFrame, name: str = "score") -> DataFrame:
        """Anomaly score in (-1, 0), lower is more isolated; null for a key without trees."""
        return self._apply(rows, "score", name, "double")

    def label(self, rows: DataFrame) -> DataFrame:
        """Add ``score`` and ``is_outlier``; a key without trees has no outliers."""
        flagged = self.score(rows).join(self.offsets, self.key, "left")
        out = F.coalesce((F.col("score") < F.col("offset")) & ~F.isnan("score"), F.lit(False))
        return flagged.withColumn("is_outlier", out).drop("offset")

    def explain(self, rows: DataFrame, names: Sequence[str], name: str = "attribution") -> DataFrame:
        """Add an array of (pos, feature, value): the share of each feature in the row's mean depth."""
        filled = self._apply(rows, "contributions", "_phi", "array<double>")
        pairs = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(n).alias("feature"), F.col("_phi")[i].alias("value"))
                          for i, n in enumerate(names)])
        return filled.withColumn(name, pairs).drop("_phi")

    def base(self) -> dict:
        """Mean depth of the training sample per key, the value contributions add up from."""
        return {k: t.base_depth() for k, t in self.trees().items()}


def fit(
    training: DataFrame, features: Sequence[Column], key: str = "pattern", id: str = "trace_id", trees: int = 100,
    sample: int = 256, contamination: float = 0.01, seed: int = 42,
    max_broadcast_nodes: int = MAX_BROADCAST_NODES,
) -> Forest:
    """Grow ``trees`` isolation trees per key and set the outlier offset at the ``contamination`` quantile of the
    training scores. Every row has the same chance to be drawn; trees share slices only where a key has too few rows for
    a slice each. Runs Spark jobs; the fitted nodes are stored in the shared folder.
    """
    names = [f"_x{i}" for i in range(len(features))]
    rows = training.select(key, id, *[f.cast("double").alias(n) for f, n in zip(features, names)])
    # Stored, so that its true size decides whether the join broadcasts it.
    sizes = materialize(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_size")), "sizes")
    slices = F.greatest(F.floor(F.col("_size") / (2 * sample)), F.lit(1)).cast("long")
    drawn = rows.join(sizes.withColumn("_slices", slices).drop("_size"), key).withColumn(
        "_slice", F.pmod(F.xxhash64(F.col(id), F.lit(seed)), F.col("_slices"))).where(F.col("_slice") < trees)
    # Trees that share a slice grow in several tasks, each with a copy of the slice.
    blocks = F.ceil(F.lit(min(TREE_BLOCKS, trees)) / F.col("_slices")).cast("int")
    # A fixed partition count: the slices are small but growing trees is not, so they must not be coalesced.
    tasks = training.sparkSession.sparkContext.defaultParallelism
    spread = drawn.withColumn("_blocks", blocks).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).where(
        F.col("_slice") + F.col("_slices") * F.col("_block") < trees).repartition(tasks, key, "_slice", "_block")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([id, *names])
        x, name = pdf[names].to_numpy(float), pdf[key].iloc[0]
        part, slice_, of, parts = (int(pdf[c].iloc[0]) for c in ("_block", "_slice", "_slices", "_blocks"))
        ids = np.arange(slice_, trees, of)[part::parts]
        rng = np.random.default_rng([seed, zlib.crc32(str(name).encode()), slice_, part])
        samples = np.stack([rng.choice(len(x), size=min(sample, len(x)), replace=False) for _ in ids])
        grown = grow_trees(x, samples, rng)
        grown["tree"] = ids[grown["tree"].to_numpy()]
        grown.insert(0, key, name)
        return grown

    key_type = training.schema[key].dataType.simpleString()
    nodes = materialize(spread.groupBy(key, "_slice", "_block").applyInPandas(grow, f"{key} {key_type}, {NODE_SCHEMA}"), "forest")
    model = Forest(nodes, key, list(features), id, nodes.count(), max_broadcast_nodes=max_broadcast_nodes)
    scored = model.score(training)
    model.offsets = materialize(quantiles(scored, "score", [key], {"offset": contamination}), "offsets")
    return model


def training_for(live: DataFrame, training: DataFrame, key: str = "pattern") -> DataFrame:
    """Training rows of the live patterns; a pattern that training lacks is trained on its own live rows."""
    wanted = training.join(live.select(key).distinct(), key, "left_semi")
    unseen = live.join(training.select(key).distinct(), key, "left_anti")
    return wanted.unionByName(unseen)
