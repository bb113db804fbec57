"""Properties of the forests and of the contributions."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanwise.operators import forest as fo


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    n = 3000
    pdf = pd.DataFrame({"trace_id": np.arange(n), "pattern": np.where(rng.random(n) < 0.9, "1", "0"),
                        "a": rng.normal(100, 10, n), "b": rng.normal(5, 1, n), "c": 3.0})
    pdf.loc[0, ["pattern", "a", "b"]] = ["1", 400.0, 40.0]
    return spark.createDataFrame(pdf)


FEATURES = ["a", "b", "c"]


def fitted(df, **more):
    return fo.fit(df, [F.col(f) for f in FEATURES], **more)


def test_planted_outlier_ranks_first_and_share_is_small(table):
    model = fitted(table)
    out = model.label(table).toPandas()
    assert out.sort_values("score").trace_id.iloc[0] == 0
    for _, part in out.groupby("pattern"):
        assert part.is_outlier.mean() <= 0.011
    assert out.score.between(-1, 0).all()


def test_same_result_for_any_partitioning(table):
    one = fitted(table.repartition(1)).score(table).toPandas().set_index("trace_id").score
    two = fitted(table.repartition(7, "a")).score(table.repartition(3)).toPandas().set_index("trace_id").score
    pd.testing.assert_series_equal(one.sort_index(), two.sort_index())


def test_shuffled_trees_score_like_broadcast_ones(table):
    model = fitted(table)
    far = fo.Forest(model.nodes, model.key, model.features, model.id, model.node_count, model.offsets,
                    max_broadcast_nodes=0)
    a = model.score(table).toPandas().set_index("trace_id").score.sort_index()
    b = far.score(table).toPandas().set_index("trace_id").score.sort_index()
    pd.testing.assert_series_equal(a, b)


def test_contributions_add_up_to_the_mean_depth(table):
    model = fitted(table)
    rows = model.explain(table.limit(40), FEATURES).toPandas()
    base = model.base()
    trees = model.trees()
    for r in rows.itertuples():
        depth = trees[r.pattern].mean_depth(np.array([[r.a, r.b, r.c]]))[0]
        assert sum(x["value"] for x in r.attribution) + base[r.pattern] == pytest.approx(depth, abs=1e-9)
        assert r.attribution[2]["value"] == 0.0


def test_contributions_equal_the_sum_over_coalitions(table):
    """Against the definition: conditional expectations by following both branches of unknown features."""
    from itertools import combinations
    from math import factorial

    model = fitted(table, trees=3, sample=32)
    trees = next(iter(model.trees().values()))
    x = np.array([130.0, 4.0, 3.0])

    def expected(t, node, known):
        f = trees.feature[t, node]
        if f < 0:
            return trees.path[t, node] / trees.count
        low, high = trees.lower[t, node], trees.upper[t, node]
        if f in known:
            return expected(t, low if x[f] <= trees.cut[t, node] else high, known)
        n = trees.n[t]
        return (n[low] * expected(t, low, known) + n[high] * expected(t, high, known)) / n[node]

    def value(known):
        return sum(expected(t, 0, known) for t in range(trees.count))

    want = []
    for i in range(3):
        rest = [j for j in range(3) if j != i]
        want.append(sum(factorial(k) * factorial(2 - k) / 6 * (value({*s, i}) - value(set(s)))
                        for k in range(3) for s in combinations(rest, k)))
    assert trees.contributions(x[None, :])[0] == pytest.approx(want, abs=1e-9)


def test_unseen_key_has_no_outliers(table):
    model = fitted(table.where("pattern = '1'"))
    assert model.label(table).where("pattern = '0' and is_outlier").count() == 0


def test_trees_are_drawn_from_all_rows(spark):
    """A key far larger than a slice: each tree has its own rows, and values from the whole key appear in the splits."""
    rows = spark.range(60_000).select(F.lit("p").alias("pattern"), F.col("id").alias("trace_id"), F.col("id").cast("double").alias("v"))
    model = fo.fit(rows, [F.col("v")], trees=20, sample=64)
    nodes = model.nodes.where("feature >= 0").toPandas()
    assert nodes["tree"].nunique() == 20
    assert nodes["threshold"].min() < 6_000 and nodes["threshold"].max() > 54_000
    assert model.nodes.where("lower < 0 OR lower IS NULL OR n > 0").groupBy("tree").count().count() == 20


def test_rows_without_key_stay_on_both_paths(spark):
    rows = spark.createDataFrame(
        [("p" if k % 50 else None, k, float(k * 37 % 101)) for k in range(300)], "pattern string, trace_id long, v double")
    near = fo.fit(rows, [F.col("v")], trees=5, sample=32)
    far = fo.fit(rows, [F.col("v")], trees=5, sample=32, max_broadcast_nodes=0)
    key = lambda r: r.trace_id
    a, b = (sorted(m.score(rows).collect(), key=key) for m in (near, far))
    assert [(r.trace_id, repr(r.score)) for r in a] == [(r.trace_id, repr(r.score)) for r in b] and len(a) == 300


def test_walk_of_many_rows_is_plain_and_small():
    """Depths equal a walk node by node, and the walk of a batch does not hold arrays of rows by trees."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 50, (20_000, 4)).astype(float)
    x[7, 1] = np.nan
    samples = np.stack([rng.choice(np.arange(8, len(x)), 256, replace=False) for _ in range(60)])
    trees = fo.Trees(fo.grow_trees(x, samples, rng))
    tracemalloc.start()
    got = trees.mean_depth(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6_000_000  # 20,000 rows by 60 trees are 9.6 MB for each array of longs
    for i in (0, 7, 511, 512, 19_999):
        depths = []
        for t in range(trees.count):
            at = 0
            while (f := trees.feature[t, at]) >= 0:
                at = trees.lower[t, at] if x[i, f] <= trees.cut[t, at] else trees.upper[t, at]
            depths.append(trees.path[t, at])
        assert got[i] == np.mean(depths)
