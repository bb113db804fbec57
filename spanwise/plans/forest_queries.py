"""Outlier detection and attribution with fitted forests over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwise.operators import attribution as at
from spanwise.operators import forest as fo
from spanwise.operators import risk
from spanwise.plans import bindings as b
from spanwise.plans.registry import query
from spanwise.session import materialize

COLUMNS = ["trace_id", "pattern", "start_us", "total_us", "durations"]


def _split(spark, sf_dir):
    """Live and training traces, stored once since fitting and scoring both read them."""
    both = materialize(b.traces(spark, sf_dir).select(*COLUMNS, "training"), "traces")
    return both.where(~F.col("training")).select(*COLUMNS), both.where("training").select(*COLUMNS)


def _features():
    return [b.feature_value(f) for f in b.FEATURES]



def _labelled(spark, sf_dir):
    live, training = _split(spark, sf_dir)
    model = fo.fit(fo.training_for(live, training), _features())
    return model, model.label(live), risk.deadlines(training)


@query("d1_training_selection", f"""WITH {b.TRACES_SQL}, t AS (SELECT * FROM train WHERE pattern NOT IN ('1111', '0001'))
SELECT trace_id, pattern, 'training' AS source FROM t WHERE pattern IN (SELECT pattern FROM live)
UNION ALL SELECT trace_id, pattern, 'live' FROM live WHERE pattern NOT IN (SELECT pattern FROM t)""")
def training_selection(spark, sf_dir):
    live, training = b.split(spark, sf_dir)
    training = training.where(~F.col("pattern").isin("1111", "0001"))
    rows = fo.training_for(live, training)
    return rows.select("trace_id", "pattern", F.when(F.col("training"), "training").otherwise("live").alias("source"))


@query("d2_feature_set", f"""WITH {b.TRACES_SQL} SELECT trace_id, CAST(total_us AS DOUBLE) AS total,
  CAST(op_0 AS DOUBLE) AS op_0, CAST(op_1 AS DOUBLE) AS op_1, CAST(op_2 AS DOUBLE) AS op_2,
  CAST(op_3 AS DOUBLE) AS op_3 FROM live""")
def feature_set(spark, sf_dir):
    live, _ = b.split(spark, sf_dir)
    return live.select("trace_id", *[b.feature_value(f).cast("double").alias(f) for f in b.FEATURES])


@query("d3_isolation_forest")
def isolation_forest(spark, sf_dir):
    _, flagged, _ = _labelled(spark, sf_dir)
    return flagged.select("trace_id", "pattern", F.round("score", 9).alias("score"), "is_outlier")


@query("d4_labelling_known_patterns")
def labelling_known_patterns(spark, sf_dir):
    """Patterns that training lacks are left out of the model, and none of their traces is flagged."""
    live, training = _split(spark, sf_dir)
    model = fo.fit(training.where(~F.col("pattern").isin("1111", "0001")), _features())
    return model.label(live).groupBy("pattern").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_outlier"), 1)).alias("outliers"))


@query("d5_global_forest")
def global_forest(spark, sf_dir):
    """One model for all patterns, without the total."""
    live, training = _split(spark, sf_dir)
    model = fo.fit(training.withColumn("whole", F.lit("all")), _features()[1:], key="whole")
    flagged = model.label(live.withColumn("whole", F.lit("all")))
    return flagged.select("trace_id", F.round("score", 9).alias("score"), "is_outlier")


@query("d7_tree_contributions")
def tree_contributions(spark, sf_dir):
    model, flagged, limits = _labelled(spark, sf_dir)
    rows = model.explain(risk.past_deadline(flagged, limits), b.FEATURES)
    rows = rows.select("trace_id", F.explode("attribution").alias("_a"))
    return rows.select("trace_id", F.col("_a.feature").alias("feature"), F.round("_a.value", 9).alias("contribution"))


# A forest of two trees written down by hand, so that SQL can walk it too: (tree, node, feature, threshold, lower, upper,
# n, path); features are the total and op_0.
STATED_TREES = [
    (0, 0, 0, 100000.0, 1, 2, 256, 0.0), (0, 1, -1, 0.0, 0, 0, 160, 8.5), (0, 2, 1, 30000.0, 3, 4, 96, 0.0),
    (0, 3, -1, 0.0, 0, 0, 60, 7.25), (0, 4, -1, 0.0, 0, 0, 36, 2.0),
    (1, 0, 1, 20000.0, 1, 2, 256, 0.0), (1, 1, -1, 0.0, 0, 0, 128, 9.0), (1, 2, -1, 0.0, 0, 0, 128, 3.5),
]


def _stated_forest(spark):
    nodes = spark.createDataFrame([("all", *n) for n in STATED_TREES], f"whole string, {fo.NODE_SCHEMA}")
    return fo.Forest(nodes, "whole", _features()[:2], "trace_id", len(STATED_TREES))


@query("d3_stated_trees", f"""WITH {b.TRACES_SQL}, depths AS (SELECT trace_id,
  (CASE WHEN total_us <= 100000 THEN 8.5 WHEN op_0 <= 30000 THEN 7.25 ELSE 2.0 END
    + CASE WHEN op_0 <= 20000 THEN 9.0 ELSE 3.5 END) / 2 AS depth FROM live)
SELECT trace_id, round(-pow(2, -CAST(depth AS DOUBLE) / (2 * (ln(255) + {fo.np.euler_gamma}) - 2 * 255.0 / 256)), 9) AS score
FROM depths""")
def stated_trees(spark, sf_dir):
    """Scores of stated trees: the walk and the normalisation without the draw."""
    live = b.split(spark, sf_dir)[0].withColumn("whole", F.lit("all"))
    return _stated_forest(spark).score(live).select("trace_id", F.round("score", 9).alias("score"))


@query("d7_stated_contributions", f"""WITH {b.TRACES_SQL}, hits AS (SELECT trace_id, CAST(total_us <= 100000 AS INT) AS a,
  CAST(op_0 <= 30000 AS INT) AS b, CAST(op_0 <= 20000 AS INT) AS c FROM live),
leaves AS (SELECT trace_id, 8.5 / 2 AS v, a AS h0, 160 / 256 AS s0, 1 AS h1, 1 AS s1 FROM hits
  UNION ALL SELECT trace_id, 7.25 / 2, 1 - a, 96 / 256, b, 60 / 96 FROM hits
  UNION ALL SELECT trace_id, 2.0 / 2, 1 - a, 96 / 256, 1 - b, 36 / 96 FROM hits
  UNION ALL SELECT trace_id, 9.0 / 2, 1, 1, c, 0.5 FROM hits UNION ALL SELECT trace_id, 3.5 / 2, 1, 1, 1 - c, 0.5 FROM hits)
SELECT trace_id, round(sum(v * (h0 - s0) * (s1 + h1) / 2), 9) AS total,
  round(sum(v * (h1 - s1) * (s0 + h0) / 2), 9) AS op_0 FROM leaves GROUP BY 1""")
def stated_contributions(spark, sf_dir):
    """Contributions of both features to the mean depth of the stated trees."""
    live = b.split(spark, sf_dir)[0].withColumn("whole", F.lit("all"))
    rows = _stated_forest(spark).explain(live, b.FEATURES[:2])
    return rows.select("trace_id", *[F.round(F.col("attribution")[i]["value"], 9).alias(n) for i, n in enumerate(b.FEATURES[:2])])


@query("d4_unseen_patterns", f"""WITH {b.TRACES_SQL} SELECT pattern, count(*) AS n, bool_or(pattern IN (SELECT pattern
  FROM train WHERE pattern NOT IN ('1111', '0001'))) AS scored, 0::BIGINT AS unseen_outliers FROM live GROUP BY 1""")
def unseen_patterns(spark, sf_dir):
    """Which live patterns the model scores; the others never count as outliers."""
    live, training = _split(spark, sf_dir)
    model = fo.fit(training.where(~F.col("pattern").isin("1111", "0001")), _features())
    unseen = F.col("score").isNull()
    return model.label(live).groupBy("pattern").agg(
        F.count(F.lit(1)).alias("n"), (~F.bool_or(unseen)).alias("scored"),
        F.count(F.when(unseen & F.col("is_outlier"), 1)).alias("unseen_outliers"))


@query("d_detected_anomalies")
def detected_anomalies(spark, sf_dir):
    """The whole chain from forest to responsible service: per pattern the traces past the gate and those attributed.

    A trace whose first candidate has no service (the total, or an unmapped operation) is dropped.
    """
    model, flagged, limits = _labelled(spark, sf_dir)
    gated = materialize(model.explain(risk.past_deadline(flagged, limits), b.FEATURES).drop("durations"), "gated")
    found = at.primary_service(gated, b.OP_SERVICE).groupBy("pattern").agg(F.count(F.lit(1)).alias("attributed"))
    rows = gated.groupBy("pattern").agg(F.count(F.lit(1)).alias("gated"), F.max("total_us").alias("slowest_us"))
    return rows.join(found, "pattern", "left").na.fill(0, ["attributed"])
