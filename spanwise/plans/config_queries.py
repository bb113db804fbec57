"""Configuration analytics over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwise import dims
from spanwise.functions import scalars as sc
from spanwise.operators import configs as cf
from spanwise.operators import experiment as ex
from spanwise.plans import bindings as b
from spanwise.plans.registry import query
from spanwise.session import materialize


def _read_docs(spark, sf_dir):
    """Documents with their parameters, stored since change detection reads them more than once."""
    rows = cf.with_params(b.config_docs(spark, sf_dir)).select("service", "seq", "applied_at", "params")
    return materialize(rows, "config-params")


def _params(spark, sf_dir, turn):
    return cf.flatten(b.config_docs(spark, sf_dir).where(F.col("seq") % 3 == turn)).select(
        "service", "seq", "param", F.col("value_num").alias("num"), F.col("value_str").alias("str"))


def _params_sql(turn):
    return f"WITH {b.CONFIG_SQL} SELECT * FROM params WHERE seq % 3 = {turn} AND param NOT IN ({_ENV_SQL})"


_ENV = ("cache_size", "ratio", "mode")
_ENV_SQL = ", ".join(f"'{e}'" for e in _ENV)


@query("c1_service_parameters", _params_sql(0))
def service_parameters(spark, sf_dir):
    return _params(spark, sf_dir, 0).where(~F.col("param").isin(*_ENV))


@query("c2_deployment_parameters", _params_sql(1))
def deployment_parameters(spark, sf_dir):
    return _params(spark, sf_dir, 1).where(~F.col("param").isin(*_ENV))


@query("c3_environment_parameters", f"WITH {b.CONFIG_SQL} SELECT * FROM params WHERE param IN ({_ENV_SQL})")
def environment_parameters(spark, sf_dir):
    rows = cf.flatten(b.config_docs(spark, sf_dir)).where(F.col("param").isin(*_ENV))
    return rows.select("service", "seq", "param", F.col("value_num").alias("num"), F.col("value_str").alias("str"))


@query("c4_settings_parameters", _params_sql(2))
def settings_parameters(spark, sf_dir):
    return _params(spark, sf_dir, 2)


@query("c5_unit_normalisation", """SELECT p_partkey,
  CASE p_partkey % 5 WHEN 0 THEN p_size WHEN 1 THEN p_size * 60 WHEN 2 THEN p_size * 3600 WHEN 3 THEN p_size ELSE 0
    END::DOUBLE AS seconds,
  CASE p_partkey % 3 WHEN 0 THEN p_size / 1000.0::DOUBLE WHEN 1 THEN p_size ELSE 0 END::DOUBLE AS cores,
  CASE p_partkey % 5 WHEN 0 THEN p_size / 1024.0::DOUBLE WHEN 1 THEN p_size WHEN 2 THEN p_size * 1024
    WHEN 3 THEN p_size ELSE 0 END::DOUBLE AS mib FROM part""")
def unit_normalisation(spark, sf_dir):
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")

    def with_unit(units, modulus):
        out = F.lit("unset")
        for i, u in enumerate(units):
            out = F.when(key % modulus == i, F.concat(size, F.lit(u))).otherwise(out)
        return out

    return b.table(spark, sf_dir, "part").select(
        "p_partkey", sc.duration_seconds(with_unit(["s", "m", "h", ""], 5)).alias("seconds"),
        sc.cpu_cores(with_unit(["m", ""], 3)).alias("cores"),
        sc.memory_mib(with_unit(["Ki", "Mi", "Gi", ""], 5)).alias("mib"))


@query("c6_parameter_matrix", f"""WITH {b.CONFIG_SQL} SELECT c.service, c.seq, k.param, p.num AS value
  FROM cfg c CROSS JOIN (SELECT DISTINCT param FROM params) k
  LEFT JOIN params p ON p.service = c.service AND p.seq = c.seq AND p.param = k.param""")
def parameter_matrix(spark, sf_dir):
    docs = _read_docs(spark, sf_dir)
    return cf.param_matrix(docs, ex.names_in(docs, "params")).select("service", "seq", "param", "value")


@query("c7_time_axis", f"""WITH {b.CONFIG_SQL}, first AS (SELECT service, min(applied_s) AS f FROM cfg
  WHERE service <> 'Brand#1' GROUP BY 1)
SELECT c.service, seq, CASE WHEN f IS NULL THEN -1 ELSE coalesce(applied_s, f) END AS x_s,
  CASE WHEN f IS NULL THEN seq ELSE -1 END AS x_seq FROM cfg c LEFT JOIN first ON first.service = c.service""")
def time_axis(spark, sf_dir):
    at = F.when(F.col("service") != "Brand#1", F.col("applied_at"))
    rows = cf.time_axis(b.config_docs(spark, sf_dir).select("service", "seq", at.alias("applied_at")))
    return rows.select("service", "seq", F.coalesce(F.unix_seconds("x_time"), F.lit(-1)).alias("x_s"),
                       F.coalesce("x_seq", F.lit(-1)).alias("x_seq"))


@query("c8_changing_parameters", f"""WITH {b.CONFIG_SQL} SELECT service, param, min(num) AS low, max(num) AS high
  FROM params GROUP BY 1, 2 HAVING count(DISTINCT num) > 1""")
def changing_parameters(spark, sf_dir):
    return cf.changing(cf.flatten(b.config_docs(spark, sf_dir)))


@query("c9_parameter_category", f"""WITH {b.CONFIG_SQL} SELECT param, CASE
  WHEN param IN ('cpu-limit', 'cpu-request', 'memory-limit', 'memory-request', 'replicas') THEN 'resource'
  WHEN param LIKE '%-scale' OR param LIKE '%-percentage' OR param LIKE '%window' OR param IN ('target', 'metric',
    'scale-down-delay') THEN 'autoscaling' ELSE 'env' END AS category, count(*) AS n FROM params GROUP BY 1, 2""")
def parameter_category(spark, sf_dir):
    return cf.flatten(b.config_docs(spark, sf_dir)).groupBy(
        "param", cf.category(F.col("param")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


_MATRIX = [
    "max-scale", "min-scale", "initial-scale", "activation-scale", "target", "metric", "window", "stable-window",
    "panic-threshold-percentage", "panic-window-percentage", "scale-down-delay", "replicas", "cpu-limit", "cpu-request",
    "memory-limit", "memory-request", "cache_size", "ratio", "mode", "rate", "grace", "zero", "note",
]


@query("c10_change_matrix", f"WITH {b.CONFIG_SQL} SELECT c.service, " + ", ".join(
    f"CAST(count(*) FILTER (param = '{p}') > 0 AS INT) AS \"{p}\"" for p in _MATRIX)
    + " FROM (SELECT DISTINCT service FROM cfg) c LEFT JOIN changed x ON x.service = c.service GROUP BY 1")
def change_matrix(spark, sf_dir):
    return cf.change_matrix(_read_docs(spark, sf_dir), _MATRIX)


@query("w10_version_changes", f"WITH {b.CONFIG_SQL} SELECT service, seq, param FROM changed")
def version_changes(spark, sf_dir):
    return cf.changes(_read_docs(spark, sf_dir)).select("service", "seq", "param")


STATS_SQL = b.CONFIG_SQL + """,
versions AS (SELECT service, count(*) AS versions FROM cfg GROUP BY 1 HAVING count(*) >= 2),
names AS (SELECT service, string_agg(DISTINCT param, ',' ORDER BY param) AS changed,
  count(DISTINCT param) AS k FROM changed GROUP BY 1),
stats AS (SELECT service, versions, versions - 1 AS updates, coalesce(changed, '') AS changed, coalesce(k, 0) AS k
  FROM versions LEFT JOIN names USING (service))"""


@query("a20_change_statistics", f"""WITH {STATS_SQL} SELECT service, versions, updates, changed FROM stats
  UNION ALL SELECT '(all)', CAST(sum(k) AS BIGINT), CAST(sum(updates) AS BIGINT), '' FROM stats""")
def change_statistics(spark, sf_dir):
    """The last row counts changed parameters and updates over all services."""
    stats = cf.change_stats(_read_docs(spark, sf_dir))
    total = cf.change_totals(stats).select(F.lit("(all)").alias("service"), F.col("changed_params").alias("versions"),
                                           "updates", F.lit("").alias("changed"))
    return stats.withColumn("changed", F.array_join("changed", ",")).unionByName(total)


@query("c11_services_of_files", "SELECT DISTINCT replace(p_brand, '#', '-') AS service FROM part")
def services_of_files(spark, sf_dir):
    """Every third part is a base file without a number."""
    name = F.translate("p_brand", "#", "-")
    numbered = F.concat(name, F.lit("_"), F.col("p_partkey").cast("string"))
    path = F.concat(F.lit("/run/config/"), F.when(F.col("p_partkey") % 3 == 0, name).otherwise(numbered),
                    F.lit(".yaml"))
    files = b.table(spark, sf_dir, "part").select(cf.service_of_file(path).alias("service"))
    return files.distinct().orderBy("service")


@query("c12_fixed_replicas", f"""WITH {b.CONFIG_SQL} SELECT service, seq, turn < 2 AND (turn = 0 OR size % 5 <> 1)
    AND service IN ('Brand#1', 'Brand#2', 'Brand#3') AS altered,
  CASE WHEN turn = 1 THEN CASE WHEN service IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 1 ELSE size % 5 END
    ELSE -1 END AS replicas,
  CASE WHEN turn = 0 AND service IN ('Brand#1', 'Brand#2', 'Brand#3') THEN '1-1' ELSE '' END AS scale FROM cfg""")
def fixed_replicas(spark, sf_dir):
    rows = cf.enforce_fixed(b.config_docs(spark, sf_dir), ["Brand#1", "Brand#2", "Brand#3"])
    note = "$.metadata.annotations['autoscaling.knative.dev/{}-scale']"
    low, high = (F.try_variant_get("doc", note.format(n), "string") for n in ("min", "max"))
    return rows.select(
        "service", "seq", "altered", F.coalesce(F.try_variant_get("doc", "$.spec.replicas", "int"), F.lit(-1))
        .alias("replicas"), F.coalesce(F.concat_ws("-", low, high), F.lit("")).alias("scale"))


# Brands propose values for the bounded keys in turn.
BOUND_KEYS = [row[1] for row in dims.PARAMETER_BOUNDS]
PROPOSED_SQL = f"""proposed AS (SELECT p_brand AS service, p_partkey AS seq,
  [{", ".join(repr(k) for k in BOUND_KEYS)}][p_partkey % 8 + 1] AS key, p_size AS size,
  p_partkey % 8 AS pos FROM part)"""


def _proposed(spark, sf_dir):
    keys = F.array(*[F.lit(k) for k in BOUND_KEYS])
    size, pos = F.col("p_size"), F.col("p_partkey") % 8
    value = F.when(pos.isin(2, 3), F.concat((size * 3).cast("string"), F.lit("m"))).when(
        pos == 0, (size - 10).cast("string")).otherwise((size * 20).cast("string"))
    return b.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("service"), F.col("p_partkey").alias("seq"),
        F.element_at(keys, (pos + 1).cast("int")).alias("key"), value.alias("value"))


_RULE_SQL = " ".join(
    "WHEN {} THEN '{}'".format(i, "\n".join(x for x in (
        f"  - {key}: allowed range [" + ", ".join(f"''{v}''" if v[-1].isalpha() else v for v in (low, high)) + "]"
        if low else (f"  - {key}: minimum {least}" if least else ""), f"    ({note})" if note else "") if x))
    for i, (_, key, low, high, least, note) in enumerate(dims.PARAMETER_BOUNDS) if low or least or note)


@query("c13_constraint_text", f"""WITH {PROPOSED_SQL},
lines AS (SELECT DISTINCT service, pos, CASE pos {_RULE_SQL} END AS line FROM proposed)
SELECT service, string_agg(line, chr(10) ORDER BY pos) AS constraints FROM lines WHERE line IS NOT NULL GROUP BY 1""")
def constraint_text(spark, sf_dir):
    """Rules for the keys that a service proposes."""
    keys = _proposed(spark, sf_dir).select("service", "key").distinct()
    return cf.constraint_text(keys.join(F.broadcast(dims.bounds_table(spark)), "key"), ["service"])


@query("c14_bounds_check", f"""WITH {PROPOSED_SQL} SELECT service, seq, key,
  CASE pos WHEN 0 THEN size - 10 >= 0 WHEN 1 THEN size * 20 >= 0 WHEN 2 THEN size * 180 BETWEEN 0 AND 3600
    WHEN 3 THEN size * 180 BETWEEN 6 AND 3600 WHEN 4 THEN size * 20 BETWEEN 1 AND 100
    WHEN 5 THEN size * 20 BETWEEN 110 AND 1000 ELSE true END AS within FROM proposed""")
def bounds_check(spark, sf_dir):
    rows = cf.check_bounds(_proposed(spark, sf_dir), dims.bounds_table(spark))
    return rows.select("service", "seq", "key", "within")


@query("c15_version_append", f"""WITH {b.CONFIG_SQL} SELECT service, count(*) AS versions, count(applied_s) +
  count(*) FILTER (seq % 7 = 0) AS timed, max(CASE WHEN seq % 7 = 0 THEN seq + 1000000000 ELSE seq END) AS last_seq
  FROM (SELECT service, seq, CASE WHEN seq % 7 <> 0 THEN applied_s END AS applied_s FROM cfg) GROUP BY 1""")
def version_append(spark, sf_dir):
    docs = b.config_docs(spark, sf_dir)
    known = docs.where(F.col("seq") % 7 != 0)
    accepted = docs.where(F.col("seq") % 7 == 0).withColumn("seq", F.col("seq") + 1_000_000_000)
    rows = cf.append_version(known, accepted)
    return rows.groupBy("service").agg(F.count(F.lit(1)).alias("versions"), F.count("applied_at").alias("timed"),
                                       F.max("seq").alias("last_seq"))


@query("j10_allow_list", f"""WITH {b.CONFIG_SQL},
base AS (SELECT DISTINCT service AS key, 'm-' || service AS metadata_name FROM cfg WHERE service < 'Brand#20'),
asked AS (SELECT seq, CASE WHEN seq % 2 = 0 THEN service ELSE 'm-' || service END AS name FROM cfg)
SELECT seq, name, coalesce(a.key, m.key, '-') AS base_key FROM asked LEFT JOIN base a ON a.key = name
LEFT JOIN base m ON m.metadata_name = name""")
def allow_list(spark, sf_dir):
    docs = b.config_docs(spark, sf_dir).select("service", "seq")
    base = docs.where(F.col("service") < "Brand#20").select(
        F.col("service").alias("key"), F.concat(F.lit("m-"), "service").alias("metadata_name")).distinct()
    asked = docs.select("seq", F.when(F.col("seq") % 2 == 0, F.col("service")).otherwise(
        F.concat(F.lit("m-"), "service")).alias("name"))
    taken, refused = cf.admissible(asked, base)
    return taken.unionByName(refused.withColumn("base_key", F.lit("-")))


@query("j11_config_meta", f"""WITH {b.CONFIG_SQL} SELECT service, seq,
  CASE WHEN seq % 4 IN (0, 1) THEN seq * 3600 ELSE -1 END AS applied_s FROM cfg""")
def config_meta(spark, sf_dir):
    """Of four versions one has bad metadata and one has none."""
    configs = b.config_docs(spark, sf_dir).select("service", "seq")
    good = F.concat(F.date_format(F.timestamp_seconds(F.col("seq") * 3600), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    meta = configs.where(F.col("seq") % 4 != 3).withColumn(
        "applied_at", F.when(F.col("seq") % 4 == 2, F.lit("soon")).otherwise(good))
    rows = cf.with_applied_at(configs, meta)
    return rows.select("service", "seq", F.coalesce(F.unix_seconds("applied_at"), F.lit(-1)).alias("applied_s"))
