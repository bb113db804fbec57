"""Configuration documents to parameters, changes, policy and bounds checks.

A document is a row (service, seq, applied_at, doc) with ``doc`` a VARIANT.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions import scalars as sc
from spanwise.functions.buckets import chunk
from spanwise.operators.experiment import at_every_name
from spanwise.operators.ordered import neighbours

PREFIX = "autoscaling.knative.dev/"
# Autoscaling annotations by how they are read.
WHOLE_NUMBERS = ("max-scale", "min-scale", "initial-scale", "activation-scale")
FRACTIONS = ("target", "panic-threshold-percentage", "panic-window-percentage")
DURATIONS = ("window", "stable-window", "scale-down-delay")
AUTOSCALING = (*WHOLE_NUMBERS, *FRACTIONS, *DURATIONS, "metric")
RESOURCES = ("cpu-limit", "cpu-request", "memory-limit", "memory-request", "replicas")
VERSIONS_PER_PIECE = 1000


def _get(path: str, kind: str) -> Column:
    return F.try_variant_get("doc", path, kind)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _raw(key: Column | str, how: Column | str, text: Column) -> Column:
    """An entry still to be read: parameter, how to read it, text."""
    lits = [F.lit(x) if isinstance(x, str) else x for x in (key, how)]
    return F.struct(lits[0].alias("key"), lits[1].alias("how"), text.alias("text"))


def _annotations() -> Column:
    """The autoscaling annotations with their defaults."""
    ways = {"whole": WHOLE_NUMBERS, "fraction": FRACTIONS, "duration": DURATIONS, "text": ("metric",)}
    default = {"duration": "0s", "text": ""}

    def read(notes: Column) -> Column:
        return F.array(*[
            _raw(n, how, F.coalesce(F.try_element_at(notes, F.lit(PREFIX + n)), F.lit(default.get(how, "0"))))
            for how, names in ways.items() for n in names])

    return _let(_get("$.spec.template.metadata.annotations", "map<string,string>"), read)


CONTAINER = ("struct<resources:struct<limits:map<string,string>,requests:map<string,string>>,"
             "env:array<struct<name:string,value:string>>>")


def _container() -> Column:
    """Resources and environment of the first container; nothing without one."""
    empty = F.array().cast("array<struct<key:string,how:string,text:string>>")

    def read(c: Column) -> Column:
        sides = []
        for what in ("cpu", "memory"):
            for side in ("limit", "request"):
                text = F.try_element_at(c["resources"][f"{side}s"], F.lit(what))
                sides.append(_raw(f"{what}-{side}", what, F.coalesce(text, F.lit("0"))))
        usable = F.filter(c["env"], lambda e: e["name"].isNotNull() & e["value"].isNotNull())
        env = F.transform(usable, lambda e: _raw(F.lower(e["name"]), "typed", e["value"]))
        return F.when(c.isNotNull(), F.concat(F.array(*sides), F.coalesce(env, empty))).otherwise(empty)

    return _let(_get("$.spec.template.spec.containers[0]", CONTAINER), read)


def typed_text(text: Column) -> Column:
    """Number of a text with type inference: a point makes it a fraction, else it has to be whole."""
    return F.when(text.contains("."), text.try_cast("double")).otherwise(text.try_cast("bigint").cast("double"))


def settings_value(text: Column) -> Column:
    """Value of a settings entry: number, duration in seconds, boolean as 1 or 0; in that order, else null."""
    seconds = F.when(text.endswith("s"), F.left(text, F.length(text) - 1).try_cast("double"))
    flag = F.when(F.lower(text) == "true", 1.0).when(F.lower(text) == "false", 0.0)
    return F.coalesce(typed_text(text), seconds, flag)


def _settings() -> Column:
    data = F.map_entries(_get("$.data", "map<string,string>"))
    return F.transform(data, lambda e: _raw(e["key"], "setting", e["value"]))


def _number(how: Column, text: Column) -> Column:
    ways = {
        "whole": text.try_cast("bigint").cast("double"), "fraction": text.try_cast("double"),
        "duration": sc.duration_seconds(text), "cpu": sc.cpu_cores(text), "memory": sc.memory_mib(text),
        "typed": typed_text(text), "setting": settings_value(text),
    }
    out = F.lit(None).cast("double")
    for name, value in ways.items():
        out = F.when(how == name, value).otherwise(out)
    return out


def with_params(docs: DataFrame) -> DataFrame:
    """Add ``kind`` and ``params``, a map from parameter to (num, str). Of equal names the last one stays.

    Documents that have ``params`` already are left as they are, so a stored result is not read again.
    """
    if "params" in docs.columns:
        return docs
    kind = _get("$.kind", "string")
    replicas = F.array(_raw("replicas", "whole", F.coalesce(_get("$.spec.replicas", "string"), F.lit("0"))))
    entries = (
        F.when(kind == "Service", F.concat(_annotations(), _container()))
        .when(kind == "Deployment", F.concat(replicas, _container()))
        .when(kind == "ConfigMap", _settings())
    )
    none = F.create_map().cast("map<string,struct<num:double,str:string>>")

    def read(e: Column) -> Column:
        text = F.when(e["how"].isin("text", "typed", "setting"), e["text"])
        value = _let(_number(e["how"], e["text"]),
                     lambda n: F.struct(n.alias("num"), F.when(n.isNull(), text).alias("str")))
        return F.struct(e["key"].alias("key"), value.alias("value"))

    def put(found: Column, e: Column) -> Column:
        return F.map_concat(F.map_filter(found, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"]))

    def collect(es: Column) -> Column:
        keys = F.transform(es, lambda e: e["key"])
        pairs = F.transform(es, read)
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_entries(pairs)).otherwise(
            F.aggregate(pairs, none, put))

    return docs.withColumn("kind", kind).withColumn("params", _let(entries, collect))


def flatten(docs: DataFrame) -> DataFrame:
    """One row per document and parameter."""
    rows = with_params(docs).select("service", "seq", "applied_at", F.explode_outer("params").alias("param", "_v"))
    return rows.where(F.col("param").isNotNull()).select("service", "seq", "applied_at", "param", F.col("_v.num").alias("value_num"),
                       F.col("_v.str").alias("value_str"))


def param_matrix(docs: DataFrame, params: DataFrame) -> DataFrame:
    """Every parameter (``name``) at every version; missing and textual values are null."""
    rows = at_every_name(with_params(docs), params, "param")
    value = F.try_element_at("params", F.col("param"))["num"]
    return rows.select("service", "seq", "applied_at", "param", value.alias("value"))


def time_axis(versions: DataFrame, first_snapshot: Column | None = None) -> DataFrame:
    """Add ``x_time``: own application time, else the first snapshot, else the service's earliest application.

    ``x_seq`` is set instead for a service without any application time.
    """
    earliest = versions.groupBy("service").agg(F.min("applied_at").alias("_first"))
    fallback = F.col("_first") if first_snapshot is None else F.coalesce(first_snapshot, F.col("_first"))
    known = F.col("_first").isNotNull()
    return versions.join(earliest, "service").withColumns({
        "x_time": F.when(known, F.coalesce("applied_at", fallback)),
        "x_seq": F.when(~known, F.col("seq")),
    }).drop("_first")


def changing(params: DataFrame, value: str = "value_num") -> DataFrame:
    """Parameters of a service with more than one non-null value."""
    ends = params.groupBy("service", "param").agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return ends.where(F.col("low") < F.col("high"))


def category(param: Column) -> Column:
    return F.when(param.isin(*AUTOSCALING), "autoscaling").when(param.isin(*RESOURCES), "resource").otherwise("env")


def changes(docs: DataFrame, piece: float = VERSIONS_PER_PIECE) -> DataFrame:
    """One row per version and parameter that differs from the version before; both versions must have it."""
    rows = with_params(docs).select("service", "seq", "applied_at", "params")
    near = neighbours(rows, ["service"], chunk(F.col("seq"), piece), ["seq"], back={"before": "params"})
    differs = F.map_filter("params", lambda k, v: F.map_contains_key("before", k) & ~F.try_element_at(
        F.col("before"), k).eqNullSafe(v))
    return near.select("service", "seq", "applied_at", F.explode(F.map_keys(differs)).alias("param"))


def change_stats(docs: DataFrame) -> DataFrame:
    """Per service: versions, updates (versions less one) and the sorted names of the parameters that changed."""
    versions = docs.groupBy("service").agg(F.count(F.lit(1)).alias("versions")).where(F.col("versions") >= 2)
    names = changes(docs).groupBy("service").agg(F.array_sort(F.collect_set("param")).alias("changed"))
    rows = versions.join(names, "service", "left")
    empty = F.array().cast("array<string>")
    return rows.select("service", "versions", (F.col("versions") - 1).alias("updates"),
                       F.coalesce("changed", empty).alias("changed"))


def change_totals(stats: DataFrame) -> DataFrame:
    return stats.agg(F.sum("updates").alias("updates"), F.sum(F.size("changed")).alias("changed_params"))


def change_matrix(docs: DataFrame, params: Sequence[str]) -> DataFrame:
    """Service by parameter: 1 where the parameter ever changed."""
    services = docs.select("service").distinct()
    hit = changes(docs).groupBy("service").pivot("param", list(params)).agg(F.lit(1))
    return services.join(hit, "service", "left").na.fill(0)


def service_of_file(path: Column) -> Column:
    """Service name of a configuration file: base name without version number and extension."""
    name = sc.base_name(path)
    return F.regexp_replace(F.regexp_replace(name, r"_\d+\.yaml$", ""), r"\.yaml", "")


def _replace(fields: Column, changed: Mapping[str, Column]) -> Column:
    """A map of variants with some entries set."""
    rest = F.map_filter(fields, lambda k, _: ~k.isin(*changed))
    pairs = [x for k, v in changed.items() for x in (F.lit(k), v.cast("variant"))]
    return F.map_concat(rest, F.create_map(*pairs))


def enforce_fixed(docs: DataFrame, fixed: Sequence[str]) -> DataFrame:
    """Hold services of the fixed list at one replica and flag the documents that were altered.

    Deployments get ``replicas`` 1; Services get "1" for both scale bounds in their top-level annotations.
    """
    no_fields = F.create_map().cast("map<string,variant>")
    listed = F.col("service").isin(*fixed)
    kind = _get("$.kind", "string")
    whole = _get("$", "map<string,variant>")
    spec = F.coalesce(_get("$.spec", "map<string,variant>"), no_fields)
    meta = F.coalesce(_get("$.metadata", "map<string,variant>"), no_fields)
    notes = F.coalesce(_get("$.metadata.annotations", "map<string,variant>"), no_fields)
    low, high = (_get(f"$.metadata.annotations['{PREFIX}{n}']", "string") for n in ("min-scale", "max-scale"))
    scaled = listed & (kind == "Deployment") & ~F.coalesce(_get("$.spec.replicas", "string") == "1", F.lit(False))
    ranged = listed & (kind == "Service") & ~F.coalesce((low == "1") & (high == "1"), F.lit(False))
    one = F.lit("1")
    deployment = _replace(whole, {"spec": F.to_variant_object(_replace(spec, {"replicas": F.lit(1)}))})
    bounds = F.to_variant_object(_replace(notes, {PREFIX + "min-scale": one, PREFIX + "max-scale": one}))
    service = _replace(whole, {"metadata": F.to_variant_object(_replace(meta, {"annotations": bounds}))})
    return docs.withColumns({
        "altered": F.coalesce(scaled | ranged, F.lit(False)),
        "doc": F.when(scaled, F.to_variant_object(deployment)).when(ranged, F.to_variant_object(service)).otherwise(
            F.col("doc")),
    })


def _shown(value: Column) -> Column:
    return F.when(value.rlike("[a-z]$"), F.concat(F.lit("'"), value, F.lit("'"))).otherwise(value)


def rule_line(key: Column, low: Column, high: Column, minimum: Column, note: Column) -> Column:
    """Text of one bound: its range, else its minimum, then its note on a line of its own; null where all are absent."""
    span = F.concat(F.lit("  - "), key, F.lit(": allowed range ["), _shown(low), F.lit(", "), _shown(high), F.lit("]"))
    least = F.concat(F.lit("  - "), key, F.lit(": minimum "), minimum)
    remark = F.concat(F.lit("    ("), note, F.lit(")"))
    return F.nullif(F.concat_ws("\n", F.coalesce(span, least), remark), F.lit(""))


def constraint_text(rules: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Lines of all rules in order, joined."""
    line = rule_line(*[F.col(c) for c in ("key", "low", "high", "minimum", "note")])
    rows = rules.withColumn("_line", line).where(F.col("_line").isNotNull())
    ordered = F.array_sort(F.collect_list(F.struct("pos", "_line")))
    return rows.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda r: r["_line"]), "\n").alias("constraints"))


def check_bounds(proposed: DataFrame, rules: DataFrame) -> DataFrame:
    """Proposed (…, key, value) rows with a rule for their key and whether they keep within it."""
    value, low, high, least = (sc.duration_seconds(F.col(c)) for c in ("value", "low", "high", "minimum"))
    above = F.col("low").isNull() | (value >= low)
    below = F.col("high").isNull() | (value <= high)
    enough = F.col("minimum").isNull() | (value >= least)
    return proposed.join(rules.select("key", "low", "high", "minimum"), "key").withColumn(
        "within", above & below & enough)


def admissible(proposed: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split proposals into those that name a base configuration, by key or by manifest name, and the rest.

    Accepted rows carry the base key they resolve to.
    """
    keys = base.select(F.col("key").alias("_own")).distinct()
    aliases = base.where(F.col("metadata_name").isNotNull()).groupBy("metadata_name").agg(
        F.max("key").alias("_aliased"))
    rows = (
        proposed.join(keys, F.col("name") == F.col("_own"), "left")
        .join(aliases, F.col("name") == F.col("metadata_name"), "left")
        .withColumn("base_key", F.coalesce("_own", "_aliased"))
        .drop("_own", "_aliased", "metadata_name")
    )
    return rows.where(F.col("base_key").isNotNull()), rows.where(F.col("base_key").isNull()).drop("base_key")


def with_applied_at(configs: DataFrame, meta: DataFrame) -> DataFrame:
    """Application times from metadata rows (service, seq, applied_at text); bad or missing ones are null."""
    times = meta.select("service", "seq", sc.iso_timestamp(F.col("applied_at")).alias("applied_at"))
    return configs.join(times, ["service", "seq"], "left")


def append_version(history: DataFrame, accepted: DataFrame, at: Column | None = None) -> DataFrame:
    """History with accepted documents added; they were applied now unless told otherwise, base rows have no time."""
    stamp = F.current_timestamp() if at is None else at
    return history.unionByName(accepted.withColumn("applied_at", stamp).select(*history.columns))


def latest_config(history: DataFrame) -> DataFrame:
    """The newest document per service."""
    return history.groupBy("service").agg(F.max_by("doc", "seq").alias("doc"), F.max("seq").alias("seq"))
