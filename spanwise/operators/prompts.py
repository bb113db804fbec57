"""Prompt and response tables for a language model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise import dims
from spanwise.functions.buckets import chunk
from spanwise.functions.scalars import lookup
from spanwise.functions.yaml_text import first_readable, json_to_yaml, yaml_to_json
from spanwise.functions.yaml_writer import yaml_of
from spanwise.operators.ordered import numbered, running_sums

# Sentences and templates.
NO_PLACEMENT = "No node placement data available."
NO_HEALTH = "No pod health data (restarts/OOM) in this window."
NO_RESTARTS = "No restarts or OOM in this window."
HEALTH_TITLE = "Services with restarts or OOM (fix these first; they are likely root cause):"
DEFAULT_PROMPT = "Please provide a configuration recommendation."
CONTEXT_CHARS = 32768 - 4096
GOAL = ("Analyse the monitoring data and provide a revised configuration that aims to resolve the anomaly, respecting "
        "the constraints and using horizontal and vertical scaling and service/node affinity/anti-affinity using the "
        "provided keys and values")
ANOMALY_PROMPT = """
anomaly_report:
  service: {service}
  revision: {service}
  
  anomaly_type: latency spike
  duration: {duration}

CONSTRAINTS (you MUST respect these):
{constraints}

NODE PLACEMENT (which services run on which nodes; use for affinity/co-location decisions):
{placement}

ROOT CAUSE (services with restarts or OOM killed — fix these first; e.g. if srv-rate is OOM, increase srv-rate memory, not memcached-rate):
{root_cause}
{root_cause_configs}

metric_snapshot:
```yaml
{snapshot}
```

service configuration
```yaml
{config}
```
"""
RESULT_PROMPT = """The configuration produced the following performance indicators:

```yaml
{result}
```
"""
REPAIR_PROMPT = """
The previous configuration you suggested for service '{service}' failed to apply to the Kubernetes/Knative cluster.

Here is the YAML that failed:
```yaml
{failed}
```

Here is the exact error returned by the API:
{error}

Please output a corrected configuration YAML that fixes this error while still respecting all policies and constraints.
Respond with YAML only.
"""
BLOCK_PATTERNS = (
    r"(?i)```yaml\n([\s\S]*?)\n```",
    r"(?i)```\n([\s\S]*?)\n```",
    r"(?i)<yaml>\n([\s\S]*?)\n</yaml>",
    r"(?i)```([\s\S]*?)```",
)


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def fill(template: str, values: Mapping[str, Column]) -> Column:
    """A template with its ``{name}`` places filled."""
    parts, rest = [], template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(before), F.coalesce(values[name].cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def placement_text(nodes: Column) -> Column:
    """One line per node with its services and pod counts; both in name order."""

    def line(e: Column) -> Column:
        pods = F.array_sort(F.map_entries(e["value"]["services"]))
        shown = F.transform(pods, lambda s: F.concat(s["key"], F.lit("="), F.format_string(
            "%.1f", F.bround(s["value"], 1))))
        listed = F.when(F.size(F.coalesce(shown, F.array())) > 0, F.array_join(shown, ", ")).otherwise("(no services)")
        return F.concat(F.lit("  "), e["key"], F.lit(": "), listed)

    keys = F.array_sort(F.map_keys(nodes))
    lines = F.transform(keys, lambda k: line(F.struct(k.alias("key"), nodes[k].alias("value"))))
    return F.when(F.size(F.coalesce(keys, F.array())) > 0, F.array_join(lines, "\n")).otherwise(NO_PLACEMENT)


def _sick(info: Column) -> Column:
    return (F.coalesce(info["restarts"], F.lit(0)) > 0) | F.coalesce(info["oom_killed"], F.lit(False))


def root_cause_text(health: Column) -> Column:
    """Services that restarted or ran out of memory, in name order, or a sentence that there are none."""

    def line(e: Column) -> Column:
        parts = F.concat_ws(
            ", ", F.when(e["value"]["restarts"] > 0, F.concat(F.lit("restarts="), e["value"]["restarts"].cast("string"))),
            F.when(e["value"]["oom_killed"], F.lit("OOM_KILLED=True")))
        return F.concat(F.lit("  "), e["key"], F.lit(": "), parts)

    sick = F.array_sort(F.filter(F.map_entries(health), lambda e: _sick(e["value"])))
    empty = F.size(F.coalesce(F.map_keys(health), F.array().cast("array<string>"))) == 0
    return F.when(empty, NO_HEALTH).when(F.size(sick) == 0, NO_RESTARTS).otherwise(
        F.concat(F.lit(HEALTH_TITLE + "\n"), F.array_join(F.transform(sick, line), "\n")))


def snapshot_text(columns: Sequence[str]) -> Column:
    """Snapshot as JSON text in column order; numbers without a value show as nan, inf or -inf."""
    text = F.to_json(F.struct(*columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ssxxx", "ignoreNullFields": "false"})
    for name, shown in (("NaN", "nan"), ("Infinity", "inf"), ("-Infinity", "-inf")):
        text = F.replace(text, F.lit(f':"{name}"'), F.lit(f':"{shown}"'))
    return text


def snapshot_yaml(rows: DataFrame, columns: Sequence[str]) -> Column:
    """Snapshot as YAML text in column order, with all nested maps; see ``yaml_writer`` for the layout."""
    return yaml_of(F.struct(*columns), rows.select(*columns).schema)


def root_cause_configs(health: DataFrame, latest: DataFrame, by: Sequence[str],
                       aliases: Mapping[str, str] = dims.CONFIG_KEY_ALIAS) -> DataFrame:
    """Per window the current configurations of its sick services, found by name or alias.

    ``health`` has rows (by, service, restarts, oom_killed), ``latest`` rows (service, doc).
    """
    key = F.coalesce(lookup(F.col("service"), aliases), F.col("service"))
    sick = health.where((F.col("restarts") > 0) | F.col("oom_killed")).select(*by, "service", key.alias("_key"))
    rows = sick.join(latest.select(F.col("service").alias("_key"), "doc"), "_key")
    title = F.concat(F.lit("# Current configuration for "), F.col("service"),
                     F.lit(" (root cause; suggest changes to fix restarts/OOM):\n"))
    rows = rows.withColumn("_yaml", json_to_yaml(F.to_json("doc"))).select(
        *by, "service", F.concat(title, F.col("_yaml")).alias("_text"))
    texts = F.array_sort(F.collect_list(F.struct("service", "_text")))
    return rows.groupBy(*by).agg(
        strip(F.array_join(F.transform(texts, lambda t: t["_text"]), "\n")).alias("root_cause_configs"))


def anomaly_prompts(anomalies: DataFrame, latest: DataFrame) -> DataFrame:
    """One prompt per anomaly (service, duration_seconds and the text columns); without a base configuration it is
    dropped."""
    docs = latest.select("service", json_to_yaml(F.to_json("doc")).alias("_config"))
    configs = F.when(F.coalesce("root_cause_configs", F.lit("")) != "", F.concat(
        F.lit("\n\nCurrent configurations for root-cause services above (use these to suggest fixes):\n```yaml\n"),
        F.col("root_cause_configs"), F.lit("\n```"))).otherwise("")
    values = {
        "service": F.col("service"), "duration": F.col("duration_seconds"), "constraints": F.col("constraints"),
        "placement": F.col("placement"), "root_cause": F.col("root_cause"), "root_cause_configs": configs,
        "snapshot": F.col("snapshot"), "config": F.col("_config"),
    }
    return anomalies.join(docs, "service").withColumn("prompt", fill(ANOMALY_PROMPT, values)).drop("_config")


def result_message(result: Column) -> Column:
    return fill(RESULT_PROMPT, {"result": result})


def repair_message(service: Column, failed: Column, error: Column) -> Column:
    return fill(REPAIR_PROMPT, {"service": service, "failed": failed, "error": error})


def block_candidates(response: Column) -> Column:
    """What each wrapper pattern finds, its matches joined as documents; the whole text comes last."""

    def found(pattern: str) -> Column:
        blocks = F.regexp_extract_all(response, F.lit(pattern), F.lit(1))
        joined = F.array_join(F.transform(blocks, lambda m: F.concat(strip(m), F.lit("\n"))), "---\n")
        return F.when(strip(joined) != "", joined)

    return F.array_compact(F.array(*[found(p) for p in BLOCK_PATTERNS], response))


def extract_blocks(responses: DataFrame, column: str = "response", name: str = "yaml") -> DataFrame:
    """The first candidate that reads as YAML, null where none does."""
    return responses.withColumn(name, first_readable(block_candidates(F.col(column))))


def split_documents(blocks: DataFrame, column: str = "yaml", asked: str = "service") -> DataFrame:
    """One row per document that is a mapping, with its manifest name, else the service that was asked about."""
    parts = F.split(F.col(column), r"(?m)^---[ \t]*$")
    rows = blocks.select("*", F.posexplode(parts).alias("doc_no", "_part"))
    rows = rows.withColumn("_json", yaml_to_json(F.col("_part"))).where(F.col("_json").startswith("{"))
    name = F.nullif(F.get_json_object("_json", "$.metadata.name"), F.lit(""))
    return rows.withColumns({"name": F.coalesce(name, F.col(asked)), "doc": F.parse_json("_json")}).drop(
        "_part", "_json")


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_log(knowledge: Column, history: Column, prompt: Column, goal: str = GOAL) -> Column:
    """Messages sent to the model: knowledge, history, goal, prompt; a blank prompt becomes the default sentence."""
    asked = strip(F.coalesce(prompt, F.lit("")))
    asked = F.when(asked == "", F.lit(DEFAULT_PROMPT)).otherwise(asked)
    return F.concat(F.array(message("user", knowledge)), history, F.array(message("user", F.lit(goal))),
                    F.array(message("user", asked)))


def conversation_text(messages: Column) -> Column:
    """``ROLE: text`` parts between blank lines."""
    return strip(F.array_join(F.transform(messages, lambda m: F.concat(F.upper(m["role"]), F.lit(": "), m["content"])),
                              "\n\n"))


def normalised_exchanges(exchanges: DataFrame) -> DataFrame:
    """Messages without a role become the user's, missing texts empty; blank responses are dropped."""
    clean = F.transform(F.coalesce(F.col("messages"), F.array().cast("array<struct<role:string,content:string>>")),
                        lambda m: F.struct(F.coalesce(m["role"], F.lit("user")).alias("role"),
                                           F.coalesce(m["content"], F.lit("")).alias("content")))
    return exchanges.where(strip(F.coalesce("response", F.lit(""))) != "").withColumn("messages", clean)


def kept_history(messages: DataFrame, key: str, order: str, most: int = 5, bounded: bool = False) -> DataFrame:
    """Messages of a history that stay in use, with their ``position``.

    The rule adds two messages and drops one while more than ``most`` are held, so it grows by one per pair; ``bounded``
    keeps the last ``most`` instead.
    """
    piece = chunk(F.col(order), 1000)
    placed = numbered(messages, [key], [piece], [F.col(order)], "position")
    total = messages.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    rows = placed.join(total, key)
    dropped = F.col("_n") - most if bounded else F.floor(F.col("_n") / 2) - (most // 2)
    return rows.where(F.col("position") > F.greatest(dropped, F.lit(0))).drop("_n")


def cut_context(messages: DataFrame, key: str, order: str, max_chars: int = CONTEXT_CHARS) -> DataFrame:
    """Newest messages whose running length fits: each counts ``ROLE: text`` and its blank line, joins one more."""
    size = F.length("role") + 2 + F.length("content") + 2
    counted = messages.withColumn("_size", (size + 1).cast("long"))
    back = -F.col(order)
    summed = running_sums(counted, [key], chunk(back, 1000), [back], {"_held": "_size"})
    return summed.where(F.col("_held") - 1 <= max_chars).drop("_size", "_held")


def context_text(kept: DataFrame, key: str, order: str) -> DataFrame:
    """Text of the kept messages in their order; bounded by the cut."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(
        F.upper("role"), F.lit(": "), F.col("content")).alias("t"))))
    return kept.groupBy(key).agg(strip(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n ")).alias("text"))
