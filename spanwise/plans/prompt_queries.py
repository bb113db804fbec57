"""Prompt and response tables over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwise import dims
from spanwise.operators import configs as cf
from spanwise.operators import prompts as pr
from spanwise.plans import bindings as b
from spanwise.plans.registry import query
from spanwise.plans.source_queries import exchanges


@query("x1_placement_text", f"""WITH {b.SNAPSHOTS_SQL},
lines AS (SELECT snapshot_no, node, '  ' || node || ': ' || string_agg(service || '=' || printf('%.1f', pods), ', '
  ORDER BY service) AS line FROM pods GROUP BY 1, 2)
SELECT snapshot_no, string_agg(line, chr(10) ORDER BY node) AS placement FROM lines GROUP BY 1""")
def placement_text(spark, sf_dir):
    maps = b.snapshot_services(spark, sf_dir)
    return maps.select("snapshot_no", pr.placement_text(F.col("nodes")).alias("placement"))


HEALTH_SQL = b.SNAPSHOTS_SQL + """,
health AS (SELECT snapshot_no, service, count(*) FILTER (value > 15000) AS restarts, max(value) > 25000 AS oom_killed
  FROM hourly GROUP BY 1, 2)"""


def _health(spark, sf_dir):
    return b.hours(spark, sf_dir).groupBy("snapshot_no", "service").agg(
        F.count(F.when(F.col("value") > 15000, 1)).alias("restarts"), (F.max("value") > 25000).alias("oom_killed"))


def _health_maps(spark, sf_dir):
    info = F.struct("service", F.struct("restarts", "oom_killed"))
    return _health(spark, sf_dir).groupBy("snapshot_no").agg(F.map_from_entries(F.collect_list(info)).alias("pod_health"))


@query("x2_root_cause_text", f"""WITH {HEALTH_SQL},
lines AS (SELECT snapshot_no, string_agg('  ' || service || ': restarts=' || restarts
  || CASE WHEN oom_killed THEN ', OOM_KILLED=True' ELSE '' END, chr(10) ORDER BY service) FILTER (restarts > 0) AS t
  FROM health GROUP BY 1)
SELECT snapshot_no, coalesce('{pr.HEALTH_TITLE}' || chr(10) || t, '{pr.NO_RESTARTS}') AS root_cause FROM lines""")
def root_cause_text(spark, sf_dir):
    return _health_maps(spark, sf_dir).select("snapshot_no", pr.root_cause_text(F.col("pod_health")).alias("root_cause"))


# Event types stand for services; each has its configuration among the parts, found by alias.
ALIASES = {"click": "Brand#1", "error": "Brand#2", "purchase": "Brand#3", "signup": "Brand#4", "view": "Brand#5"}


@query("x3_root_cause_configs", f"""WITH {HEALTH_SQL},
latest AS (SELECT p_brand, arg_max(CASE p_partkey % 3 WHEN 0 THEN 'kind: Service' WHEN 1 THEN 'kind: Deployment'
  || chr(10) || 'replicas: ' || p_size % 5 ELSE 'kind: ConfigMap' END, p_partkey) AS config FROM part GROUP BY 1)
SELECT snapshot_no, string_agg('# Current configuration for ' || service
    || ' (root cause; suggest changes to fix restarts/OOM):' || chr(10) || config, chr(10) || chr(10)
    ORDER BY service) AS root_cause_configs
FROM health JOIN latest ON p_brand = 'Brand#' || CASE service WHEN 'click' THEN 1 WHEN 'error' THEN 2
  WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END WHERE restarts > 0 OR oom_killed GROUP BY 1""")
def root_cause_configs(spark, sf_dir):
    field = lambda path, kind, name: F.try_variant_get("doc", path, kind).alias(name)
    small = cf.latest_config(b.config_docs(spark, sf_dir)).select("service", F.parse_json(F.to_json(F.struct(
        field("$.kind", "string", "kind"), field("$.spec.replicas", "int", "replicas")))).alias("doc"))
    return pr.root_cause_configs(_health(spark, sf_dir), small, ["snapshot_no"], ALIASES)


@query("x4_prompt_assembly")
def prompt_assembly(spark, sf_dir):
    """One prompt per sick service and hour, with all rules and the placement, health, configuration and snapshot texts."""
    docs = cf.latest_config(b.config_docs(spark, sf_dir))
    health = _health(spark, sf_dir)
    texts = (
        b.snapshot_services(spark, sf_dir).select("snapshot_no", pr.placement_text(F.col("nodes")).alias("placement"))
        .join(_health_maps(spark, sf_dir).select("snapshot_no", pr.root_cause_text(F.col("pod_health")).alias(
            "root_cause")), "snapshot_no")
        .join(pr.root_cause_configs(health, docs, ["snapshot_no"], ALIASES), "snapshot_no")
        .join(_snapshot_yaml(spark, sf_dir), "snapshot_no")
    )
    rules = cf.constraint_text(dims.bounds_table(spark).withColumn("scope", F.lit("all")), ["scope"])
    alias = F.lit("none")
    for service, key in ALIASES.items():
        alias = F.when(F.col("service") == service, F.lit(key)).otherwise(alias)
    anomalies = health.where(F.col("oom_killed")).select(
        "snapshot_no", alias.alias("service"), F.col("restarts").cast("double").alias("duration_seconds"),
        F.lit("all").alias("scope")).join(F.broadcast(rules), "scope").join(texts, "snapshot_no")
    return pr.anomaly_prompts(anomalies, docs).select("snapshot_no", "service", "prompt")


@query("x5_snapshot_text", f"""WITH {b.SNAPSHOTS_SQL} SELECT snapshot_no, '{{"total_requests":' || total_requests
  || ',"phase":"' || phase || '","rate":' || CASE snapshot_no % 3 WHEN 0 THEN '"nan"' WHEN 1 THEN '"inf"'
  ELSE snapshot_no || '.5' END || ',"subphase":"' || subphase || '"}}' AS snapshot FROM snap""")
def snapshot_text(spark, sf_dir):
    n = F.col("snapshot_no")
    rate = F.when(n % 3 == 0, F.lit(float("nan"))).when(n % 3 == 1, F.lit(float("inf"))).otherwise(n + 0.5)
    rows = b.snapshots(spark, sf_dir).withColumn("rate", rate)
    return rows.select("snapshot_no", pr.snapshot_text(["total_requests", "phase", "rate", "subphase"]).alias("snapshot"))


def _yaml_number(x: str) -> str:
    return f"CAST(CAST({x} AS DOUBLE) AS VARCHAR)"


def _yaml_lines(pad: str, fields: dict[str, str]) -> str:
    return " || ".join(f"'{pad}{name}: ' || {value} || chr(10)" for name, value in fields.items())


_QUOTED_END = "chr(39) || strftime(make_timestamp(ts_s * 1000000), '%Y-%m-%dT%H:%M:%SZ') || chr(39)"
_SNAPSHOT_FIELDS = {
    "total_requests": "total_requests", **{c: _yaml_number(c) for c in (
        "mean_response_time", "p90_response_time", "deadline_miss_rate", "anomaly_rate", "sum_cpu_utilization_cores",
        "sum_memory_utilization_mb")},
    "phase": "phase", "subphase": "subphase",
    "collection_end_time": f"CASE WHEN snapshot_no % 4 <> 0 THEN {_QUOTED_END} ELSE 'null' END", "timestamp": _QUOTED_END}
_NODE_FIELDS = {"cpu_usage_cores": _yaml_number("v / 1000.0"), "cpu_limit_cores": "'64.0'", "memory_usage_mb": _yaml_number("v / 10.0"),
                "memory_limit_mb": "'4096.0'"}

SNAPSHOT_YAML_SQL = b.SNAPSHOTS_SQL + f""",
service_text AS (SELECT snapshot_no, string_agg('  ' || service || ':' || chr(10)
    || {_yaml_lines("    ", {"cpu_utilization_cores": _yaml_number("cpu"), "memory_utilization_mb": _yaml_number("mem")})},
    '' ORDER BY service) AS services FROM usage GROUP BY 1),
pod_text AS (SELECT snapshot_no, node, string_agg('      ' || service || ': ' || {_yaml_number("pods")} || chr(10), '' ORDER BY service)
  AS pods FROM pods GROUP BY 1, 2),
node_text AS (SELECT snapshot_no, string_agg('  ' || node || ':' || chr(10) || {_yaml_lines("    ", _NODE_FIELDS)} || '    services:'
    || chr(10) || pods, '' ORDER BY node) AS nodes FROM node_use JOIN pod_text USING (snapshot_no, node) GROUP BY 1),
snapshot_yaml AS (SELECT snapshot_no, {_yaml_lines("", _SNAPSHOT_FIELDS)} || 'services:' || chr(10) || services || 'nodes:' || chr(10)
  || nodes AS snapshot FROM snap JOIN service_text USING (snapshot_no) JOIN node_text USING (snapshot_no))"""


def _snapshot_yaml(spark, sf_dir):
    rows = b.snapshots(spark, sf_dir).join(b.snapshot_services(spark, sf_dir), "snapshot_no")
    return rows.select("snapshot_no", pr.snapshot_yaml(rows, [*_SNAPSHOT_FIELDS, "services", "nodes"]).alias("snapshot"))


@query("x5_snapshot_yaml", f"WITH {SNAPSHOT_YAML_SQL} SELECT snapshot_no, snapshot FROM snapshot_yaml")
def snapshot_yaml(spark, sf_dir):
    """Every hour's whole snapshot with its maps of services, nodes and their pods."""
    return _snapshot_yaml(spark, sf_dir)


_RESULT_SQL = pr.RESULT_PROMPT.replace("'", "''").split("{result}")


@query("x4_result_message", f"""WITH {SNAPSHOT_YAML_SQL} SELECT snapshot_no, '{_RESULT_SQL[0]}' || snapshot || '{_RESULT_SQL[1]}' AS message
  FROM snapshot_yaml""")
def result_message(spark, sf_dir):
    """What a configuration led to, as the message that goes back to the model."""
    return _snapshot_yaml(spark, sf_dir).select("snapshot_no", pr.result_message(F.col("snapshot")).alias("message"))


_REPAIR_SQL = "'" + pr.REPAIR_PROMPT.replace("'", "''").replace("{service}", "' || service || '").replace(
    "{failed}", "' || failed || '").replace("{error}", "' || error || '") + "'"


@query("x4_repair_message", f"""WITH failed AS (SELECT a.conv_id, a.turn, 'srv-' || a.conv_id AS service, a.text AS failed, e.text AS error
  FROM conversations a JOIN conversations e ON e.conv_id = a.conv_id AND e.turn = a.turn + 1 WHERE a.role = 'assistant')
SELECT conv_id, turn, {_REPAIR_SQL} AS message FROM failed""")
def repair_message(spark, sf_dir):
    """Every assistant turn stands for a configuration that failed, the turn behind it for the error it met."""
    turns = b.table(spark, sf_dir, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("error"))
    failed = turns.where(F.col("role") == "assistant").join(after, ["conv_id", "turn"])
    service = F.concat(F.lit("srv-"), F.col("conv_id").cast("string"))
    return failed.select("conv_id", "turn", pr.repair_message(service, F.col("text"), F.col("error")).alias("message"))


# Each assistant turn, whole, as a YAML block in one of four wrappings.
RESPONSES_SQL = """responses AS (SELECT conv_id, turn, 'note: |2-' || chr(10) || '  '
  || replace(text, chr(10), chr(10) || '  ') AS body FROM conversations WHERE role = 'assistant')"""


def _responses(spark, sf_dir):
    turns = b.table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    body = F.concat(F.lit("note: |2-\n  "), F.replace("text", F.lit("\n"), F.lit("\n  ")))
    wrap = [("Here:\n```YAML\n", "\n```\ndone"), ("```\n", "\n```"), ("<yaml>\n", "\n</yaml>"), ("", "")]
    text = F.lit(None).cast("string")
    for i, (start, end) in enumerate(wrap):
        text = F.when(F.floor(F.col("turn") / 2 + F.col("conv_id")) % 4 == i,
                      F.concat(F.lit(start), body, F.lit(end))).otherwise(text)
    return turns.select("conv_id", "turn", F.concat(F.lit("srv-"), F.col("conv_id").cast("string")).alias("service"),
                        text.alias("response"))


@query("x6_block_extraction", f"""WITH {RESPONSES_SQL} SELECT conv_id, turn,
  CASE WHEN (turn // 2 + conv_id) % 4 = 3 THEN body ELSE regexp_replace(body, '\\s+$', '') || chr(10) END AS yaml FROM responses""")
def block_extraction(spark, sf_dir):
    return pr.extract_blocks(_responses(spark, sf_dir)).select("conv_id", "turn", "yaml")


@query("x7_document_split", f"""WITH {RESPONSES_SQL} SELECT conv_id, turn, doc_no,
  CASE doc_no WHEN 0 THEN 'srv-' || conv_id ELSE 'made-' || turn END AS name FROM responses,
  (SELECT unnest([0, 2]) AS doc_no)""")
def document_split(spark, sf_dir):
    """A document without a name, a text that is no mapping, and a document with a name."""
    rows = pr.extract_blocks(_responses(spark, sf_dir))
    more = F.concat(F.lit("\n---\nplain words\n---\nmetadata:\n  name: made-"), F.col("turn").cast("string"), F.lit("\n"))
    rows = pr.split_documents(rows.withColumn("yaml", F.concat("yaml", more)))
    return rows.select("conv_id", "turn", "doc_no", "name")


@query("x8_chat_log", f"""SELECT conv_id, turn, 4 AS messages, 'user: K' || chr(10) || role || ': ' || text || chr(10)
  || 'user: {pr.GOAL}' || chr(10) || 'user: ' || CASE WHEN turn % 2 = 0 THEN '{pr.DEFAULT_PROMPT}' ELSE 'ask' END AS log
  FROM conversations""")
def chat_log(spark, sf_dir):
    turns = b.table(spark, sf_dir, "conversations")
    history = F.array(F.struct(F.col("role").alias("role"), F.col("text").alias("content")))
    log = pr.chat_log(F.lit("K"), history, F.when(F.col("turn") % 2 == 0, "  ").otherwise(" ask "))
    rows = turns.select("conv_id", "turn", log.alias("log"))
    return rows.select("conv_id", "turn", F.size("log").alias("messages"), F.array_join(F.transform(
        "log", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("log"))


@query("x9_conversation_text", """SELECT conv_id, turn, regexp_replace(regexp_replace('SYSTEM: go' || chr(10) || chr(10)
  || upper(role) || ': ' || text, '^\\s+', ''), '\\s+$', '') AS text FROM conversations""")
def conversation_text(spark, sf_dir):
    turns = b.table(spark, sf_dir, "conversations")
    messages = F.array(pr.message("system", F.lit("go")), F.struct(F.col("role").alias("role"),
                                                                   F.col("text").alias("content")))
    return turns.select("conv_id", "turn", pr.conversation_text(messages).alias("text"))


@query("x10_exchange_normalisation", """SELECT 'srv-' || conv_id % 5 AS service, conv_id * 1000 + turn AS seq,
  CASE WHEN turn % 3 = 0 THEN 'user' ELSE role END AS role, CASE WHEN turn % 4 = 0 THEN '' ELSE text END AS content
  FROM conversations WHERE turn % 5 <> 0""")
def exchange_normalisation(spark, sf_dir):
    turn = F.col("seq") % 1000
    m = F.col("messages")[0]
    messages = F.array(F.struct(F.when(turn % 3 != 0, m["role"]).alias("role"),
                                F.when(turn % 4 != 0, m["content"]).alias("content")))
    rows = exchanges(spark, sf_dir).withColumn("messages", messages).withColumn(
        "response", F.when(turn % 5 != 0, F.col("response")).otherwise(" \n"))
    rows = pr.normalised_exchanges(rows)
    return rows.select("service", "seq", F.col("messages")[0]["role"].alias("role"),
                       F.col("messages")[0]["content"].alias("content"))


HISTORY_SQL = """placed AS (SELECT 'srv-' || conv_id % 5 AS service, conv_id * 1000 + turn AS seq,
  row_number() OVER (PARTITION BY conv_id % 5 ORDER BY conv_id, turn) AS position,
  count(*) OVER (PARTITION BY conv_id % 5) AS n FROM conversations)"""


def _history(spark, sf_dir):
    return exchanges(spark, sf_dir).select("service", "seq")


@query("w13_kept_history", f"""WITH {HISTORY_SQL} SELECT service, seq, position FROM placed
  WHERE position > greatest(n // 2 - 2, 0)""")
def kept_history(spark, sf_dir):
    return pr.kept_history(_history(spark, sf_dir), "service", "seq")


@query("w13_kept_history_bounded", f"WITH {HISTORY_SQL} SELECT service, seq, position FROM placed "
       "WHERE position > n - 5")
def kept_history_bounded(spark, sf_dir):
    return pr.kept_history(_history(spark, sf_dir), "service", "seq", bounded=True)


@query("w14_context_cut", """WITH held AS (SELECT conv_id, turn, sum(len(role) + len(text) + 5) OVER
  (PARTITION BY conv_id % 5 ORDER BY conv_id DESC, turn DESC) AS h, conv_id % 5 AS g FROM conversations)
  SELECT 'srv-' || g AS service, conv_id, turn FROM held WHERE h - 1 <= 28672""")
def context_cut(spark, sf_dir):
    turns = b.table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("srv-"), (F.col("conv_id") % 5).cast("string")).alias("service"), "conv_id", "turn",
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "role", F.col("text").alias("content"))
    return pr.cut_context(turns, "service", "seq").select("service", "conv_id", "turn")
