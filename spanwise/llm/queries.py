"""Registered queries of the training-data operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.llm import bpe, decontaminate, language, licenses, merkle, secrets, sharding, simhash, sketch, substrings, token_counts, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def query(name: str):
    def keep(fn):
        QUERIES[name] = fn
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    """Where the installed vocabulary files are; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def sha(text) -> F.Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def remainder(of: int):
    """The remainder of the id's CRC-32; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % of


@query("op1_secret_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in secrets.BASE), sha(secrets.listed(secrets.BASE)).alias("base_sha256"),
        secrets.listed(secrets.KINDS).alias("spans"), *(F.size(k).cast("long").alias(f"n_{k}") for k in secrets.KINDS[3:]),
    )


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), docs.where(remainder(3) != 1).select("lang", "text"))
    return found.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits a document: a cut in the first quarter, an insertion in the middle, a replacement in the last quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    n = F.coalesce(F.length("text"), F.lit(0))
    at = lambda part: F.floor(n * part).cast("int")
    change = lambda start, length, text: F.struct(start.alias("start"), (start + length).alias("end"), text.alias("text"))
    edits = F.array(
        change(at(0.2), F.least(at(0.05), F.lit(40)), F.lit("")),
        change(at(0.5), F.lit(0), F.concat(F.lit(" edited for "), F.coalesce("source", F.lit("nobody")), F.lit("'s 2nd copy "))),
        change(at(0.8), F.least(at(0.05), F.lit(60)), F.upper(F.substring(F.coalesce("text", F.lit("")), at(0.8) + 1, F.least(at(0.05), F.lit(60))))),
    )
    found = token_counts.edited_counts(docs, edits, vocabulary_path(), trees=False)
    return found.select(
        "doc_id", "n_tokens", "n_pieces", F.col("edited.n_tokens").alias("n_tokens_edited"),
        F.col("edited.n_encoded").alias("n_encoded_again"), sha(F.col("edited.text")).alias("edited_sha256"),
    )


@query("op4_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_benchmark(docs, table(spark, sf_dir, "benchmark"))
    hit = decontaminate.hit_words()
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        sha(F.array_join(F.array_sort("hit_items"), ",")).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


@query("op5_simhash_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.membership(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    training = labels.where(remainder(5) != 0)
    found = toxicity.scored(docs, docs, training)
    return found.select(
        "doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op7_fingerprints")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sketch.edited_halves(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", sha("edited").alias("edited_sha256"), sketch.written("own").alias("fingerprint"),
        sketch.written("edited_sketch").alias("edited_fingerprint"), sketch.likeness("own", "edited_sketch").alias("near_edited"),
        sketch.likeness("own", "next_own").alias("near_next"),
    )


@query("op8_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(bpe.tokenized(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path()))


def digests(tokens: DataFrame) -> DataFrame:
    return tokens.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        sha("decoded").alias("decoded_sha256"),
    )


@query("op9_substring_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_units(table(spark, sf_dir, "documents"))


@query("op9_passage_dedup")
def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as units too."""
    return substrings.repeated_units(table(spark, sf_dir, "documents"), grains=substrings.GRAINS + substrings.WHOLES)


@query("op10_license_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


@query("op11_merkle_manifest")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth document's text, by the CRC-32 of its id, is tampered with: its capital letters are made small."""
    docs = table(spark, sf_dir, "documents")
    small = F.translate("text", UPPER, UPPER.lower())
    parts = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.when(remainder(5) == 0, merkle.leaf_digest(*parts, small))
    found = merkle.manifest(docs, "doc_id", "source", merkle.leaf_digest(*parts, F.col("text")), changed)
    return found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query("op12_sharding")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.sharded(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    return found.select(
        "doc_id", sharding.record_size().alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.usable(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    fitted = whitening.fit(rows, "embedding")
    if fitted is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    found = whitening.whitened(rows, "embedding", fitted, 32)
    error = whitening.identity_error(found)
    explained = F.array(*(F.lit(float(e) / fitted.trace if fitted.trace else 0.0) for e in fitted.values[:32]))
    return found.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened")).select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


ORACLES["op4_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark WHERE text IS NOT NULL
), bi AS (SELECT item_id, least(10, len(w)) AS n, len(w) AS m, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM b),
pat AS (
  SELECT DISTINCT item_id, n, p FROM (
    SELECT item_id, n, m, i, string_agg(word, ' ') OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS p FROM bi
  ) WHERE i + n - 1 <= m
), di AS (SELECT doc_id, len(w) AS m, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
dl AS (SELECT doc_id, m, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM di),
dw AS (SELECT doc_id, n, i, array_to_string(l[1:n], ' ') AS p FROM dl, (SELECT DISTINCT n FROM pat) WHERE i + n - 1 <= m),
hit AS (SELECT doc_id, item_id, n, i FROM dw JOIN pat USING (n, p)),
pos AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY 1),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

#: White space, stops, marks inside sentences and letters of scripts without spaces, as character classes.
BLANK = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
STOP, MARK = ".!?。！？．｡", ",;:，、；：､"
DENSE = (
    r"\x{e00}-\x{eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}"
    r"\x{f900}-\x{faff}\x{ff66}-\x{ff9f}\x{20000}-\x{3ffff}"
)
PARAGRAPH = rf"(?s).+?(?:\n[ \t\r]*\n[{BLANK}]*|$)"


def _cut_sql(grain: int, pattern: str) -> str:
    return f"SELECT doc_id, {grain} AS grain, regexp_extract_all(text, '{pattern}') AS l FROM documents WHERE text IS NOT NULL"


def _until(marks: str) -> str:
    return f"[^{marks}]*[{marks}]+|[^{marks}]+$"


ORACLES["op9_substring_dedup"] = rf"""
WITH u AS (
  SELECT doc_id, grain, unnest(l) AS unit, generate_subscripts(l, 1) AS i FROM (
    {_cut_sql(1, _until(r"\n"))}
    UNION ALL {_cut_sql(2, PARAGRAPH)}
    UNION ALL {_cut_sql(3, _until(r"\n" + STOP))}
    UNION ALL {_cut_sql(4, _until(STOP))}
    UNION ALL {_cut_sql(5, _until(r"\n" + STOP + MARK))})
), o AS (
  SELECT doc_id, grain, unit, CAST(sum(length(unit)) OVER (PARTITION BY doc_id, grain ORDER BY i) AS INTEGER) AS "end",
    trim(regexp_replace(lower(unit), '[{BLANK}]+', ' ', 'g')) AS norm FROM u
), g AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, norm, "end" - length(regexp_replace(unit, '^[{BLANK}]+', '')) ORDER BY grain) AS nth
  FROM o WHERE len(string_split(norm, ' ')) >= 6 OR length(regexp_replace(unit, '[^{DENSE}]+', '', 'g')) >= 20
), k AS (SELECT doc_id, CAST("end" - length(unit) AS INTEGER) AS start, "end", norm FROM g WHERE nth = 1),
r AS (
  SELECT *, first_value(doc_id) OVER w AS kept_doc_id, first_value(start) OVER w AS kept_start FROM k
  WINDOW w AS (PARTITION BY norm ORDER BY doc_id, start)
)
SELECT doc_id, start, "end", kept_doc_id, kept_start FROM r WHERE doc_id <> kept_doc_id OR start <> kept_start
"""


def _tree_sql(name: str, leaves: str) -> str:
    """Nodes of all levels over leaves (s, pos, digest), roots with heights, and what lies beside each leaf's path, by level."""
    return f"""{name}_nodes AS (
  SELECT s, 0 AS level, pos, digest FROM {leaves}
  UNION ALL SELECT s, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos))
  FROM (SELECT *, max(pos) OVER (PARTITION BY s) AS last FROM {name}_nodes) WHERE last > 0 GROUP BY s, level, pos // 16
), {name}_root AS (SELECT s, arg_max(digest, level) AS root, max(level) AS height FROM {name}_nodes GROUP BY s),
{name}_run AS (SELECT s, level, pos // 16 AS up, string_agg(digest, '' ORDER BY pos) AS run FROM {name}_nodes GROUP BY ALL),
{name}_path AS (
  SELECT l.s, l.pos, level, substr(run, 1, 64 * (l.pos // pow16 % 16)) AS before, substr(run, 64 * (l.pos // pow16 % 16 + 1) + 1) AS behind
  FROM (SELECT *, CAST(pow(16, level) AS BIGINT) AS pow16 FROM {name}_run) r JOIN {leaves} l ON l.s = r.s AND up = l.pos // (pow16 * 16)
  JOIN {name}_root h ON h.s = r.s AND level < height)"""


ORACLES["op11_merkle_manifest"] = rf"""
WITH RECURSIVE crc_table AS (
  SELECT range AS b, range AS v, 0 AS k FROM range(256)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM crc_table WHERE k < 8
), crc AS (
  SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id, CAST(4294967295 AS BIGINT) AS c, 0 AS i FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT id, xor(c >> 8, v), i + 1 FROM crc JOIN crc_table ON k = 8 AND b = xor(c, CAST(ascii(substr(id, i + 1, 1)) AS BIGINT)) & 255
  WHERE i < length(id)
), changes AS (SELECT CAST(id AS BIGINT) AS id FROM crc WHERE i = length(id) AND xor(c, 4294967295) % 5 = 0),
parts AS (
  SELECT doc_id, source, id IS NOT NULL AS hit, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
    || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body,
    coalesce(strlen(text) || ':' || translate(text, '{UPPER}', '{UPPER.lower()}'), '-') AS small
  FROM documents LEFT JOIN changes ON doc_id = id
), leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos
  FROM (SELECT doc_id, source, sha256(head || body) AS digest, sha256(head || CASE WHEN hit THEN small ELSE body END) AS new FROM parts)
), {_tree_sql("low", "leaves")},
tops AS (SELECT 0 AS s, s AS pos, root AS digest FROM low_root),
{_tree_sql("top", "tops")},
steps AS (
  SELECT s, pos, level, before, behind FROM low_path
  UNION ALL SELECT l.s, l.pos, height + level, before, behind FROM leaves l JOIN low_root h ON h.s = l.s JOIN top_path p ON p.pos = l.s
), folded AS (
  SELECT s, pos, 0 AS level, new AS digest FROM leaves
  UNION ALL SELECT s, pos, level + 1, sha256(before || digest || behind) FROM folded JOIN steps USING (s, pos, level)
), ends AS (SELECT s, pos, arg_max(digest, level) AS folded_root FROM folded GROUP BY ALL),
proofs AS (SELECT s, pos, string_agg(before || behind, '' ORDER BY level) AS beside FROM steps GROUP BY ALL)
SELECT doc_id, l.digest AS leaf, h.root AS subroot, t.root, sha256(coalesce(beside, '')) AS proof_sha256, folded_root, folded_root = t.root AS verified
FROM leaves l JOIN low_root h USING (s) JOIN ends USING (s, pos) LEFT JOIN proofs USING (s, pos), (SELECT root FROM top_root) t
"""
