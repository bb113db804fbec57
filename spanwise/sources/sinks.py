"""Table and transcript sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_csv(rows: DataFrame, path: str) -> None:
    """Add rows to a CSV table; every part carries the header, which readers skip."""
    rows.write.mode("append").csv(path, header=True)


def write_effects(table: DataFrame, path: str) -> None:
    """Per-change table of means, effects and toxicities."""
    table.write.mode("overwrite").csv(path, header=True)


def _block(text: Column, indent: str) -> Column:
    """The lines of a text, each indented."""
    return F.concat(F.lit(indent), F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n|\r|\n", "\n" + indent))


def transcript(exchanges: DataFrame) -> DataFrame:
    """One text per exchange (service, seq, label, llm_type, messages, response)."""
    messages = F.array_join(F.transform("messages", lambda m: F.concat(
        F.lit("- role: "), m["role"], F.lit("\n  content: |\n"), _block(m["content"], "    "))), "\n")
    text = F.concat_ws(
        "\n", F.concat(F.lit("## Exchange "), F.col("seq").cast("string")),
        F.concat(F.lit("label: "), F.col("label")), F.concat(F.lit("llm_type: "), F.col("llm_type")),
        F.lit("chat_messages:"), F.nullif(messages, F.lit("")), F.lit("llm_response: |"),
        _block(F.col("response"), "  "))
    return exchanges.select("service", "seq", text.alias("value"))


def write_transcripts(exchanges: DataFrame, path: str) -> None:
    """Transcripts in a folder per service, in exchange order.

    Rows are range-partitioned by service and number, so a busy service is spread over several ordered parts.
    """
    rows = transcript(exchanges).repartitionByRange("service", "seq").sortWithinPartitions("service", "seq")
    rows.select("service", "value").write.mode("overwrite").partitionBy("service").text(path)
