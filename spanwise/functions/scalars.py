"""Scalar expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1024.0 * 1024.0
DAY_US = 86_400_000_000


def micros_to_timestamp(us: Column) -> Column:
    return F.timestamp_micros(us)


def seconds_to_timestamp(s: Column) -> Column:
    return F.timestamp_seconds(s)


def epoch_micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zone-free timestamp."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def number(text: Column) -> Column:
    """Text to double; anything that is not a number becomes null."""
    return text.try_cast("double")


def iso_timestamp(text: Column) -> Column:
    """Parse an ISO-8601 instant, a trailing ``Z`` included; bad text becomes null."""
    return text.try_cast("timestamp")


def iso_text(ts: Column) -> Column:
    """Format an instant as ISO-8601 with microseconds and offset."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def lookup(key: Column, mapping: Mapping[str, str]) -> Column:
    """Value of a fixed mapping, null where the key is absent."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def longest_prefix(text: Column, mapping: Mapping[str, str]) -> Column:
    """Value of the longest prefix in a fixed mapping that the text starts with, else null."""
    found = F.lit(None).cast("string")
    for prefix in sorted(mapping, key=len):
        found = F.when(text.startswith(prefix), F.lit(mapping[prefix])).otherwise(found)
    return found


def stable_hash(text: Column, modulus: int = 10_000) -> Column:
    """SHA-256 of the text, read as one integer, modulo a small number."""
    digest = F.sha2(text, 256)
    step = pow(16, 8, modulus)
    folded = F.lit(0).cast("long")
    for i in range(8):
        word = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
        folded = (folded * step + word) % modulus
    return folded


def strip_suffix(text: Column, suffix: str) -> Column:
    return F.when(text.endswith(suffix), F.left(text, F.length(text) - len(suffix))).otherwise(text)


def us_to_ms(x: Column) -> Column:
    return x / 1000.0


def us_to_s(x: Column) -> Column:
    return x / 1_000_000.0


def to_mib(x: Column) -> Column:
    return x / MIB


def to_millicores(x: Column) -> Column:
    return x * 1000.0


def _suffixed(text: Column, units: Mapping[str, float], scale_down: bool = False) -> Column:
    """Number with an optional unit. Without a unit bad text gives 0; with one it is an error."""
    value = F.trim(text.cast("string"))
    out = F.coalesce(value.try_cast("double"), F.lit(0.0))
    for suffix, factor in sorted(units.items(), key=lambda kv: len(kv[0])):
        bare = F.left(value, F.length(value) - len(suffix)).cast("double")
        out = F.when(value.endswith(suffix), bare / factor if scale_down else bare * factor).otherwise(out)
    return F.when(text.isNull() | (value == ""), F.lit(0.0)).otherwise(out)


def duration_seconds(text: Column) -> Column:
    """``30s``, ``2m``, ``1h`` or bare seconds to seconds."""
    return _suffixed(text, {"s": 1.0, "m": 60.0, "h": 3600.0})


def cpu_cores(text: Column) -> Column:
    """``500m`` or bare cores to cores."""
    return _suffixed(text, {"m": 1000.0}, scale_down=True)


def memory_mib(text: Column) -> Column:
    """``64Ki``, ``512Mi`` or ``1Gi`` to MiB; a bare number is kept."""
    return _suffixed(text, {"Ki": 1.0 / 1024.0, "Mi": 1.0, "Gi": 1024.0})
