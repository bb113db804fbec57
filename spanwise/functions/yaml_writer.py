"""YAML text of structs, maps and arrays in column functions, laid out from the schema.

Block style, keys of structs in their order, keys of maps sorted, unicode as it is. Strings that would read as something
else are quoted; strings with line breaks or control characters are written with escapes. Nulls are ``null``; numbers
without a value are the words nan, inf and -inf.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the format: words and shapes of plain scalars that are no strings.
_WORDS = "yes|Yes|YES|no|No|NO|true|True|TRUE|false|False|FALSE|on|On|ON|off|Off|OFF|~|null|Null|NULL|<<|="
_INTEGER = r"[-+]?(?:0b[01_]+|0[0-7_]*|[1-9][0-9_]*|0x[0-9a-fA-F_]+|[1-9][0-9_]*(?::[0-5]?[0-9])+)"
_FLOAT = (r"[-+]?[0-9][0-9_]*\.[0-9_]*(?:[eE][-+][0-9]+)?|\.[0-9][0-9_]*(?:[eE][-+][0-9]+)?"
          r"|[-+]?[0-9][0-9_]*(?::[0-5]?[0-9])+\.[0-9_]*|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)")
_TIME = (r"\d{4}-\d\d-\d\d|\d{4}-\d\d?-\d\d?(?:[Tt]|[ \t]+)\d\d?:\d\d:\d\d(?:\.\d*)?(?:[ \t]*(?:Z|[-+]\d\d?(?::\d\d)?))?")
_OTHER = f"^(?:{_WORDS}|{_INTEGER}|{_FLOAT}|{_TIME})$"
_NO_PLAIN = r"""^$|^[\s,\[\]{}#&*!|>'"%@`]|^[-?:](?:\s|$)|^(?:---|\.\.\.)|:\s|:$|\s#|\s$"""
_ESCAPED = r"[\x00-\x1F\x7F-\x9F\u2028\u2029\uFEFF]"


def text(value: Column) -> Column:
    quoted = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))
    escaped = F.to_json(F.array(value))
    escaped = F.substring(escaped, F.lit(2), F.length(escaped) - 2)
    return F.when(value.rlike(_ESCAPED), escaped).when(value.rlike(_OTHER) | value.rlike(_NO_PLAIN), quoted).otherwise(value)


def number(value: Column) -> Column:
    """Digits of a double, with an exponent only below 0.0001 and from 1e16 on."""
    size, shown = F.abs(value), value.cast("string")
    plain = F.regexp_replace(value.cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    power = F.regexp_extract(shown, r"E(-?\d+)$", 1)
    power = F.concat(F.when(power.startswith("-"), "-").otherwise("+"), F.lpad(F.regexp_replace(power, "-", ""), 2, "0"))
    long = F.when(F.length(F.regexp_extract(shown, r"E-?(\d+)$", 1)) > 2, F.regexp_replace(F.regexp_extract(shown, r"E(-?\d+)$", 1), r"^(\d)", "+$1"))
    scientific = F.concat(F.regexp_extract(shown, r"^(.*)E", 1), F.lit("e"), F.coalesce(long, power))
    return (F.when(F.isnan(value), "nan").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf")
            .when(value == 0, shown).when((size >= 1e-4) & (size < 1e16), plain).otherwise(scientific))


def scalar(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        shown = F.when(value, "true").when(~value, "false")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        shown = number(value.cast("double"))
    elif isinstance(kind, T.TimestampType):
        shown = text(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ssxxx"))
    elif isinstance(kind, T.StringType):
        shown = text(value)
    else:
        shown = value.cast("string")
    return F.coalesce(shown, F.lit("null"))


def _lines(value: Column, kind: T.DataType, indent: int) -> Column:
    """What stands below a key or is a whole document; every line ends with a line feed."""
    pad = " " * indent
    if isinstance(kind, T.StructType):
        return F.concat(*[F.concat(F.lit(pad), text(F.lit(f.name)), F.lit(":"), _after(value[f.name], f.dataType, indent)) for f in kind])
    if isinstance(kind, T.MapType):
        keys = F.array_sort(F.map_keys(value))
        return F.array_join(F.transform(keys, lambda k: F.concat(
            F.lit(pad), scalar(k, kind.keyType), F.lit(":"), _after(value[k], kind.valueType, indent))), "")
    if isinstance(kind, T.ArrayType):
        item = kind.elementType
        if isinstance(item, (T.StructType, T.MapType, T.ArrayType)):
            def shown(x: Column) -> Column:
                rest = F.substring(_lines(x, item, indent + 2), indent + 3, 2**31 - 1)
                return F.when(x.isNull(), "null\n").when(_empty(x, item), f"{_none(item)}\n").otherwise(rest)
        else:
            def shown(x: Column) -> Column:
                return F.concat(scalar(x, item), F.lit("\n"))
        return F.array_join(F.transform(value, lambda x: F.concat(F.lit(pad + "- "), shown(x))), "")
    return F.concat(F.lit(pad), scalar(value, kind), F.lit("\n"))


def _empty(value: Column, kind: T.DataType) -> Column:
    return F.lit(not kind.fields) if isinstance(kind, T.StructType) else F.size(value) == 0


def _none(kind: T.DataType) -> str:
    return "[]" if isinstance(kind, T.ArrayType) else "{}"


def _after(value: Column, kind: T.DataType, indent: int) -> Column:
    if not isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        return F.concat(F.lit(" "), scalar(value, kind), F.lit("\n"))
    below = _lines(value, kind, indent if isinstance(kind, T.ArrayType) else indent + 2)
    return F.when(value.isNull(), " null\n").when(_empty(value, kind), f" {_none(kind)}\n").otherwise(F.concat(F.lit("\n"), below))


def yaml_of(value: Column, kind: T.StructType) -> Column:
    """The document of a struct of the given type."""
    return _lines(value, kind, 0)
