"""YAML text from column functions against the YAML library."""

import datetime as dt

import pytest
import yaml
from pyspark.sql import functions as F

from spanwise.functions.yaml_writer import number, yaml_of

SCHEMA = ("n long, x double, ok boolean, word string, at timestamp, none string, tags array<string>, "
          "pods map<string,struct<cpu:double,services:map<string,double>,names:array<struct<a:int,b:array<int>>>>>, grid array<array<int>>")


def dumped(data):
    return yaml.dump(data, default_flow_style=False, allow_unicode=True, sort_keys=False, width=10**9)


def test_nested_documents(spark):
    at = dt.datetime(2024, 1, 1, 12, tzinfo=dt.timezone.utc)
    rows = [
        (1, 0.5, True, "plain text", at, None, ["a", "yes", ""], {"b": (1e-7, {"s": 2.0, "10": 1.0}, [(1, [2, 3]), (None, []), None]), "a": (None, {}, None), "c": None}, [[1, 2], [], None]),
        (None, None, False, "key: value", at, None, [], {}, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [r.y for r in df.select(F.col("word"), yaml_of(F.struct("*"), df.schema).alias("y")).orderBy("y").collect()]

    def plain(r):
        pods = {k: r[7][k] and {"cpu": r[7][k][0], "services": dict(sorted(r[7][k][1].items())), "names": r[7][k][2] and [x and {"a": x[0], "b": x[1]} for x in r[7][k][2]]}
                for k in sorted(r[7])}
        return dict(zip(("n", "x", "ok", "word", "at", "none", "tags", "pods", "grid"), (*r[:4], at.isoformat(), None, r[6], pods, r[8])))

    assert sorted(got) == sorted(dumped(plain(r)) for r in rows)


WORDS = ["", "a", "no", "12", "1_000", "0x1F", "1.5", "1e5", "1.0e+5", ".5", "-", "- a", "-a", "?x", ": a", "a:", "a:b", "a: b", "a #b", "a#b", "#a", " a",
         "a ", "it's", "'q'", '"q"', "2024-01-01", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00+00:00", "12:30", "12:30:45.5", "~", "null", "nan", "inf",
         ".inf", "ünï", "日本", "[a]", "a[0]", "{a}", "@a", "%a", "`a`", "&a", "*a", "!a", "|", "> a", "---", "...", "--- a", "a, b", "=", "<<", "+1", "007", "08", "x-y.z/w"]


def test_strings(spark):
    df = spark.createDataFrame([(w,) for w in WORDS], "w string")
    got = {r.w: r.y for r in df.select("w", yaml_of(F.struct("w"), df.schema).alias("y")).collect()}
    assert got == {w: dumped({"w": w}) for w in WORDS}
    odd = ["two\nlines", "tab\there", "nul\x00", "quote\" and\\\n"]
    df = spark.createDataFrame([(w,) for w in odd], "w string")
    assert {r.w: yaml.safe_load(r.y)["w"] for r in df.select("w", yaml_of(F.struct("w"), df.schema).alias("y")).collect()} == {w: w for w in odd}


@pytest.mark.parametrize("x", [0.0, 1.0, -2.5, 123456789.125, 1e15, 1e16, 1.5e22, 1e-4, 0.00012345, 1e-5, 2.5e-10, 1e100, -1e-300, 0.1 + 0.2, 1 / 3, 9007199254740993.0])
def test_numbers(spark, x):
    got = spark.createDataFrame([(x,)], "x double").select(number(F.col("x"))).first()[0]
    assert got == dumped({"x": x})[3:-1]


def test_numbers_without_a_value(spark):
    df = spark.createDataFrame([(float("nan"), float("inf"), float("-inf"))], "a double, b double, c double")
    assert df.select(yaml_of(F.struct("*"), df.schema)).first()[0] == dumped({"a": "nan", "b": "inf", "c": "-inf"})
