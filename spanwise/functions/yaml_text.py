"""YAML helpers that run inside Arrow-batched tasks."""

from __future__ import annotations

import json
import sys

import pandas as pd
import yaml
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _load_all(text: str) -> list:
    return list(yaml.load_all(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)))


def _json(text: str | None) -> str | None:
    try:
        docs = _load_all(text or "")
        return json.dumps(docs[0] if docs else None, default=str)
    except (yaml.YAMLError, ValueError, TypeError):
        return None


def _first_readable(candidates) -> str | None:
    for text in [] if candidates is None else candidates:
        if text is None:
            continue
        try:
            _load_all(text)
            return text
        except (yaml.YAMLError, ValueError, TypeError):
            continue
    return None


def _dump(text: str | None) -> str | None:
    return None if text is None else yaml.dump(json.loads(text), default_flow_style=False, sort_keys=False,
                                               allow_unicode=True)


def yaml_to_json(text: Column) -> Column:
    """First YAML document as JSON text; null where it cannot be read."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(_json)

    return run(text)


def first_readable(candidates: Column) -> Column:
    """The first text of an array that reads as YAML (one or more documents), else null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(_first_readable)

    return run.asNondeterministic()(candidates)


def json_to_yaml(text: Column) -> Column:
    """JSON text as YAML text in key order."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(_dump)

    return run(text)
