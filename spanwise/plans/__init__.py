"""Registered queries, their inputs and their SQL counterparts."""

from __future__ import annotations

import importlib

MODULES = (
    "trace_queries", "metric_queries", "experiment_queries", "config_queries", "forest_queries", "source_queries",
    "prompt_queries", "stream_queries",
)


def load():
    """All queries and all SQL counterparts, by name."""
    from spanwise.plans import registry

    for name in MODULES:
        importlib.import_module(f"spanwise.plans.{name}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
