"""Query registry shared by the plan modules and ``__spark_entry__``."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Plan modules that register queries on import.
PLAN_MODULES = (
    "agora.plans.catalog",
    "agora.plans.catalog_export",
    "agora.plans.catalog_ingest",
    "agora.plans.catalog_text",
    "agora.plans.catalog_extract",
    "agora.plans.catalog_annotate",
    "agora.plans.catalog_stream",
    "agora.plans.catalog_more",
    "agora.plans.catalog_feed",
    "agora.plans.catalog_store",
)


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES and QUERIES[name] is not fn:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def _load() -> None:
    for mod in PLAN_MODULES:
        importlib.import_module(mod)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return QUERIES


def all_oracles() -> dict[str, str]:
    _load()
    return ORACLES
