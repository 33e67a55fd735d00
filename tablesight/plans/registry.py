"""Registry of checkable queries: name -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLE: dict[str, str] = {}

_MODULES = (
    "tablesight.plans.q_profile",
    "tablesight.plans.q_clean",
    "tablesight.plans.q_tags",
    "tablesight.plans.q_features",
    "tablesight.plans.q_supervised",
    "tablesight.plans.q_cluster",
    "tablesight.plans.q_bandit",
    "tablesight.plans.q_recommend",
    "tablesight.plans.q_facts",
    "tablesight.plans.q_grounding",
    "tablesight.plans.q_cashflow",
    "tablesight.plans.q_logistics",
    "tablesight.plans.q_scenario",
    "tablesight.plans.q_analysis",
)


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql
        return fn
    return deco


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(m)


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
