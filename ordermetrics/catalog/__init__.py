"""The library's metrics over the test tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES = ("ops_summary", "lab_ops", "billing", "checkout", "marketing", "experiments", "refresh", "primitives")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in _MODULES:
        found.update(import_module(f"{__name__}.{name}").QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in _MODULES:
        found.update(import_module(f"{__name__}.{name}").ORACLE)
    return found
