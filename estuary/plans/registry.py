"""Collects the registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from estuary.plans import q_extract, q_loadings, q_mesh, q_observations, q_series, q_sources, q_thresholds

MODULES = (q_sources, q_extract, q_thresholds, q_mesh, q_series, q_loadings, q_observations)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
