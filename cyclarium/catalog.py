"""All queries of the engine's own operators and the SQL that each must equal."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES and SQL.
MODULES = ("statistics", "cleaning", "selection", "alignment", "events", "peaks", "ramps", "reports", "windows", "plans", "comparison", "correlation", "references", "experiments", "clocks")


def _gather(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(importlib.import_module(f"cyclarium.queries.{module}"), name)
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query that the smoke check runs."""
    return queries()["bead_quality"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query by name."""
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return _gather("SQL")
