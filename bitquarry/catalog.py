"""Every query of the engine's own operators, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES and ORACLE, in the order in which they are listed.
MODULES = tuple(f"bitquarry.operators.{m}" for m in ("order", "references", "geometry", "planes", "blocks", "motion", "filters", "params", "streams", "entropy", "reconstruct", "decode", "readers")) + ("bitquarry.streaming.order",)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in import_module(m).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in import_module(m).ORACLE.items()}
