"""All registered queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES (name to function of session and folder) and ORACLES (name to SQL).
MODULES = ["threadloom.plans." + m for m in ("dealt", "relational", "network", "case", "casegraph", "extras", "names", "streams")]


def _merged(attribute: str) -> dict:
    out: dict = {}
    for m in MODULES:
        part = getattr(import_module(m), attribute)
        if twice := out.keys() & part.keys():
            raise ValueError(f"registered twice: {sorted(twice)}")
        out |= part
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLES")
