"""All queries of the core, by name, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quaestor.plans import changes, documents, intake, quality, retrieval, scalars, views

MODULES = (retrieval, quality, scalars, changes, documents, intake, views)
FLAGSHIP = "top_matches"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
