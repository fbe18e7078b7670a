"""Registered queries of the core library, and for each, where it exists, the same in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.queries import graphs, ingest, keys, papers

Query = Callable[[SparkSession, str], DataFrame]

MODULES = [papers, graphs, ingest, keys]


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
