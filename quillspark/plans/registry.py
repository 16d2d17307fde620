"""The queries of the reference's operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans import analysis, catalog, dense, payloads, research, retrieval, sheets, sources, stages, structure, summaries, tables, two_stage

MODULES = (catalog, retrieval, structure, tables, dense, research, sources, sheets, summaries, payloads, stages, two_stage, analysis)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
