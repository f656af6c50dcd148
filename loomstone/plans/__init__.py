"""The registered queries: one module per part of the engine, each with its queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomstone.plans import columns, dates, extras, graphs, grouping, nesting, numbers, relations, sequences, streams, tables, texts

MODULES = (grouping, sequences, relations, texts, dates, numbers, nesting, graphs, streams, extras, columns, tables)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
