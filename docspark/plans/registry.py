"""Registered queries of the reference's operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalog_queries, end_to_end_queries, evaluation_queries, record_queries, text_queries, vector_queries

_MODULES = (vector_queries, text_queries, evaluation_queries, catalog_queries, end_to_end_queries, record_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
