"""All registered queries and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docspark.plans import checksum_queries, layout_queries, note_queries, number_queries, product_queries, record_queries, text_queries

_PARTS = (number_queries, text_queries, checksum_queries, record_queries, layout_queries, product_queries, note_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: f for p in _PARTS for n, f in p.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {n: s for p in _PARTS for n, s in p.ORACLE_SQL.items()}
