"""Queries of the engine and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = ("graph_queries", "text_queries", "retrieval_queries", "scoring_queries", "build_queries", "integrity_queries")


class Book:
    """The queries of one module with their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep


def _books() -> list[Book]:
    return [import_module(f"tessera.plans.{m}").BOOK for m in _MODULES]


def queries() -> dict[str, Query]:
    return {k: f for b in _books() for k, f in b.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for b in _books() for k, s in b.sql.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions resolved to nodes, traversed, answered and scored."""
    return queries()["question_to_score"](spark, sf_dir)
