"""Queries and their oracle SQL, registered where the operators are defined."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.QUERIES: dict[str, Query] = {}
        self.ORACLE: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a query under a name, with the DuckDB SQL that must give the same rows."""

        def keep(run: Query) -> Query:
            self.QUERIES[name] = run
            if sql is not None:
                self.ORACLE[name] = sql
            return run

        return keep
