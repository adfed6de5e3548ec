"""A query is a Spark plan with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Named plans and their oracle SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Plan] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
        def put(plan: Plan) -> Plan:
            assert name not in self.queries, name
            self.queries[name] = plan
            if sql is not None:
                self.oracles[name] = sql
            return plan

        return put
