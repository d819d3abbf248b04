"""A place for queries with their SQL.

Names begin with the id of the operator in the inventory; its predicates P1 to P22 are pp1 to pp22, as p1 to p9 are the
queries of the training-data problems.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    def __init__(self):
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.ORACLE: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f):
            self.QUERIES[name] = f
            if sql is not None:
                self.ORACLE[name] = sql
            return f

        return add
