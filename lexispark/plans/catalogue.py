"""The catalogue of named queries: each has a Spark plan and, where SQL can say it on whole tables, its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .ship import ship

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Catalogue:
    queries: dict[str, Query] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(f: Query) -> Query:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                ship(spark)
                return f(spark, sf_dir)

            run.__doc__, run.__name__ = f.__doc__, name
            self.queries[name] = run
            if sql:
                # the views are written as the parts of a WITH clause
                self.sql[name] = sql if sql.lstrip().lower().startswith(("select", "with")) else "with " + sql
            return f

        return register

    def merge(self, other: Catalogue) -> Catalogue:
        return Catalogue(self.queries | other.queries, self.sql | other.sql)
