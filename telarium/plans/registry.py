"""Registration of a query with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from telarium.session import read


class Plan:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None, *tables: str) -> Callable:
        """Decorates a function of the named tables; it becomes the query `name` of (spark, sf_dir)."""

        def wrap(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            def run(spark, sf_dir: str) -> DataFrame:
                return fn(*(read(spark, sf_dir, t) for t in tables))

            run.__doc__, run.__name__ = fn.__doc__, fn.__name__
            self.queries[name] = run
            if sql:
                self.sql[name] = sql
            return fn

        return wrap
