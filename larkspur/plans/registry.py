"""Registration of queries with the SQL that each is held against."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        """Register the decorated (spark, sf_dir) -> DataFrame under name."""

        def put(fn):
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return put
