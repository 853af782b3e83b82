"""A book of queries: each a function of (spark, sf_dir) with, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardloom.plans.adapters import oracle, view

Query = Callable[[SparkSession, str], DataFrame]


class Views:
    """``v.roll``, ``v.documents`` ... of one session and folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Registers a function of Views under its name."""

        def add(f: Callable[[Views], DataFrame]):
            self.queries[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
            if sql:
                self.sql[f.__name__] = oracle(sql)
            return f

        return add
