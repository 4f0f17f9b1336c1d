"""Decorator that collects queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None) -> Callable:
        """Registers fn(t) where t(table) reads a table of the data directory."""

        def add(fn: Callable) -> Callable:
            key = name or fn.__name__
            if key in self.queries:
                raise ValueError(f"{key} is registered twice")
            self.queries[key] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
            if sql:
                self.sql[key] = sql
            return fn

        return add


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
