"""Rows from nowhere: number series and literal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def generate_series(spark: SparkSession, first: int, last: int, name: str = "value", step: int = 1) -> DataFrame:
    """first, first + step, ... up to `last` included, as BIGINT; made by the tasks."""
    if step == 0:
        raise ValueError("the step must not be zero")
    return spark.range(first, last + (1 if step > 0 else -1), step).withColumnRenamed("id", name)


def values(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """Literal rows."""
    return spark.createDataFrame(rows, schema)
