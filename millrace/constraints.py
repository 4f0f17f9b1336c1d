"""Defaults, coercion, NOT NULL, ranges, CHECK and uniqueness as column expressions and joins."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import CHECK, INVALID_VALUE, NOT_NULL, OUT_OF_RANGE, UNIQUE, EngineError
from .meta import NOW, Table
from .types import literal, out_of_range


def default_of(column):
    """A column's default as an expression: NULL where it has none."""
    if not column.has_default or column.default is None:
        return F.lit(None).cast(column.kind.spark)
    if column.default == NOW:
        return F.current_timestamp().cast(T.TimestampNTZType())
    return F.lit(literal(column.default, column.kind)).cast(column.kind.spark)


def completed(df: DataFrame, table: Table) -> DataFrame:
    """`df` in the table's columns: defaults for columns it hasn't, never for nulls it has."""
    have = set(df.columns)
    return df.select(*[F.col(c.name).alias(c.name) if c.name in have else default_of(c).alias(c.name) for c in table.columns])


def checked(df: DataFrame, table: Table) -> DataFrame:
    """`df` cast to the table's types after one pass that looks for the first broken rule; CHECK fails on false only."""
    tests = []
    for c in table.columns:
        value = F.col(c.name)
        numeric = isinstance(df.schema[c.name].dataType, T.NumericType)
        if c.kind.low is not None and numeric:
            tests.append((out_of_range(value, c.kind), OUT_OF_RANGE if c.kind.signed_integer else INVALID_VALUE, f"{c.name} is out of range for {c.kind.name}"))
        elif not isinstance(df.schema[c.name].dataType, T.NullType) and df.schema[c.name].dataType != c.kind.spark:
            tests.append((value.isNotNull() & value.try_cast(c.kind.spark).isNull(), INVALID_VALUE, f"{c.name} has a value that is no {c.kind.name}"))
        if not c.nullable:
            tests.append((value.isNull(), NOT_NULL, f"{c.name} must not be null"))
    typed = df.select(*[F.col(c.name).try_cast(c.kind.spark).alias(c.name) for c in table.columns])
    raise_first(df, tests)
    raise_first(typed, [(~F.coalesce(F.expr(k.sql), F.lit(True)), CHECK, f"a row breaks {k.name}") for k in table.checks])
    return typed


def raise_first(df: DataFrame, tests: list) -> None:
    """Raises the first test that holds for any row. One aggregate answers all tests."""
    if not tests:
        return
    row = df.agg(*[F.max(t.cast("int")).alias(f"t{i}") for i, (t, _, _) in enumerate(tests)]).first()
    for i, (_, state, message) in enumerate(tests):
        if row[f"t{i}"]:
            raise EngineError(state, message)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur twice; rows with a null in a key never conflict."""
    present = functools.reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.where(present).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def raise_duplicates(new: DataFrame, base: DataFrame | None, keys: list[str], what: str) -> None:
    """23505 if keys repeat in `new`, or are in `base` already."""
    if not duplicate_keys(new, keys).isEmpty():
        raise EngineError(UNIQUE, f"the rows repeat a value of {what}")
    if base is not None and not new.join(base.select(*keys), keys, "left_semi").isEmpty():
        raise EngineError(UNIQUE, f"a value of {what} exists already")
