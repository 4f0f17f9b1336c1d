"""Column types: SQL names, Spark types and the ranges that Spark's types don't enforce."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import INVALID_VALUE, OUT_OF_RANGE, UNSUPPORTED, EngineError


class ColumnType(NamedTuple):
    name: str
    spark: T.DataType
    low: int | None = None
    high: int | None = None
    signed_integer: bool = False


def _int(name: str, spark: T.DataType, bits: int) -> ColumnType:
    return ColumnType(name, spark, -(2 ** (bits - 1)), 2 ** (bits - 1) - 1, True)


TYPES = {
    t.name: t
    for t in (
        _int("int8", T.ByteType(), 8),
        _int("int16", T.ShortType(), 16),
        _int("int32", T.IntegerType(), 32),
        _int("int64", T.LongType(), 64),
        ColumnType("uint8", T.ShortType(), 0, 2**8 - 1),
        ColumnType("uint16", T.IntegerType(), 0, 2**16 - 1),
        ColumnType("uint32", T.LongType(), 0, 2**32 - 1),
        ColumnType("uint64", T.DecimalType(20, 0), 0, 2**64 - 1),
        ColumnType("float64", T.DoubleType()),
        ColumnType("boolean", T.BooleanType()),
        ColumnType("utf8", T.StringType()),
        ColumnType("timestamp", T.TimestampNTZType()),
    )
}

#: Which SQL names mean which type. INT, INTEGER and INT4 are 64 bits wide.
SQL_NAMES = {
    "int8": "TINYINT",
    "int16": "SMALLINT, INT2",
    "int32": "INT32",
    "int64": "BIGINT, INT8, INTEGER, INT, INT4, MEDIUMINT",
    "uint8": "TINYINT UNSIGNED, UTINYINT",
    "uint16": "SMALLINT UNSIGNED, USMALLINT",
    "uint32": "UINT32",
    "uint64": "BIGINT UNSIGNED, INT UNSIGNED, INTEGER UNSIGNED, UBIGINT, UINT64",
    "float64": "FLOAT, REAL, FLOAT4, FLOAT8, DOUBLE, DOUBLE PRECISION",
    "boolean": "BOOLEAN, BOOL",
    "utf8": "TEXT, STRING, VARCHAR, CHAR, CHARACTER, CHARACTER VARYING",
    "timestamp": "TIMESTAMP, DATETIME, TIMESTAMP WITHOUT TIME ZONE",
}
BY_SQL_NAME = {sql.strip(): kind for kind, names in SQL_NAMES.items() for sql in names.split(",")}


def from_sql(name: str) -> ColumnType:
    """The type of an SQL name; a length in brackets is accepted on texts and not enforced."""
    kind = BY_SQL_NAME.get(" ".join(name.upper().split()))
    if kind is None:
        raise EngineError(UNSUPPORTED, f"column type {name} is not supported")
    return TYPES[kind]


def out_of_range(column: Column, kind: ColumnType) -> Column:
    """Whether a value (of any number type) doesn't fit; false for nulls."""
    if kind.low is None:
        return F.lit(False)
    wide = column.cast("decimal(38,0)")
    return F.coalesce((wide < F.lit(str(kind.low)).cast("decimal(38,0)")) | (wide > F.lit(str(kind.high)).cast("decimal(38,0)")), F.lit(False))


def literal(value: object, kind: ColumnType) -> object:
    """A Python value for a column of `kind`, or an error: 22003 for a signed range, 22023 for any other misfit."""
    if value is None:
        return None
    if kind.low is not None:
        if isinstance(value, bool) or not isinstance(value, int | str):
            raise EngineError(INVALID_VALUE, f"{value!r} is not a whole number")
        try:
            number = int(value)
        except ValueError:
            raise EngineError(INVALID_VALUE, f"{value!r} is not a whole number") from None
        if not kind.low <= number <= kind.high:
            raise EngineError(OUT_OF_RANGE if kind.signed_integer else INVALID_VALUE, f"{number} is out of range for {kind.name}")
        if kind.name == "uint64":
            from decimal import Decimal

            return Decimal(number)
        return number
    if kind.name == "float64":
        if isinstance(value, bool):
            raise EngineError(INVALID_VALUE, f"{value!r} is not a number")
        try:
            return float(value)
        except (TypeError, ValueError):
            raise EngineError(INVALID_VALUE, f"{value!r} is not a number") from None
    if kind.name == "boolean":
        if not isinstance(value, bool):
            raise EngineError(INVALID_VALUE, f"{value!r} is not a boolean")
        return value
    if kind.name == "timestamp":
        import datetime

        if isinstance(value, datetime.datetime):
            return value
        try:
            return datetime.datetime.fromisoformat(str(value))
        except ValueError:
            raise EngineError(INVALID_VALUE, f"{value!r} is not a timestamp") from None
    if not isinstance(value, str):
        raise EngineError(INVALID_VALUE, f"{value!r} is not a text")
    return value
