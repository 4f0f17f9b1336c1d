"""One error type that carries an SQLSTATE."""

from __future__ import annotations

#: The states this engine raises.
UNSUPPORTED = "0A000"
OUT_OF_RANGE, INVALID_VALUE = "22003", "22023"
NOT_NULL, UNIQUE, CHECK = "23502", "23505", "23514"
ABORTED = "25P02"
CONFLICT = "40001"
SYNTAX, DUPLICATE_COLUMN, UNKNOWN_COLUMN, DUPLICATE_OBJECT, WRONG_TYPE, UNKNOWN_OBJECT = "42601", "42701", "42703", "42710", "42804", "42704"
UNKNOWN_TABLE, DUPLICATE_TABLE = "42P01", "42P07"
OVERLOAD, LIMIT, TIMEOUT, INTERNAL = "53300", "54000", "57014", "XX000"


class EngineError(Exception):
    def __init__(self, sqlstate: str, message: str):
        super().__init__(f"{sqlstate}: {message}")
        self.sqlstate, self.message = sqlstate, message
