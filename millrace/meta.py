"""What is known of a table: columns, key, checks, indexes; kept as JSON in each manifest."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import types as T

from .errors import DUPLICATE_COLUMN, DUPLICATE_OBJECT, NOT_NULL, UNKNOWN_COLUMN, UNSUPPORTED, WRONG_TYPE, EngineError
from .types import TYPES, ColumnType

SCHEMA_VERSION = 2
DEFAULT_BUCKETS, MOST_BUCKETS = 32, 65535
NOW = {"now": True}


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = True
    has_default: bool = False
    default: object = None  # a literal, or NOW

    @property
    def kind(self) -> ColumnType:
        return TYPES[self.type]


@dataclass(frozen=True)
class Check:
    name: str
    sql: str


@dataclass(frozen=True)
class Index:
    name: str
    keys: tuple[str, ...]
    include: tuple[str, ...] = ()
    unique: bool = False
    using: str = "btree"
    buckets: int | None = None
    state: str = "write_only"  # write_only, then public

    def columns(self, key: str) -> list[str]:
        """What the index holds: its keys, the included columns, the table's key."""
        return list(dict.fromkeys([*self.keys, *self.include, key]))

    def covers(self, columns: set[str], key: str) -> bool:
        return columns <= set(self.columns(key))


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    key: str
    checks: tuple[Check, ...] = ()
    distribution: str = "range"  # range or hash
    buckets: int | None = None
    indexes: tuple[Index, ...] = field(default=())
    schema_version: int = SCHEMA_VERSION
    #: The last batch of each stream that writes here, by its checkpoint.
    batches: dict = field(default_factory=dict, hash=False)

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise EngineError(UNKNOWN_COLUMN, f"column {name} of {self.name} does not exist")

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.kind.spark, True) for c in self.columns])

    def with_index(self, index: Index) -> Table:
        return replace(self, indexes=(*(i for i in self.indexes if i.name != index.name), index))

    def without_index(self, name: str) -> Table:
        return replace(self, indexes=tuple(i for i in self.indexes if i.name != name))

    def to_json(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_json(data: dict) -> Table:
        """Reads version 1 too, which knew neither distribution nor indexes."""
        return Table(
            data["name"],
            tuple(Column(**c) for c in data["columns"]),
            data["key"],
            tuple(Check(**c) for c in data.get("checks", ())),
            data.get("distribution", "range"),
            data.get("buckets"),
            tuple(Index(**{**i, "keys": tuple(i["keys"]), "include": tuple(i["include"])}) for i in data.get("indexes", ())),
            batches=data.get("batches", {}),
        )


def validated(table: Table) -> Table:
    """The table, or an error for a definition that breaks a rule."""
    names = [c.name for c in table.columns]
    if len(set(names)) < len(names):
        raise EngineError(DUPLICATE_COLUMN, f"{table.name} has a column twice")
    key = table.column(table.key)
    if not key.kind.signed_integer:
        raise EngineError(WRONG_TYPE, f"the primary key {key.name} must be a signed integer")
    if key.nullable:
        raise EngineError(NOT_NULL, f"the primary key {key.name} must be NOT NULL")
    labels = [c.name for c in table.checks]
    if len(set(labels)) < len(labels):
        raise EngineError(DUPLICATE_OBJECT, f"{table.name} has a constraint name twice")
    if table.distribution == "hash" and not 1 <= (table.buckets or 0) <= MOST_BUCKETS:
        raise EngineError(UNSUPPORTED, f"hash buckets must be from 1 to {MOST_BUCKETS}")
    return table
