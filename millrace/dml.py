"""Insert, upsert, update and delete as maps from a snapshot to the next."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constraints
from .errors import LIMIT, UNSUPPORTED, EngineError
from .meta import Index, Table, validated
from .statements import Bounds
from .store import File, Snapshot, Store
from .types import literal

MOST_ROWS = 100_000


def within(key: str, bounds: Bounds) -> Column:
    return F.col(key).between(bounds.low, bounds.high)


def touched(snapshot: Snapshot, bounds: Bounds) -> tuple[tuple[File, ...], tuple[File, ...]]:
    """(files whose key range meets the bounds, the others)."""
    hit, rest = [], []
    for f in snapshot.files:
        (hit if not bounds.empty and f.high >= bounds.low and f.low <= bounds.high else rest).append(f)
    return tuple(hit), tuple(rest)


def raise_conflicts(store: Store, snapshot: Snapshot, rows: DataFrame) -> None:
    """23505 for a primary key or unique index value that repeats. Only files whose range the new keys meet are read."""
    table = snapshot.table
    edge = rows.agg(F.min(table.key).alias("low"), F.max(table.key).alias("high")).first()
    base = None
    if edge.low is not None:
        files, _ = touched(snapshot, Bounds(edge.low, edge.high))
        base = store.read(snapshot, files) if files else None
    constraints.raise_duplicates(rows, base, [table.key], table.key)
    for index in table.indexes:
        if index.unique:
            constraints.raise_duplicates(rows, store.read(snapshot), list(index.keys), index.name)


@contextmanager
def landed(store: Store, rows: DataFrame, table: Table) -> Iterator[DataFrame]:
    """`rows` with defaults, written and read back: what is checked is what is stored, though the source be read twice."""
    for c in rows.columns:
        table.column(c)
    full = constraints.completed(rows, table)
    full = full.select(*[F.col(f.name).cast(table.column(f.name).kind.spark) if isinstance(f.dataType, T.NullType) else F.col(f.name) for f in full.schema])
    folder = f"{store.folder}/{table.name}/staging/{uuid.uuid4().hex}"
    full.write.parquet(folder)
    try:
        yield store.spark.read.schema(full.schema).parquet(folder)
    finally:
        store.fs.delete(store._path(folder), True)


def insert(store: Store, snapshot: Snapshot, rows: DataFrame) -> tuple[Snapshot, int]:
    """Appends rows: defaults, checks and uniqueness first, all or nothing. Returns the new snapshot and the row count."""
    table = snapshot.table
    with landed(store, rows, table) as given:
        ready = constraints.checked(given, table)
        raise_conflicts(store, snapshot, ready)
        files = store.write(ready, table)
    return store.commit(Snapshot(snapshot.version, table, snapshot.files + files)), sum(f.rows for f in files)


def upsert_rows(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`base` with the rows of `new` in place of those with their keys."""
    return base.join(new.select(key), key, "left_anti").unionByName(new)


def upsert(store: Store, snapshot: Snapshot, rows: DataFrame) -> tuple[Snapshot, int]:
    """Insert or replace by primary key."""
    table = snapshot.table
    with landed(store, rows, table) as given:
        ready = constraints.checked(given, table)
        constraints.raise_duplicates(ready, None, [table.key], table.key)
        edge = ready.agg(F.min(table.key).alias("low"), F.max(table.key).alias("high"), F.count("*").alias("n")).first()
        if not edge.n:
            return snapshot, 0
        hit, rest = touched(snapshot, Bounds(edge.low, edge.high))
        merged = upsert_rows(store.read(snapshot, hit), ready, table.key)
        for index in table.indexes:
            if index.unique:
                constraints.raise_duplicates(merged.unionByName(store.read(snapshot, rest)), None, list(index.keys), index.name)
        files = store.write(merged, table)
    return store.commit(Snapshot(snapshot.version, table, rest + files)), edge.n


def set_expressions(table: Table, values: dict[str, object]) -> dict[str, Column]:
    """New values of columns; the primary key can't be set, and only literals can be."""
    out = {}
    for name, value in values.items():
        column = table.column(name)
        if name == table.key:
            raise EngineError(UNSUPPORTED, f"the primary key {name} can't be changed")
        if isinstance(value, dict):
            out[name] = F.current_timestamp().cast(column.kind.spark)
        else:
            out[name] = F.lit(literal(value, column.kind)).cast(column.kind.spark)
    return out


def updated(rows: DataFrame, table: Table, bounds: Bounds, values: dict[str, object]) -> DataFrame:
    """Rows after the update: those within the bounds get the new values."""
    new = set_expressions(table, values)
    inside = within(table.key, bounds)
    return rows.select(*[F.when(inside, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns])


def matched(store: Store, snapshot: Snapshot, files: tuple[File, ...], bounds: Bounds, limit: int = MOST_ROWS) -> int:
    """How many rows the bounds match; 54000 above the limit."""
    n = store.read(snapshot, files).where(within(snapshot.table.key, bounds)).limit(limit + 1).count() if files else 0
    if n > limit:
        raise EngineError(LIMIT, f"the change matches more than {limit} rows")
    return n


def update(store: Store, snapshot: Snapshot, bounds: Bounds, values: dict[str, object], limit: int = MOST_ROWS) -> tuple[Snapshot, int]:
    """Copies on write the files that the bounds meet. Counts matched rows, changed or not."""
    table = snapshot.table
    set_expressions(table, values)
    hit, rest = touched(snapshot, bounds)
    n = matched(store, snapshot, hit, bounds, limit)
    if not n:
        return snapshot, 0
    rows = updated(store.read(snapshot, hit), table, bounds, values)
    constraints.checked(rows.where(within(table.key, bounds)), table)
    for index in table.indexes:
        if index.unique and set(index.keys) & set(values):
            constraints.raise_duplicates(rows.unionByName(store.read(snapshot, rest)), None, list(index.keys), index.name)
    files = store.write(rows, table, files=max(1, len(hit)))
    return store.commit(Snapshot(snapshot.version, table, rest + files)), n


def delete(store: Store, snapshot: Snapshot, bounds: Bounds, limit: int = MOST_ROWS) -> tuple[Snapshot, int]:
    table = snapshot.table
    hit, rest = touched(snapshot, bounds)
    n = matched(store, snapshot, hit, bounds, limit)
    if not n:
        return snapshot, 0
    files = store.write(store.read(snapshot, hit).where(~within(table.key, bounds)), table, files=max(1, len(hit)))
    return store.commit(Snapshot(snapshot.version, table, rest + files)), n


def tombstone(store: Store, snapshot: Snapshot, keys: DataFrame) -> Snapshot:
    """Removes rows by a table of keys, unconditionally. Only files that hold one of the keys are rewritten."""
    table = snapshot.table
    gone = keys.select(F.col(table.key).cast("long").alias(table.key)).where(F.col(table.key).isNotNull())
    edge = gone.agg(F.min(table.key).alias("low"), F.max(table.key).alias("high")).first()
    if edge.low is None:
        return snapshot
    near, _ = touched(snapshot, Bounds(edge.low, edge.high))
    holding = set()
    if near:
        found = store.read(snapshot, near).select(table.key, F.input_file_name().alias("_file")).join(gone, table.key, "left_semi")
        holding = {r["_file"] for r in found.select("_file").distinct().collect()}  # a row for each file at most
    hit = tuple(f for f in near if f.path in holding)
    if not hit:
        return snapshot
    files = store.write(store.read(snapshot, hit).join(gone, table.key, "left_anti"), table, files=len(hit))
    return store.commit(Snapshot(snapshot.version, table, tuple(f for f in snapshot.files if f.path not in holding) + files))


def apply_if(store: Store, snapshot: Snapshot, rows: DataFrame, expected: DataFrame) -> tuple[Snapshot, DataFrame]:
    """Upserts `rows` if every key's present row is the one the writer saw; else writes nothing.

    expected: the rows the writer saw, one for each key of `rows` that was there; a key without one must be absent. Returns
    the new snapshot and the keys in conflict; with any, the snapshot is the old one.
    """
    table = snapshot.table
    names = [c.name for c in table.columns]
    now = store.read(snapshot).join(rows.select(table.key), table.key, "left_semi").select(table.key, F.struct(*names).alias("_now"))
    seen = expected.select(table.key, F.struct(*[F.col(c.name).cast(c.kind.spark).alias(c.name) for c in table.columns]).alias("_seen"))
    keys = rows.select(table.key).distinct()
    conflicts = keys.join(now, table.key, "left").join(seen, table.key, "left").where(~F.col("_now").eqNullSafe(F.col("_seen"))).select(table.key)
    if not conflicts.isEmpty():
        return snapshot, conflicts
    return upsert(store, snapshot, rows)[0], conflicts


def redistribute(store: Store, snapshot: Snapshot, distribution: str, buckets: int | None) -> Snapshot:
    """Rewrites a table with another distribution of its key and swaps the snapshot at once."""
    table = validated(replace(snapshot.table, distribution=distribution, buckets=buckets))
    files = store.write(store.read(snapshot), table) if snapshot.files else ()
    return store.commit(Snapshot(snapshot.version, table, files))


def create_index(store: Store, snapshot: Snapshot, index: Index) -> Snapshot:
    """Backfills an index as a projection of each data file, sorted by its keys, then publishes it.

    The first commit shows the index as write-only, so writers already keep it unique and current; the second makes it
    public. If the backfill fails, for duplicates or for any other reason, the index is dropped again.
    """
    table = snapshot.table
    for c in (*index.keys, *index.include):
        table.column(c)
    now = store.commit(Snapshot(snapshot.version, table.with_index(replace(index, state="write_only")), snapshot.files))
    try:
        if index.unique:
            constraints.raise_duplicates(store.read(now), None, list(index.keys), index.name)
        files = store.project(now.files, table, index)
        return store.commit(Snapshot(now.version, now.table.with_index(replace(index, state="public")), files))
    except Exception:
        store.commit(Snapshot(now.version, now.table.without_index(index.name), now.files))
        raise
