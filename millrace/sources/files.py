"""Readers and writers of files, and the catalogue as views."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..store import Store

FORMATS = ("parquet", "orc", "csv", "json")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Rows of a file or folder. CSV and JSON want a schema: inference would read everything twice."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None, **options) -> None:
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    writer = df.write.format(kind).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def information_schema(store: Store) -> tuple[DataFrame, DataFrame]:
    """(tables, columns) of a store, a row per table and column."""
    tables, columns = [], []
    for name in store.tables():
        t = store.snapshot(name).table
        tables.append(("public", name, "BASE TABLE"))
        columns += [("public", name, c.name, i, "YES" if c.nullable else "NO", c.type) for i, c in enumerate(t.columns, 1)]
    spark = store.spark
    return (
        spark.createDataFrame(tables, "table_schema STRING, table_name STRING, table_type STRING"),
        spark.createDataFrame(columns, "table_schema STRING, table_name STRING, column_name STRING, ordinal_position INT, is_nullable STRING, data_type STRING"),
    )


#: How catalogue views are named in SQL, and in Spark, whose names of views have no schema.
VIEWS = {"information_schema.tables": "information_schema_tables", "information_schema.columns": "information_schema_columns"}


#: The ids of the two namespaces, and the columns of the pg_catalog views.
NAMESPACES = ((11, "pg_catalog"), (2200, "public"))
PG_VIEWS = {
    "pg_namespace": "oid BIGINT, nspname STRING",
    "pg_class": "oid BIGINT, relname STRING, relnamespace BIGINT, relkind STRING, reltuples FLOAT",
    "pg_attribute": "attrelid BIGINT, attname STRING, attnum SMALLINT, attnotnull BOOLEAN, attisdropped BOOLEAN",
    "pg_tables": "schemaname STRING, tablename STRING, hasindexes BOOLEAN",
    "pg_indexes": "schemaname STRING, tablename STRING, indexname STRING",
}


def oid(name: str) -> int:
    """An id that a table or index keeps as long as its name."""
    return 16384 + zlib.crc32(name.encode())


def pg_catalog(store: Store) -> dict[str, DataFrame]:
    """The views of pg_catalog over a store, by name: a row per table, index and column."""
    rows: dict[str, list[tuple]] = {name: [] for name in PG_VIEWS}
    rows["pg_namespace"] += NAMESPACES
    public = NAMESPACES[1][0]
    for name in store.tables():
        snapshot = store.snapshot(name)
        table = snapshot.table
        rows["pg_class"].append((oid(name), name, public, "r", float(snapshot.rows)))
        rows["pg_tables"].append(("public", name, bool(table.indexes)))
        rows["pg_attribute"] += [(oid(name), c.name, i, not c.nullable, False) for i, c in enumerate(table.columns, 1)]
        for index in table.indexes:
            rows["pg_class"].append((oid(index.name), index.name, public, "i", float(snapshot.rows)))
            rows["pg_indexes"].append(("public", name, index.name))
    return {name: store.spark.createDataFrame(rows[name], columns) for name, columns in PG_VIEWS.items()}


def register_views(store: Store, sql: str) -> None:
    """The catalogue as temporary views, if a query names one of them."""
    words = set(re.findall(r"\w+", sql.lower()))
    if "information_schema" in words:
        for view, rows in zip(VIEWS.values(), information_schema(store), strict=True):
            rows.createOrReplaceTempView(view)
    if words & PG_VIEWS.keys():
        for view, rows in pg_catalog(store).items():
            rows.createOrReplaceTempView(view)
