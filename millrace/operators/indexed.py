"""The orders table in a store with indexes, for the queries that read through them."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dml
from ..meta import Column, Index, Table
from ..session import Session
from ..store import Store
from .registry import Tables

#: The session and data directory of the last table made: queries over the same directory share it.
_made: dict[tuple[str, str], Session] = {}

INDEXES = (
    Index("by_status", ("o_orderstatus", "o_orderdate"), ("o_orderpriority",)),
    Index("by_customer", ("o_custkey",)),
)
ORDERS = Table("orders", (Column("o_orderkey", "int64", False), Column("o_custkey", "int64"), Column("o_orderstatus", "utf8"), Column("o_totalprice", "float64"), Column("o_orderdate", "timestamp"), Column("o_orderpriority", "utf8")), "o_orderkey")


def folder(spark: SparkSession) -> str:
    """A new folder for a store: in the shared folder of a cluster, else under /tmp. It goes when the application ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    out = f"{(root or 'file://' + tempfile.gettempdir()).rstrip('/')}/millrace-store-{os.getpid()}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return out


def typed(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c.name).cast(c.kind.spark) for c in ORDERS.columns])


def orders(t: Tables) -> Session:
    """A session over a store that holds orders with both indexes, filled by insert and backfill."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _made:
        store = Store(t.spark, folder(t.spark))
        snapshot, _ = dml.insert(store, store.create(ORDERS), typed(t("orders")))
        for index in INDEXES:
            snapshot = dml.create_index(store, snapshot, index)
        _made.clear()
        _made[key] = Session(t.spark, store)
    return _made[key]
