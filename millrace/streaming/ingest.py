"""Streams: inserts per micro-batch with the table's checks, windows with a watermark, sessions, state by key."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import dml
from ..store import Store


def ingest(stream: DataFrame, store: Store, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Inserts each micro-batch as one snapshot, all or nothing; a key that exists already stops the stream with 23505.

    The manifest of a batch records the stream (its checkpoint) and the batch's number with the rows, so a batch that
    is delivered again after a restart is known and skipped.
    """

    def write(batch: DataFrame, number: int) -> None:
        snapshot = store.snapshot(table)
        if snapshot.table.batches.get(checkpoint, -1) >= number:
            return
        marked = replace(snapshot.table, batches=snapshot.table.batches | {checkpoint: number})
        dml.insert(store, replace(snapshot, table=marked), batch)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed(stream: DataFrame, time: str, keys: list[str], length: str, slide: str | None = None, late: str = "10 minutes", value: str | None = None) -> DataFrame:
    """Counts (and sums) per window and keys; rows later than the watermark are dropped and state is let go."""
    aggregates = [F.count("*").alias("n"), *([F.sum(value).alias("total")] if value else [])]
    window = F.window(time, length, slide) if slide else F.window(time, length)
    out = stream.withWatermark(time, late).groupBy(window, *keys).agg(*aggregates)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", *(["total"] if value else []))


def keyed(stream: DataFrame, time: str, keys: list[str], value: str, late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """Running count, sum and last time of each key, held as state from batch to batch. For output mode update.

    A batch gives a row for each key that it holds; a key whose last row lies `idle_ms` behind the watermark gives a
    last one (closed) and is forgotten, so state doesn't grow with all keys ever seen. Rows without a time and rows later
    than the watermark are dropped; a null value adds nothing to the sum. A key's rows come in chunks, so a hot key holds
    no more memory than another.
    """
    names = (*keys, "n", "total", "last_ms", "closed")

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, last = state.get if state.exists else (0, 0.0, 0)
        closed = state.hasTimedOut
        if closed:
            state.remove()
        else:
            for chunk in chunks:
                n, total, last = n + len(chunk), total + float(chunk["_value"].sum()), max(last, int(chunk["_ms"].max()))
            state.update((n, total, last))
            state.setTimeoutTimestamp(last + idle_ms)
        yield pd.DataFrame([(*key, n, total, last, closed)], columns=names)

    rows = stream.where(F.col(time).isNotNull()).withWatermark(time, late).select(*keys, time, F.col(value).cast("double").alias("_value"), F.unix_millis(time).alias("_ms"))
    out = T.StructType([*[stream.schema[k] for k in keys], *T._parse_datatype_string("n BIGINT, total DOUBLE, last_ms BIGINT, closed BOOLEAN").fields])
    return rows.groupBy(*keys).applyInPandasWithState(step, out, "n BIGINT, total DOUBLE, last_ms BIGINT", "update", GroupStateTimeout.EventTimeTimeout)


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of rows no further apart than `gap`."""
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")
