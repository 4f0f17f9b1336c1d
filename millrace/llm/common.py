"""Shared parts: scratch tables, word hashing, ranks that survive hot keys."""

from __future__ import annotations

import os
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
#: Odd 64-bit multipliers (from the golden ratio and the finaliser of splitmix64).
GOLDEN = U64(0x9E3779B97F4A7C15)
MIX_1 = U64(0xBF58476D1CE4E5B9)
MIX_2 = U64(0x94D049BB133111EB)


#: Rows that one file of a small written table holds at least.
ROWS_PER_FILE = 200_000


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster, from spark.checkpoint.dir.

    Where that is unset, a folder under /tmp serves a session that runs in one process; a cluster has to name one.
    """
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")


def importable(spark: SparkSession) -> None:
    """Lets the tasks' Python import this package from where the driver has it, wherever that was started.

    On a cluster without that path the package comes with --py-files, which the workers look up as well.
    """
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    have = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in have:
        environment["PYTHONPATH"] = os.pathsep.join([root, *have])


class Scratch:
    """Tables that cut lineage, written to the shared folder and dropped when the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        importable(spark)
        self.spark = spark
        self.base = f"{scratch_root(spark).rstrip('/')}/millrace-{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.base)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.deleteOnExit(path)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str, most_rows: int | None = None) -> DataFrame:
        """Writes a table and reads it back. most_rows: a bound of its rows, so that few rows don't make many small files."""
        if most_rows is not None:
            df = df.coalesce(1 + most_rows // ROWS_PER_FILE)
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name)), True)


def fresh(columns: list[str], name: str) -> str:
    """`name`, with marks before it until no column is called so (names are compared as Spark does, without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def named(columns: list[str]) -> list[Column]:
    """Columns by their exact names, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """mapInArrow for columns of any name, which it can't look up if there are dots in them."""
    names = df.columns
    inner = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(b.rename_columns(names) for b in batches):
            yield out.rename_columns(inner.names)

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(renamed, inner).toDF(*schema.names)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows and about so many bytes at most, so that what is made of a batch stays small."""
    for batch in batches:
        step = max(1, min(rows, len(batch) * size // max(1, batch.nbytes)))
        for at in range(0, len(batch), step):
            yield batch.slice(at, step)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over unsigned 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * MIX_1
    x = x ^ (x >> U64(27))
    x = x * MIX_2
    return x ^ (x >> U64(31))


#: Bytes of a dict's slot, with what the table keeps free.
SLOT = 100


class WordHashes(dict):
    """64-bit hash of each word seen. Full, it keeps what came first, which holds the frequent ones.

    `room` bounds its memory in bytes, however long the words are.
    """

    room = 40 << 20

    def __missing__(self, word: bytes) -> int:
        h = self.hash_of(word)
        size = sys.getsizeof(word) + sys.getsizeof(h) + SLOT
        if size <= self.room:
            self[word] = h
            self.room -= size
        return h

    def hash_of(self, word: bytes) -> int:
        return xxhash.xxh64_intdigest(word)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


_shared: dict = {}


def shared(kind: type) -> WordHashes:
    """The process's table of a kind: tasks that share a Python worker share what it has seen. Two kinds at most stay."""
    if kind not in _shared:
        if len(_shared) > 1:
            _shared.clear()
        _shared[kind] = kind()
    return _shared[kind]


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` in UTF-8; none for a null. bytes.split() cuts at just these six characters."""
    return text.encode("utf-8", "replace").split() if text else []


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words; of the whole where there are fewer; none where there are none."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    out = np.zeros(len(hashes) - n + 1, U64) + U64(n)
    for i in range(n):
        out = mix(out * GOLDEN + hashes[i : len(hashes) - n + 1 + i])
    return out


def ranked(df: DataFrame, key: str, order: list[str], rank: str = "rank", per_bucket: int = 100_000, few_keys: bool = False) -> DataFrame:
    """Adds the place of each row (from 0) among those with the same key, in the order of `order` within hash buckets.

    A key with very many rows is dealt over as many buckets as it needs, so that no task holds all of them:
    place = rows in the earlier buckets of the key + place in the bucket. `df` must be a written table, as it is read
    three times; rows alike in `order` are told apart by where they are written, so they are dealt over the buckets
    too. The sums run over one row for each key and bucket. few_keys: the keys are bounded by their definition
    (lengths, cells of a grid), so their counts are broadcast. Keys must not be null.
    """
    df = df.withColumns({"_file": F.xxhash64("_metadata.file_name"), "_row": F.col("_metadata.row_index")})
    order = [*order, "_file", "_row"]
    buckets = df.groupBy(key).agg(F.count("*").alias("_n")).select(key, F.ceil(F.col("_n") / per_bucket).cast("int").alias("_of"))
    dealt = df.join(F.broadcast(buckets) if few_keys else buckets, key).withColumn("_b", F.expr(f"pmod(xxhash64({', '.join(order)}), _of)")).drop("_of")
    counts = dealt.groupBy(key, "_b").agg(F.count("*").alias("_n"))
    before = counts.select(key, "_b", (F.sum("_n").over(Window.partitionBy(key).orderBy("_b")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy(key, "_b").orderBy(*order)) - 1
    return dealt.withColumn("_place", place).join(before, [key, "_b"]).withColumn(rank, F.col("_before") + F.col("_place")).drop("_b", "_before", "_place", "_file", "_row")


def array_runs(batches: Iterator[pa.RecordBatch], key: list[str], arrays: Callable[[pa.RecordBatch], dict[str, np.ndarray]]) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """As runs(), for very many short runs: `arrays` turns a whole batch at once, and a run is a slice of its arrays."""
    held: dict[str, np.ndarray] | None = None
    held_key: tuple = ()
    for batch in batches:
        if not len(batch):
            continue
        keys, found = np.stack([batch[k].to_numpy() for k in key], axis=1), arrays(batch)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        names = keys[cuts[:-1]].tolist()
        for start, end, name in zip(cuts[:-1], cuts[1:], names, strict=True):
            part = {k: v[start:end] for k, v in found.items()}
            if held is not None:
                if tuple(name) == held_key:
                    held = {k: np.concatenate([held[k], part[k]]) for k in part}
                    continue
                yield held_key, held
            held, held_key = part, tuple(name)
    if held is not None:
        yield held_key, held


def runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) for each run of rows with equal whole-number keys, over the ends of batches too."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch[k].to_numpy() for k in key], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(keys[start].tolist())
            if held and now != held_key:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held, held_key = [*held, batch.slice(start, end - start)], now
    if held:
        yield held_key, pa.Table.from_batches(held)
