"""Near-duplicate embeddings by cross-polytope hashing (Andoni et al. 2015).

A vector is rotated by sign flips and fast Hadamard transforms, three times over; its hash is the nearest of the 2d
signed axes. A bucket of a table is a few such hashes, the last of which looks at some of the axes only: how many is
set by the count of vectors (`shape`), so that buckets stay as full at any size. Every vector lies in its own bucket and is also sent to a
few neighbouring buckets (multiprobe: the next-best axis of either hash). Two vectors are a candidate pair of a table if
one's own bucket is among the other's; pairs are confirmed by cosine in double precision inside the bucket, as blocks
of one matrix product, and counted in the first table that makes them candidates. So no pair ever leaves its block:
a block gives each vector's number of links and the edges of a spanning forest. Equal vectors fall into one class
before hashing, and a bucket with very many vectors is cut into blocks that go to different tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, array_runs
from .components import connected

PROBES, BLOCK, STRIP = 3, 2048, 512
#: Vectors that a bucket should hold of its own.
LOAD = 32
#: Tables by the number of hashes: these miss at most some 3 in a million pairs at a cosine of 0.95 in 64 dimensions.
TABLES = {2: 8, 3: 16, 4: 28}
LEAST = 0.95


class Shape(NamedTuple):
    """How many tables, hashes in a table, probes, and axes that the last hash of a table looks at."""

    tables: int
    hashes: int
    probes: int
    last: int


def width(dim: int) -> int:
    return max(2, 1 << (dim - 1).bit_length())


def shape(classes: int, dim: int, probes: int = PROBES, load: int = LOAD) -> Shape:
    """The least number of buckets that keeps `load` of `classes` vectors in one, if they lie evenly."""
    w, wanted = width(dim), classes / load
    for hashes, tables in TABLES.items():
        last = 2
        while last < w and (2 * w) ** (hashes - 1) * 2 * last < wanted:
            last *= 2
        if (2 * w) ** (hashes - 1) * 2 * last >= wanted:
            break
    return Shape(6 if hashes == 2 and last <= 8 else tables, hashes, probes, last)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths; the width must be a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


class CrossPolytope:
    """Buckets of unit vectors: for each table its own, then the probes, in order of what they lose in height."""

    def __init__(self, dim: int, tables: int, hashes: int, probes: int, last: int, seed: int = 11):
        self.width = width(dim)
        self.tables, self.hashes, self.probes, self.last = tables, hashes, probes, min(last, self.width)
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, hashes, 3, self.width))

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """(n, tables, 1 + probes) of int64; places past the last probe repeat the own bucket."""
        n, w = len(unit), self.width
        x = np.zeros((n, w))
        x[:, : unit.shape[1]] = unit
        out = np.empty((n, self.tables, 1 + self.probes), np.int64)
        for t in range(self.tables):
            codes, loss = np.zeros((n, 1), np.int64), np.zeros((n, 1))
            for k, signs in enumerate(self.signs[t]):
                y = x
                for s in signs:
                    y = hadamard(y * s)
                if k == self.hashes - 1:
                    y = y[:, : self.last]
                size, axes = np.abs(y), y.shape[1]
                few = min(self.probes + 1, axes)
                best = np.argpartition(-size, few - 1, axis=1)[:, :few] if few < axes else np.tile(np.arange(axes), (n, 1))
                best = np.take_along_axis(best, np.argsort(-np.take_along_axis(size, best, 1), axis=1, kind="stable"), 1)
                top = np.take_along_axis(size, best, 1)
                axis = 2 * best + (np.take_along_axis(y, best, 1) < 0)
                codes = (codes[:, :, None] * (2 * w) + axis[:, None, :]).reshape(n, -1)
                loss = (loss[:, :, None] + ((top[:, :1] - top) ** 2)[:, None, :]).reshape(n, -1)
            pick = np.argsort(loss, axis=1, kind="stable")[:, : 1 + self.probes]
            got = np.take_along_axis(codes, pick, 1)
            out[:, t, : got.shape[1]] = got
            out[:, t, got.shape[1] :] = got[:, :1]
        return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled by the largest part first, so nothing overflows or vanishes."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def units(vectors: list[bytes], kind: str) -> np.ndarray:
    """An array of unit vectors, each of its own width, from vectors in bytes; made at once for those alike in width."""
    sizes = np.array([len(v) for v in vectors])
    out = np.empty(len(vectors), object)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size).tolist()
        for i, row in zip(at, unit_rows(np.frombuffer(b"".join([vectors[i] for i in at]), kind).reshape(len(at), -1)), strict=True):
            out[i] = row
    return out


def first_seen(a: np.ndarray, b: np.ndarray, table: int, bucket: int) -> np.ndarray:
    """Whether pairs (rows of codes) are candidates in this bucket of this table and in none before it."""
    own_a, own_b = a[:, :, 0], b[:, :, 0]
    in_a, in_b = (a == own_b[:, :, None]).any(axis=2), (b == own_a[:, :, None]).any(axis=2)
    before = (in_a | in_b)[:, :table].any(axis=1)
    far = np.iinfo(np.int64).max
    here = np.minimum(np.where(in_a[:, table], own_b[:, table], far), np.where(in_b[:, table], own_a[:, table], far))
    return ~before & (here == bucket)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row reachable from each of n rows over the pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class Block:
    """Links among the rows of one bucket, or between two blocks of its rows."""

    def __init__(self, least: float, shapes: dict[int, Shape]):
        self.least, self.shapes, self.hashers = least, shapes, {}

    def links(self, table: int, bucket: int, ids: np.ndarray, weights: np.ndarray, own: np.ndarray, side: np.ndarray, unit: np.ndarray):
        """(ids, links, other) of the rows that have links found first here."""
        split = int(np.searchsorted(side, 1))  # rows come in order of side
        alone = split == len(side)
        found = []
        for k in range(0, split, STRIP):  # strips bound the memory of the product
            from_ = k if alone else split
            a, b = np.nonzero(unit[k : min(k + STRIP, split)] @ unit[from_:].T >= self.least)
            a, b = a + k, b + from_
            found.append(np.stack([a, b])[:, a < b])
        a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        ok = (own[a] | own[b]) & (ids[a] != ids[b])
        a, b = a[ok], b[ok]
        if not len(a):
            return None
        dim = unit.shape[1]
        if dim not in self.hashers:
            self.hashers[dim] = CrossPolytope(dim, *self.shapes[dim])
        used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        codes = self.hashers[dim].buckets(unit[used])
        ca, cb = at[: len(a)], at[len(a) :]
        first = np.concatenate([first_seen(codes[ca[k : k + 50_000]], codes[cb[k : k + 50_000]], table, bucket) for k in range(0, len(a), 50_000)])
        a, b = a[first], b[first]
        if not len(a):
            return None
        count = np.zeros(len(ids), np.int64)
        np.add.at(count, a, weights[b])
        np.add.at(count, b, weights[a])
        rows = np.flatnonzero(count)
        return ids[rows], count[rows], ids[forest(len(ids), a, b)[rows]]


def near_vectors(table: DataFrame, least: float = LEAST, probes: int = PROBES, load: int = LOAD, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `table` (vec_id, embedding, any others).

    Links: vectors whose cosine is `least` or more. n_links: how many other vectors a vector is linked with directly;
    component_id: the least vec_id reachable, its own included; kept: vec_id = component_id. A vector that is null,
    empty, zero, or holds a null or non-finite part links with nothing, nor do vectors of different widths with each
    other. Rows that share a vec_id are one vector with all their links; very long vectors are compared whole. A row whose vec_id is null links with nothing, has a
    null component_id and is kept. An empty table gives an empty result.
    """
    scratch = scratch or Scratch(table.sparkSession, "vectors")
    kind = "<f4" if "float" in table.schema["embedding"].dataType.simpleString() else "<f8"
    part = "float" if kind == "<f4" else "double"
    named = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{part}>").alias("e"))
    usable = "vec_id is not null and e is not null and size(e) > 0 and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(e, x -> x <> 0)"
    rows = named.where(F.expr(f"coalesce({usable}, false)")).select("vec_id", F.xxhash64("e").alias("h1"), F.hash("e").alias("h2"), "e")
    members = scratch.save(rows.select("vec_id", "h1", "h2").distinct(), "members")
    classes = scratch.save(members.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "classes")
    single = rows.join(classes.withColumnRenamed("rep", "vec_id"), ["vec_id", "h1", "h2"]).dropDuplicates(["vec_id", "h1", "h2"]).select("vec_id", "weight", "e")
    # a row for each width that occurs; an embedding table has one or a few
    shapes = {r["d"]: shape(r["n"], r["d"], probes, load) for r in rows.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).collect()}

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers: dict[int, CrossPolytope] = {}
        for batch in batches:
            vectors = [np.array(v, kind) for v in batch["e"].to_pylist()]
            codes: list = [None] * len(vectors)
            widths = np.array([len(v) for v in vectors])
            for dim in np.unique(widths):
                at = np.flatnonzero(widths == dim)
                h = hashers.setdefault(int(dim), CrossPolytope(int(dim), *shapes[int(dim)]))
                for i, c in zip(at, h.buckets(unit_rows(np.stack([vectors[i] for i in at]))), strict=True):
                    codes[i] = c.tolist()
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["weight"], pa.array(widths.astype(np.int32)), pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array(codes, pa.list_(pa.list_(pa.int64())))], names=["vec_id", "weight", "dim", "vec", "codes"])

    coded = scratch.save(single.mapInArrow(hashed, "vec_id long, weight long, dim int, vec binary, codes array<array<long>>"), "codes")
    by_table = F.posexplode("codes").alias("t", "c")
    sent = coded.select("vec_id", "weight", "dim", "vec", by_table).select("*", F.col("c")[0].alias("mine"), F.explode(F.array_distinct("c")).alias("bucket")).withColumn("own", F.col("bucket") == F.col("mine")).drop("c", "mine")
    sizes = coded.select("dim", by_table).select("dim", "t", F.col("c")[0].alias("mine"), F.explode(F.array_distinct("c")).alias("bucket"))
    sizes = sizes.groupBy("dim", "t", "bucket").agg(F.count("*").alias("n"), F.max(F.col("bucket") == F.col("mine")).alias("any")).where("n > 1 and any").select("dim", "t", "bucket", F.ceil(F.col("n") / block).cast("int").alias("of"))
    sizes = scratch.save(sizes, "sizes")  # written, so that the rows of a hot bucket can be split in the join
    key = ["dim", "t", "bucket", "i", "j"]
    dealt = sent.join(sizes, ["dim", "t", "bucket"]).withColumn("at", F.expr("pmod(xxhash64(vec_id), of)")).withColumn("other", F.explode(F.expr("sequence(0, of - 1)")))
    dealt = dealt.select("dim", "t", "bucket", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), F.when(F.col("at") > F.col("other"), 1).otherwise(0).alias("side"), "vec_id", "weight", "own", "vec")
    dealt = dealt.repartition(*key).sortWithinPartitions(*key, "side", "vec_id")

    def arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        out = {k: batch[k].to_numpy(zero_copy_only=False) for k in ("vec_id", "weight", "own", "side")}
        return out | {"unit": units(batch["vec"].to_pylist(), kind)}

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Block(least, shapes)
        for (_, t, bucket, *_), rows in array_runs(batches, key, arrays):
            found = blocks.links(t, bucket, *(rows[k] for k in ("vec_id", "weight", "own", "side")), np.stack(rows["unit"])) if len(rows["side"]) > 1 else None
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["vec_id", "links", "other"])

    found = scratch.save(dealt.mapInArrow(linked, "vec_id long, links long, other long"), "links")
    counts = scratch.save(found.groupBy("vec_id").agg(F.sum("links").alias("links")).withColumnRenamed("vec_id", "rep"), "counts")
    own = members.join(classes, ["h1", "h2"]).select("vec_id", "rep", (F.col("weight") - 1).alias("copies"))
    edges = found.where("vec_id <> other").select(F.col("vec_id").alias("u"), F.col("other").alias("v")).unionByName(own.where("vec_id <> rep").select(F.col("vec_id").alias("u"), F.col("rep").alias("v")))
    labels = scratch.save(connected(edges, scratch), "labels")
    per = own.join(counts, "rep", "left").groupBy("vec_id").agg(F.sum(F.col("copies") + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = named.select("vec_id").join(per, "vec_id", "left").join(labels.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def brute_force(rows: list[tuple[int, list | None]], least: float = LEAST) -> dict[int, tuple[int, int]]:
    """vec_id -> (n_links, component_id) from all pairs; for tests on small tables of one width."""
    ids = [i for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    kept = dict(rows)
    out = {i: (0, i) for i, _ in rows}
    if ids:
        unit = unit_rows(np.array([kept[i] for i in ids], float))
        near = unit @ unit.T >= least
        np.fill_diagonal(near, False)
        order = np.argsort(ids, kind="stable")
        near = near[np.ix_(order, order)]
        label = forest(len(ids), *np.nonzero(near))
        ids = np.array(ids)[order]
        out |= {int(i): (int(n), int(ids[c])) for i, n, c in zip(ids, near.sum(axis=1), label, strict=True)}
    return out
