"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams (McMahan et al. 2013).

Fitting takes a bounded sample of labelled rows (`FIT_ROWS`, those with the least hash of doc_id, so the same rows at
any partitioning) through one task, a row at a time: per-coordinate rates, L1 sparsity. That task holds the examples'
coordinates as bytes, at most `FIT_BYTES` of them. The weights that come back are at most 2**bits pairs of numbers, mostly
far fewer; that bound is what makes them fit to broadcast. Scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import GOLDEN, MIX_1, U64, WordHashes, importable, mapped, named, shared, slices

BITS = 20
FIT_ROWS = 30_000
#: Of the sample's coordinates, two or four bytes each; examples beyond teach nothing.
FIT_BYTES = 192 << 20
THRESHOLD = 0.7
#: What surrounds letters and digits in a word; ASCII only, so that accented letters stay.
EDGES = re.compile(rb"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$")


class Weights(NamedTuple):
    """Sparse weights: coordinates in ascending order, their values, the bias, the bits of a coordinate."""

    at: np.ndarray
    value: np.ndarray
    bias: float
    bits: int

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits)
        out[self.at] = self.value
        return out


class BareHashes(WordHashes):
    """Hash of each word without the ASCII marks around it."""

    def hash_of(self, word: bytes) -> int:
        return xxhash.xxh64_intdigest(EDGES.sub(b"", word))


class Features:
    """Coordinates of a text: its words, runs of two and three, and pairs with one or two words skipped between.

    A coordinate counts once however often it occurs, so that length alone moves nothing.
    """

    def __init__(self, bits: int = BITS):
        self.shift, self.words = U64(64 - bits), shared(BareHashes)

    def all(self, text: str | None) -> np.ndarray:
        """Every occurrence's coordinate."""
        words = (text or "").lower().encode("utf-8", "replace").split()
        if not words:
            return np.array([], np.int64)
        h = self.words.of(words)
        parts = [h * GOLDEN]
        for kind, gaps in enumerate(((1,), (1, 2), (2,), (3,)), 1):
            if len(h) > gaps[-1]:
                n = len(h) - gaps[-1]
                out = h[:n] + U64(kind)
                for g in gaps:
                    out = (out ^ (out >> U64(29))) * MIX_1 + h[g : g + n]
                parts.append((out ^ (out >> U64(32))) * GOLDEN)
        return (np.concatenate(parts) >> self.shift).astype(np.int64)

    def of(self, text: str | None) -> np.ndarray:
        return np.unique(self.all(text))

    def logit(self, text: str | None, dense: np.ndarray, used: np.ndarray) -> float:
        """Sum of the weights of the text's coordinates; only those with a weight (`used`) are sorted out."""
        at = self.all(text)
        return float(dense[np.unique(at[used[at]])].sum())


class Ftrl:
    """One pass or more over examples; the state is two vectors of 2**bits."""

    def __init__(self, bits: int = BITS, alpha: float = 2.0, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0):
        self.bits, self.alpha, self.beta, self.l1, self.l2 = bits, alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)  # the last one is the bias

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] += g * g

    def result(self) -> Weights:
        w = self.weights(np.arange(len(self.z)))
        at = np.flatnonzero(w[:-1])
        return Weights(at, w[at], float(w[-1]), self.bits)


def packed(at: np.ndarray) -> bytes:
    """Coordinates in ascending order as the steps between them, of two or four bytes."""
    steps = np.diff(at, prepend=0)
    size = 2 if steps.max(initial=0) < 1 << 16 else 4
    return bytes([size]) + steps.astype(f"<u{size}").tobytes()


def unpacked(data) -> np.ndarray:
    view = memoryview(data)
    return np.cumsum(np.frombuffer(view[1:], f"<u{view[0]}"), dtype=np.int64)


def learn(batches: Iterator[pa.RecordBatch], model: Ftrl, passes: int, room: int) -> Iterator[pa.RecordBatch]:
    """The weights, as one row, after `passes` over the examples (at: packed coordinates, label), of `room` bytes at most.

    The coordinates stay where Arrow has them and are unpacked one example at a time.
    """
    held = []
    for batch in batches:
        held.append((batch["at"], batch["label"].to_pylist()))
        room -= batch["at"].nbytes
        if room < 0:
            break
    for _ in range(passes):
        for coordinates, labels in held:
            for at, label in zip(coordinates, labels, strict=True):
                model.learn(unpacked(at.as_buffer()), label)
    w = model.result()
    yield pa.RecordBatch.from_arrays([pa.array([w.at.astype(np.int64).tobytes()]), pa.array([w.value.tobytes()]), pa.array([w.bias])], names=["at", "value", "bias"])


def fit(docs: DataFrame, labels: DataFrame, where: str = "true", bits: int = BITS, rows: int = FIT_ROWS, passes: int = 2) -> Weights:
    """Weights from at most `rows` labelled documents for which `where` (over doc_id) holds.

    Labels other than 0 and 1, and null texts or ids, teach nothing; with no row left every score is 0.5. Examples come
    in the order of a hash of doc_id, then text, so the result doesn't depend on the partitioning. Labels are first cut
    to the sample, so only the sample's texts are shuffled.
    """
    importable(docs.sparkSession)
    order = F.xxhash64("doc_id")
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").where(where)
    sample = given.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(order, "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    chosen = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for batch in slices(batches):
            at = [packed(features.of(t)) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(at, pa.binary()), batch["label"]], names=["doc_id", "at", "label"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return learn(batches, Ftrl(bits), passes, FIT_BYTES)

    seen = chosen.mapInArrow(coordinates, "doc_id long, at binary, label int")
    one = seen.repartition(1).sortWithinPartitions(order, "doc_id", "at").select("at", "label").mapInArrow(train, "at binary, value binary, bias double").first()
    if one is None:
        return Weights(np.array([], np.int64), np.array([]), 0.0, bits)
    return Weights(np.frombuffer(one.at, np.int64), np.frombuffer(one.value), one.bias, bits)


def score(docs: DataFrame, weights: Weights, threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """`docs` with `score` (0 to 1) and `predicted` (1 if score >= threshold), as `names`; such columns are replaced.

    A null or empty text scores by the bias alone. Every other column passes through.
    """
    importable(docs.sparkSession)
    keep = [c for c in docs.columns if c not in names]
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    docs = docs.select(*named(keep))
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        dense, features = w.dense(), Features(w.bits)
        used = dense != 0
        for batch in slices(batches):
            logits = np.array([features.logit(t, dense, used) + w.bias for t in batch["text"].to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(logits, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*batch.schema.names, *names])

    return mapped(docs, run, schema)


def held_out(column: str = "doc_id") -> str:
    """SQL: the third of documents whose labels are never learnt from."""
    return f"crc32(cast({column} as string)) % 3 = 1"


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs` (doc_id, text, others), whole texts.

    Learns from the labels outside the held-out third. A null doc_id is not held out and teaches nothing. A null or empty
    text scores by the bias alone; a very long one is read whole. Repeated rows score alike, and of labels that differ
    for one doc_id the greatest counts. Extra columns are ignored, whatever their names. An empty table gives an empty
    result; without labels every score is 0.5.
    """
    weights = fit(docs, labels, f"not ({held_out()})", rows=fit_rows)
    out = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), weights, threshold)
    return out.select("doc_id", F.coalesce(F.expr(held_out()), F.lit(False)).alias("held_out"), "score", "predicted")
