"""Quality classifier from weak labels.

Several heuristic labellers vote good, bad or nothing on each text. Expectation-maximisation over the counts of vote
patterns (at most 3**labellers, whatever the corpus) estimates how often each labeller says what about good and about
bad texts, and so the posterior of each pattern. The posteriors of a bounded sample then train a hashed linear scorer,
which judges every text by its words and word shapes as well, where the labellers abstain or disagree.
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

from .common import GOLDEN, MIX_1, U64, WordHashes, importable, shared, slices
from .toxicity import FIT_BYTES, Ftrl, Weights, learn, packed

BITS = 18
FIT_ROWS = 20_000
THRESHOLD = 0.5
GOOD, NONE, BAD = 2, 1, 0

UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
MARKS = b"#*$%&|<>{}[]~^_=+\\"
#: Function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to in is that for it on with as was by this are at an be or not from have which "
    "de la le les et des en un une du est que qui dans pour sur par avec au "
    "der die das und den von zu mit ist dem für im auf ein eine nicht sich des "
    "el los las una por con para del se su no lo al como".encode().split()
)


def statistics(data: bytes, words: list[bytes]) -> dict[str, float]:
    """Shares that the labellers judge; `words` in lower case."""
    n, size = max(1, len(words)), max(1, len(data))
    letters = max(1, size - len(data.translate(None, LETTERS)))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return {
        "words": len(words),
        "marks": (len(data) - len(data.translate(None, MARKS))) / n,
        "bangs": data.count(b"!") / n,
        "upper": (len(data) - len(data.translate(None, UPPER))) / letters,
        "function": sum(map(FUNCTION_WORDS.__contains__, words)) / n,
        "distinct": len(set(words)) / n * min(1.0, n / 100) + max(0.0, 1 - n / 100),
        "ended": sum(x.rstrip().endswith((b".", b"!", b"?", b":", b'"')) for x in lines) / max(1, len(lines)),
        "pauses": (data.count(b". ") + data.count(b".\n") + data.count(b",")) / n,
    }


#: (statistic, good from, bad from): a labeller is silent between; a good bound under the bad one means less is better.
LABELLERS = (("words", 30, 0), ("marks", 0.05, 0.25), ("bangs", 0.05, 0.3), ("upper", 0.15, 0.5), ("function", 0.15, 0.05), ("distinct", 0.45, 0.25), ("ended", 0.6, 0.2), ("pauses", 0.04, 0.01))


#: Texts with fewer words are too short to judge by these.
SHORT, LONG_ONLY = 20, ("function", "distinct", "ended", "pauses")


def votes(stats: dict[str, float]) -> list[int]:
    out = []
    for name, good, bad in LABELLERS:
        if name in LONG_ONLY and 0 < stats["words"] < SHORT:
            out.append(NONE)
            continue
        x, sign = stats[name], 1 if good > bad else -1
        out.append(GOOD if sign * x >= sign * good else BAD if sign * x <= sign * bad else NONE)
    return out


def pattern(given: list[int]) -> int:
    code = 0
    for v in given:
        code = 3 * code + v
    return code


class LabelModel(NamedTuple):
    """prior: share of good texts. says[j, y, v]: how often labeller j votes v on texts that are good (1) or bad (0)."""

    prior: float
    says: np.ndarray

    def posterior(self, given: np.ndarray) -> np.ndarray:
        """P(good) for each row of votes."""
        logs = np.log(self.says)
        good, bad = np.log(self.prior), np.log(1 - self.prior)
        for j in range(given.shape[1]):
            good, bad = good + logs[j, 1, given[:, j]], bad + logs[j, 0, given[:, j]]
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))

    def accuracies(self) -> np.ndarray:
        """How often each labeller is right when it votes."""
        right = self.prior * self.says[:, 1, GOOD] + (1 - self.prior) * self.says[:, 0, BAD]
        wrong = self.prior * self.says[:, 1, BAD] + (1 - self.prior) * self.says[:, 0, GOOD]
        return right / (right + wrong)


def expectation_maximisation(given: np.ndarray, counts: np.ndarray, rounds: int = 200, smooth: float = 1.0) -> LabelModel:
    """Estimates from vote patterns (rows of `given`) and how many texts have each.

    Starts from the labellers' majority, so that 'good' keeps its sense. The share of bad texts among those that no
    labeller or as many on either side judge starts at a half. With no text every posterior is a half.
    """
    n, k = given.shape
    start = (given == GOOD).sum(axis=1) - (given == BAD).sum(axis=1)
    # a text that two labellers call bad starts as bad: junk shows in few statistics at once
    good = np.where((given == BAD).sum(axis=1) >= 2, 0.1, np.where(start > 0, 0.9, 0.5))
    model = LabelModel(0.5, np.full((k, 2, 3), 1 / 3))
    for _ in range(rounds):
        weight = np.stack([(1 - good) * counts, good * counts])
        says = np.empty((k, 2, 3))
        for j in range(k):
            for v in (BAD, NONE, GOOD):
                says[j, :, v] = weight[:, given[:, j] == v].sum(axis=1) + smooth
        says /= says.sum(axis=2, keepdims=True)
        model = LabelModel(float((weight[1].sum() + smooth) / (weight.sum() + 2 * smooth)), says)
        new = model.posterior(given) if n else good
        if not n or np.abs(new - good).max() < 1e-9:
            break
        good = new
    return model


SHAPES = tuple((re.compile(p), r) for p, r in ((rb"[A-Z]+", b"X"), (rb"[a-z\x80-\xff]+", b"x"), (rb"[0-9]+", b"9")))


class ShapeHashes(WordHashes):
    """Hash of a word's shape: runs of capitals, other letters and digits become one sign each."""

    def hash_of(self, word: bytes) -> int:
        shape = word
        for p, r in SHAPES:
            shape = p.sub(r, shape)
        return xxhash.xxh64_intdigest(shape[:12], seed=7)


class Features:
    """Hashed coordinates: words, word shapes, pairs of shapes, and each statistic's step; each once."""

    def __init__(self, bits: int = BITS):
        self.shift, self.words, self.shapes = U64(64 - bits), shared(WordHashes), shared(ShapeHashes)

    def of(self, text: str | None) -> tuple[np.ndarray, list[int]]:
        """(coordinates, votes)."""
        data = (text or "").encode("utf-8", "replace")
        words, lower = data.split(), data.lower().split()
        stats = statistics(data, lower)
        parts = [np.array([xxhash.xxh64_intdigest(f"{k}:{int(np.log2(v + 1 / 64) * 2)}") for k, v in stats.items()], U64)]
        if words:
            parts.append(np.unique(self.words.of(lower)) * GOLDEN)
            s = self.shapes.of(words)
            pairs = (s[:-1] ^ (s[:-1] >> U64(29))) * MIX_1 + s[1:]
            parts += [np.unique(s) * GOLDEN, np.unique(pairs) * GOLDEN]
        return np.unique((np.concatenate(parts) >> self.shift).astype(np.int64)), votes(stats)


def label_model(docs: DataFrame) -> tuple[LabelModel, dict[int, float]]:
    """The model from every text, and the posterior of each pattern."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text in batch["text"].to_pylist():
                data = (text or "").encode("utf-8", "replace")
                out.append(pattern(votes(statistics(data, data.lower().split()))))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["pattern"])

    seen = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "pattern long").groupBy("pattern").count().collect()
    codes = np.array([r["pattern"] for r in seen], np.int64)
    k = len(LABELLERS)
    given = np.stack([codes // 3 ** (k - 1 - j) % 3 for j in range(k)], axis=1) if len(codes) else np.zeros((0, k), np.int64)
    model = expectation_maximisation(given, np.array([r["count"] for r in seen], float))
    return model, dict(zip(codes.tolist(), model.posterior(given).tolist(), strict=True)) if len(codes) else {}


def fit(docs: DataFrame, posteriors: dict[int, float], bits: int = BITS, rows: int = FIT_ROWS, passes: int = 2) -> Weights:
    """Weights of the scorer from the posteriors of at most `rows` different texts: those with the least hash of doc_id and text."""
    order = F.xxhash64("doc_id", "text_hash")
    named = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    cut = named.select(order.alias("o")).distinct().orderBy("o").limit(rows).agg(F.max("o")).first()[0]
    if cut is None:
        return Weights(np.array([], np.int64), np.array([]), 0.0, bits)
    sent = docs.sparkSession.sparkContext.broadcast(posteriors)

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for batch in slices(batches):
            found = [features.of(t) for t in batch["text"].to_pylist()]
            label = [sent.value.get(pattern(v), 0.5) for _, v in found]
            yield pa.RecordBatch.from_arrays([batch["o"], pa.array([packed(a) for a, _ in found], pa.binary()), pa.array(label, pa.float64())], names=["o", "at", "label"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return learn(batches, Ftrl(bits, alpha=0.5, l1=2.0), passes, FIT_BYTES)

    sample = named.withColumn("o", order).where(F.col("o") <= cut).select("o", "text").dropDuplicates(["o"]).mapInArrow(coordinates, "o long, at binary, label double")
    one = sample.repartition(1).sortWithinPartitions("o", "at").select("at", "label").mapInArrow(train, "at binary, value binary, bias double").first()
    return Weights(np.frombuffer(one.at, np.int64), np.frombuffer(one.value), one.bias, bits)


def quality(docs: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, score, posterior, kept) for every row of `docs` (doc_id, text, others): score is P(good), 0 to 1.

    posterior: what the labellers alone say. kept: score >= threshold. A null or empty text has no words: it gets a
    score like any other, and the labellers call it bad. A very long text is read whole. Repeated rows score alike; a
    null doc_id stays null. Rows that tie at the end of the fitted sample (equal doc_id and text) are alike, and those
    beyond `fit_rows` teach nothing more. Extra columns are ignored; an empty table gives an empty result.
    """
    _, posteriors = label_model(docs)
    sent = docs.sparkSession.sparkContext.broadcast((fit(docs, posteriors, rows=fit_rows), posteriors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, known = sent.value
        dense, features = weights.dense(), Features(weights.bits)
        for batch in slices(batches):
            found = [features.of(t) for t in batch["text"].to_pylist()]
            logits = np.array([dense[at].sum() + weights.bias for at, _ in found])
            p = 1 / (1 + np.exp(-np.clip(logits, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(p), pa.array([known.get(pattern(v), 0.5) for _, v in found], pa.float64()), pa.array(p >= threshold)], names=["doc_id", "score", "posterior", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, posterior double, kept boolean")
