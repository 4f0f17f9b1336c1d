"""Substring dedup over sliding sentence spans.

Texts are cut at places that the words themselves decide: where a sentence ends, and in longer stretches before the
words of least hash. So a passage is cut alike in every text that holds it, wherever it begins in a sentence and with or
without marks. Runs of SPAN sentences or pieces (see `ranges`) are hashed and looked up in the whole table; pieces covered
by a run that is not its first occurrence are removed. Any 51 words that came before hold such a run; of a longer passage
up to 15 words at its head and 22 at its tail can stay where it begins or ends in mid-sentence. Occurrences are ordered by doc_id, then by place in the text. Runs that repeat inside one text are found
while the text is read; across texts a run needs only its least doc_id, which is a partial aggregate, so a passage that
a third of all texts share is never gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import GOLDEN, U64, Scratch, WordHashes, fresh, mapped, mix, named, shared, slices

SPAN = 3
#: A piece ends after [.!?] before white space, or before a word of least hash, after so many words at the latest.
LONGEST = 8
#: Runs have at least so many words; fewer are chance repeats of short sentences.
LEAST_WORDS = 12
#: Runs of pieces that are not whole sentences have at least so many. Any 51 words that repeat hold a whole run:
#: 3 * LONGEST - 1 + max(SPAN * LONGEST, LEAST_CUT + LONGEST - 1) is 51.
LEAST_CUT = 21
WORD = re.compile(r"\S+")
BACK = U64(pow(int(GOLDEN), -1, 2**64))


class EndHashes(WordHashes):
    """The hash of each word; its lowest bit says whether a sentence ends with the word."""

    def hash_of(self, word: str) -> int:
        return xxhash.xxh64_intdigest(word) & ~1 | word.endswith((".", "!", "?"))


def read(text: str | None) -> tuple[list[str], np.ndarray]:
    """The words, and how many come before each line that has any."""
    words, lines = [], []
    for line in (text or "").split("\n"):
        if found := line.split():
            lines.append(len(words))
            words += found
    return words, np.array(lines, np.int64)


def cuts(h: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Before which words a piece begins, by the words alone: after a sentence's end, and before the least of each `longest` words.

    A word is the least of its neighbours whatever stands further away: but for `longest` words at its head and
    `longest` - 1 at its tail, a passage is cut alike everywhere. No `longest` words are without a cut. Starts of
    sentences count as least, so that short sentences are not cut.
    """
    key = h >> U64(1)
    key[1:][(h[:-1] & U64(1)).astype(bool)] = 0
    out = key == 0
    if (m := len(key) - longest + 1) > 0:
        least = key[:m].copy()
        for i in range(1, longest):
            np.minimum(least, key[i : i + m], out=least)
        most = np.zeros(len(key), U64)  # of the windows that hold a word, the greatest of their least
        for i in range(longest):
            np.maximum(most[i : i + m], least, out=most[i : i + m])
        out |= key == most
    return np.flatnonzero(out)


def ranges(h: np.ndarray, lines: np.ndarray, span: int = SPAN, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word after the last) of each run, and before which words a piece or line begins.

    From each piece and line: the shortest run of `span` pieces with LEAST_CUT words, and from a sentence `span` sentences
    with `least` words too if that is shorter. To each line's end: the shortest run of the first kind. Those of the first
    kind end at cuts whatever the lines are, so line breaks can't hide them. A text too short for them is one run.
    """
    n, none = len(h), np.array([], np.int64)
    if not n:
        return none, none, none
    at = cuts(h)
    whole = np.append(np.union1d(np.flatnonzero(h[:-1] & U64(1)) + 1, lines), n)
    start, enough = np.union1d(at, lines), max(least, LEAST_CUT)
    pieces = start
    k = np.maximum(np.searchsorted(at, start, "right") + span - 1, np.searchsorted(at, start + enough))
    end = np.where(k < len(at), np.append(at, 0)[np.minimum(k, len(at))], n + 1)
    k = np.searchsorted(whole, start)
    third = np.where((whole[k] == start) & (k + span < len(whole)), whole[np.minimum(k + span, len(whole) - 1)], n + 1)
    short = (third < end) & (third - start >= least)
    start, end = np.append(start[end <= n], start[short]), np.append(end[end <= n], third[short])
    stop = np.append(lines[1:], n)
    k = np.minimum(np.searchsorted(at, stop) - span, np.searchsorted(at, stop - enough, "right") - 1)
    start, end = np.append(start, at[k[k >= 0]]), np.append(end, stop[k >= 0])
    if n >= least and (not len(start) or start.min() > 0 or end.max() < n):
        start, end = np.append(start, 0), np.append(end, n)
    start, end = np.unique(np.stack([start, end]), axis=1)
    return start, end, pieces


def sentences(text: str | None) -> list[str]:
    """The text cut into pieces with what follows them; joined they give the text."""
    words, lines = read(text)
    return split(text, ranges(shared(EndHashes).of(words), lines)[2]) if words else [text] if text else []


def split(text: str, at: np.ndarray) -> list[str]:
    """The text cut before the words `at`; what precedes the first word goes with it."""
    begins = [m.start() for m in WORD.finditer(text)]
    edges = [0, *(begins[i] for i in at.tolist() if i), len(text)]
    return [text[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def runs(text: str | None, span: int = SPAN, least: int = LEAST_WORDS) -> np.ndarray:
    """The hash of each run of `ranges`. Case and marks count; white space doesn't."""
    words, lines = read(text)
    if not words:
        return np.array([], U64)
    h = shared(EndHashes).of(words)
    start, end, _ = ranges(h, lines, span, least)
    # sums of hash * GOLDEN^place, brought back to place 0
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(mix(h) * np.cumprod(np.full(len(h), GOLDEN, U64)), dtype=U64)))
    back = np.cumprod(np.full(len(h), BACK, U64))
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(U64))


def repeated_inside(hashes: np.ndarray) -> np.ndarray:
    """Which runs occur earlier in the same text."""
    out = np.ones(len(hashes), bool)
    out[np.unique(hashes, return_index=True)[1]] = False
    return out


def strip(text: str | None, again: list[int] | None, span: int = SPAN, least: int = LEAST_WORDS) -> tuple[str | None, int]:
    """The text without the pieces that the runs numbered `again` cover, and how many these are."""
    if not text or not again:
        return text, 0
    words, lines = read(text)
    start, end, at = ranges(shared(EndHashes).of(words), lines, span, least)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, start[again], 1)
    np.add.at(depth, end[again], -1)
    gone = np.cumsum(depth)[at] > 0
    return "".join(p for p, g in zip(split(text, at), gone, strict=True) if not g), int(gone.sum())


def repeats(docs: DataFrame, scratch: Scratch, span: int, least: int) -> DataFrame:
    """(doc_id, half, again): the numbers of the runs that came before, in this text or a smaller doc_id's.

    half: the lower 32 bits of the text's hash, as a signed number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, places, inside = [], [], []
            for t in batch["text"].to_pylist():
                h = runs(t, span, least)
                again = repeated_inside(h)
                hashes.append(h[~again].view(np.int64))
                places.append(np.flatnonzero(~again).astype(np.int32))
                inside.append(np.flatnonzero(again).astype(np.int32))
            arrays = [pa.array(hashes, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32())), pa.array(inside, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], *arrays], names=["doc_id", "text_hash", "hashes", "places", "inside"])

    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    table = scratch.save(rows.mapInArrow(run, "doc_id long, text_hash long, hashes array<long>, places array<int>, inside array<int>"), "runs")
    # a run's place and half of its text's hash go as one number; rows of one doc_id are told apart by it
    at = F.expr("shiftleft(text_hash, 32) | r.places").alias("at")
    spans = table.where("doc_id is not null").select("doc_id", "text_hash", F.explode(F.arrays_zip("hashes", "places")).alias("r")).select("doc_id", F.col("r.hashes").alias("h"), at)
    # written, so that the rows of a passage that very many texts share can be split over tasks in the join
    first = spans.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last").select("h", "first")
    later = spans.join(scratch.save(first, "first"), "h").where("doc_id > first").select("doc_id", F.expr("shiftright(at, 32)").alias("half"), F.expr("at & 4294967295").cast("int").alias("place"))
    inside = table.select("doc_id", F.expr("shiftright(shiftleft(text_hash, 32), 32)").alias("half"), F.explode("inside").alias("place"))
    again = later.unionByName(inside).groupBy("doc_id", "half").agg(F.collect_set("place").alias("again"))
    again = scratch.save(again, "again")
    scratch.drop("runs")
    return again


def substring_dedup(docs: DataFrame, span: int = SPAN, least: int = LEAST_WORDS, scratch: Scratch | None = None, counts: bool = True) -> DataFrame:
    """`docs` with repeated pieces removed from `text`, and the column n_removed (long: pieces, see `sentences`) if `counts`.

    n_chars, where there, becomes the new length of a changed text. Every row stays, even one left without text.
    A null text stays null. A row whose doc_id is null is only cleaned of repeats inside itself and is no first
    occurrence for others. Rows with the same doc_id are one document: they don't repeat each other. Other columns pass
    through; one named n_removed is replaced. Texts are cut whole, however long. Of runs that tie, the one with the least
    doc_id, then the least place, stays. An empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "sentences")
    names = [c for c in docs.columns if not (counts and c == "n_removed")]
    docs = docs.select(*named(names))
    at, digest, gone = (fresh(names, n) for n in ("_id", "_hash", "_gone"))
    again = repeats(docs, scratch, span, least).select(F.col("doc_id").alias(at), F.col("half").alias(digest), F.col("again").alias(gone))
    both = docs.join(again, F.col("doc_id").cast("long").eqNullSafe(F.col(at)) & (F.expr("shiftright(shiftleft(xxhash64(text), 32), 32)") == F.col(digest)), "left")
    schema = T.StructType([*docs.schema.fields, *([T.StructField("n_removed", T.LongType())] if counts else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [strip(t, s, span, least) for t, s in zip(batch["text"].to_pylist(), batch[gone].to_pylist(), strict=True)]
            new = {"text": pa.array([x[0] for x in out], pa.string())}
            if "n_chars" in names:
                new["n_chars"] = pa.array([len(x[0]) if x[1] else n for x, n in zip(out, batch["n_chars"].to_pylist(), strict=True)], batch["n_chars"].type)
            arrays = [*(new.get(c, batch[c]) for c in names), *([pa.array([x[1] for x in out], pa.int64())] if counts else [])]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return mapped(both.select(*named(names), gone), run, schema)


def brute_force(rows: list[tuple[int, str | None]], span: int = SPAN, least: int = LEAST_WORDS) -> dict[int, str | None]:
    """Texts after removal, with a dictionary of first occurrences of runs of words; for tests on small tables."""
    first: dict[tuple, tuple[int, int]] = {}
    found = {}
    for i, t in sorted(rows):
        words, lines = read(t)
        start, end, at = ranges(shared(EndHashes).of(words), lines, span, least)
        found[i] = words, at, list(zip(start.tolist(), end.tolist(), strict=True))
        for a, b in found[i][2]:
            first.setdefault(tuple(words[a:b]), (i, a))
    out = {}
    for i, t in rows:
        words, at, spans = found[i]
        gone = {k for a, b in spans if first[tuple(words[a:b])] != (i, a) for k in range(a, b)}
        out[i] = "".join(p for p, a in zip(split(t, at), at.tolist(), strict=True) if a not in gone) if words else t
    return out
