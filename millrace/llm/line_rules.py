"""Quality rules by cross-document line frequency.

A line that many documents of one host carry is boilerplate. Lines are normalised and hashed, and the distinct documents
of each (host, line) are counted. Lines above the limits are removed from every document, and a document that is depleted
by this is rejected. Base rules on the document itself come before that.

Two parameters soften the count, both off by default: `copies_once` counts exact copies of a document once, so that a
text isn't boilerplate for having been copied; `first_stays` leaves a line to the document of least doc_id that has it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, fresh, mapped, named, shared, slices, words_of

#: A line is boilerplate in more documents of a host than this and than this share of the host's documents.
LEAST_DOCS = 5
SHARE = 0.01
#: A document is depleted if fewer words stay than this, or less than this share of its words.
LEAST_WORDS = 25
LEAST_SHARE = 0.4
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
SYMBOLS = re.compile(r"[#*$%&|<>]")
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def normal(line: list[bytes]) -> bytes:
    """A line's words with single spaces, A-Z in lower case, digits as 0."""
    return re.sub(rb"[0-9]+", b"0", b" ".join(line).lower())


def repeat_words(hashes: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more."""
    if len(hashes) < 4:
        return 0
    ids = np.unique(hashes, return_inverse=True)[1].astype(np.int64)
    n = int(ids.max()) + 1
    windows = (ids[:-2] * n + ids[1:-1]) * n + ids[2:] if n < 2**20 else np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]]), axis=1, return_inverse=True)[1]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    marks = np.zeros(len(ids), bool)
    for i in range(3):
        marks[i : len(twice) + i] |= twice
    return int(marks.sum())


def measure(text: str | None, words: WordHashes) -> tuple[tuple[int, ...], list[int], list[int]]:
    """The base statistics; the hashes of the text's distinct normal lines, and the words under each."""
    all_words = words_of(text)
    lines, seen, repeats = {}, set(), 0
    for line in (text or "").split("\n"):
        if own := words_of(line):
            repeats += line in seen
            seen.add(line)
            h = xxhash.xxh64_intdigest(normal(own))
            lines[h] = lines.get(h, 0) + len(own)
    chars = sum(len(w) - sum(0x80 <= b < 0xC0 for b in w) if not w.isascii() else len(w) for w in all_words)
    stats = (len(all_words), chars, len(SYMBOLS.findall(text or "")), repeats, repeat_words(words.of(all_words)))
    return stats, list(lines), list(lines.values())


def measured(docs: DataFrame, host: str, text: str = "text") -> DataFrame:
    """doc_id, host, text_hash, the base statistics, and the arrays lines (hashes) and line_words."""
    types = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("text_hash", pa.int64()), *((c, pa.int64()) for c in STATS), ("lines", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared(WordHashes)
        for batch in slices(batches):
            found = [measure(t, words) for t in batch["text"].to_pylist()]
            stats = [pa.array([f[0][i] for f in found], pa.int64()) for i in range(len(STATS))]
            lines = pa.array([np.array(f[1], np.uint64).view(np.int64) for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["host"], batch["text_hash"], *stats, lines, pa.array([f[2] for f in found], pa.list_(pa.int64()))], schema=types)

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, host string, text_hash long, " + ", ".join(f"{c} long" for c in STATS) + ", lines array<long>, line_words array<long>")


def judged(docs: DataFrame, host: str = "source", scratch: Scratch | None = None, least_docs: int = LEAST_DOCS, share: float = SHARE, copies_once: bool = False, first_stays: bool = False) -> DataFrame:
    """(doc_id, text_hash, the base statistics, base_failed, removed_words, removed_lines, kept) for every row of `docs`.

    base_failed: n_words < 50, or 100 * n_repeat_words > 50 * n_words. kept: not base_failed, and after the removal of
    boilerplate lines at least 25 words and 40 % of the words stay. A null or empty text has no words and fails the
    base; a very long one is measured whole. A null host is a host of its own. Rows with the same doc_id and text are
    one document and get the same verdict; rows without a doc_id are one document if their texts are the same. With
    `first_stays`, all rows of the least doc_id that hold a line keep it, and one without a doc_id is never the first.
    Extra columns are ignored; an empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    table = scratch.save(measured(docs, host), "measured")
    document = ["text_hash"] if copies_once else ["doc_id", "_text"]
    table_ = table.withColumn("_text", F.when(F.col("doc_id").isNull(), F.col("text_hash")))
    lines = table_.where("size(lines) > 0").select("doc_id", "text_hash", "_text", "host", F.posexplode("lines").alias("_at", "line"))
    documents = table_.groupBy("host", *document).agg(F.lit(1).alias("_one")).groupBy("host").agg(F.count("*").alias("documents"))
    # one row for each (host, line, document), so a hot line is dealt over its documents before it is counted
    single = lines.groupBy("host", "line", *document).agg(F.min("doc_id").alias("first"))
    counted = single.groupBy("host", "line").agg(F.count("*").alias("n"), F.min("first").alias("first")).where(F.col("n") > least_docs)
    documents = scratch.save(documents.withColumnRenamed("host", "_host"), "documents")  # so that a hot host's lines can be split too
    above = counted.join(documents, F.col("host").eqNullSafe(F.col("_host")))
    # written, so that Spark can split the rows of a hot line over tasks in the join below
    hot = scratch.save(above.where(F.col("n") > share * F.col("documents")).select(F.col("_host").alias("hot_host"), F.col("line").alias("hot_line"), "first"), "hot")

    hit = lines.join(hot, F.col("host").eqNullSafe(F.col("hot_host")) & (F.col("line") == F.col("hot_line")))
    if first_stays:
        hit = hit.where("first is null or doc_id is null or doc_id <> first")
    gone = scratch.save(hit.groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("removed_lines")), "gone")
    out = table.alias("t").join(gone.alias("g"), F.expr("t.doc_id <=> g.doc_id and t.text_hash = g.text_hash"), "left")
    removed = F.expr("aggregate(zip_with(lines, line_words, (l, w) -> if(array_contains(removed_lines, l), w, 0L)), 0L, (a, x) -> a + x)")
    out = out.select("t.doc_id", "t.text_hash", *STATS, F.when(F.col("removed_lines").isNull(), F.lit(0)).otherwise(removed).cast("long").alias("removed_words"), "removed_lines")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    return out.withColumn("base_failed", base).withColumn("kept", ~base & (left >= LEAST_WORDS) & (left >= LEAST_SHARE * F.col("n_words")))


def cleaned(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The kept rows of `docs` without their boilerplate lines, in the columns of `docs`; n_chars, if there, follows.

    `verdicts`: judged() of the same rows. Rows are matched by doc_id, null or not, and text; repeated rows stay as
    often as they occur. Null and empty texts are never kept, very long ones are rewritten whole. Extra columns pass
    through whatever their names; an empty table gives an empty result.
    """
    types, names = docs.schema, docs.columns
    own, at, digest, gone = (fresh(names, n) for n in ("_own", "_id", "_hash", "_gone"))
    v = verdicts.where("kept").select(F.col("doc_id").alias(at), F.col("text_hash").alias(digest), F.col("removed_lines").alias(gone)).dropDuplicates([at, digest])
    both = docs.withColumn(own, F.xxhash64("text")).join(v, F.col("doc_id").cast("long").eqNullSafe(F.col(at)) & (F.col(own) == F.col(digest))).select(*named(names), gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [without(t, g) for t, g in zip(batch["text"].to_pylist(), batch[gone].to_pylist(), strict=True)]
            new = {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                new["n_chars"] = pa.array([n if g is None or t is None else len(t) for t, g, n in zip(texts, batch[gone].to_pylist(), batch["n_chars"].to_pylist(), strict=True)], batch["n_chars"].type)
            yield pa.RecordBatch.from_arrays([new.get(c, batch[c]) for c in names], names=names)

    return mapped(both, run, types)


def without(text: str | None, gone: list[int] | None) -> str | None:
    """The text without the lines whose hash is in `gone`; as it is where there are none."""
    if not gone or text is None:
        return text
    out, hashes = [], {h % 2**64 for h in gone}
    for line in text.split("\n"):
        own = words_of(line)
        if not own or xxhash.xxh64_intdigest(normal(own)) not in hashes:
            out.append(line)
    return "\n".join(out)


def quality_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """The contract's columns from judged(): doc_id, the base statistics, base_failed, removed_words, kept."""
    return judged(docs, host).select("doc_id", *STATS, "base_failed", "removed_words", "kept")
