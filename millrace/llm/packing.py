"""Best-fit packing planned on the histogram of lengths.

The planner sees only how many pieces there are of each length (at most `capacity` numbers), never a document. It runs
best-fit decreasing over whole counts: bins that are alike are one group, and a count goes to the group with the least
room in one step. The plan is a table of slots: "the pieces of length l with rank r0.. go to bins b0.., k to a bin, at
offset o". Each piece then finds its slot by its rank within its length. The plan grows with the number of different
lengths, not with the number of documents, so it is broadcast.
"""

from __future__ import annotations

import heapq
import sys
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLOT, Scratch, _shared, ranked, slices

CAPACITY = 4096
END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[pd.DataFrame, int]:
    """(slots, number of bins) by best-fit decreasing. Slots: length, rank, n, per_bin, sequence, offset.

    Lengths over the capacity or under 1 are an error. A slot serves the pieces of `length` with `rank` <= r < rank + n;
    a bin takes `per_bin` of them in a row from `offset` on, bins in order from `sequence`.
    """
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError("a piece must have between 1 token and the capacity")
    slots, bins = [], 0
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> [(first bin, how many)]
    rooms: list[int] = []  # ascending, of the groups there are

    def add(room: int, first: int, many: int) -> None:
        if room and many:
            if room not in groups:
                groups[room] = []
                at = np.searchsorted(rooms, room) if rooms else 0
                rooms.insert(int(at), room)
            heapq.heappush(groups[room], (first, many))

    def place(length: int, rank: int, n: int, first: int, many: int, room: int) -> int:
        """Fills up to `many` like bins with up to n pieces; returns how many pieces found room."""
        per = room // length
        whole, rest = divmod(min(n, per * many), per)
        if whole:
            slots.append((length, rank, whole * per, per, first, capacity - room))
            add(room - per * length, first, whole)
        if rest:
            slots.append((length, rank + whole * per, rest, rest, first + whole, capacity - room))
            add(room - rest * length, first + whole, 1)
        add(room, first + whole + bool(rest), many - whole - bool(rest))
        return whole * per + rest

    for length in sorted((n for n, c in counts.items() if c > 0), reverse=True):
        rank, left = 0, counts[length]
        while left and rooms and rooms[-1] >= length:
            room = rooms[int(np.searchsorted(rooms, length))]
            first, many = heapq.heappop(groups[room])
            if not groups[room]:
                del groups[room]
                rooms.remove(room)
            put = place(length, rank, left, first, many, room)
            rank, left = rank + put, left - put
        if left:
            per = capacity // length
            many = -(-left // per)
            place(length, rank, left, bins, many, capacity)
            bins += many
    return pd.DataFrame(slots, columns=["length", "rank", "n", "per_bin", "sequence", "offset"], dtype="int64"), bins


def tokenizer_text(path: str) -> str:
    """The tokenizer file, read once on the driver and sent to the tasks: it has a fixed size (some MB)."""
    return Path(path).read_text(encoding="utf-8")


class Encoder(dict):
    """Ids of chunks as little-endian unsigned 32-bit bytes, by a word-level `tokenizers` model.

    The model's own pre-tokenizer never joins what a space or a line feed separates, nor a letter and a mark after it, and
    it lowers case, so each such part is encoded alone and kept: the ids of a text are those of its chunks in a row.
    Full, it keeps what came first, which holds the frequent ones; `room` bounds its bytes.
    """

    room = 176 << 20

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.model = Tokenizer.from_str(model)
        self[""] = b""

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > 1 and chunk[-1] in MARKS and chunk[-2] < LATIN_END and chunk[-2].lower()[-1].isalpha():
            out = self[chunk[:-1]] + self[chunk[-1]]
        elif chunk.isascii() and (lower := chunk.lower()) != chunk and "<|" not in chunk:
            out = self[lower]
        else:
            out = array("I", self.model.encode(chunk, add_special_tokens=False).ids).tobytes()
            if sys.byteorder == "big":
                out = np.frombuffer(out, ">u4").astype("<u4").tobytes()
        size = sys.getsizeof(chunk) + sys.getsizeof(out) + SLOT
        if size <= self.room:
            self[chunk] = out
            self.room -= size
        return out

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").replace("\n", " ").split(" ")))


#: What may follow a letter as a part of its own.
MARKS = frozenset(".,;:!?")
#: Letters up to here are letters in every version of Unicode.
LATIN_END = "\u0250"
_encoders: dict[int, Encoder] = {}


def encoder_of(model: str) -> Encoder:
    """The process's encoder for a model: tasks that share a Python worker share what it has seen."""
    key = zlib.crc32(model.encode())
    if key not in _encoders:
        _encoders.clear()
        _shared.clear()  # other operators' tables make room
        _encoders[key] = Encoder(model)
    return _encoders[key]


def pieces(docs: DataFrame, model: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece of each document, the end id included."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(sent.value)
        for batch in slices(batches):
            out: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                data = encoder.ids(text) + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if ids:
                flat = pa.array(np.frombuffer(b"".join(cols[5]), "<u4").astype(np.int32))
                ends = np.concatenate([[0], np.cumsum(np.array(cols[3], np.int64))]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES + (", ids array<int>" if ids else ""))


def placed(table: DataFrame, spark: SparkSession, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces."""
    counts = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}  # at most `capacity` rows
    slots, _ = plan(counts, capacity)
    slots = slots.sort_values(["length", "rank"])
    sent = spark.sparkContext.broadcast({k: slots[k].to_numpy() for k in slots.columns})
    ranks = ranked(table, "length", ["doc_id", "piece", "start", "ids_crc32"], few_keys=True)
    names = table.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        step = int(s["rank"].max(initial=0) + s["n"].max(initial=0)) + 1
        starts = s["length"] * step + s["rank"]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            at = np.searchsorted(starts, length * step + rank, side="right") - 1
            place = rank - s["rank"][at]
            sequence, offset = s["sequence"][at] + place // s["per_bin"][at], s["offset"][at] + place % s["per_bin"][at] * length
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema) + ", sequence_id long, offset long"
    return ranks.select(*names, "rank").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    Every row of `docs` is packed: a null or empty text is the end id alone. Documents over `capacity` are cut into
    pieces of that many ids; none else is cut. Repeated rows are packed as often as they occur, a null doc_id stays
    null. Extra columns are ignored; an empty table gives an empty result. `tokenizer`: path of a `tokenizers` file.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    table = scratch.save(pieces(docs, tokenizer_text(tokenizer), capacity, ids), "pieces")
    return placed(table, spark, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, doc_ids, ids) from pack(ids=True): each sequence's ids in the order of offset.

    A sequence has at most `capacity` ids, so a group is bounded.
    """
    rows = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(rows.alias("r")).select("sequence_id", F.expr("aggregate(r, 0L, (a, x) -> a + x.length)").alias("length"), F.expr("transform(r, x -> x.doc_id)").alias("doc_ids"), F.flatten(F.expr("transform(r, x -> x.ids)")).alias("ids"))
