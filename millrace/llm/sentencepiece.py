"""SentencePiece encoding and decoding by suffix-array matching.

The texts of a batch are cut where no piece can reach over (before a run of spaces, around line feeds); chunks seen
before are looked up. The new chunks are concatenated and indexed by a suffix array that is sorted as deep as the longest
piece. Every piece of the vocabulary is binary-searched in it, all at once, which gives its occurrences as a range; these
are the edges of the chunks' lattices, sorted by position. Relaxing them gives the segmentation: for a unigram model
the best path; for a BPE model the merge of the best-ranked edge that joins two neighbouring symbols, until none does.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable

SPACE = "▁"
ALONE = ("\n", "\0")
BREAKS = re.compile("([\n\0])")
#: Chunks longer than this are merged with a heap, one by one, since rounds grow with a chunk's length.
LONG = 64


class Model(NamedTuple):
    """What the tasks need of a model file: the normal pieces with their ids and scores, bytes, control ids."""

    pieces: list[str]
    kinds: list[int]  # 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
    scores: list[float]
    bpe: bool
    unknown: int


def load(path: str) -> Model:
    """Reads a model file, once, on the driver; its size is fixed (under a MB) and it is sent to the tasks."""
    import sentencepiece

    kinds, scores, pieces, bpe, fallback = [], [], [], False, False
    processor = sentencepiece.SentencePieceProcessor(model_proto=Path(path).read_bytes())
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    spec.ParseFromString(processor.serialized_model_proto())
    normal = spec.normalizer_spec
    if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.add_dummy_prefix or not normal.escape_whitespaces:
        raise ValueError("only models that leave the text as it is, but for a space before it, are supported")
    for p in spec.pieces:
        pieces.append(p.piece)
        kinds.append(p.type)
        scores.append(p.score)
    bpe, fallback = spec.trainer_spec.model_type == 2, spec.trainer_spec.byte_fallback
    if not fallback or any(k == 4 for k in kinds):
        raise ValueError("only models with byte fallback and without user-defined pieces are supported")
    if any(SPACE in p.lstrip(SPACE) or any(c in p for c in ALONE) for p, k in zip(pieces, kinds, strict=True) if k == 1):
        raise ValueError("a piece reaches over a word's start or a line feed")
    return Model(pieces, kinds, scores, bpe, kinds.index(2))


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of `codes` (values over 0; 0 ends a chunk) sorted by their first `depth` values, by doubling."""
    rank = codes.astype(np.int64)
    done = 1
    while done < depth:
        ahead = np.zeros(len(rank), np.int64)
        ahead[: max(0, len(rank) - done)] = rank[done:]
        key = rank * (int(rank.max(initial=0)) + 1) + ahead
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
        done *= 2
    return np.argsort(rank, kind="stable")


def ranges(codes: np.ndarray, order: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of `pieces` (padded with 0) the range of `order` whose suffixes begin with it, by binary search."""
    n = len(order)
    lo, hi = np.zeros(len(pieces), np.int64), np.full(len(pieces), n, np.int64)
    padded = np.concatenate([codes, np.zeros(pieces.shape[1] + 1, codes.dtype)])

    def first(depth: int, value: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least place in [a, b) whose suffix has a value of at least `value` at `depth`."""
        a, b = a.copy(), b.copy()
        while (open_ := a < b).any():
            mid = (a + b) // 2
            less = padded[order[np.minimum(mid, n - 1)] + depth] < value
            a = np.where(open_ & less, mid + 1, a)
            b = np.where(open_ & ~less, mid, b)
        return a

    active = np.arange(len(pieces))
    for depth in range(pieces.shape[1]):
        active = active[(pieces[active, depth] > 0) & (lo[active] < hi[active])]
        if not len(active):
            break
        value, a, b = pieces[active, depth], lo[active], hi[active]
        lo[active], hi[active] = first(depth, value, a, b), first(depth, value + 1, a, b)
    return lo, hi


class Encoder:
    """Ids of texts under a Model."""

    limit = 1_000_000

    def __init__(self, model: Model):
        self.model = model
        normal = [(p, i) for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == 1]
        self.depth = max(len(p) for p, _ in normal)
        self.piece_ids = np.array([i for _, i in normal])
        self.piece_codes = np.zeros((len(normal), self.depth), np.int64)
        for r, (p, _) in enumerate(normal):
            self.piece_codes[r, : len(p)] = [ord(c) for c in p]
        self.lengths = (self.piece_codes > 0).sum(axis=1)
        score = np.array(model.scores)[self.piece_ids]
        #: Merge order: the higher score first.
        self.rank = np.unique(-score, return_inverse=True)[1]
        self.score = score
        self.bytes = np.zeros(256, np.int64)
        for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)):
            if k == 6:
                self.bytes[int(p[3:-1], 16)] = i
        self.single = {p: i for p, i in normal if len(p) == 1}
        self.known: dict[str, bytes] = {}
        self.alone = {c: self.fallback(c) for c in ALONE}
        self.text_of = [b"" if k in (2, 3) else bytes([int(p[3:-1], 16)]) if k == 6 else p.replace(SPACE, " ").encode() for p, k in zip(model.pieces, model.kinds, strict=True)]

    def fallback(self, char: str) -> bytes:
        return self.bytes[list(char.encode("utf-8", "replace"))].astype("<i4").tobytes()

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Chunks in order. A line feed and a NUL are chunks of their own."""
        out: list[str] = []
        for line in BREAKS.split(SPACE + text.replace(" ", SPACE)):
            if not line:
                continue
            if line in ALONE:
                out.append(line)
                continue
            parts = line.split(SPACE)
            if parts[0]:
                out.append(parts[0])
            spaces = 0
            for p in parts[1:]:
                spaces += 1
                if p:
                    out.append(SPACE * spaces + p)
                    spaces = 0
            if spaces:
                out.append(SPACE * spaces)
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self.chunks(t) if t else [] for t in texts]
        known = self.known
        if len(known) > self.limit:  # frequent chunks come back soon
            known.clear()
        known.update(self.alone)
        new = list({c for chunks in cut for c in chunks if c not in known})
        if new:
            self.learn(new)
        return [np.frombuffer(b"".join([known[c] for c in chunks]), "<i4") for chunks in cut]

    def edges(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(codes of the chunks joined by 0, and the edges' starts, ends, piece rows) sorted by position."""
        joined = "\0".join([*chunks, ""])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        order = suffix_array(codes, self.depth)
        lo, hi = ranges(codes, order, self.piece_codes)
        many = hi - lo
        row = np.repeat(np.arange(len(many)), many)
        place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
        start = order[place]
        by_place = np.lexsort((self.lengths[row], start))
        start, row = start[by_place], row[by_place]
        return codes, start, start + self.lengths[row], row

    def learn(self, chunks: list[str]) -> None:
        """Segments chunks and keeps their ids."""
        codes, start, end, row = self.edges(chunks)
        sizes = np.array([len(c) for c in chunks], np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        home = np.repeat(np.arange(len(chunks)), sizes + 1)
        if self.model.bpe:
            cuts = self.merge(codes, begin, sizes, home, start, end, row)
        else:
            cuts = self.best_path(begin, sizes, start, end, row)
        ids_at = np.full(len(codes), -1, "<i4")
        first, _, piece = self.used(cuts, start, end, row)
        ids_at[first] = self.piece_ids[piece]
        at = np.flatnonzero(cuts & (codes > 0))
        ids = ids_at[at]
        bounds = np.searchsorted(home[at], np.arange(len(chunks) + 1)).tolist()
        bare = set(home[at][ids < 0].tolist())
        data = ids.tobytes()
        for k, (c, lo, hi) in enumerate(zip(chunks, bounds[:-1], bounds[1:], strict=True)):
            if k not in bare:
                self.known[c] = data[4 * lo : 4 * hi]
            else:
                self.known[c] = b"".join(self.fallback(chr(codes[p])) if i < 0 else i.tobytes() for p, i in zip(at[lo:hi], ids[lo:hi], strict=True))

    @staticmethod
    def used(cuts: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges from one cut to the next."""
        before = np.concatenate([[0], np.cumsum(cuts)])
        ok = cuts[start] & cuts[np.minimum(end, len(cuts) - 1)] & (before[end] - before[start] == 1)
        return start[ok], end[ok], row[ok]

    def merge(self, codes, begin, sizes, home, start, end, row) -> np.ndarray:
        """Symbol starts after all merges. A round merges, in each chunk, the best-ranked edge, the leftmost first."""
        cuts = np.ones(len(codes) + 1, bool)
        longer = end - start > 1
        s, e, key = start[longer], end[longer], self.rank[row[longer]].astype(np.int64) * (len(codes) + 1) + start[longer]
        chunk = home[s]
        slow = sizes > LONG
        for k in np.flatnonzero(slow):
            mine = chunk == k
            self.heap(cuts, begin[k], sizes[k], s[mine], e[mine], key[mine])
        rest = ~slow[chunk]
        s, e, key, chunk = s[rest], e[rest], key[rest], chunk[rest]
        far = np.iinfo(np.int64).max
        while len(s):
            places = np.flatnonzero(cuts)
            index = np.cumsum(cuts) - 1
            here = cuts[s] & cuts[e]
            ok = here & (index[e] - index[s] == 2)
            best = np.full(len(sizes), far)
            np.minimum.at(best, chunk[ok], key[ok])
            if not ok.any():
                break
            won = ok & (key == best[chunk])
            cuts[places[index[s[won]] + 1]] = False
            # an edge whose ends are no longer cuts never fits again; chunks without a merge are done
            keep = cuts[s] & cuts[e] & ~won & (best[chunk] < far)
            s, e, key, chunk = s[keep], e[keep], key[keep], chunk[keep]
        return cuts[: len(codes)] if len(codes) else cuts[:0]

    @staticmethod
    def heap(cuts: np.ndarray, begin: int, size: int, s: np.ndarray, e: np.ndarray, key: np.ndarray) -> None:
        """The merges of one long chunk, in the order of a queue."""
        edge = {(int(a), int(b)): int(k) for a, b, k in zip(s, e, key, strict=True)}
        nxt = {i: i + 1 for i in range(begin, begin + size)}
        prev = {i + 1: i for i in range(begin, begin + size)}
        queue = [(k, a, b, a + 1) for (a, b), k in edge.items() if b - a == 2]
        heapq.heapify(queue)
        while queue:
            _, a, b, m = heapq.heappop(queue)
            if nxt.get(a) != m or nxt.get(m) != b:
                continue
            nxt[a], prev[b] = b, a
            del nxt[m], prev[m]
            cuts[m] = False
            if b in nxt and (k := edge.get((a, nxt[b]))) is not None:
                heapq.heappush(queue, (k, a, nxt[b], b))
            if a in prev and (k := edge.get((prev[a], b))) is not None:
                heapq.heappush(queue, (k, prev[a], b, a))

    def best_path(self, begin, sizes, start, end, row) -> np.ndarray:
        """Symbol starts of the best path; a character without a piece costs ten below the least score."""
        total = int(begin[-1] + sizes[-1]) if len(sizes) else 0
        poor = float(self.score.min()) - 10
        at = np.searchsorted(start, np.arange(total + 1))
        best, back = np.full(total + 1, -np.inf), np.zeros(total + 1, np.int64)
        cuts = np.zeros(total + 1, bool)
        for b, n in zip(begin, sizes, strict=True):
            best[b] = 0
            for i in range(b, b + n):
                hit = range(at[i], at[i + 1])
                if all(end[k] != i + 1 for k in hit) and best[i] + poor > best[i + 1]:
                    best[i + 1], back[i + 1] = best[i] + poor, i
                for k in hit:
                    if (v := best[i] + self.score[row[k]]) > best[end[k]]:
                        best[end[k]], back[end[k]] = v, i
            i = b + n
            while i > b:
                i = back[i]
                cuts[i] = True
            cuts[b + n] = True
        return cuts

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, bytes put together, the space before the text dropped."""
        text = b"".join([self.text_of[i] for i in ids]).decode("utf-8", "replace")
        return text.removeprefix(" ")


_encoders: dict[int, Encoder] = {}


def encoder_of(model: Model) -> Encoder:
    """The process's encoder for a model: tasks that share a Python worker share what it has seen."""
    key = zlib.crc32("\n".join(model.pieces).encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model)
    return _encoders[key]


def encoded(docs: DataFrame, path: str, text: str = "text", batch_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, ids, n_ids, decoded) for every row: ids of the whole text, and the text decoded from them again.

    A null or empty text has no ids and decodes to "". U+2581 in a text is a space to the model and decodes as one.
    Repeated rows are encoded each; a null doc_id stays null. Extra columns are ignored; an empty table gives an empty
    result. `path`: a model file with byte fallback and no normalisation but the space before the text.
    """
    importable(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(sent.value)
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for doc_id, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                held.append((doc_id, t))
                size += len(t or "")
                if size >= batch_chars:
                    yield rows(encoder, held)
                    held, size = [], 0
        if held:
            yield rows(encoder, held)

    def rows(encoder: Encoder, held: list[tuple]) -> pa.RecordBatch:
        ids = encoder.encode([t for _, t in held])
        lengths = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids) if len(ids) else np.array([], np.int32)
        array = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat.astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in held], pa.int64()), array, pa.array(lengths), pa.array([encoder.decode(x.tolist()) for x in ids], pa.string())], names=["doc_id", "ids", "n_ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_ids long, decoded string")
