"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

Plan, for a table of any size:

1. One pass over the texts makes a signature per document: the set of its word shingles (64-bit hashes), cut into
   `bins` ranges of the hash space, the least hash of each range, empty ranges filled by optimal densification
   (Shrivastava 2017). Documents with the same set fall into one class at once; only the class with its least doc_id
   goes on, so thousands of copies cost one.
2. Rows of a bucket (a band's hash) are never paired with each other: each is paired with the bucket's least doc_id,
   which gives at most `bands` candidates a document. Candidates are confirmed on the full sets.
3. A star can miss a link between two members that are both unlike the centre. So each bucket in which a candidate
   failed and whose members are still in several components is searched in full. Sets that link are alike in size, so
   members are dealt by a scale of sizes and meet only the same and the next step of it. Of each such part, the members
   outside its largest component (which are few where a bucket is mixed by chance) are cut into blocks, and so is the
   largest component; a block of the first meets every block of either kind. So a large group of near copies with some
   strangers is sent about once, and only a part whose members are mostly in different components costs the number of
   members times that of its blocks. Pairs from different components that an exact bound leaves open are compared. A
   task gives a link only where it joins two components, so no pairs leave it. No partner is dropped.
4. Components of the confirmed links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, U64, Scratch, WordHashes, mix, runs, shared, shingle_hashes, slices, words_of
from .components import connected

BANDS, ROWS = 28, 5
SIGNATURE = "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>"


class Hasher:
    """Signatures of shingle sets."""

    def __init__(self, shingle: int, bands: int = BANDS, rows: int = ROWS):
        self.shingle, self.bands, self.rows, self.bins = shingle, bands, rows, bands * rows
        self.edges = np.array([(i << 64) // self.bins for i in range(1, self.bins)], U64)
        self.words = shared(WordHashes)
        bins = np.arange(self.bins, dtype=U64)
        self.salt = mix((bins + U64(1)) * GOLDEN)
        self.band_salt = mix((np.arange(bands, dtype=U64) + U64(977)) * GOLDEN)

    def shingles(self, text: str | None) -> np.ndarray:
        """The sorted set of the document's shingles, A-Z in lower case."""
        return np.unique(shingle_hashes(self.words.of([w.lower() for w in words_of(text)]), self.shingle))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """The bins' least hashes; zeros for an empty set."""
        if not len(shingles):
            return np.zeros(self.bins, U64)
        at = np.concatenate(([0], np.searchsorted(shingles, self.edges)))
        full = at < np.concatenate((at[1:], [len(shingles)]))
        out = np.zeros(self.bins, U64)
        out[full] = shingles[at[full]]
        empty = np.flatnonzero(~full)
        source, attempt = np.arange(self.bins), 0
        while len(empty):
            attempt += 1
            tried = (mix(self.salt[empty] + U64(attempt * int(GOLDEN) % 2**64)) % U64(self.bins)).astype(np.int64)
            hit = full[tried]
            source[empty[hit]] = tried[hit]
            empty = empty[~hit]
        return out[source]

    def row(self, doc_id: int | None, text: str | None) -> tuple:
        s = self.shingles(text)
        if not len(s):
            return doc_id, 0, 0, 0, []
        values = self.signature(s)
        keys = np.zeros(self.bands, U64) + self.band_salt
        for i in range(self.rows):
            keys = mix(keys * GOLDEN + values[i :: self.rows])
        fp = np.array([s.sum(dtype=U64), mix(s).sum(dtype=U64)], U64).view(np.int64)
        return doc_id, len(s), int(fp[0]), int(fp[1]), keys.view(np.int64)


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(shingle, bands, rows)
        types = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("bands", pa.list_(pa.int64()))])
        for batch in slices(batches):
            out = [hasher.row(i, t) for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types.types, strict=True)] if out else [pa.array([], t) for t in types.types], schema=types)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SIGNATURE)


def confirm(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int, scratch: Scratch, per_salt: int = 256, most_centres: int | None = None) -> DataFrame:
    """`pairs` (c, d) with `linked`: 100 * intersection >= percent * union, on the full sets of the documents' words.

    Each text travels once for each of its pairs; very long ones are compared whole. A centre with many pairs is dealt
    over several salts; how many is written first, so that its pairs can be split over tasks in the join too. Pairs of
    which either document is not in `docs` are not returned; no pair gives an empty result. most_centres: a bound of the
    number of centres.
    """
    salts = scratch.save(pairs.groupBy("c").agg(F.ceil(F.count("*") / per_salt).cast("int").alias("of")), "salts", most_centres)
    salted = pairs.join(salts, "c").select("c", "d", F.expr("pmod(xxhash64(d), of)").alias("salt"))
    needs = salted.select("c", "salt", F.col("d").alias("doc_id")).unionByName(salted.select("c", "salt", F.col("c").alias("doc_id")).distinct())
    texts = needs.join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id")
    dealt = texts.select("c", "salt", (F.col("doc_id") != F.col("c")).alias("member"), F.col("doc_id").alias("d"), "text").repartition("c", "salt").sortWithinPartitions("c", "salt", "member", "d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, at, centre = Hasher(shingle), None, np.array([], U64)
        for batch in slices(batches):
            cs, ds, yes = [], [], []
            for c, salt, member, d, text in zip(*(batch[k].to_pylist() for k in ("c", "salt", "member", "d", "text")), strict=True):
                if not member:
                    if at != (c, salt):
                        at, centre = (c, salt), hasher.shingles(text)
                    continue
                own = hasher.shingles(text)
                both = len(np.intersect1d(centre, own, assume_unique=True))
                cs.append(c)
                ds.append(d)
                yes.append(bool(both) and 100 * both >= percent * (len(centre) + len(own) - both))
            yield pa.RecordBatch.from_arrays([pa.array(cs, pa.int64()), pa.array(ds, pa.int64()), pa.array(yes, pa.bool_())], names=["c", "d", "linked"])

    return dealt.mapInArrow(run, "c long, d long, linked boolean")


class Blocks:
    """Links between different components inside one block of a bucket, or between two blocks of it.

    A pair whose sets are too unlike in size can't link. Nor can one whose bitmaps differ too much: each bit that only
    one of them has stands for a shingle that the other lacks. Both bounds are exact. All other pairs are compared in
    full, unless links found in the block already join them.
    """

    def __init__(self, shingle: int, percent: int, bits: int = 16_384):
        self.hasher, self.percent, self.bits = Hasher(shingle), percent, bits

    def bitmap(self, shingles: np.ndarray) -> np.ndarray:
        out = np.zeros(self.bits, np.uint8)
        out[mix(shingles) % U64(self.bits)] = 1
        return np.packbits(out).view(U64)

    def links(self, rows: pa.Table) -> list[tuple[int, int]]:
        ids, side, component, low_step = rows["doc_id"].to_pylist(), rows["side"].to_numpy(), rows["component"].to_numpy(), rows["low"].to_numpy()
        sets = [self.hasher.shingles(t) for t in rows["text"].to_pylist()]
        n = np.array([len(x) for x in sets])
        maps = np.stack([self.bitmap(x) for x in sets])
        root = {int(c): int(c) for c in component}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1)
        within = not len(right)
        found = []
        for k, a in enumerate(left):
            others = left[k + 1 :] if within else right
            if not low_step[a]:  # two of the higher step meet in that step's own part
                others = others[low_step[others]]
            low, high = np.minimum(n[others], n[a]), np.maximum(n[others], n[a])
            others = others[(component[others] != component[a]) & (100 * low >= self.percent * high)]
            if len(others):
                theirs = maps[others]
                most = np.minimum(n[a] - np.bitwise_count(maps[a] & ~theirs).sum(axis=1, dtype=np.int64), n[others] - np.bitwise_count(theirs & ~maps[a]).sum(axis=1, dtype=np.int64))
                others = others[100 * most >= self.percent * (n[a] + n[others] - most)]
            for b in others:
                x, y = find(int(component[a])), find(int(component[b]))
                if x != y:
                    both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    if both and 100 * both >= self.percent * (n[a] + n[b] - both):
                        root[max(x, y)] = min(x, y)
                        found.append((ids[a], ids[b]))
        return found


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, block: int = 512, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs` (doc_id, text, any others).

    Links: documents whose sets of `shingle`-word shingles have 100 * intersection >= percent * union. component_id:
    the least doc_id reachable over links, its own included; kept: doc_id = component_id.
    A document with fewer words than a shingle has the whole sequence as its one shingle. A null text, an empty one or
    one without words has an empty set, which links with nothing. Rows that share a doc_id count as one document for
    links, and each gets its own n_shingles. A row whose doc_id is null links with nothing, has a null component_id
    and is kept. Texts are read whole, however long: memory grows with the longest text of a task's block. Equal sets
    tie, and the least doc_id stays. Other columns are ignored; an empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "minhash")
    sigs = scratch.save(signatures(docs, shingle, bands, rows), "sigs")
    n = sigs.count()  # bounds the rows of what is made of it, so that small tables get few files
    # what is joined to groups that may be hot is written first: Spark splits only what both come from plain shuffles
    classes = scratch.save(sigs.where("doc_id is not null and n_shingles > 0").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep")), "classes", n)
    reps = sigs.join(classes.withColumnRenamed("rep", "doc_id"), ["fp1", "fp2", "doc_id"], "left_semi").dropDuplicates(["doc_id", "fp1", "fp2"])
    banded = reps.select(F.col("doc_id").alias("d"), F.explode("bands").alias("key"), "n_shingles")
    buckets = scratch.save(banded.groupBy("key").agg(F.min("d").alias("c"), F.count("*").alias("n")).where("n > 1"), "buckets", n * bands // 2)
    stars = scratch.save(banded.join(buckets, "key").select("key", "c", "d", "n", "n_shingles"), "stars")

    texts = docs.select("doc_id", "text")
    pairs = scratch.save(stars.where("c <> d").select("c", "d").distinct(), "pairs", n * bands)
    checked = scratch.save(confirm(pairs, _one_text(texts), shingle, percent, scratch, most_centres=n), "checked")
    found = checked.where("linked").select(F.col("c").alias("u"), F.col("d").alias("v"))
    # rows with one doc_id and several texts: their classes meet in the id; classes of one set meet in its least id
    own = sigs.where("doc_id is not null and n_shingles > 0").join(classes, ["fp1", "fp2"]).select("doc_id", "rep")
    found = found.unionByName(own.where("rep <> doc_id").select(F.col("rep").alias("u"), F.col("doc_id").alias("v")))
    labels = scratch.save(connected(found, scratch, "cc", most_edges=n * (bands + 1)), "labels")

    failed = stars.where("n > 2").join(checked.where("not linked").select("c", "d"), ["c", "d"], "left_semi").select("key").distinct()
    doubtful = stars.join(scratch.save(failed, "failed", n * bands // 2), "key", "left_semi")
    # a member of size s meets those of sizes up to 100 * s / percent: its own step of the scale and the next
    step = F.floor(F.log("n_shingles") / float(np.log(100 / percent)) + 1e-9).cast("int") if percent < 100 else F.col("n_shingles")
    members = doubtful.join(labels.withColumnRenamed("node", "d"), "d", "left").select("key", "d", F.coalesce("component", "d").alias("component"), F.explode(F.array(step, step - 1)).alias("step"), step.alias("own"))
    members = scratch.save(members, "members")
    per = members.groupBy("key", "step", "component").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("d")).alias("h1"), F.bit_xor(F.xxhash64("d", F.lit(17))).alias("h2"), F.max(F.expr("own = step")).alias("low"))
    parts = per.groupBy("key", "step").agg(F.count("*").alias("components"), F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("main"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), F.max("low").alias("low"))
    # bands often make the same part again: one of those with the same members is enough
    parts = parts.where("components > 1 and low").groupBy("h1", "h2", "n", "main").agg(F.min(F.struct("key", "step")).alias("k"))
    of = [F.ceil(x / block).cast("int").alias(y) for x, y in ((F.col("n") - F.col("main.n"), "of_few"), (F.col("main.n"), "of_main"))]
    parts = scratch.save(parts.select("k.key", "k.step", F.col("main.component").alias("main"), *of), "parts", n * bands)
    # the few in block `at` meet the few of each block and the main component's of each block, whose numbers come after
    dealt = members.join(parts, ["key", "step"]).withColumn("few", F.expr("component <> main")).withColumn("at", F.expr("pmod(xxhash64(d), if(few, of_few, of_main))"))
    dealt = dealt.withColumn("other", F.explode(F.expr("if(few, sequence(0, of_few + of_main - 1), sequence(0, of_few - 1))"))).withColumn("at", F.expr("if(few, at, of_few + at)"))
    dealt = dealt.select("key", "step", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), F.when(F.col("at") > F.col("other"), 1).otherwise(0).alias("side"), F.col("d").alias("doc_id"), "component", F.expr("own = step").alias("low"))
    full = dealt.join(_one_text(texts), "doc_id")
    place = ["key", "step", "i", "j"]
    full = full.repartition(*place).sortWithinPartitions(*place, "side", "doc_id")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(shingle, percent)
        for _, rows in runs(batches, place):
            if found := blocks.links(rows):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["u", "v"])

    more = scratch.save(full.mapInArrow(searched, "u long, v long"), "more")
    if found_more := more.count():
        tree = labels.where("node <> component").select(F.col("component").alias("u"), F.col("node").alias("v"))
        labels = scratch.save(connected(more.unionByName(tree), scratch, "cd", most_edges=found_more + n), "relabelled")

    out = sigs.select("doc_id", "n_shingles").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _one_text(texts: DataFrame) -> DataFrame:
    """Candidates are named by doc_id; rows without one or without text can't be named."""
    return texts.where("doc_id is not null and text is not null")


def brute_force(rows: list[tuple[int | None, str | None]], shingle: int, percent: int) -> dict[int, int]:
    """component_id by comparing every pair of sets of word tuples; for tests on small tables."""
    sets = {}
    for i, t in rows:
        w = [x.lower() for x in words_of(t)]
        n = min(shingle, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
