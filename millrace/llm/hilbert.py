"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to a few bits, in its own order; a row's cell is its place on the Hilbert curve through the
grid (Skilling's transform, 2004). Rows are ordered by cell and the order is cut into runs of equal row counts, one per
shard. Rows that are near in all dimensions are near on the curve, so a shard's files cover a small box and a filter on
any dimension skips most of them. Names are quantised by rank: cells are cut where equal shares of the rows end, and
the cuts (15 names at 4 bits) are all that the driver gets. Cells are bounded (2**(bits * dimensions)), so their
counts are broadcast; a cell with very many rows is ranked in several buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Scratch, fresh, named, ranked

BITS = 4
#: Bits of a cell's place at most, which bound the number of cells that are counted and broadcast.
MOST_BITS = 20


def curve_index(coordinates: np.ndarray, bits: int) -> np.ndarray:
    """Place on the curve of each row of `coordinates` (n, dimensions), whole numbers under 2**bits."""
    x = coordinates.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            low = q - 1
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    fix = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        fix = np.where(x[-1] & q, fix ^ (q - 1), fix)
        q >>= 1
    x ^= fix
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def name_cuts(rows: DataFrame, column: str, scratch: Scratch, bits: int = BITS) -> list[tuple[str, int]]:
    """(name, cell): the names in ascending order, 2**bits - 1 at most, at which a new cell begins.

    A cell stands for its share of the rows: its number is how many of 2**bits equal shares come before the name.

    Names are counted with a partial aggregate and sorted over range partitions; sums go over one row for each
    partition. Nulls have no place among them.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n"))
    ordered = scratch.save(counts.repartitionByRange("name").withColumn("part", F.spark_partition_id()), f"names-{column}")
    totals = {r["part"]: r["n"] for r in ordered.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return []
    before, seen = {}, 0
    for part in sorted(totals):
        before[part], seen = seen, seen + totals[part]
    spark = rows.sparkSession
    starts = spark.createDataFrame(list(before.items()), "part INT, start BIGINT")
    own = F.sum("n").over(Window.partitionBy("part").orderBy("name")) - F.col("n")
    placed = ordered.join(F.broadcast(starts), "part").withColumn("from", F.col("start") + own)
    cells = 1 << bits
    first = placed.withColumn("cell", F.expr(f"({cells} * from + {seen - 1}) div {seen}")).where(f"cell * {seen} < {cells} * (from + n)")
    return sorted((r["name"], r["cell"]) for r in first.groupBy("cell").agg(F.min("name").alias("name")).where("cell > 0").collect())


def by_rank(column: str, cuts: list[tuple[str, int]]) -> Column:
    """Cell of a name: that of the last cut that doesn't come after it. Null and names before the first are in cell 0."""
    return F.greatest(F.lit(0), F.lit(0), *(F.when(F.col(column) >= F.lit(name), F.lit(cell)) for name, cell in cuts)).cast("int")


def by_size(column: str, least: float = 16, bits: int = BITS) -> Column:
    """Cell of a size on a scale of doublings from `least`; null and sizes below are cell 0."""
    return F.least(F.lit((1 << bits) - 1), F.greatest(F.lit(0), F.coalesce(F.floor(F.log2(F.col(column) / least)) + 1, F.lit(0)))).cast("int")


def by_share(column: str, low: int | None, high: int | None, bits: int = BITS) -> Column:
    """Cell of a number in equal steps from `low` to `high`; null is cell 0."""
    if low is None or high is None or high <= low:
        return F.lit(0)
    step = (F.col(column).cast("double") - float(low)) / (float(high) - float(low)) * (1 << bits)
    return F.least(F.lit((1 << bits) - 1), F.greatest(F.lit(0), F.coalesce(F.floor(step), F.lit(0)))).cast("int")


def sharded(rows: DataFrame, cells: list[Column], shards: int, order: list[str], bits: int = BITS, scratch: Scratch | None = None) -> DataFrame:
    """`rows` with shard (0 to shards - 1) and slot (place in the shard, from 0).

    Row counts of shards differ by one at most. Order: curve index, then hash bucket and `order` within it; rows alike
    in `order` take neighbouring places in any order. Rows are written once before ranking, so pass narrow rows. Null
    cells are an error, as are more than MOST_BITS bits in all. An empty table gives an empty result.
    """
    if bits * len(cells) > MOST_BITS:
        raise ValueError(f"{len(cells)} dimensions of {bits} bits make more than 2**{MOST_BITS} cells")
    scratch = scratch or Scratch(rows.sparkSession, "hilbert")
    names = rows.columns
    grid = rows.select("*", F.array(*cells).alias("_cells"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", curve long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch["_cells"].flatten().to_numpy(), np.int64).reshape(len(batch), -1)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(curve_index(x, bits) if len(x) else [], pa.int64())], names=[*names, "curve"])

    table = scratch.save(grid.mapInArrow(run, schema), "curve")
    counts = table.groupBy("curve").agg(F.count("*").alias("n"))  # at most 2**(bits * dimensions) rows
    before = counts.select("curve", (F.sum("n").over(Window.orderBy("curve")) - F.col("n")).alias("_first"), F.sum("n").over(Window.partitionBy()).alias("_all"))
    placed = ranked(table, "curve", order, "_rank", few_keys=True).join(F.broadcast(before), "curve").withColumn("_at", F.col("_first") + F.col("_rank"))
    # shard s holds places floor(s * n / shards) to floor((s + 1) * n / shards) - 1
    shard = F.expr(f"(({shards} * (_at + 1)) - 1) div _all")
    slot = F.expr("_at - (shard * _all) div " + str(shards))
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", slot.cast("long")).select(*names, "curve", "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = 8, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve) for every row of `docs`.

    Dimensions: language, source, size. Within a cell equal texts lie together unless the cell has very many rows.
    size: UTF-8 bytes of the text plus 1, 1 for a null text, whose text_crc32 is null; a very long text is one row like
    any other. Any column may be null; repeated rows each have a place, and rows that tie in text and doc_id take
    theirs in the order in which they are written. law is `rows`: counts differ by one at most. Extra columns are
    ignored; a missing lang or source counts as null. An empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "hilbert")
    for c in ("lang", "source"):
        docs = docs.withColumn(c, F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string"))
    text = F.col("text").cast("string")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(text).cast("long"), F.lit(0)).alias("_bytes"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("_text"), "lang", "source")
    cells = [*(by_rank(c, name_cuts(docs, c, scratch)) for c in ("lang", "source")), by_size("_bytes")]
    out = sharded(narrow.select("doc_id", (F.col("_bytes") + 1).alias("size"), "_bytes", "text_crc32", "_text", "lang", "source"), cells, shards, ["_text", "doc_id"], scratch=scratch)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, placed: DataFrame, folder: str) -> None:
    """`docs` as Parquet under folder/shard=N, each file in curve order, so that file and row-group ranges prune.

    `placed`: shard_documents(docs). Rows are matched by doc_id, null or not, and text, null, empty or very long; rows
    that repeat in both all go to the least shard of theirs. Extra columns are written too, but for those named shard
    or curve. An empty table writes no file.
    """
    docs = docs.drop("shard", "curve")
    at, crc, size, to = (fresh(docs.columns, n) for n in ("_id", "_crc", "_size", "_to"))
    keys = placed.select(F.col("doc_id").alias(at), F.col("text_crc32").alias(crc), F.col("size").alias(size), F.struct("shard", "curve").alias(to))
    keys = keys.groupBy(at, crc, size).agg(F.min(to).alias(to)).select(at, crc, size, f"{to}.*")
    text = F.col("text").cast("string")
    both = docs.join(keys, F.col("doc_id").cast("long").eqNullSafe(F.col(at)) & F.crc32(F.encode(text, "UTF-8")).eqNullSafe(F.col(crc)) & (F.coalesce(F.octet_length(text), F.lit(0)) + 1 == F.col(size)))
    both.repartitionByRange("shard", "curve").sortWithinPartitions("shard", "curve").select(*named(docs.columns), "shard").write.partitionBy("shard").parquet(folder)
