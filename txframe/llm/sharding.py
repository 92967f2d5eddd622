"""Sharding along a Hilbert curve over several metadata dimensions.

Language, source and size are quantised to 8 bits each; the index of that cell on a
three-dimensional Hilbert curve orders the documents, and runs of the order are cut into shards
whose row counts differ by one at most. Neighbours on the curve are near in every dimension, so
each shard's files span narrow ranges of all three and readers can skip files on any of them.

Nulls and odd input: a null text counts as empty (size 8, CRC 0); null languages and sources
rank after all others; rows that repeat get a slot each; fewer rows than shards leave the last
shards empty; an empty table gives an empty one. ``sharded`` carries other columns along untouched,
save ``shard`` and ``slot``: where a table has such columns already, the new ones take their place.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import OWN, prefix_sums, staged

SHARDS = 24
BITS = 8
DIMS = 3
#: Bytes that a document has besides its text.
OVERHEAD = 8
#: Distinct values of a dimension up to which their ranks go to every executor.
BROADCAST_VALUES = 20_000


@lru_cache
def curve_steps(dims: int = DIMS) -> tuple[list[int], list[int]]:
    """Hilbert's curve as an automaton: per (state, corner), the digit on the curve and the next state.

    A state is an entry corner and an axis. A corner, seen from that entry along that axis, is a
    Gray code; its rank is the digit, and the sub-cube's own entry and axis make the next state.
    """
    full, n = (1 << dims) - 1, 1 << dims

    def rotate(x: int, k: int) -> int:
        k %= dims
        return ((x << k) | (x >> (dims - k))) & full

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    def trailing_ones(i: int) -> int:
        return (~i & (i + 1)).bit_length() - 1

    rank = {gray(i): i for i in range(n)}
    digits, states = [], []
    for entry in range(n):
        for axis in range(dims):
            for corner in range(n):
                w = rank[rotate(corner ^ entry, dims - axis - 1)]
                inner = 0 if w == 0 else gray(2 * ((w - 1) // 2))
                turn = 0 if w == 0 else trailing_ones(w - 1 if w % 2 == 0 else w) % dims
                digits.append(w)
                states.append((entry ^ rotate(inner, axis + 1)) * dims + (axis + turn + 1) % dims)
    return digits, states


def curve_index(cells: list[Column], bits: int = BITS) -> Column:
    """Index on the curve of a cell given by one number of ``bits`` bits for each dimension."""
    dims = len(cells)
    digits, states = (F.lit(x) for x in curve_steps(dims))

    def step(acc: Column, level: Column) -> Column:
        corner = F.lit(0)
        for k, c in enumerate(cells):
            corner = corner + F.call_function("shiftright", c, level).bitwiseAND(F.lit(1)) * (1 << k)
        at = acc["state"] * (1 << dims) + corner
        return F.struct((acc["index"] * (1 << dims) + F.get(digits, at)).cast("long").alias("index"), F.get(states, at).cast("int").alias("state"))

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda a: a["index"])


def value_cells(df: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """Per distinct value of ``column``: its rank, scaled to ``bits`` bits, nulls last."""
    values = staged(df.select(F.col(column).alias(OWN + "v")).distinct())
    n = values.count()
    ranked = prefix_sums(values, [], [F.col(OWN + "v").asc_nulls_last()], {})
    ranked = ranked.select(OWN + "v", F.floor(F.col("before_rows") * (1 << bits) / F.lit(max(n, 1))).cast("int").alias(OWN + column + "_cell"))
    return F.broadcast(ranked) if n <= BROADCAST_VALUES else ranked


def size_cell(size: Column, bits: int = BITS) -> Column:
    """Twelve steps for each doubling of the size."""
    return F.least(F.floor(F.log2(size.cast("double")) * 12), F.lit((1 << bits) - 1)).cast("int")


def row_hash() -> Column:
    """Rows that share it and doc_id share all that decides their place."""
    return F.xxhash64(F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit("")), F.lit(1), F.coalesce("source", F.lit("")), F.col("lang").isNull(), F.col("source").isNull())


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row of ``docs``: doc_id, row_hash, size, text_crc32, curve, rank, shard and slot."""
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = staged(docs.select("doc_id", "lang", "source", row_hash().alias("row_hash"), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32")))
    n = rows.count()
    for c in ("lang", "source"):
        cells = value_cells(rows, c)
        rows = rows.join(cells, F.col(c).eqNullSafe(F.col(OWN + "v"))).drop(OWN + "v")
    curve = curve_index([F.col(OWN + "lang_cell"), F.col(OWN + "source_cell"), size_cell(F.col("size"))])
    rows = rows.withColumn("curve", curve).select("doc_id", "row_hash", "size", "text_crc32", "curve")
    ranked = prefix_sums(rows, [], [F.col("curve").asc(), F.col("row_hash").asc(), F.col("doc_id").asc_nulls_last()], {}).withColumnRenamed("before_rows", "rank")
    return cut(ranked, shards, n)


def cut(ranked: DataFrame, shards: int, n: int, rank: str = "rank", shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Shard and slot from a gapless rank of ``n`` rows: the first n mod shards shards hold one row more."""
    each, more = divmod(n, shards)
    longer = more * (each + 1)
    over = F.col(rank) - longer
    first = F.col(rank) < longer
    number = F.when(first, F.floor(F.col(rank) / (each + 1))).otherwise(more + F.floor(over / max(each, 1)))
    place = F.when(first, F.col(rank) % (each + 1)).otherwise(over % max(each, 1))
    return ranked.withColumn(shard, number.cast("int")).withColumn(slot, place.cast("long"))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with shard and slot, dealt so that each output file covers a run of one shard.

    Texts are shuffled twice, to their ranks and to their places: a place's partition follows from
    shard and slot, so nothing is sampled.
    """
    keyed = assign(docs, shards).groupBy(F.col("doc_id").alias(OWN + "id"), F.col("row_hash").alias(OWN + "h")).agg(F.min("rank").alias(OWN + "rank"), F.count(F.lit(1)).alias(OWN + "k"))
    plan = staged(keyed)
    n = plan.agg(F.sum(OWN + "k")).first()[0] or 0
    joined = docs.withColumn(OWN + "row", row_hash()).join(plan, F.col("doc_id").eqNullSafe(F.col(OWN + "id")) & (F.col(OWN + "row") == F.col(OWN + "h")))
    # equal rows hold consecutive ranks, and each takes one; the join has brought them together
    again = Window.partitionBy("doc_id", OWN + "row").orderBy("doc_id", OWN + "row")
    ranked = joined.withColumn(OWN + "at", F.col(OWN + "rank") + F.row_number().over(again) - 1)
    placed = cut(ranked, shards, n, OWN + "at", OWN + "shard", OWN + "slot")
    # so many runs of slots to a shard, and a partition for each
    runs = max(1, -(-int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")) // shards))
    longest = max(1, -(-n // shards))
    run = F.least(F.floor(F.col(OWN + "slot") * runs / longest), F.lit(runs - 1)).cast("int")
    dealt = placed.repartitionById(shards * runs, F.col(OWN + "shard") * runs + run).sortWithinPartitions(OWN + "shard", OWN + "slot")
    return dealt.select(*[c for c in docs.columns if c not in ("shard", "slot")], F.col(OWN + "shard").alias("shard"), F.col(OWN + "slot").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """One folder for each shard, rows in slot order."""
    sharded(docs, shards).write.partitionBy("shard").parquet(path)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharded(docs)
