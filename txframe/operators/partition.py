"""Buckets, ranges, slices and migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import murmur3_32
from .skew import hot_join, prefix_sums

BUCKETS = 1024
SEED = 9001
SLICE_MOST, SLICE_LEAST = 16 * 1024, 4 * 1024


def key_bucket(h: Column) -> Column:
    return F.pmod(h.bitwiseAND(0x3FFF), F.lit(BUCKETS))


def range_bucket(range_id: Column) -> Column:
    return F.pmod(murmur3_32(range_id, SEED), F.lit(BUCKETS))


def bucket_core(bucket: Column, cores: int) -> Column:
    return F.pmod(bucket.bitwiseAND(0x3FF), F.lit(cores))


def shard_code(ng: Column, residual: Column) -> Column:
    return F.shiftleft(ng, 10).bitwiseOR(residual.bitwiseAND(0x3FF))


def shard_parts(code: Column) -> Column:
    """Node group and residual of a shard code."""
    return F.struct(F.shiftright(code, 10).alias("ng"), code.bitwiseAND(0x3FF).alias("residual"))


def tx_number(core: Column, counter: Column) -> Column:
    """A transaction's number: the global core in the upper half, a counter in the lower."""
    return F.shiftleft(core.cast("long"), 32).bitwiseOR(counter.cast("long").bitwiseAND(0xFFFFFFFF))


def bucket_partition(bucket: Column, partitions: int) -> Column:
    """The store partition of a bucket, and so of its keys: neighbouring buckets go to different ones."""
    return F.pmod(bucket, F.lit(partitions))


def ranges_in_bucket(ranges: DataFrame, slices: DataFrame) -> DataFrame:
    """Per bucket its ranges and slices, counted, from (range_id) and (range_id, slice_id)."""
    per = slices.groupBy("range_id").agg(F.count(F.lit(1)).alias("n"))
    placed = ranges.select("range_id", range_bucket(F.col("range_id")).alias("bucket")).join(per, "range_id", "left")
    return placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_ranges"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_slices"))


def slice_update(slices: DataFrame) -> DataFrame:
    """What a checkpoint does to slices (slice_id, bytes, after_bytes, exported, rows): split, resize or keep; and the average size of their rows.

    A slice is split only if its size after the checkpoint is known, over the limit and over what it
    was, and only once all its rows were exported.
    """
    grown = F.col("after_bytes").isNotNull() & (F.col("after_bytes") > SLICE_MOST) & (F.col("after_bytes") > F.col("bytes"))
    action = F.when(grown & F.col("exported"), "split").when(F.col("after_bytes").isNotNull() & F.col("exported"), "resize").otherwise("keep")
    parts = F.when(action == "split", F.ceil(F.col("after_bytes") / (SLICE_MOST // 2))).otherwise(1)
    average = F.when(F.col("exported") & (F.col("rows") > 0), F.floor(F.coalesce("after_bytes", "bytes") / F.col("rows")))
    return slices.select("slice_id", action.alias("action"), parts.cast("long").alias("parts"), average.cast("long").alias("avg_bytes"))


def split_flush(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows (range_id, key, ...) by the part of their range after a split: ``new_range`` is the greatest cut (range_id, part, start_key) not above the key, part 0 before all.

    Cuts of a range are few, as its size is bounded; they reach its rows as one sorted array.
    """
    per = cuts.groupBy("range_id").agg(F.array_sort(F.collect_list("start_key")).alias("starts"))
    return hot_join(rows, per, ["range_id"], "left").withColumn("part", F.coalesce(F.size(F.filter("starts", lambda x: x <= F.col("key"))), F.lit(0)).cast("long")).drop("starts")


def kick_out(cached: DataFrame, clean: str, start: int | None = None, stop: int | None = None, bucket: int | None = None, upto_ts: int | None = None) -> DataFrame:
    """What stays of cached rows (key, status, commit_ts, flushed) after one kind of cleaning: range, bucket, truncate or deleted. Rows not flushed yet always stay."""
    key = F.col("key")
    gone = {
        "range": (key >= F.lit(start if start is not None else -(1 << 63))) & (key < F.lit(stop if stop is not None else (1 << 63) - 1)), "bucket": key_bucket(key) == F.lit(bucket),
        "truncate": F.lit(True), "deleted": (F.col("status") == "Deleted") & (F.col("commit_ts") <= F.lit(upto_ts)),
    }[clean]
    return cached.filter(~(gone & F.col("flushed")))


def range_metadata(ranges: DataFrame) -> DataFrame:
    """Rows (range_id, start_key, stop_key, version) from ranges' start keys (range_id, start_key, version): a range ends where the next begins, the last nowhere.

    Range ids and start keys are metadata: a table's ranges are as many as its size over the size of a range.
    """
    nxt = prefix_sums(ranges, [], [F.col("start_key").asc()], {}, out="n")
    after = nxt.select((F.col("n_rows") - 1).alias("n_rows"), F.col("start_key").alias("stop_key"))
    return nxt.join(after, "n_rows", "left").select("range_id", "start_key", "stop_key", "version")


def ring(spark: SparkSession, groups: list[int], points: int = 64) -> DataFrame:
    """bucket, owner: each bucket belongs to the group whose point follows it on the ring.

    Points come from an integer formula, so every engine draws the same ring; of groups on one
    point the smallest owns it. The ring has 1024 places, whatever the data.
    """
    at = {}
    for g in sorted(groups):
        for i in range(points):
            at.setdefault((g * 7919 + i * 104729 + (g + 1) * i * 31) % BUCKETS, g)
    places = sorted(at)
    owner = [(b, at[next((p for p in places if p > b), places[0])]) for b in range(BUCKETS)]
    return spark.createDataFrame(owner, "bucket long, owner long")


def migration(before: DataFrame, after: DataFrame) -> DataFrame:
    """Buckets that change hands, by their old and new owner."""
    moved = before.join(after.withColumnRenamed("owner", "new_owner"), "bucket").filter("owner <> new_owner")
    return moved.groupBy("owner", "new_owner").agg(F.count(F.lit(1)).alias("n_buckets"), F.min("bucket").alias("first_bucket"), F.sum("bucket").alias("bucket_sum"))


def slice_flags(slices: DataFrame) -> DataFrame:
    return slices.withColumn("action", F.when(F.col("bytes") > SLICE_MOST, "split").when(F.col("bytes") < SLICE_LEAST, "merge").otherwise("keep"))


def slice_deltas(rows: DataFrame) -> DataFrame:
    """Size change of each slice from its dirty rows (slice_id, live, row_bytes, stored_bytes)."""
    return rows.groupBy("slice_id").agg(F.sum(F.when(F.col("live"), F.col("row_bytes") - F.col("stored_bytes")).otherwise(-F.col("stored_bytes"))).alias("delta"))


def range_splits(slices: DataFrame, most: int, fill: float = 0.6) -> DataFrame:
    """Start keys of the parts that ranges (range_id, start_key, bytes by slice) over ``most`` bytes are cut into.

    Slices add up in key order and a new part starts once one holds its share; the running sum
    starts anew there, so the slices of one range, bounded by the size of a range, fold in order.
    """
    ordered = F.array_sort(F.collect_list(F.struct("start_key", "bytes")))
    per = slices.groupBy("range_id").agg(ordered.alias("s"), F.sum("bytes").alias("total")).filter(F.col("total") > most)
    parts = F.ceil(F.col("total") / F.lit(most * fill))
    share = F.col("total") / parts

    def step(acc: Column, x: Column) -> Column:
        full = acc["sum"] >= share
        return F.struct(F.when(full, x["bytes"]).otherwise(acc["sum"] + x["bytes"]).alias("sum"), F.when(full, F.concat(acc["starts"], F.array(x["start_key"]))).otherwise(acc["starts"]).alias("starts"))

    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("starts"))
    cut = per.select("range_id", "total", F.posexplode(F.aggregate("s", start, step, lambda a: a["starts"])))
    return cut.select("range_id", (F.col("pos") + 1).cast("long").alias("part"), F.col("col").alias("start_key"))
