"""Scans: inclusive bounds, direction, projections, filters, ordered lookups, cursors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import staged


@dataclass(frozen=True)
class ScanSpec:
    """A range scan. A missing bound is unbounded; infinities are never data."""

    start: object = None
    start_inclusive: bool = True
    end: object = None
    end_inclusive: bool = True
    backward: bool = False
    keys: bool = True
    records: bool = True
    sort: bool = True
    delta: bool = False
    object_type: str | None = None
    pattern: str | None = None
    now_ms: int | None = None
    limit: int | None = None


def within(key: Column, spec: ScanSpec) -> Column:
    """Plain comparisons, which reach the Parquet reader."""
    out = F.lit(True)
    if spec.start is not None:
        out = out & (key >= spec.start if spec.start_inclusive else key > spec.start)
    if spec.end is not None:
        out = out & (key <= spec.end if spec.end_inclusive else key < spec.end)
    return out


def glob_regex(pattern: str) -> str:
    """``*``, ``?``, ``[...]`` and a backslash escape as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out += "\\" + pattern[i] if not pattern[i].isalnum() else pattern[i]
        elif c == "[" and (end := pattern.find("]", i + 1)) > 0:
            out += "[" + pattern[i + 1 : end].replace("\\", "\\\\") + "]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c, c if c.isalnum() or c in "_ " else "\\" + c)
        i += 1
    return f"^{out}$"


def alive(ttl_ms: Column, now_ms: int) -> Column:
    """Rows that expire exactly now survive."""
    return ttl_ms.isNull() | (ttl_ms >= now_ms)


def scan(df: DataFrame, spec: ScanSpec, key: str = "key", records: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``df`` (key, payload columns, optionally status, object_type, ttl_ms) that the spec asks for."""
    out = df.filter(within(F.col(key), spec))
    if not spec.delta and "status" in df.columns:
        out = out.filter(F.col("status") == "Normal")
    if spec.object_type is not None:
        out = out.filter(F.col("object_type") == spec.object_type)
    if spec.pattern is not None:
        out = out.filter(F.col(key).cast("string").rlike(glob_regex(spec.pattern)))
    if spec.now_ms is not None:
        out = out.filter(alive(F.col("ttl_ms"), spec.now_ms))
    rest = list(records) if records is not None else [c for c in df.columns if c != key]
    kept = ([key] if spec.keys else []) + (rest if spec.records else [])
    if spec.sort or spec.limit is not None:
        out = out.orderBy(F.col(key).desc() if spec.backward else F.col(key).asc())
    out = out.select(*kept)
    return out.limit(spec.limit) if spec.limit is not None else out


def batch_read(df: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Every asked key with its row; a missing one is Deleted at version 1."""
    found = keys.join(df, key, "left")
    gone = F.col("status").isNull()
    return found.withColumn("version_ts", F.when(gone, F.lit(1).cast("long")).otherwise(F.col("commit_ts"))).withColumn("status", F.coalesce("status", F.lit("Deleted"))).drop("commit_ts")


def read_ttl(df: DataFrame, now_ms: int) -> DataFrame:
    """A row whose lifetime is over reads as Deleted at version 1."""
    over = (F.col("ttl_ms") > 0) & (F.col("ttl_ms") < now_ms)
    return df.withColumn("read_status", F.when(over, "Deleted").otherwise(F.col("status"))).withColumn("version_ts", F.when(over, F.lit(1).cast("long")).otherwise(F.col("commit_ts")))


def floor_lookup(df: DataFrame, probes: DataFrame, key: str = "key", probe: str = "probe") -> DataFrame:
    """Per probe the greatest key that is not above it: one ordered pass over the union, no range join.

    Keys are range partitioned with the probes by blocks of the probe order, so equal neighbours
    meet; each block starts from the greatest key before it.
    """
    both = df.select(F.col(key).alias("at"), F.col(key).alias("floor"), F.lit(0).alias("side")).unionByName(probes.select(F.col(probe).alias("at"), F.lit(None).cast(df.schema[key].dataType).alias("floor"), F.lit(1).alias("side")))
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = staged(both.repartitionByRange(parts, "at").withColumn("part", F.spark_partition_id()))  # both uses below must see the same parts
    greatest = dealt.groupBy("part").agg(F.max("floor").alias("most"))
    before = greatest.select("part", F.max("most").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))  # one row for each partition
    w = Window.partitionBy("part").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    seen = dealt.withColumn("seen", F.last("floor", ignorenulls=True).over(w)).filter("side = 1")
    return seen.join(F.broadcast(before), "part").select(F.col("at").alias(probe), F.coalesce("seen", "carried").alias("floor"))


def lower_bound(df: DataFrame, probes: DataFrame, key: str = "key", probe: str = "probe") -> DataFrame:
    """Per probe the least key that is not below it: ``floor_lookup`` from the other side."""
    turned = floor_lookup(df.select((-F.col(key)).alias(key)), probes.select((-F.col(probe)).alias(probe)), key, probe)
    return turned.select((-F.col(probe)).alias(probe), (-F.col("floor")).alias("bound"))


def gaps(df: DataFrame, spec: ScanSpec, key: str = "key") -> DataFrame:
    """The gaps that a scan locks besides its keys: per key within the bounds, the one before it (null at the start).

    One ordered pass: keys look up the greatest below them.
    """
    keys = df.filter(within(F.col(key), spec)).select(F.col(key))
    before = floor_lookup(keys, keys.select((F.col(key) - 1).alias("probe")), key)
    return before.select((F.col("probe") + 1).alias(key), F.col("floor").alias("after"))


#: Saved positions that are broadcast; more are joined by a shuffle.
BROADCAST_POSITIONS = 100_000


def resume(df: DataFrame, positions: DataFrame, batch: int, key: str = "key", bucket: str = "bucket", version: int | None = None) -> DataFrame:
    """The next ``batch`` rows of every bucket after its saved position (bucket, last_key).

    Positions may carry the version of the configuration they were saved under; with a ``version`` given,
    one saved under another is an error, as its buckets may have moved.
    """
    if version is not None and not positions.filter(F.col("version") != version).isEmpty():
        raise ValueError(f"positions were not saved under version {version}")
    at = positions.select(bucket, "last_key")
    few = at.limit(BROADCAST_POSITIONS + 1).count() <= BROADCAST_POSITIONS
    after = df.join(F.broadcast(at) if few else at, bucket, "left").filter(F.col("last_key").isNull() | (F.col(key) > F.col("last_key")))
    return after.withColumn("rn", F.row_number().over(Window.partitionBy(bucket).orderBy(key))).filter(F.col("rn") <= batch).drop("rn", "last_key")
