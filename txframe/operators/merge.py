"""Merging sorted runs and secondary indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_runs(mem: DataFrame, kv: DataFrame, key: str = "key") -> DataFrame:
    """Both runs with the memory row where both have a key, each marked with its run."""
    return mem.withColumn("run", F.lit("mem")).unionByName(kv.join(mem.select(key), key, "left_anti").withColumn("run", F.lit("kv")))


def batch_cut(runs: DataFrame, key: str = "key") -> DataFrame:
    """Rows of unfinished runs (run, key, drained) up to the least of their last keys."""
    ends = runs.groupBy("run").agg(F.max(key).alias("last"), F.max("drained").alias("drained"))
    bound = ends.filter("NOT drained").agg(F.min("last").alias("bound"))
    return runs.join(F.broadcast(bound), F.col("bound").isNull() | (F.col(key) <= F.col("bound"))).drop("bound")  # one row


def newest_wins(base: DataFrame, more: DataFrame, key: str = "key", ts: str = "commit_ts") -> DataFrame:
    """A bulk upsert: of each key the row with the newest commit time."""
    rest = [c for c in base.columns if c not in (key, ts)]
    return base.unionByName(more).groupBy(key).agg(F.max(F.struct(ts, *rest)).alias("v")).select(key, *[F.col("v")[c].alias(c) for c in (ts, *rest)])


def build_index(base: DataFrame, sk: Column, scan_ts: int, keep: Column | None = None, multi: bool = False) -> DataFrame:
    """Index entries (sk, key, commit_ts) of rows committed by ``scan_ts``: none, one or many for each row."""
    rows = base.filter(F.col("commit_ts") <= scan_ts)
    if "status" in base.columns:
        rows = rows.filter("status = 'Normal'")
    if keep is not None:
        rows = rows.filter(keep)
    return rows.select((F.explode(sk) if multi else sk).alias("sk"), "key", "commit_ts")


def violations(index: DataFrame) -> DataFrame:
    """Values of a unique index that several rows hold."""
    return index.groupBy("sk").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def guarded_lookup(index: DataFrame, base: DataFrame) -> DataFrame:
    """Index entries with their base rows; one older than its entry is pending, not valid."""
    b = base.select("key", F.col("commit_ts").alias("base_ts"), "price")
    return index.join(b, "key").withColumn("stale", F.col("base_ts") < F.col("commit_ts"))
