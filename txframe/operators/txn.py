"""Transactions over tables: write sets, overlays, validation, commit times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ordered_fold


def fold(ops: DataFrame, check_unique: bool = False) -> DataFrame:
    """A transaction's operations (key, seq, op, payload) as one final operation for each key.

    Operations fold one after the other as the shuffle has sorted them; of a key only the operation
    so far is held, whatever their number.
    """
    again = "DuplicateKey" if check_unique else "Insert"
    merged = {("Insert", "Insert"): again, ("Insert", "Update"): "Insert", ("Insert", "Delete"): "Delete", ("Update", "Update"): "Update", ("Update", "Delete"): "Delete", ("Delete", "Insert"): "Update", ("Delete", "Delete"): "Delete"}

    def of(key: tuple):
        op = payload = None
        n = 0

        def step(row: tuple | None):
            nonlocal op, payload, n
            if row is None:
                yield (key[0], op, payload, n)
                return
            op = row[2] if op is None else op if op in ("Illegal", "DuplicateKey") else merged.get((op, row[2]), "Illegal")
            payload, n = row[3], n + 1

        return step

    rows = ops.select("key", "seq", "op", "payload")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return ordered_fold(rows, ["key"], ["seq", "op", "payload"], f"key {kinds['key']}, op string, payload {kinds['payload']}, n_ops long", of)


def overlay(base: DataFrame, ws: DataFrame, value: str = "price", keep_deleted: bool = False) -> DataFrame:
    """Base rows under a write set: own values win; own deletes vanish, or with ``keep_deleted`` are there with the status Deleted."""
    w = ws.select("key", F.col("op"), F.col(value).alias("own"))
    gone = F.coalesce(F.col("op") == "Delete", F.lit(False))
    both = base.select("key", value).join(w, "key", "full_outer")
    kept = both if keep_deleted else both.filter(~gone)
    out = kept.select("key", F.when(~gone, F.coalesce("own", value)).alias(value), F.when(F.col("op").isNull(), "base").otherwise("own").alias("origin"), *([F.when(gone, "Deleted").otherwise("Normal").alias("status")] if keep_deleted else []))
    return out


def read_own(base: DataFrame, ws: DataFrame, keys: DataFrame, value: str = "price") -> DataFrame:
    """Point reads that see the write set first: own writes have version 0, own deletes and absent keys are Deleted."""
    w = ws.select("key", "op", F.col(value).alias("own"))
    j = keys.join(w, "key", "left").join(base.select("key", F.col(value).alias("old"), "commit_ts"), "key", "left")
    status = F.when(F.col("op") == "Delete", "Deleted").when(F.col("op").isNotNull() | F.col("commit_ts").isNotNull(), "Normal").otherwise("Deleted")
    version = F.when(F.col("op").isNotNull(), F.lit(0)).otherwise(F.coalesce("commit_ts", F.lit(1))).cast("long")
    return j.select("key", status.alias("status"), F.when(status == "Normal", F.coalesce("own", "old")).alias(value), version.alias("version_ts"))


def validate(reads: DataFrame, current: DataFrame, locks: DataFrame) -> DataFrame:
    """Per transaction of reads (txn, key, version_ts): whether each version is still current and unlocked by others."""
    c = current.select("key", F.col("commit_ts").alias("now_ts"))
    held = locks.groupBy("key").agg(F.min("holder").alias("lo"), F.max("holder").alias("hi"))
    j = reads.join(c, "key", "left").join(held, "key", "left")
    stale = (F.col("version_ts") > 0) & (F.col("version_ts") != F.coalesce("now_ts", F.lit(1)))
    other = F.coalesce((F.col("lo") != F.col("txn")) | (F.col("hi") != F.col("txn")), F.lit(False))
    return j.groupBy("txn").agg(F.sum(stale.cast("long")).alias("mismatches"), F.sum((~stale & other).cast("long")).alias("conflicts")).select(
        "txn", "mismatches", "conflicts", F.when(F.col("mismatches") > 0, "VERSION_MISMATCH").when(F.col("conflicts") > 0, "CONFLICTED").otherwise("OK").alias("outcome")
    )


def repeatable_breaks(reads: DataFrame) -> DataFrame:
    """Reads (txn, key, seq, version_ts) that find a newer version than the transaction read before."""
    w = Window.partitionBy("txn", "key").orderBy("seq")
    return reads.withColumn("before_ts", F.lag("version_ts").over(w)).filter("before_ts <> 0 AND version_ts > before_ts")


def commit_times(bounds: DataFrame, writes: DataFrame, reads: DataFrame) -> DataFrame:
    """Per transaction the least commit time after its bound, its keys' commits and validations, and its reads."""
    w = writes.groupBy("txn").agg((F.max(F.greatest("commit_ts", "last_vali_ts")) + 1).alias("w"))
    r = reads.groupBy("txn").agg((F.max("version_ts") + 1).alias("r"))
    return bounds.join(w, "txn", "left").join(r, "txn", "left").select("txn", F.greatest("bound", "w", "r").alias("commit_ts"))


def install(log: DataFrame, ws: DataFrame, commit_ts: int, value: str = "price") -> DataFrame:
    """The log with a write set's versions appended at ``commit_ts``."""
    added = ws.select("key", F.lit(commit_ts).cast("long").alias("commit_ts"), F.when(F.col("op") == "Delete", "Deleted").otherwise("Normal").alias("status"), value)
    return log.select("key", "commit_ts", F.lit("Normal").alias("status"), value).unionByName(added)


def size_guard(ws: DataFrame, limit: int = 62 << 20) -> DataFrame:
    """Transactions whose write set is too large, by summed bytes (txn, bytes)."""
    return ws.groupBy("txn").agg(F.sum("bytes").alias("bytes")).withColumn("exceeded", F.col("bytes") > limit)
