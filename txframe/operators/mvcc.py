"""Versions: what is visible as of a time, archives, pruning, checkpoint export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible_as_of(log: DataFrame, read_ts: int, keep_deleted: bool = False) -> DataFrame:
    """Per key the newest version not after ``read_ts``; one aggregate, combined before the shuffle."""
    rest = [c for c in log.columns if c not in ("key", "commit_ts")]
    newest = log.filter(F.col("commit_ts") <= read_ts).groupBy("key").agg(F.max(F.struct("commit_ts", *rest)).alias("v")).select("key", "v.commit_ts", *[F.col("v")[c].alias(c) for c in rest])
    return newest if keep_deleted else newest.filter("status = 'Normal'")


def chain(log: DataFrame) -> DataFrame:
    """Versions of each key from the newest, as position 0, back."""
    return log.withColumn("position", (F.row_number().over(Window.partitionBy("key").orderBy(F.desc("commit_ts"))) - 1).cast("long"))


def prune(log: DataFrame, oldest: int) -> DataFrame:
    """Versions still needed by a reader at ``oldest``: the newest one not after it, and all later ones.

    The needed version is one aggregate for each key, so no key's versions are gathered in a task.
    """
    floor = log.filter(F.col("commit_ts") <= oldest).groupBy("key").agg(F.max("commit_ts").alias("floor"))
    return log.join(floor, "key", "left").filter(F.col("floor").isNull() | (F.col("commit_ts") >= F.col("floor"))).drop("floor")


def export(log: DataFrame, to_ts: int) -> DataFrame:
    """Versions not after ``to_ts``, each to the base (the newest of its key) or to the archive."""
    done = log.filter(F.col("commit_ts") <= to_ts)
    newest = done.groupBy("key").agg(F.max("commit_ts").alias("newest"))
    return done.join(newest, "key").withColumn("target", F.when(F.col("commit_ts") == F.col("newest"), "base").otherwise("archive")).drop("newest")


def miss_class(read_ts: int, current_ts: Column, oldest_ts: Column, ckpt_ts: Column) -> Column:
    """What a read finds in a cache that holds the versions from oldest_ts to current_ts."""
    return F.when(current_ts <= read_ts, "Hit").when(oldest_ts <= read_ts, "ArchiveHit").when(ckpt_ts == 0, "VersionUnknown").when(ckpt_ts <= read_ts, "BaseVersionMiss").otherwise("ArchiveVersionMiss")


def checkpoint_ts(locks: DataFrame, raw_ts: int, delay: int) -> DataFrame:
    """The time up to which a checkpoint may export: before every write lock, and not much behind the clock."""
    least = F.coalesce(F.min("lock_ts") - 1, F.lit(raw_ts))
    return locks.agg(least.alias("m")).select(F.when(F.col("m") < raw_ts - delay, F.lit(raw_ts - delay)).when(F.col("m") < raw_ts, F.col("m")).otherwise(F.lit(raw_ts)).cast("long").alias("ckpt_ts"))


def set_flushed(log: DataFrame, ckpt_ts: int) -> DataFrame:
    """Versions with the time they were flushed at: those a checkpoint at ``ckpt_ts`` exported."""
    return log.withColumn("flushed_ts", F.when(F.col("commit_ts") <= ckpt_ts, F.lit(ckpt_ts)))


def max_active_ts(snapshots: DataFrame) -> DataFrame:
    """The greatest start of the snapshot transactions (start_ts, active) that still run."""
    return snapshots.filter("active").agg(F.max("start_ts").alias("max_active_ts"))


def archive_before_update(entry_status: Column, commit_ts: Column, oldest_active: Column) -> Column:
    """Whether a version goes to the archive before it is replaced: it must be known, and some snapshot must be able to see it."""
    return (entry_status != "Unknown") & (commit_ts > 1) & (oldest_active.isNull() | (oldest_active >= commit_ts))


def merge_archives(archive: DataFrame, more: DataFrame) -> DataFrame:
    """Archives with added versions, each (key, commit_ts) once."""
    return archive.unionByName(more).dropDuplicates(["key", "commit_ts"])


def backfill(cached: DataFrame, fetched: DataFrame) -> DataFrame:
    """Cached rows (key, commit_ts, status, payload, ckpt_ts) after versions (key, commit_ts, status, payload) came from the store.

    A row that was Unknown becomes the version fetched; beside a newer row that version goes to the
    archive; else the row stays. What was fetched is checkpointed. ``target`` says base or archive. One
    version is fetched for each key.
    """
    f = fetched.select("key", F.struct("commit_ts", "status", "payload").alias("f"))
    j = cached.join(f, "key", "left")
    unknown = (F.col("status") == "Unknown") & F.col("f").isNotNull()
    filled = [F.when(unknown, F.col(f"f.{c}")).otherwise(F.col(c)).alias(c) for c in ("commit_ts", "status", "payload")]
    ckpt = F.greatest("ckpt_ts", F.col("f.commit_ts")).alias("ckpt_ts")
    base = j.select("key", *filled, ckpt, F.lit("base").alias("target"))
    older = j.filter((F.col("status") != "Unknown") & (F.col("commit_ts") > F.col("f.commit_ts")))
    return base.unionByName(older.select("key", "f.commit_ts", "f.status", "f.payload", ckpt, F.lit("archive").alias("target")))
