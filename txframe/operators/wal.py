"""Write-ahead log: grouping, replay, truncation, recovery verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import prefix_sums

HOUR_US = 3_600_000_000


def log_group(txn: Column, groups: int) -> Column:
    return F.pmod(txn, F.lit(groups))


def by_node_group(wal: DataFrame) -> DataFrame:
    """Per (txn, ng) its records and terms; two terms in one group abort."""
    return wal.groupBy("txn", "ng_id").agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct("term").alias("n_terms")).withColumn("aborts", F.col("n_terms") > 1)


def replay(wal: DataFrame, ng: int, start_ts: int) -> DataFrame:
    return wal.filter((F.col("ng_id") == ng) & (F.col("commit_ts") > start_ts))


#: What a record does, in the order in which replay takes it: schemas before ranges, ranges before data.
CLASSES = ("schema", "split", "scale", "data")


def append(records: DataFrame, path: str) -> None:
    """Appends records to a log, sorted by (commit_ts, ng_id, txn) within files, whose bounds let replay skip files."""
    records.repartition("ng_id").sortWithinPartitions("commit_ts", "ng_id", "txn").write.mode("append").parquet(path)


def replay_order(wal: DataFrame, ng: int, start_ts: int) -> DataFrame:
    """What replay of a group takes, numbered: by class of operation, then commit time and transaction. Each (ng_id, txn, key) counts once."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, CLASSES)), F.col("class")), F.lit(len(CLASSES) + 1))
    once = replay(wal, ng, start_ts).dropDuplicates(["ng_id", "txn", "key"]).withColumn("place", place)
    return prefix_sums(once, [], [F.col("place").asc(), F.col("commit_ts").asc(), F.col("txn").asc(), F.col("key").asc()], {}, out="at").withColumnRenamed("at_rows", "position").drop("place")


def multistage_verdict(asked: DataFrame, stages: DataFrame) -> DataFrame:
    """Per asked txn of an operation in several stages: what recovery does, by the farthest stage that was logged.

    Prepared but not committed is rolled back, committed but not clean is carried on, clean is done, and
    what was never logged is not there.
    """
    j = asked.join(latest_stage(stages).select("txn", "stage"), "txn", "left")
    return j.select("txn", F.when(F.col("stage").isNull(), "Unknown").when(F.col("stage") == "Prepare", "RollBack").when(F.col("stage") == "Commit", "CarryOn").otherwise("Done").alias("verdict"))


def remaining_stages(stages: DataFrame, order: Sequence[str], committed: str) -> DataFrame:
    """Of operations that were broken off the stages (txn, position, stage) that recovery has yet to run, by the farthest that was logged.

    One that reached ``committed`` runs all that follow; another is rolled back, which is the last stage alone.
    """
    far = latest_stage(stages).select("txn", F.array_position(F.array(*map(F.lit, order)), F.col("stage")).alias("at"))
    first = F.when(F.col("at") >= order.index(committed) + 1, F.col("at") + 1).otherwise(F.lit(len(order)))
    todo = far.filter((F.col("at") > 0) & (F.col("at") < len(order))).select("txn", F.explode(F.sequence(first.cast("long"), F.lit(len(order)).cast("long"))).alias("position"))
    return todo.select("txn", "position", F.element_at(F.array(*map(F.lit, order)), F.col("position").cast("int")).alias("stage"))


def replay_waves(wal: DataFrame) -> DataFrame:
    """Adds ``wave``: how many changes of schema of the group come before a record, which must be in place before it is replayed.

    At one time changes of schema come first. Records of one wave are independent of each other.
    """
    rows = wal.withColumn("ddl", (F.col("class") != "data").cast("long"))
    order = [F.col("commit_ts").asc(), F.col("ddl").desc(), F.col("txn").asc(), F.col("key").asc()]
    return prefix_sums(rows, ["ng_id"], order, {"ddl": "ddl"}, out="n").withColumnRenamed("n_ddl", "wave").drop("ddl", "n_rows")


def tx_status(asked: DataFrame, wal: DataFrame, open_txns: DataFrame) -> DataFrame:
    """Per asked (txn, at_ts): Committed if it is logged, Ongoing if open, else Aborted; and the commit time, put off to after ``at_ts`` while it is open."""
    logged = wal.groupBy("txn").agg(F.max("commit_ts").alias("logged"))
    j = asked.join(logged, "txn", "left").join(open_txns.select("txn", F.col("bound").alias("open_bound")), "txn", "left")
    status = F.when(F.col("logged").isNotNull(), "Committed").when(F.col("open_bound").isNotNull(), "Ongoing").otherwise("Aborted")
    return j.select("txn", status.alias("status"), F.coalesce("logged", F.greatest("open_bound", F.when(F.col("open_bound").isNotNull(), F.col("at_ts") + 1))).alias("commit_ts"))


def replay_apply(wal: DataFrame, base: DataFrame, schema_ts: int) -> DataFrame:
    """Base rows after replay: a record counts if newer than the row and not older than the schema; the newest wins."""
    b = base.select("key", F.col("commit_ts").alias("base_ts"), F.col("payload").alias("base_payload"), F.col("status").alias("base_status"))
    newest = wal.filter(F.col("commit_ts") >= schema_ts).groupBy("key").agg(F.max(F.struct("commit_ts", "payload", "status")).alias("v"))
    j = b.join(newest, "key", "full_outer")
    newer = F.col("v").isNotNull() & (F.col("base_ts").isNull() | (F.col("v.commit_ts") > F.col("base_ts")))
    pick = lambda c: F.when(newer, F.col(f"v.{c}")).otherwise(F.col("base_ts" if c == "commit_ts" else f"base_{c}")).alias(c)
    return j.select("key", pick("commit_ts"), pick("payload"), pick("status"))


def min_checkpoint(ckpts: DataFrame) -> DataFrame:
    """The least, over groups, of each one's greatest checkpoint."""
    return ckpts.groupBy("ng_id").agg(F.max("ckpt_ts").alias("m")).agg(F.min("m").alias("min_ckpt_ts"))


def truncate(wal: DataFrame, ckpts: DataFrame) -> DataFrame:
    return wal.join(F.broadcast(min_checkpoint(ckpts)), F.col("commit_ts") > F.col("min_ckpt_ts")).drop("min_ckpt_ts")  # one row


def cleaned_stages(stages: DataFrame, min_ckpt: int) -> DataFrame:
    """Multi-stage operations that may go: clean, and an hour behind every checkpoint."""
    return latest_stage(stages).filter((F.col("stage") == "Clean") & (F.lit(min_ckpt) > F.col("commit_ts") + HOUR_US))


def latest_stage(stages: DataFrame) -> DataFrame:
    """Per txn its farthest stage (txn, stage_ord, stage, commit_ts)."""
    return stages.groupBy("txn").agg(F.max(F.struct("stage_ord", "stage", "commit_ts")).alias("s")).select("txn", "s.stage_ord", "s.stage", "s.commit_ts")


def recovery_verdict(asked: DataFrame, terms: DataFrame, wal: DataFrame) -> DataFrame:
    """Per asked (txn, ng_id, term): Committed, NotCommitted or RecoverError."""
    t = terms.select("ng_id", F.col("term").alias("now"))
    logged = wal.select("txn", F.lit(True).alias("logged")).distinct()
    j = asked.join(t, "ng_id", "left").join(logged, "txn", "left")
    return j.select("txn", F.when(F.col("now").isNull(), "RecoverError").when(F.col("now") != F.col("term"), "NotCommitted").when(F.col("logged"), "Committed").otherwise("NotCommitted").alias("verdict"))
