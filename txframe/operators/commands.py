"""Object commands and ordered change streams, in batch."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .skew import prefix_sums


def fold_sum(commands: DataFrame) -> DataFrame:
    """Per key an accumulator that overwrites set and other commands add to, in order.

    Commands before a key's last overwrite do not matter, so the rest is one sum.
    """
    kept = since_overwrite(commands)
    return kept.groupBy("key").agg(F.sum("payload").alias("value"), F.max("new_version").alias("version"))


def since_overwrite(commands: DataFrame) -> DataFrame:
    """Commands from each key's last overwrite on."""
    last = commands.filter("overwrite").groupBy("key").agg(F.max("new_version").alias("from_version"))
    return commands.join(last, "key", "left").filter("from_version IS NULL OR new_version >= from_version").drop("from_version")


def ordered_apply(commands: DataFrame) -> DataFrame:
    """Per key what can be applied: from the last overwrite, or the start, up to the first gap.

    Gives the version reached, how many commands were applied, their sum, and how many wait.
    """
    w = Window.partitionBy("key").orderBy("new_version")
    kept = since_overwrite(commands.dropDuplicates(["key", "new_version"]))
    before = F.coalesce(F.lag("new_version").over(w), F.lit(1).cast("long"))
    gap = kept.withColumn("gap", F.when(F.col("overwrite") | (F.col("obj_version") == before), 0).otherwise(1))
    run = gap.withColumn("gaps", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ok = F.col("gaps") == 0
    return run.groupBy("key").agg(
        F.coalesce(F.max(F.when(ok, F.col("new_version"))), F.lit(1).cast("long")).alias("version"), F.sum(ok.cast("long")).alias("applied"),
        F.coalesce(F.sum(F.when(ok, F.col("payload"))), F.lit(0).cast("long")).alias("value"), F.sum((~ok).cast("long")).alias("waiting"),
    )


def watermark(progress: DataFrame) -> DataFrame:
    """The time all subscribed groups have reached: the least of each group's greatest."""
    return progress.groupBy("seq_grp").agg(F.max("consistent_ts").alias("ts")).agg(F.min("ts").alias("watermark"))


def capture(log: DataFrame, shards: int = 4) -> DataFrame:
    """What a primary forwards to standbys: its changes (key, commit_ts, ...) numbered from 1 in each shard of keys, by commit time.

    Numbers come from prefix sums, so no task holds a shard.
    """
    numbered = prefix_sums(log.withColumn("seq_grp", F.pmod(F.col("key"), F.lit(shards)).cast("long")), ["seq_grp"], [F.col("commit_ts").asc(), F.col("key").asc()], {}, out="sent")
    return numbered.withColumn("seq_id", F.col("sent_rows") + 1).drop("sent_rows")


def standby_apply(messages: DataFrame, subscriptions: DataFrame, current: DataFrame) -> DataFrame:
    """What a standby makes of forwarded messages (seq_grp, epoch, key, commit_ts, payload, status).

    Messages of an epoch before the subscription's (seq_grp, epoch) are late and dropped, as are those
    not newer than the key's current version; of the rest the newest wins.
    """
    ok = messages.join(F.broadcast(subscriptions.select("seq_grp", F.col("epoch").alias("since"))), "seq_grp").filter("epoch >= since")  # a row for each shard
    newest = ok.groupBy("key").agg(F.max(F.struct("commit_ts", "payload", "status")).alias("v"))
    j = current.select("key", F.col("commit_ts").alias("c"), F.col("payload").alias("p"), F.col("status").alias("s")).join(newest, "key", "full_outer")
    newer = F.col("v").isNotNull() & (F.col("c").isNull() | (F.col("v.commit_ts") > F.col("c")))
    return j.select("key", F.when(newer, F.col("v.commit_ts")).otherwise(F.col("c")).alias("commit_ts"), F.when(newer, F.col("v.payload")).otherwise(F.col("p")).alias("payload"), F.when(newer, F.col("v.status")).otherwise(F.col("s")).alias("status"))


def late(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Messages of an epoch before their group's subscription."""
    return messages.join(F.broadcast(subscriptions.select("seq_grp", F.col("epoch").alias("since"))), "seq_grp").filter("epoch < since").drop("since")


def progress(messages: DataFrame) -> DataFrame:
    """Each message (seq_grp, seq_id, consistent_ts) with the greatest consistent time of its group so far, by prefix maxima."""
    return prefix_sums(messages, ["seq_grp"], [F.col("seq_id").asc()], {}, out="so_far", greatest={"ts": "consistent_ts"}).select("seq_grp", "seq_id", F.col("so_far_ts").alias("consistent_ts"))


def unexpired(commands: DataFrame, now_ms: int) -> DataFrame:
    """A command buffer (key, new_version, overwrite, valid_until, ...): a command that expired before now, or overwrites, erases all earlier ones of its key; equal versions count once.

    An expired command itself stays, as the point from which its object is gone.
    """
    resets = F.col("overwrite") | (F.col("valid_until") < now_ms)
    last = commands.groupBy("key").agg(F.max(F.when(resets, F.col("new_version"))).alias("from_version"))
    return commands.dropDuplicates(["key", "new_version"]).join(last, "key").filter("from_version IS NULL OR new_version >= from_version").drop("from_version")


def resend(sent: DataFrame, acked: DataFrame, most: int) -> DataFrame:
    """Messages (seq_grp, seq_id) not acknowledged yet; a group with more than ``most`` of them is out of sync and must subscribe anew."""
    last = acked.groupBy("seq_grp").agg(F.max("seq_id").alias("done"))
    open_ = sent.join(F.broadcast(last), "seq_grp", "left").filter("done IS NULL OR seq_id > done")  # a row for each shard
    return open_.groupBy("seq_grp").agg(F.min("seq_id").alias("from_seq"), F.max("seq_id").alias("to_seq"), F.count(F.lit(1)).alias("n")).withColumn("out_of_sync", F.col("n") > most)


def lag(sent: DataFrame, acked: DataFrame) -> DataFrame:
    s = sent.groupBy("seq_grp").agg(F.max("seq_id").alias("sent"))
    a = acked.groupBy("seq_grp").agg(F.max("seq_id").alias("acked"))
    return s.join(a, "seq_grp", "left").select("seq_grp", "sent", F.coalesce("acked", F.lit(0)).alias("acked"), (F.col("sent") - F.coalesce("acked", F.lit(0))).alias("lag"))


def fanout(messages: DataFrame, subscribers: DataFrame) -> DataFrame:
    """Each message to every subscriber of its channel: an equi-join on the channel."""
    return messages.join(subscribers, "channel")


def pop_match(waiters: DataFrame, elements: DataFrame) -> DataFrame:
    """Per key the n-th waiter gets the n-th element. Numbers come from prefix sums, and numbers meet evenly, however hot a key is."""
    ranked = lambda df, o: prefix_sums(df, ["key"], [F.col(o).asc()], {}, out="n")
    return ranked(waiters, "waiter").join(ranked(elements, "element"), ["key", "n_rows"]).select("key", "waiter", "element")


POPS = "key long, waiter long, element long, at long, outcome string"


def pop_expiring(waiters: DataFrame, elements: DataFrame, now: int) -> DataFrame:
    """Blocking pops whose waits can end: per waiter (key, waiter, at, deadline) its element and outcome.

    Elements (key, element, at) go to the waiter that came first among those still waiting, or are
    kept for the next one. A wait is over once the time is its deadline; a null deadline never
    comes. The outcome is popped, expired, or waiting at ``now``, with the time it came about
    (null while waiting). At equal times elements come before waiters, then least number first;
    rows after ``now`` do not count, nor do rows with a null key or time.

    Who gets what depends on all that came before, so a key is one sequence: its rows are sorted
    by the shuffle and read as they come, and only the queue is held.
    """
    same = waiters.select("key", "at", F.lit(1).alias("kind"), F.col("waiter").alias("id"), "deadline").unionByName(elements.select("key", "at", F.lit(0).alias("kind"), F.col("element").alias("id"), F.lit(None).cast("long").alias("deadline")))
    rows = same.filter(F.col("key").isNotNull() & (F.col("at") <= now)).select(F.col("key").cast("long").alias("key"), F.col("at").cast("long").alias("at"), "kind", F.col("id").cast("long").alias("id"), F.col("deadline").cast("long").alias("deadline"))
    schema = pa.schema([("key", pa.int64()), ("waiter", pa.int64()), ("element", pa.int64()), ("at", pa.int64()), ("outcome", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, kept, out = None, deque(), deque(), []

        def over(by: int, deadline: int | None) -> bool:
            return deadline is not None and deadline <= by

        def close() -> None:
            out.extend((key, w, None, d if over(now, d) else None, "expired" if over(now, d) else "waiting") for w, d in waiting)
            waiting.clear()
            kept.clear()

        def made() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for k, at, kind, number, deadline in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    close()
                    key = k
                if kind == 0:
                    while waiting and over(at, waiting[0][1]):
                        w, d = waiting.popleft()
                        out.append((key, w, None, d, "expired"))
                    if waiting:
                        out.append((key, waiting.popleft()[0], number, at, "popped"))
                    else:
                        kept.append(number)
                elif kept:
                    out.append((key, number, kept.popleft(), at, "popped"))
                else:
                    waiting.append((number, deadline))
            yield made()
        close()
        yield made()

    return rows.repartition("key").sortWithinPartitions("key", "at", "kind", "id").mapInArrow(run, POPS)
