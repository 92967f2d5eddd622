"""Locks as relations: types, conflicts, waits, cycles, victims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, staged
from .ordered import ordered_fold
from .skew import hot_join, hot_keys

#: Which requested lock a held one keeps out.
CONFLICTS = [("WriteLock", "WriteLock"), ("WriteLock", "WriteIntent"), ("WriteLock", "ReadLock"), ("WriteIntent", "WriteLock"), ("WriteIntent", "WriteIntent"), ("ReadLock", "WriteLock")]
#: Locks from the strongest.
LOCK_ORDER = ("WriteLock", "WriteIntent", "ReadLock")
#: Parts that the holders of one entry are dealt to.
SPREAD = 4


def lock_type(op: Column, isolation: Column, protocol: Column, covering: Column) -> Column:
    snapshot, committed = isolation == "Snapshot", isolation == "ReadCommitted"
    strong = F.when(protocol == "Locking", "ReadLock").otherwise("ReadIntent")
    return (
        F.when(op == "Write", "WriteLock").when(op == "ReadForWrite", "WriteIntent")
        .when((op == "ReadSkIndex") & (snapshot | (committed & covering)), "NoLock").when(op == "ReadSkIndex", "ReadLock")
        .when(snapshot | committed, "NoLock").otherwise(strong)
    )


def conflicts(spark: SparkSession, holds: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (tx, entry, lock, protocol) against others' holds (tx, entry, lock), with the outcome."""
    matrix = F.broadcast(spark.createDataFrame(CONFLICTS, "held string, lock string"))  # six rows
    h = holds.select("entry", F.col("tx").alias("holder"), F.col("lock").alias("held")).withColumn("part", F.pmod(F.xxhash64("holder"), F.lit(SPREAD)).cast("int"))
    dealt = requests.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    met = dealt.join(h, ["entry", "part"]).filter("tx <> holder").join(matrix, ["held", "lock"])
    outcome = F.when((F.col("protocol") == "OCC") & (F.col("lock") != "ReadLock"), "Failed").otherwise("Blocked")
    return met.select("tx", "entry", "lock", "holder", "held", outcome.alias("outcome"))


def wait_graph(holds: DataFrame, waits: DataFrame) -> DataFrame:
    """Distinct edges from each waiting transaction to each holder of what it waits for.

    Holders of one entry are dealt to parts, and each waiter meets every part, so that an entry that
    many hold or wait for is spread over tasks.
    """
    parts = F.pmod(F.xxhash64("holder"), F.lit(SPREAD)).cast("int")
    h = holds.select("entry", F.col("tx").alias("holder")).withColumn("part", parts)
    w = waits.select("entry", F.col("tx").alias("waiter"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
    return w.join(h, ["entry", "part"]).filter("waiter <> holder").select("waiter", "holder").distinct()


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those that lead from a node nobody waits for, or to one that waits for nobody; round by round."""
    while True:
        waited, waiting = edges.select(F.col("holder").alias("waiter")).distinct(), edges.select(F.col("waiter").alias("holder")).distinct()
        less = staged(edges.join(waited, "waiter", "left_semi").join(waiting, "holder", "left_semi").select("waiter", "holder"))
        before, after = edges.count(), less.count()
        discard(edges)
        edges = less
        if after == before:
            return edges


def _reached(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Per node the least node that a path from ``source`` to ``target`` leads from, itself included: (node, least)."""
    nodes = edges.select(F.col("waiter").alias("node")).unionByName(edges.select(F.col("holder").alias("node"))).distinct()
    hot = hot_keys(edges, [source])
    least = staged(nodes.withColumn("least", F.col("node")))
    while True:
        given = least.select(F.col("node").alias(source), F.col("least").alias("from"))
        best = hot_join(edges, given, [source], hot=hot).groupBy(F.col(target).alias("node")).agg(F.min("from").alias("from"))
        after = staged(least.join(best, "node", "left").select("node", F.least("least", "from").alias("least"), (F.col("from") < F.col("least")).alias("moved")))
        discard(least)
        least = after
        if after.filter("moved").isEmpty():
            return least.select("node", "least")


def on_cycles(edges: DataFrame) -> DataFrame:
    """Transactions that wait, in the end, for themselves; with the component they wait in, named by its least member.

    Nodes that cannot lie on a cycle are trimmed. Then each node learns the least node it is reached
    from and the least it reaches; where they are the same, that is its component. What is left keeps
    the edges whose ends agree on both, and goes round again. Labels are a number for each node, so
    no pairs are listed.
    """
    edges = _trimmed(staged(edges.select("waiter", "holder").distinct()))
    found = []
    while not edges.isEmpty():
        ahead, back = _reached(edges, "waiter", "holder"), _reached(edges, "holder", "waiter")
        marks = staged(ahead.withColumnRenamed("least", "a").join(back.withColumnRenamed("least", "b"), "node"))
        found.append(marks.filter("a = b").select(F.col("node").alias("tx"), F.col("a").alias("component")))
        left = marks.filter("a <> b")
        ends = lambda n: left.select(F.col("node").alias(n), F.col("a").alias(n + "_a"), F.col("b").alias(n + "_b"))
        rest = edges.join(ends("waiter"), "waiter").join(ends("holder"), "holder").filter("waiter_a = holder_a AND waiter_b = holder_b").select("waiter", "holder")
        edges = _trimmed(staged(rest))
    if not found:
        return edges.select(F.col("waiter").alias("tx"), F.col("holder").alias("component"))
    every = reduce(DataFrame.unionByName, found)
    many = every.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component")
    return every.join(many, "component").select("tx", "component")


GRANTS = "entry long, seq long, tx long, lock string, outcome string, granted_seq long"


def _queue(key: tuple):
    """The locks of one entry: holders, and a queue that is served from its head."""
    held: dict[str, set] = {"WriteLock": set(), "WriteIntent": set(), "ReadLock": set()}
    queue: list[tuple[int, int, str]] = []

    def free(tx: int, lock: str) -> bool:
        kept_out = [h for h, wanted in CONFLICTS if wanted == lock]
        return not any(held[h] - {tx} for h in kept_out)

    def take(tx: int, lock: str) -> None:
        for other in held.values():
            other.discard(tx)
        held[lock].add(tx)

    def step(row: tuple | None):
        if row is None:
            for seq, tx, lock in queue:
                yield (key[0], seq, tx, lock, "Blocked", None)
            return
        _, seq, tx, lock, protocol = row
        if lock == "Release":
            for one in held.values():
                one.discard(tx)
            queue[:] = [q for q in queue if q[1] != tx]
            while queue and free(queue[0][1], queue[0][2]):
                since, who, what = queue.pop(0)
                take(who, what)
                yield (key[0], since, who, what, "Granted", seq)
            return
        if any(tx in held[h] for h in LOCK_ORDER[: LOCK_ORDER.index(lock) + 1]):
            yield (key[0], seq, tx, lock, "Granted", seq)  # it holds as much already
            return
        upgrade = lock == "WriteLock" and tx in held["WriteIntent"]
        writer_waits = any(q[2] != "ReadLock" for q in queue)
        if free(tx, lock) and (upgrade or not queue or (lock == "ReadLock" and not writer_waits)):
            take(tx, lock)
            yield (key[0], seq, tx, lock, "Granted", seq)
        elif protocol == "OCC" and lock != "ReadLock":
            yield (key[0], seq, tx, lock, "Failed", None)
        elif upgrade:
            queue.insert(0, (seq, tx, lock))
        else:
            queue.append((seq, tx, lock))

    return step


def queue_grants(requests: DataFrame) -> DataFrame:
    """Requests (entry, seq, tx, lock, protocol) in order, with what comes of each: Granted, and by which request, Failed, or Blocked to the end.

    A lock is granted if no other holder keeps it out and no one waits before it; a reader also waits
    behind a queued writer. The holder of a WriteIntent who asks for the WriteLock goes to the head of
    the queue. ``Release`` frees a transaction's lock and its place in the queue, and serves the queue
    from its head up to the first that must go on waiting. Writers under OCC fail instead of waiting.
    """
    rows = requests.select(F.col("entry").cast("long").alias("entry"), F.col("seq").cast("long").alias("seq"), F.col("tx").cast("long").alias("tx"), "lock", "protocol")
    return ordered_fold(rows, ["entry"], ["seq"], GRANTS, _queue)


def victims(cycles: DataFrame, holds: DataFrame) -> DataFrame:
    """Per component the transaction with the fewest held entries, of equals the smallest."""
    held = holds.groupBy("tx").agg(F.count(F.lit(1)).alias("n"))
    counted = cycles.join(held, "tx", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counted.groupBy("component").agg(F.min(F.struct("n", "tx")).alias("v")).select("component", F.col("v.tx").alias("victim"), F.col("v.n").alias("n_locks"))


def first_error(errors: DataFrame) -> DataFrame:
    """Per request the error reported: the first of infrastructure, else the first conflict."""
    return errors.groupBy("req").agg(F.min(F.struct(F.col("is_conflict").cast("int").alias("c"), "idx", "error")).alias("e")).select("req", F.col("e.error").alias("error"))
