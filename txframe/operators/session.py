"""A transaction over one store table: buffered writes, reads that see them, validation, commit and abort."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import staged
from ..sources.store import FOREVER, Store
from . import scan, txn

OPS = "key long, seq long, op string, value long"


class Transaction:
    """Begins at ``read_ts`` (the newest versions, if none is given). Tables have one column of their own, ``value``.

    Under Snapshot and RepeatableRead, and for reads for write under any isolation, the versions that
    were read must still be the newest at commit.
    """

    def __init__(self, store: Store, table: str, read_ts: int = FOREVER, isolation: str = "RepeatableRead"):
        self.store, self.table, self.read_ts, self.isolation = store, table, read_ts, isolation
        self.spark, self.state = store.spark, "open"
        self._ops: list[DataFrame] = []
        self._reads: list[DataFrame] = []

    def _open(self) -> None:
        if self.state != "open":
            raise ValueError(f"the transaction is {self.state}")

    def upsert(self, ops: DataFrame) -> None:
        """Buffers operations (key, op, value); later calls come after earlier ones."""
        self._open()
        self._ops.append(ops.select("key", F.lit(len(self._ops)).cast("long").alias("seq"), "op", "value"))

    def revert(self, keys: DataFrame) -> None:
        """Forgets what is buffered for ``keys``."""
        self._open()
        self._ops = [o.join(keys.select("key"), "key", "left_anti").select("key", "seq", "op", "value") for o in self._ops]

    def writes(self) -> DataFrame:
        """One final operation for each key that is written."""
        every = reduce(DataFrame.unionByName, self._ops) if self._ops else self.spark.createDataFrame([], OPS)
        return txn.fold(every.withColumnRenamed("value", "payload")).select("key", "op", F.col("payload").alias("value"))

    def read(self, keys: DataFrame, for_write: bool = False) -> DataFrame:
        """Each asked key: own writes first, then the version as of the transaction; notes the versions read."""
        self._open()
        base = self.store.rows(self.table, self.read_ts)
        found = staged(txn.read_own(base.filter("status = 'Normal'").select("key", "value", "commit_ts"), self.writes(), keys, "value"))
        if for_write or self.isolation in ("Snapshot", "RepeatableRead", "Serializable"):
            self._reads.append(found.filter("version_ts > 0").select("key", "version_ts"))
        return found

    def scan(self, spec: scan.ScanSpec) -> DataFrame:
        """A range scan under the transaction's own writes, in order; own deletes are there, as Deleted."""
        self._open()
        base = self.store.rows(self.table, self.read_ts).filter("status = 'Normal'").filter(scan.within(F.col("key"), spec)).select("key", "value")
        seen = txn.overlay(base, self.writes().filter(scan.within(F.col("key"), spec)), "value", keep_deleted=True)
        ordered = seen.orderBy(F.col("key").desc() if spec.backward else F.col("key").asc())
        return ordered if spec.limit is None else ordered.limit(spec.limit)

    def commit(self, now_ts: int) -> tuple[str, int | None]:
        """(outcome, commit time): OK, VERSION_MISMATCH, or the operation that cannot be (Illegal, DuplicateKey).

        The commit time is after ``now_ts`` and after every version read and replaced.
        """
        self._open()
        writes = staged(self.writes())
        wrong = writes.filter("op IN ('Illegal', 'DuplicateKey')").agg(F.min("op")).first()[0]
        current = self.store.rows(self.table)
        if wrong is None and self._reads:
            read = staged(reduce(DataFrame.unionByName, self._reads).groupBy("key").agg(F.min("version_ts").alias("lo"), F.max("version_ts").alias("hi")))
            now = read.join(current.select("key", F.when(F.col("status") == "Normal", F.col("commit_ts")).otherwise(F.lit(1)).alias("now")), "key", "left").withColumn("now", F.coalesce("now", F.lit(1).cast("long")))
            if not now.filter("lo <> now OR hi <> now").isEmpty():
                wrong = "VERSION_MISMATCH"
            now_ts = max(now_ts, read.agg(F.max("hi")).first()[0] or 0)
        if wrong is not None:
            self.abort()
            return wrong, None
        replaced = current.join(writes.select("key"), "key", "left_semi").agg(F.max("commit_ts")).first()[0] or 0
        commit_ts = max(now_ts, replaced) + 1
        self.store.batch_write(self.table, writes.withColumn("ttl_ms", F.lit(None).cast("long")), commit_ts)
        self.state = "committed"
        return "OK", commit_ts

    def abort(self) -> None:
        self._ops, self._reads, self.state = [], [], "aborted"
