"""Backups of a store with their status, and the copy that a standby starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import removed, written_rows
from ..sources.store import Store

NOTE = "seq long, backup string, status string, ckpt_ts long, table string, columns string, n_rows long, max_commit_ts long"


class Backups:
    """Backups under one folder: a copy of every table as of a checkpoint, and a log of what was done.

    A backup counts once its last note says Finished; one that was broken off stays Running, and can
    be terminated. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _notes(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/notes")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(NOTE).parquet(f"{self.root}/notes") if there else self.spark.createDataFrame([], NOTE)

    def _note(self, *notes: tuple) -> None:
        """Appends notes (backup, status, and what more is known), which count together or not at all."""
        seq = self._notes().agg(F.max("seq")).first()[0] or 0
        rows = [(seq + 1 + i, *n, *[None] * (7 - len(n))) for i, n in enumerate(notes)]
        written_rows(self.spark, rows, NOTE, f"{self.root}/notes")

    def status(self) -> DataFrame:
        """backup, status (Running, Finished, Terminated) and ckpt_ts of every backup."""
        last = self._notes().filter("table IS NULL").groupBy("backup").agg(F.max(F.struct("seq", "status", "ckpt_ts")).alias("n"))
        return last.select("backup", "n.status", "n.ckpt_ts")

    def _state(self, backup: str) -> str | None:
        row = self.status().filter(F.col("backup") == backup).first()
        return row.status if row else None

    def create(self, store: Store, backup: str, ckpt_ts: int) -> None:
        """Copies every table of ``store`` as of ``ckpt_ts``; a name is used once."""
        if self._state(backup) is not None:
            raise ValueError(f"backup {backup} exists")
        self._note((backup, "Running", ckpt_ts))
        copied = []
        for t in store.tables().select("table", "columns").collect():  # names of tables
            folder = f"{self.root}/{backup}/{t.table}"
            store.rows(t.table, ckpt_ts).filter("status = 'Normal'").write.parquet(folder)
            held = self.spark.read.parquet(folder).agg(F.count(F.lit(1)).alias("n"), F.max("commit_ts").alias("m")).first()
            copied.append((backup, "Copied", ckpt_ts, t.table, t.columns, held.n, held.m))
        self._note(*copied, (backup, "Finished", ckpt_ts))

    def terminate(self, backup: str) -> None:
        """Ends a backup in any state and removes its files; an unknown name is an error."""
        if self._state(backup) is None:
            raise ValueError(f"no backup {backup}")
        self._note((backup, "Terminated"))
        removed(self.spark, f"{self.root}/{backup}")

    def tables(self, backup: str) -> DataFrame:
        """table, columns, n_rows and max_commit_ts of what a backup holds."""
        return self._notes().filter((F.col("backup") == backup) & (F.col("status") == "Copied")).select("table", "columns", "n_rows", "max_commit_ts")

    def restore(self, backup: str, store: Store) -> None:
        """Makes the tables of a finished backup in ``store``, which must not have them."""
        if self._state(backup) != "Finished":
            raise ValueError(f"backup {backup} is not finished")
        for t in self.tables(backup).collect():
            store.create_table(t.table, t.columns)
            store.put_all(t.table, self.spark.read.parquet(f"{self.root}/{backup}/{t.table}"))


def sync_standby(store: Store, standby: Store, table: str, ckpt_ts: int) -> str:
    """Brings a standby's table to what ``store`` holds as of ``ckpt_ts``; says what was sent: whole or changes.

    Changes are the newest versions after the standby's own newest one, deletes among them. A table the
    standby does not have, and one with keys deleted by range or compacted, which leave no versions
    behind, is sent whole.
    """
    columns = {t.table: t.columns for t in store.tables().collect()}
    there = table in {t.table for t in standby.tables().collect()}
    rows = store.rows(table, ckpt_ts)
    if there and store.keeps_versions(table):
        since = standby.rows(table).agg(F.max("commit_ts")).first()[0] or 0
        standby.put_all(table, rows.filter(F.col("commit_ts") > since))
        return "changes"
    if there:
        standby.truncate(table)
    else:
        standby.create_table(table, columns[table])
    standby.put_all(table, rows)
    return "whole"
