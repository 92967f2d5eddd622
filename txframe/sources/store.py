"""A key/value store of Parquet tables on any store that Hadoop reads.

A table is a list of written parts in a manifest. A write adds a part and then its manifest row, so
readers see a part whole or not at all; deletes are tombstone rows, deletes of a range are manifest
rows that hold for earlier parts. Reads take the newest version of each key. ``compact`` rewrites a
table into one part. One writer at a time; readers need no lock.

Rows are (key long, commit_ts long, status string, ttl_ms long) and the table's own columns.
"""

from __future__ import annotations

import uuid
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mvcc, scan
from .shared import removed, written_rows

OWN = "key long, commit_ts long, status string, ttl_ms long"
ENTRY = "seq long, table string, kind string, folder string, start long, stop long, columns string"
#: Partitions that the keys of a part are dealt to and sorted in.
PARTITIONS = 16
FOREVER = 9_223_372_036_854_775_807
KINDS = {"primary": "t", "secondary": "i", "unique": "u"}


class Connector(Protocol):
    """What a store offers the operators; ``Store`` is one over Parquet files."""

    def put_all(self, table: str, rows: DataFrame) -> None: ...
    def delete_range(self, table: str, start: int | None, stop: int | None) -> None: ...
    def rows(self, table: str, read_ts: int = FOREVER) -> DataFrame: ...
    def scan(self, table: str, spec: scan.ScanSpec) -> DataFrame: ...


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        if not self._there():
            spark.createDataFrame([], ENTRY).write.mode("overwrite").parquet(f"{self.root}/manifest")

    def _there(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _entries(self) -> list:
        """Manifest rows in order: one for each write since tables were compacted."""
        return sorted(self.spark.read.schema(ENTRY).parquet(f"{self.root}/manifest").collect(), key=lambda e: e.seq)

    def _note(self, table: str, kind: str, folder: str | None = None, start: int | None = None, stop: int | None = None, columns: str | None = None) -> None:
        seq = max((e.seq for e in self._entries()), default=0) + 1
        written_rows(self.spark, [(seq, table, kind, folder, start, stop, columns)], ENTRY, f"{self.root}/manifest")

    def _live(self) -> dict[str, list]:
        """Per existing table its manifest rows from its creation, or its last whole part, on."""
        out: dict[str, list] = {}
        for e in self._entries():
            if e.kind == "create":
                out[e.table] = [e]
            elif e.kind == "drop":
                out.pop(e.table, None)
            elif e.kind == "whole":
                out[e.table] = [out[e.table][0], e]
            else:
                out[e.table].append(e)
        return out

    def create_table(self, table: str, columns: str, kind: str = "primary") -> str:
        """Makes a table with its own ``columns``; gives the name its files go by. An existing table is an error."""
        if table in self._live():
            raise ValueError(f"table {table} exists")
        name = f"{KINDS[kind]}{uuid.uuid4().hex}"
        self._note(table, "create", name, columns=columns)
        return name

    def drop_table(self, table: str) -> None:
        name = self._live()[table][0].folder
        self._note(table, "drop")
        removed(self.spark, f"{self.root}/{name}")

    def tables(self) -> DataFrame:
        """database, table, kind and columns of every table; a database is what stands before the first dot."""
        rows = [(t.split(".")[0] if "." in t else "", t, {v: k for k, v in KINDS.items()}[e[0].folder[0]], e[0].columns) for t, e in self._live().items()]
        return self.spark.createDataFrame(rows, "database string, table string, kind string, columns string")

    def databases(self) -> DataFrame:
        return self.tables().select("database").distinct()

    def _write(self, table: str, rows: DataFrame, kind: str) -> None:
        head = self._live()[table][0]
        names = [c.strip().split()[0] for c in f"{OWN}, {head.columns}".split(",")]
        folder = f"{head.folder}/{uuid.uuid4().hex}"
        # sorted runs of keys, so that a range reaches few files and row groups
        rows.select(*names).repartition(PARTITIONS, "key").sortWithinPartitions("key").write.parquet(f"{self.root}/{folder}")
        self._note(table, kind, folder)

    def put_all(self, table: str, rows: DataFrame) -> None:
        """Writes versions; every column of the table must be there."""
        self._write(table, rows, "part")

    def batch_write(self, table: str, ops: DataFrame, commit_ts: int) -> None:
        """Puts and deletes (key, op Put or Delete, ttl_ms, own columns) at ``commit_ts``."""
        status = F.when(F.col("op") == "Delete", "Deleted").otherwise("Normal")
        self.put_all(table, ops.withColumn("commit_ts", F.lit(commit_ts).cast("long")).withColumn("status", status))

    def delete_range(self, table: str, start: int | None, stop: int | None) -> None:
        """Removes keys from ``start`` up to but without ``stop``, of what is written so far; a missing bound is open."""
        self._live()[table]
        self._note(table, "range", start=start, stop=stop)

    def delete_out_of_range(self, table: str, start: int, stop: int) -> None:
        """Keeps only keys from ``start`` up to but without ``stop``."""
        self.delete_range(table, None, start)
        self.delete_range(table, stop, None)

    def versions(self, table: str) -> DataFrame:
        """All versions that are written and not deleted by range."""
        entries, spark = self._live()[table], self.spark
        schema = f"{OWN}, {entries[0].columns}"
        ranges = [e for e in entries if e.kind == "range"]
        groups: dict[int, list[str]] = {}  # parts by how many of the ranges are later
        for e in entries:
            if e.kind in ("part", "whole"):
                groups.setdefault(sum(r.seq > e.seq for r in ranges), []).append(f"{self.root}/{e.folder}")
        made = []
        for later, folders in groups.items():
            df = spark.read.schema(schema).parquet(*folders)
            for r in ranges[len(ranges) - later :]:
                df = df.filter(~scan.within(F.col("key"), scan.ScanSpec(r.start, True, r.stop, False)))
            made.append(df)
        return reduce(DataFrame.unionByName, made) if made else spark.createDataFrame([], schema)

    def rows(self, table: str, read_ts: int = FOREVER) -> DataFrame:
        """Of each key the newest version not after ``read_ts``, tombstones among them."""
        return mvcc.visible_as_of(self.versions(table), read_ts, keep_deleted=True)

    def scan(self, table: str, spec: scan.ScanSpec, read_ts: int = FOREVER) -> DataFrame:
        """A range scan; bounds reach the files before versions are compared."""
        versions = self.versions(table).filter(scan.within(F.col("key"), spec))
        return scan.scan(mvcc.visible_as_of(versions, read_ts, keep_deleted=True), spec)

    def pages(self, table: str, spec: scan.ScanSpec, size: int):
        """Pages of ``size`` rows of a forward scan, each from after the last key of the one before."""
        at = spec
        while True:
            page = self.scan(table, scan.ScanSpec(**{**at.__dict__, "limit": size}))
            last = page.agg(F.max("key")).first()[0]
            if last is None:
                return
            yield page
            at = scan.ScanSpec(**{**at.__dict__, "start": last, "start_inclusive": False})

    def read(self, table: str, keys: DataFrame, read_ts: int = FOREVER) -> DataFrame:
        """Every asked key; a missing one is Deleted at version 1."""
        return scan.batch_read(self.rows(table, read_ts), keys)

    def count(self, table: str) -> int:
        return self.rows(table).filter("status = 'Normal'").count()

    def compact(self, table: str, now_ms: int | None = None) -> None:
        """Rewrites a table as one part without old versions, tombstones, and rows whose lifetime ended before ``now_ms``."""
        old = [e.folder for e in self._live()[table] if e.kind in ("part", "whole")]
        kept = self.rows(table).filter("status = 'Normal'")
        self._write(table, kept if now_ms is None else kept.filter(scan.alive(F.col("ttl_ms"), now_ms)), "whole")
        for folder in old:
            removed(self.spark, f"{self.root}/{folder}")

    def keeps_versions(self, table: str) -> bool:
        """Whether every delete of the table left a version: none was by range, and it was never compacted."""
        return all(e.kind in ("create", "part") for e in self._live()[table])

    def reload(self, table: str | None = None) -> None:
        """Drops what Spark has cached of a table's files, or of all, so that the next read sees the store as it is."""
        self.spark.catalog.refreshByPath(self.root if table is None else f"{self.root}/{self._live()[table][0].folder}")

    def truncate(self, table: str) -> None:
        self.delete_range(table, None, None)
