"""What a query engine brings: its tables, its order of keys; and the stages of index DDL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import staged, written_rows
from ..sources.store import Store
from . import merge, scan

DDL = "seq long, index string, stage string"


class KeySchema(Protocol):
    """How an engine orders its keys: a column that compares as its keys do, and where a key lies between two others, from 0 to 1."""

    def order(self, key: Column) -> Column: ...
    def position(self, key: Column, low: Column, high: Column) -> Column: ...


class NumberKeys:
    """Numbers in their own order."""

    def order(self, key: Column) -> Column:
        return key

    def position(self, key: Column, low: Column, high: Column) -> Column:
        return F.when(low.isNull() | high.isNull(), F.lit(0.5)).otherwise((key - low) / (high - low))


@dataclass(frozen=True)
class Engine:
    """A name, the columns of the tables it needs from the start, the order of its keys, and what publishes its messages."""

    name: str
    prebuilt: dict[str, str] = field(default_factory=dict)
    keys: KeySchema = field(default_factory=NumberKeys)
    publish: Callable[[DataFrame], None] | None = None


ENGINES: dict[str, Engine] = {}


def register_engine(store: Store, engine: Engine) -> None:
    """Makes an engine known and makes those of its prebuilt tables that are not there; registering again changes nothing in the store."""
    ENGINES[engine.name] = engine
    there = set(store._live())
    for table, columns in engine.prebuilt.items():
        if table not in there:
            store.create_table(table, columns)


def _logged(store: Store, index: str, stage: str) -> None:
    path = f"{store.root}/ddl"
    n = ddl_log(store).count()
    written_rows(store.spark, [(n + 1, index, stage)], DDL, path)


def ddl_log(store: Store) -> DataFrame:
    """Stages (seq, index, stage) of index operations, in order."""
    path = store.spark._jvm.org.apache.hadoop.fs.Path(f"{store.root}/ddl")
    there = path.getFileSystem(store.spark._jsc.hadoopConfiguration()).exists(path)
    return store.spark.read.schema(DDL).parquet(f"{store.root}/ddl") if there else store.spark.createDataFrame([], DDL)


def add_index(store: Store, table: str, index: str, sk: Column, unique: bool = False) -> str:
    """Builds a secondary index while the table is in use: prepare, build from a scan, commit, clean; gives the last stage.

    Entries are rows of a table of their own, whose commit time is that of the row they stand for. Values
    that repeat in a unique index abort it, and its table goes. A stage that is logged is done, so an
    operation that was broken off is taken up by its last stage.
    """
    _logged(store, index, "Prepare")
    store.create_table(index, "sk long, base string", "unique" if unique else "secondary")
    base = store.rows(table)
    entries = staged(merge.build_index(base.withColumn("sk_", sk.cast("long")), F.col("sk_"), (1 << 63) - 1))
    if unique and not merge.violations(entries).isEmpty():
        store.drop_table(index)
        _logged(store, index, "Abort")
        return "Abort"
    store.put_all(index, entries.select("key", "commit_ts", F.lit("Normal").alias("status"), F.lit(None).cast("long").alias("ttl_ms"), "sk", F.lit(table).alias("base")))
    _logged(store, index, "Commit")
    _logged(store, index, "Clean")
    return "Clean"


def index_scan(store: Store, index: str, spec: scan.ScanSpec) -> DataFrame:
    """Rows (sk, key, value, stale) of the base table by a range of an index; an entry newer than its row is stale, as the row is still to come."""
    entries = store.rows(index).filter("status = 'Normal'").filter(scan.within(F.col("sk"), spec))
    table = entries.select("base").limit(1).collect()
    if not table:
        return store.spark.createDataFrame([], "sk long, key long, value long, stale boolean")
    base = store.rows(table[0].base).filter("status = 'Normal'").select("key", F.col("commit_ts").alias("base_ts"), "value")
    return entries.select("sk", "key", "commit_ts").join(base, "key").select("sk", "key", "value", (F.col("base_ts") < F.col("commit_ts")).alias("stale"))
