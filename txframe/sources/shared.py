"""Tables written to the folder that all machines share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all machines of a cluster see.

    Where the setting is missing a temporary folder takes its place, on one machine only: with any
    other master that would lose data, and is an error. The folder goes when the session ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", master := spark.sparkContext.master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="txframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    target, fs = _located(spark, path)
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    return path if "://" in path or path.startswith("file:") else fs.makeQualified(target).toString()


def _located(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder, if it is there."""
    target, fs = _located(spark, path)
    fs.delete(target, True)


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: lost executors lose none of it."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    df.write.parquet(folder + "/table")
    out = spark.read.schema(df.schema).parquet(folder + "/table")
    out.txf_folder = folder
    return out


def written_rows(spark: SparkSession, rows: list[tuple], schema: str, path: str) -> None:
    """Appends a few known rows to the Parquet files at ``path``, as one file, which is there whole or not at all. No Python worker is started."""
    columns = [c.strip().split() for c in schema.split(",")]
    made = F.array(*[F.struct(*[F.lit(x).cast(kind).alias(name) for x, (name, kind) in zip(r, columns)]) for r in rows])
    spark.range(0, 1, 1, 1).select(F.inline(made)).write.mode("append").parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes staged tables that nothing reads any more."""
    for t in tables:
        removed(t.sparkSession, t.txf_folder)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, size: int) -> Iterator[None]:
    """Batches of at most so many rows, and about so many bytes, for Python workers in jobs that run inside."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
