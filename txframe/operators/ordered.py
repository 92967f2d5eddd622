"""Folding rows in order, key by key, where each step depends on all before it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Result rows that a task holds before it hands them on.
HELD = 4096


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], schema: str | StructType, fold: Callable[[tuple], Callable[[tuple | None], Iterator[tuple]]]) -> DataFrame:
    """Rows of each key in ``order`` through ``fold(key)``, a function called with each row and at last with None; it yields result rows.

    What comes of a row depends on all earlier ones of its key, so a key is one sequence in one task.
    The shuffle sorts, rows are read as they come, and only what ``fold`` keeps is held.
    """
    shape = schema if isinstance(schema, StructType) else df.sparkSession.createDataFrame([], schema).schema
    arrow, at = to_arrow_schema(shape), [df.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step, out = None, None, []

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)
            out.clear()
            return batch

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if step is None or key != tuple(row[i] for i in at):
                    if step is not None:
                        out.extend(step(None))
                    key = tuple(row[i] for i in at)
                    step = fold(key)
                out.extend(step(row))
                if len(out) >= HELD:
                    yield made()
        if step is not None:
            out.extend(step(None))
        yield made()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, shape)
