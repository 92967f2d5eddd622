"""Joins and numbering that hold when one key has a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import staged

#: Keys that are joined apart, at most, and the rows from which a key is among them.
HOT_KEYS, HOT_ROWS = 10_000, 1_000
OWN = "__txf_"


def hot_keys(df: DataFrame, keys: Sequence[str], rows: int = HOT_ROWS, most: int = HOT_KEYS) -> DataFrame:
    """The ``most`` commonest keys of those with over ``rows`` rows; any other key has at most 1/most of all rows, or ``rows``."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(OWN + "n")).filter(F.col(OWN + "n") > rows)
    return staged(counted.orderBy(F.desc(OWN + "n"), *keys).limit(most).select(*keys))


def hot_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """``left`` joined (inner or left) with ``right``, which has one row for each key, so that no task gets all rows of a key.

    Rows of hot keys meet their one row of ``right`` by a broadcast of at most HOT_KEYS rows and
    stay where they are; the others are shuffled. ``left`` is read more than once: stage it. Null
    keys join nothing.
    """
    keys = list(keys)
    hot = hot_keys(left, keys) if hot is None else hot
    if hot.isEmpty():
        return left.join(right, keys, how)
    few = right.join(F.broadcast(hot), keys, "left_semi")
    there = left.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(few), keys, how)
    return there.unionByName(left.join(F.broadcast(hot), keys, "left_anti").join(right, keys, how))


def prefix_sums(df: DataFrame, group: Sequence[str], order: Sequence[Column], values: dict[str, str], out: str = "before", greatest: dict[str, str] | None = None) -> DataFrame:
    """Adds ``<out>_<name>``, the sum of each of ``values`` over earlier rows of the group, and ``<out>_rows``, their count.

    ``greatest`` names columns whose greatest value so far, the row's own included, is added the same way.
    A group may hold most of the rows, so no task ever holds a whole group: rows are range
    partitioned by (group, order) and each part sums on its own. Only the first group of a part can
    have rows in earlier parts, so one row for each part carries what goes before, and is broadcast.
    The dealt rows are staged, so part numbers hold even if a task runs twice. Rows that tie on the
    whole order are interchangeable.
    """
    part, greatest = OWN + "part", greatest or {}
    keys = [F.col(g) for g in group]
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = staged(df.repartitionByRange(parts, *[k.asc_nulls_last() for k in keys], *order).withColumn(part, F.spark_partition_id()))
    names = {**values, "rows": None}
    amount = {n: F.lit(1).cast("long") if c is None else F.col(c).cast("long") for n, c in names.items()}
    sums = [F.sum(amount[n]).alias(OWN + n) for n in names] + [F.max(c).alias(OWN + n) for n, c in greatest.items()]
    totals = dealt.groupBy(part, *group).agg(*sums)
    # of each part its first and last group: what an earlier part leaves for a later one lies in its last group
    place = F.struct(*[F.struct(k.isNull().alias("none"), k.alias("value")) for k in keys]) if group else F.lit(0)
    ends = totals.withColumn(OWN + "at", place).groupBy(part).agg(F.min(OWN + "at").alias(OWN + "head"), F.max(F.struct(OWN + "at", *[OWN + n for n in (*names, *greatest)])).alias("last"))
    flat = ends.select(part, OWN + "head", F.col("last")[OWN + "at"].alias(OWN + "g"), *[F.col("last")[OWN + n].alias(OWN + n) for n in (*names, *greatest)])
    own = [OWN + n for n in (*names, *greatest)]
    tails = ends.select(F.col("last")[OWN + "at"].alias(OWN + "head"), part, F.lit(True).alias(OWN + "tail"), *[F.col("last")[n].alias(n) for n in own])
    heads = ends.select(OWN + "head", part, F.lit(False).alias(OWN + "tail"), *[F.lit(None).cast("long" if n[len(OWN):] in names else totals.schema[n].dataType).alias(n) for n in own])
    earlier = Window.partitionBy(OWN + "head").orderBy(part).rangeBetween(Window.unboundedPreceding, -1)  # two rows for each part
    base = tails.unionByName(heads).select(part, OWN + "head", OWN + "tail", *[F.sum(OWN + n).over(earlier).alias(OWN + "base_" + n) for n in names], *[F.max(OWN + n).over(earlier).alias(OWN + "base_" + n) for n in greatest]).filter(~F.col(OWN + "tail")).drop(OWN + "tail")
    inner = Window.partitionBy(part, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(part, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.select("*", place.alias(OWN + "at"), *[F.coalesce(F.sum(amount[n]).over(inner), F.lit(0)).alias(OWN + "in_" + n) for n in names], *[F.max(c).over(upto).alias(OWN + "in_" + n) for n, c in greatest.items()])
    right = base.withColumnRenamed(part, part + "_r")
    joined = summed.join(F.broadcast(right), (F.col(part) == F.col(part + "_r")) & (F.col(OWN + "at") == F.col(OWN + "head")), "left")
    kept = [c for c in dealt.columns if c != part]
    return joined.select(*kept, *[(F.col(OWN + "in_" + n) + F.coalesce(OWN + "base_" + n, F.lit(0))).alias(f"{out}_{n}") for n in names], *[F.greatest(OWN + "in_" + n, OWN + "base_" + n).alias(f"{out}_{n}") for n in greatest])

