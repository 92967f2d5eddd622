"""Table statistics: samples, equal-depth steps, selectivity, distinct prefixes."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import Store
from .ordered import ordered_fold

STEPS = 128
#: Fixed value: the multiplier of a multiplicative hash, 2**32 divided by the golden ratio.
MIX = 2_654_435_761


def hashed_sample(df: DataFrame, key: str = "key", capacity: int = 1024) -> DataFrame:
    """At most ``capacity`` distinct numbers, those of least hash: a sample that reruns and merges alike.

    Every task keeps its own least ones and only those meet. The hash is a product modulo 2**32, which
    any engine can state.
    """
    return df.select(key).distinct().orderBy(mixed(F.col(key)), key).limit(capacity)


def mixed(key: Column) -> Column:
    return F.pmod(key.cast("long") * MIX, F.lit(1 << 32))


def merged_samples(samples: DataFrame, key: str = "key", capacity: int = 1024) -> DataFrame:
    """The sample of all rows from samples of parts of them: equal to one drawn from all at once."""
    return hashed_sample(samples, key, capacity)


def split_samples(samples: DataFrame, owners: DataFrame, key: str = "key") -> DataFrame:
    """Sampled keys and record counts (owner, n_sampled) by the new owner of their range (start, stop, owner), after a range was split."""
    met = samples.join(F.broadcast(owners), (F.col(key) >= F.col("start")) & (F.col("stop").isNull() | (F.col(key) < F.col("stop"))))  # ranges of one split
    return met.groupBy("owner").agg(F.count(F.lit(1)).alias("n_sampled"), F.min(key).alias("least"), F.max(key).alias("most"))


def random_pairing(ops: DataFrame, capacity: int = 1024, lanes: int = 8, seed: int = 0) -> DataFrame:
    """Per table a uniform sample (tbl, key) of the keys that are live after ``ops`` (tbl, seq, key, op Insert or Delete), by random pairing.

    An insert makes good an earlier delete: it takes the place that one left in the sample, or, as often
    as deletes hit keys outside it, none. A table is dealt by key to ``lanes``, each with its share of the
    capacity, so that only a lane is one task's work and only its sample is held. Inserts are of keys
    that are not live and deletes of keys that are. Draws are seeded: reruns agree.
    """
    room = max(1, capacity // lanes)

    def of(group: tuple):
        draw = random.Random(f"{seed}/{group}")
        held: list[int] = []
        place: dict[int, int] = {}
        live = inside = outside = 0  # live keys, and deletes not made good that hit the sample, or did not

        def put(x: int, at: int) -> None:
            if at < len(held):
                del place[held[at]]
                held[at] = x
            else:
                held.append(x)
            place[x] = at

        def step(row: tuple | None):
            nonlocal live, inside, outside
            if row is None:
                yield from ((group[0], x) for x in sorted(held))
                return
            _, _, _, x, op = row
            if op == "Insert":
                live += 1
                if inside + outside:
                    if draw.randrange(inside + outside) < inside:
                        inside -= 1
                        put(x, len(held))
                    else:
                        outside -= 1
                elif len(held) < room:
                    put(x, len(held))
                elif (at := draw.randrange(live)) < room:
                    put(x, at)
                return
            live -= 1
            at = place.pop(x, None)
            if at is None:
                outside += 1
                return
            inside += 1
            last = held.pop()
            if last != x:
                held[at] = last
                place[last] = at

        return step

    lane = F.pmod(F.xxhash64("key"), F.lit(lanes))
    rows = ops.select(F.col("tbl").cast("long").alias("tbl"), lane.alias("lane"), F.col("seq").cast("long").alias("seq"), F.col("key").cast("long").alias("key"), "op")
    return ordered_fold(rows, ["tbl", "lane"], ["seq"], "tbl long, key long", of)


def save(store: Store, table: str, steps: DataFrame, records: int, version: int) -> None:
    """Keeps a histogram (step, key) and the number of records of a table in the store, as of ``version``."""
    name = f"stats.{table}"
    if store.tables().filter(F.col("table") == name).isEmpty():
        store.create_table(name, "at long, records long")
    rows = steps.select(F.col("step").alias("key"), F.lit(version).cast("long").alias("commit_ts"), F.lit("Normal").alias("status"), F.lit(None).cast("long").alias("ttl_ms"), F.col("key").alias("at"), F.lit(records).cast("long").alias("records"))
    store.put_all(name, rows)


def fetch(store: Store, table: str) -> DataFrame:
    """The histogram (step, key, records) of a table that was kept last; steps that only an earlier one had are not in it."""
    rows = store.rows(f"stats.{table}")
    newest = rows.agg(F.max("commit_ts").alias("newest"))
    return rows.join(F.broadcast(newest), F.col("commit_ts") == F.col("newest")).select(F.col("key").alias("step"), F.col("at").alias("key"), "records")  # one row


def fallback(records: Column, has_histogram: Column, estimate: Column) -> Column:
    """Without a histogram a condition is taken to keep a hundredth of the records."""
    return F.when(has_histogram, estimate).otherwise(F.floor(records / 100)).cast("long")


def equal_depth(sample: DataFrame, key: str = "key", steps: int = STEPS) -> DataFrame:
    """Of a bounded sample every n/steps-th key in order, the first ``steps`` of them."""
    w = Window.orderBy(key)
    ranked = sample.select(key, F.row_number().over(w).alias("rn"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    step = F.when(F.col("n") > steps, F.expr(f"n DIV {steps}")).otherwise(F.lit(1))
    return ranked.filter((F.col("rn") - 1) % step == 0).select((F.row_number().over(w) - 1).cast("long").alias("step"), F.col(key)).filter(F.col("step") < steps)


def _below(x: int, key: str) -> Column:
    """Share of keys below ``x``: steps below it, and how far it lies into the step it falls in; half where that step is open."""
    n = F.count(F.lit(1))
    before, after = F.max(F.when(F.col(key) < x, F.col(key))), F.min(F.when(F.col(key) >= x, F.col(key)))
    into = F.when(before.isNull() | after.isNull(), F.lit(0.5)).otherwise((F.lit(x) - before) / (after - before))
    return (F.sum((F.col(key) < x).cast("long")) + into) / (n + 1)


def selectivity(steps: DataFrame, low: int, high: int, key: str = "key") -> DataFrame:
    """Share of keys in [low, high) by the steps of a histogram."""
    if high <= low:
        return steps.agg(F.lit(0.0).alias("selectivity"))
    return steps.agg((_below(high, key) - _below(low, key)).alias("selectivity"))


def records_per_prefix(df: DataFrame, prefix: list[str], key: str = "key", capacity: int = 1024) -> DataFrame:
    """Per prefix length: distinct prefixes in a sample of ``capacity`` rows, scaled to all rows, and records for each, rounded down.

    Scaling keeps both ends: all equal stays one, all different becomes the number of rows.
    """
    picked = df.select(key, *prefix).orderBy(mixed(F.col(key)), key).limit(capacity)
    exprs = [F.count_distinct(*prefix[: i + 1]).alias(f"d{i + 1}") for i in range(len(prefix))]
    counted = picked.agg(F.count(F.lit(1)).alias("s"), *exprs).join(F.broadcast(df.agg(F.count(F.lit(1)).alias("t"))))  # one row each
    rows = F.explode(F.array(*[F.struct(F.lit(i + 1).cast("long").alias("prefix_len"), F.col(f"d{i + 1}").alias("ndv")) for i in range(len(prefix))]))
    scaled = F.when(F.col("s") > 1, F.floor((F.col("t") - 1) * (F.col("ndv") - 1) / (F.col("s") - 1)) + 1).otherwise(F.lit(1))
    return counted.select("s", "t", rows.alias("r")).select("t", "s", "r.prefix_len", "r.ndv").select("prefix_len", "ndv", scaled.cast("long").alias("scaled_ndv"), F.floor(F.col("t") / scaled).cast("long").alias("rec_per_key"))


def estimate(visited: DataFrame, slices: Column, visited_slices: Column) -> DataFrame:
    """Records of a table from those of the slices visited, rounded up."""
    return visited.select(F.ceil(slices * F.col("keys") / visited_slices).cast("long").alias("records"))


def record_size_ema(sizes: DataFrame) -> DataFrame:
    """Per table, sizes (tbl, seq, size) folded in order: a tenth of each new one, rounded down. Only the average so far is held."""
    def of(key: tuple):
        average = None

        def step(row: tuple | None):
            nonlocal average
            if row is None:
                yield (key[0], average)
            else:
                average = row[2] if average is None else (row[2] + average * 9) // 10

        return step

    rows = sizes.select(F.col("tbl").cast("long").alias("tbl"), F.col("seq").cast("long").alias("seq"), F.col("size").cast("long").alias("size"))
    return ordered_fold(rows, ["tbl"], ["seq"], "tbl long, avg_size long", of)


def split_keys(sample: DataFrame, parts: int, key: str = "key") -> DataFrame:
    """Keys that split a bounded sample into ``parts`` + 1 nearly equal runs."""
    ranked = sample.select(key, (F.row_number().over(Window.orderBy(key)) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    step = F.greatest(F.lit(1), F.expr(f"n DIV {parts + 1}"))
    return ranked.filter((F.col("i") > 0) & (F.col("i") % step == 0) & (F.col("i") <= step * parts)).select((F.col("i") / step - 1).cast("long").alias("part"), key)
