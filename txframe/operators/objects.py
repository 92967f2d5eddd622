"""Object commands: a registry, the rule of which commands run, and execution in order.

An object is (key, value, ttl_ms); a missing one has no row. Values are numbers. ``register`` adds
commands of one's own to the few that are built in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import ordered_fold


@dataclass(frozen=True)
class Command:
    """``run(value, arg)`` gives (result, value after); the flags say on what it runs and what it does to the object."""

    run: Callable[[int | None, int | None], tuple[int | None, int | None]]
    read_only: bool = False
    overwrite: bool = False
    delete: bool = False
    on_existing: bool = True
    on_missing: bool = True
    sets_ttl: bool = False


REGISTRY: dict[str, Command] = {
    "get": Command(lambda v, a: (v, v), read_only=True),
    "set": Command(lambda v, a: (a, a), overwrite=True),
    "setnx": Command(lambda v, a: (a, a), overwrite=True, on_existing=False),
    "incr": Command(lambda v, a: ((v or 0) + a, (v or 0) + a)),
    "raise": Command(lambda v, a: (max(v, a), max(v, a)), on_missing=False),
    "delete": Command(lambda v, a: (v, None), delete=True, on_missing=False),
    "pop": Command(lambda v, a: (v, None), delete=True, on_missing=False),
    "expire": Command(lambda v, a: (v, v), on_missing=False, sets_ttl=True),
}


def register(name: str, command: Command) -> None:
    REGISTRY[name] = command


def proceeds(exists: bool, expired: bool, on_existing: bool, on_missing: bool, ttl_reset: bool) -> bool:
    """Whether a writing command runs on an object."""
    return (exists and on_existing) or (not exists and on_missing) or expired or ttl_reset


RESULTS = "key long, seq long, cmd string, status string, ran boolean, result long, value long, ttl_ms long"


def _folded(commands: dict[str, Command]):
    def fold(key: tuple) -> Callable[[tuple | None], Iterator[tuple]]:
        value = ttl = None

        def step(row: tuple | None) -> Iterator[tuple]:
            nonlocal value, ttl
            if row is None:
                return
            _, kind, seq, cmd, arg, now, there, lives = row
            if kind == 0:  # the object as it is before any command
                value, ttl = there, lives
                return
            c, exists = commands[cmd], value is not None
            expired = exists and ttl is not None and ttl < now
            if c.read_only:
                runs = exists and not expired and c.on_existing
                status = "Deleted" if not exists or expired else "Normal"
                yield (key[0], seq, cmd, status, runs, c.run(value, arg)[0] if runs else None, value, ttl)
                return
            reset = exists and not expired and ttl is not None and c.sets_ttl and not c.overwrite
            if not proceeds(exists and not expired, expired, c.on_existing, c.on_missing, reset):
                yield (key[0], seq, cmd, "Normal" if exists and not expired else "Deleted", False, None, value, ttl)
                return
            if expired:
                value = ttl = None
            if value is None and not c.on_missing:  # what expired is gone; there is nothing to run on
                yield (key[0], seq, cmd, "Deleted", False, None, None, None)
                return
            result, value = c.run(value, arg)
            if c.sets_ttl:
                ttl = now + arg
            elif c.overwrite or value is None:
                ttl = None
            yield (key[0], seq, cmd, "Deleted" if value is None else "Normal", True, result, value, ttl)

        return step

    return fold


def execute(objects: DataFrame, commands: DataFrame) -> DataFrame:
    """Each command (key, seq, cmd, arg, now_ms) with the object's status after it, whether it ran, its result, and the value and lifetime it left.

    A read-only command on a missing or expired object finds it Deleted. A writing one runs if the
    object exists or is missing as its flags ask, if it has expired, or if it renews a lifetime; else it
    changes nothing. An expired object counts as gone when its next writing command runs.
    """
    none = F.lit(None).cast("long")
    first = objects.select(F.col("key").cast("long").alias("key"), F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("seq"), F.lit("").alias("cmd"), none.alias("arg"), none.alias("now_ms"), F.col("value").cast("long").alias("value"), F.col("ttl_ms").cast("long").alias("ttl_ms"))
    then = commands.select(F.col("key").cast("long").alias("key"), F.lit(1).alias("kind"), F.col("seq").cast("long").alias("seq"), "cmd", F.col("arg").cast("long").alias("arg"), F.col("now_ms").cast("long").alias("now_ms"), none.alias("value"), none.alias("ttl_ms"))
    return ordered_fold(first.unionByName(then), ["key"], ["kind", "seq"], RESULTS, _folded(dict(REGISTRY)))


def objects_after(objects: DataFrame, results: DataFrame) -> DataFrame:
    """The objects that are left once the commands of ``results`` have run."""
    last = results.groupBy("key").agg(F.max(F.struct("seq", "value", "ttl_ms")).alias("l")).select("key", F.col("l.value").alias("value"), F.col("l.ttl_ms").alias("ttl_ms"))
    return objects.join(last, "key", "left_anti").select("key", "value", "ttl_ms").unionByName(last.filter("value IS NOT NULL"))


def execute_steps(objects: DataFrame, steps: Sequence[Callable[[DataFrame | None], DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """A command on several objects in steps: each step makes its commands from the results of the one before, and sees what that left.

    Gives the last step's results and the objects afterwards.
    """
    results = None
    for step in steps:
        results = execute(objects, step(results))
        objects = objects_after(objects, results)
    return results, objects
